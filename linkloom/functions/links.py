"""Links of a page: extract, strip, resolve, normalise, filter, dedupe, cap, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ExtractConfig
from .urls import netloc, resolve, strip

#: What holds no tags: comments, and the elements whose content is plain text.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)"
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
_NAME = r"""[^\s"'<>/=]+"""
#: An anchor's first href; the repeated group is possessive, so that many attributes need no stack.
ANCHOR = rf"(?i)<a(?=[\s/])(?:\s+|/|(?!href\s*=){_NAME}(?:\s*=\s*{_VALUE})?)*+href\s*=\s*({_VALUE})"
#: The character references that attribute values use most; & comes last, so that none is read twice.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def raw_links(html: Column) -> Column:
    """Values of the first href attributes of anchors, in document order.

    Values may stand in double or single quotes or in none, with spaces round the
    equals sign; anchors in comments, scripts and styles are none. Of character
    references those in ``ENTITIES`` are resolved; the parser "html" knows all.
    """
    shown = F.when(html.rlike(r"(?i)<!--|<script|<style"), F.regexp_replace(html, HIDDEN, "")).otherwise(html)

    def value(x: Column) -> Column:
        quoted = F.substring(x, 1, 1).isin('"', "'")
        plain = F.when(quoted, F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)
        resolved = plain
        for name, sign in ENTITIES:
            resolved = F.replace(resolved, F.lit(name), F.lit(sign))
        return F.when(F.contains(plain, F.lit("&")), resolved).otherwise(plain)

    return F.transform(F.regexp_extract_all(shown, F.lit(ANCHOR)), value)


def clean_links(url: Column, hrefs: Column, config: ExtractConfig = ExtractConfig()) -> Column:
    """The distinct link targets in order of their first occurrence, at most ``max_links``.

    Empty references and pure fragments are skipped, other schemes than http(s)
    dropped; the domain filter looks for a part of the host, or all of it if
    ``exact_host``.
    """
    stripped = F.filter(F.transform(hrefs, strip), lambda x: (x != "") & ~x.startswith("#"))
    targets = F.filter(F.transform(stripped, lambda x: resolve(url, x)), lambda x: x.rlike(r"^(?i:https?)://"))
    if config.domain is not None:
        here = (lambda x: netloc(x) == config.domain) if config.exact_host else (lambda x: netloc(x).contains(config.domain))
        targets = F.filter(targets, here)
    targets = F.array_distinct(targets)
    return targets if config.max_links is None else F.slice(targets, 1, config.max_links)


def _parsed(html: str | None) -> list[str]:
    from html.parser import HTMLParser

    found: list[str] = []

    class Anchors(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "a":
                found.extend(v for k, v in attrs[:] if k == "href" and v is not None)

    Anchors(convert_charrefs=True).feed(html or "")
    return found


def with_links(pages: DataFrame, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """``pages`` (url, html, ...) with the column ``links``; null html has none.

    The regex parser stays in the JVM; "html" reads attributes as HTML does
    (quotes, entities, comments), in Arrow batches.
    """
    if config.parser == "regex":
        return pages.withColumn("links", F.coalesce(clean_links(F.col("url"), raw_links(F.col("html")), config), F.expr("cast(array() as array<string>)")))

    @F.pandas_udf("array<string>")
    def hrefs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(_parsed)

    return pages.withColumn("links", clean_links(F.col("url"), hrefs("html"), config))
