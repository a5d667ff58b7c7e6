"""URLs as column expressions: parts, resolution, normalisation, cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def origin(url: Column) -> Column:
    """scheme://authority of an http(s) URL, else an empty string."""
    return F.regexp_extract(url, r"^((?i:https?)://[^/?#]+)", 1)


def netloc(url: Column) -> Column:
    """The authority, with user and port."""
    return F.regexp_extract(url, r"^[a-zA-Z][^:/?#]*://([^/?#]*)", 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_query(url: Column) -> Column:
    """Without query and fragment; everything else, ;params and case included, stays."""
    return F.regexp_replace(url, r"[?#].*$", "")


def cache_key(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 16)


def without_dots(path: Column) -> Column:
    """RFC 3986 removal of dot segments from a path that begins with a slash."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    start = F.expr("cast(array() as array<string>)")
    up = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))  # noqa: E731  the leading empty part stays
    kept = F.aggregate(parts, start, lambda kept, part: F.when(part == ".", kept).when(part == "..", up(kept)).otherwise(F.concat(kept, F.array(part))))
    joined = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    return F.when(path.contains("/."), joined).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """The absolute URL of a reference on a page, without query and fragment; null without a usable base."""
    clean = without_query(href)
    site = origin(base)
    path = F.regexp_replace(without_query(base), r"^(?i:https?)://[^/]*", "")
    folder = F.concat(F.regexp_replace(path, r"[^/]*$", ""))
    folder = F.when(folder == "", "/").otherwise(folder)
    relative = (
        F.when(clean == "", F.concat(site, path))
        .when(clean.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z]+:)", 1), clean))
        .when(clean.startswith("/"), F.concat(site, without_dots(clean)))
        .otherwise(F.concat(site, without_dots(F.concat(folder, clean))))
    )
    return F.when(clean.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), clean).when(site == "", F.lit(None)).otherwise(relative)
