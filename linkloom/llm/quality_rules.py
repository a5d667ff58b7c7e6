"""Quality rules by weak supervision.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts
of all vote patterns (at most 3 ** rules of them reach the driver, whatever the
corpus) estimates how often each rule is right about good and about bad
documents; a document's posterior probability of being good decides, so that one
rule alone neither rejects nor saves it.

Defined cases: null text has no words; a text without words gets no vote but
fails the base rules; rows that repeat an id are treated alike; an empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import cut, prepare

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_marked", "top_word")
_WHITE = " \t\n\v\f\r"
_SYMBOL, _UPPER, _MARK, _ODD = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"#*$%&|<>", bytes(range(65, 91)), b"!?", b"#*$%&|<>@^~_={}[]\\/+"))


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def count_texts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text of a batch."""
    data, offsets = T.text_bytes(column)
    starts, ends, first = T.word_spans(data, offsets)
    n_words = np.diff(first)
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    words = T.word_hashes(data, starts, ends)
    own = T.mix(words ^ T.mix(text_of.astype(np.uint64)))
    _, where, times = np.unique(own, return_inverse=True, return_counts=True)
    top = np.zeros(len(n_words), np.int64)
    np.maximum.at(top, text_of, times[where])
    repeated = np.zeros(len(words) + 2, bool)
    if len(words) >= 3:
        inside = text_of[2:] == text_of[:-2]
        runs = T.mix(words[:-2] * T.U64(0x9E3779B97F4A7C15) + T.mix(words[1:-1] * T.U64(3) + T.mix(words[2:]))) ^ T.mix(text_of[2:].astype(np.uint64))
        at = np.flatnonzero(inside)
        _, where, times = np.unique(runs[at], return_inverse=True, return_counts=True)
        again = at[times[where] > 1]
        for k in range(3):
            repeated[again + k] = True
    lines = [[line for line in (t or "").split("\n") if line.strip(_WHITE)] for t in column.to_pylist()]
    inside = ~T._SPACE[data]
    odd = np.concatenate([[0], np.cumsum(_ODD[data])])
    marked = odd[ends] > odd[starts]
    return {
        "n_words": n_words,
        "word_chars": _per_text(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": np.bincount(text_of, repeated[: len(words)], len(n_words)).astype(np.int64),
        "n_lines": np.array([len(x) for x in lines], np.int64),
        "n_upper": _per_text(_UPPER[data], offsets),
        "n_marks": _per_text(_MARK[data], offsets),
        "n_marked": np.bincount(text_of, marked, len(n_words)).astype(np.int64),
        "top_word": top,
    }


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and ``COUNTS`` for each row of ``docs`` (doc_id, text).

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with
    a word, equal to an earlier line), n_repeat_words (words in 3-word windows
    found more than once in the text), n_lines (lines with a word), n_upper (A-Z),
    n_marks (! and ?), n_marked (words with an odd character), top_word (how often the most frequent word is there).
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            counts = count_texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(counts[c].astype(np.int64)) for c in COUNTS]], ["doc_id", *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def _rule(value: Column, good: Column, bad: Column) -> Column:
    """0 abstains, 1 good, 2 bad."""
    return F.when(value.isNull(), 0).when(bad, 2).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules as columns of the counts."""
    per_word = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words"))
    symbols, repeats, marks, length = per_word("n_symbols"), per_word("n_repeat_words"), per_word("n_marks"), per_word("word_chars")
    marked = per_word("n_marked")
    lines = F.when(F.col("n_lines") > 4, F.col("n_dup_lines") / F.col("n_lines"))
    upper = F.when(F.col("word_chars") > 0, F.col("n_upper") / F.col("word_chars"))
    top = F.when(F.col("n_words") >= 20, F.col("top_word") / F.col("n_words"))
    return {
        "few symbols": _rule(symbols, symbols < 0.02, symbols > 0.1),
        "few marked words": _rule(marked, marked < 0.03, marked > 0.1),
        "few repeated runs": _rule(repeats, repeats < 0.1, repeats > 0.3),
        "few repeated lines": _rule(lines, lines < 0.1, lines > 0.3),
        "plain case": _rule(upper, upper < 0.1, upper > 0.25),
        "few marks": _rule(marks, marks < 0.05, marks > 0.2),
        "usual words": _rule(length, length.between(3.5, 8), (length < 2.5) | (length > 11)),
        "no dominant word": _rule(top, top < 0.15, top > 0.3),
    }


def estimate(patterns: dict[int, int], rules: int, rounds: int = 200, begin: tuple = (0.99, 0.4), least: tuple = (0.99, 0.02)) -> tuple[np.ndarray, dict[int, float]]:
    """(rules, 2) accuracies about good and bad documents, and each pattern's posterior of good.

    A rule that looks for one defect is seldom wrong about good documents, but votes
    good on most bad ones, which have another. So its accuracy about good documents
    starts at 0.99 and stays there or above, that about bad ones starts at 0.4 and is
    free; as every defect is looked at by two rules, their agreement tells which
    documents are bad. Ten documents' worth of these beliefs stay in every estimate.
    """
    codes = sorted(patterns)
    table = np.array([[c // 3**k % 3 for k in range(rules)] for c in codes], int).reshape(len(codes), rules)
    weight = np.array([patterns[c] for c in codes], float)
    good_vote, bad_vote = table == 1, table == 2
    start = np.array(begin)
    accuracy, prior = np.tile(start, (rules, 1)), 0.8
    posterior = np.zeros(len(codes))
    for _ in range(rounds):
        log_good = np.log(prior) + good_vote @ np.log(accuracy[:, 0]) + bad_vote @ np.log(1 - accuracy[:, 0])
        log_bad = np.log(1 - prior) + good_vote @ np.log(1 - accuracy[:, 1]) + bad_vote @ np.log(accuracy[:, 1])
        now = 1 / (1 + np.exp(np.clip(log_bad - log_good, -500, 500)))
        for side, share, right, wrong in ((0, now, good_vote, bad_vote), (1, 1 - now, bad_vote, good_vote)):
            hits, misses = (weight * share) @ right, (weight * share) @ wrong
            accuracy[:, side] = np.clip((hits + 10 * start[side]) / (hits + misses + 10), least[side], 0.9999)
        prior = float(np.clip((weight @ now + 8) / (weight.sum() + 10), 0.01, 0.99))
        if np.abs(now - posterior).max(initial=0) < 1e-9:
            break
        posterior = now
    return accuracy, dict(zip(codes, posterior.tolist(), strict=True))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The counts with base_failed, the posterior probability ``quality``, and kept, for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    rules = votes()
    code = sum((vote * 3**k for k, vote in enumerate(rules.values())), F.lit(0))
    rows = cut(measure(docs).withColumn("pattern", code.cast("int")))
    counts = {r["pattern"]: r["count"] for r in rows.groupBy("pattern").count().collect()}
    _, posterior = estimate(counts, len(rules))
    table = spark.createDataFrame(list(posterior.items()) or [(0, 0.5)], "pattern int, quality double")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    judged = rows.join(F.broadcast(table), "pattern").drop("pattern")  # at most 3 ** rules rows
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
