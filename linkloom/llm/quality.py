"""Quality classifier: two zstandard dictionaries, from good and from bad labelled text.

Every 2 KB window of a text is compressed with either dictionary. The score is a
logistic calibration of the normalised size difference (bad - good) / (bad +
good), over the whole text and in its lowest window, with the compressed share
of the raw size (text that both dictionaries shrink to nothing repeats itself)
and the raw size, which tells how far the difference can be trusted.

The fit reads two bounded samples of labelled documents, disjoint by the id's
crc32: ``DICTIONARY_DOCS`` a class for the dictionaries, windows spread over
each whole text, and ``CALIBRATION_DOCS`` in their natural mix for the logistic
weights. Scoring looks at the text alone.

Defined cases: null and empty text have one empty window; labels without a
quality, of unknown documents or contradicting each other take no part
(repeated equal labels count once); with no label of one class the score of all
rows is the share of good labels, 0.5 without any; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, prepare

#: Bounds of the fit.
DICTIONARY_DOCS, CALIBRATION_DOCS = 1500, 6000
DICTIONARY_BYTES = 256 << 10
#: Windows of training text: their number for a document, their characters.
SPREAD, SPREAD_CHARS = 6, 1024
WINDOW, LEVEL = 2048, 3
FEATURES = 5


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries (bad, good), None if there is nothing to compare; calibration; the score without dictionaries."""

    dictionaries: tuple[bytes, bytes] | None
    centre: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float


_compressors: dict[tuple[bytes, bytes], list[zstandard.ZstdCompressor]] = {}


def _pair(dictionaries: tuple[bytes, bytes]) -> list[zstandard.ZstdCompressor]:
    """Made once in a process."""
    if dictionaries not in _compressors:
        _compressors.clear()
        made = []
        for raw in dictionaries:
            own = zstandard.ZstdCompressionDict(raw)
            own.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False))
        _compressors[dictionaries] = made
    return _compressors[dictionaries]


def features(text: str | None, dictionaries: tuple[bytes, bytes]) -> list[float]:
    bad, good = _pair(dictionaries)
    raw = (text or "").encode("utf-8", "replace")
    pieces = [raw[at : at + WINDOW] for at in range(0, max(len(raw), 1), WINDOW)]
    a = np.array([len(bad.compress(p)) for p in pieces], float)
    b = np.array([len(good.compress(p)) for p in pieces], float)
    n = np.array([max(len(p), 1) for p in pieces], float)
    full = n >= min(WINDOW // 2, n.max())
    both = a + b
    return [(a.sum() - b.sum()) / both.sum(), np.log(both.sum() / 2 / n.sum() + 0.01), ((a - b) / both)[full].min(), np.log((both / 2 / n)[full].min() + 0.01), np.log1p(len(raw))]


def _expand(x: np.ndarray, centre, spread) -> np.ndarray:
    z = np.clip((x - np.array(centre)) / np.array(spread), -4, 4)
    i, j = np.triu_indices(z.shape[1])
    return np.hstack([np.ones((len(z), 1)), z, z[:, i] * z[:, j]])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge and halved steps while the loss does not fall."""
    w, ridge = np.zeros(x.shape[1]), 0.1

    def loss(v):
        s = x @ v
        return np.sum(np.logaddexp(0, s) - y * s) + ridge / 2 * v @ v

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, excluded_fold: int = 0, folds: int = 5) -> QualityModel:
    """A model from the documents (doc_id, text) that ``labels`` (doc_id, quality) marks, without those of the excluded fold."""
    prepare(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").where(fold("doc_id", folds) != excluded_fold)
    half = F.pmod(F.crc32(F.concat(F.lit("half "), F.col("doc_id").cast("string")).cast("binary")), F.lit(2))
    order = (F.xxhash64("doc_id"), "doc_id")
    for_words = [usable.where((half == 0) & (F.col("quality") == q)).orderBy(*order).limit(DICTIONARY_DOCS) for q in (0, 1)]
    for_words = for_words[0].union(for_words[1]).select("doc_id", "quality")
    for_weights = usable.where(half == 1).orderBy(*order).limit(CALIBRATION_DOCS).select("doc_id", "quality")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def windows(batches):
        for batch in batches:
            out = ([], [], [])
            for i, q, text in zip(*[batch.column(k).to_pylist() for k in ("doc_id", "quality", "text")], strict=True):
                text = text or ""
                whole = len(text) <= SPREAD * SPREAD_CHARS
                starts = range(0, len(text), SPREAD_CHARS) if whole else [k * (len(text) - SPREAD_CHARS) // (SPREAD - 1) for k in range(SPREAD)]
                for at in starts:
                    for column, value in zip(out, (i, q, text[at : at + SPREAD_CHARS].encode("utf-8", "replace")), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["doc_id", "quality", "piece"])

    # bounded: at most 2 * DICTIONARY_DOCS documents with SPREAD windows each
    got = docs.join(F.broadcast(for_words), "doc_id").mapInArrow(windows, "doc_id long, quality int, piece binary").collect()
    pieces = [sorted({(r.doc_id, bytes(r.piece)) for r in got if r.quality == q}) for q in (0, 1)]
    known = for_weights.agg(F.avg("quality")).first()[0]
    blank = QualityModel(None, (), (), (), 0.5 if known is None else float(known))
    if not pieces[0] or not pieces[1]:
        return blank
    dictionaries = tuple(_dictionary([p for _, p in sorted(own, key=lambda x: hashlib.blake2b(x[1]).digest())]) for own in pieces)

    def measure(batches):
        for batch in batches:
            values = np.array([features(t, dictionaries) for t in batch.column("text").to_pylist()], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *[pa.array(values[:, k]) for k in range(FEATURES)]], ["doc_id", "quality", *[f"x{k}" for k in range(FEATURES)]])

    rows = docs.join(F.broadcast(for_weights), "doc_id").mapInArrow(measure, "doc_id long, quality int, " + ", ".join(f"x{k} double" for k in range(FEATURES))).collect()
    rows = sorted(set(map(tuple, rows)))
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return blank
    x = np.array([r[2:] for r in rows], float)
    centre, spread = tuple(x.mean(axis=0)), tuple(x.std(axis=0) + 1e-6)
    return QualityModel(dictionaries, centre, spread, tuple(_logistic(_expand(x, centre, spread), y)), float(y.mean()))


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary; of little text, the text itself."""
    total = sum(map(len, pieces))
    if total >= 64 * 1024 and len(pieces) >= 64:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 3), pieces).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"\n".join(pieces)[:DICTIONARY_BYTES]


def score(model: QualityModel, text: Column) -> Column:
    """The probability that the label is 1."""
    if model.dictionaries is None:
        return F.lit(model.prior)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        x = np.array([features(t, model.dictionaries) for t in texts], float).reshape(-1, FEATURES)
        s = _expand(x, model.centre, model.spread) @ np.array(model.weights)
        return pd.Series(1 / (1 + np.exp(-np.clip(s, -30, 30))))

    return scored(text.cast("string"))


def classify(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for each row of ``docs`` (doc_id, text)."""
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
