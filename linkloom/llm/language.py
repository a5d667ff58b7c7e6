"""Language identification by a byte convolutional network, trained and applied in numpy.

A window of 256 bytes (UTF-8, A-Z in lower case) is embedded, convolved with
filters of 2, 3, 4 and 5 bytes' width, rectified, pooled by its maxima and
classified by a softmax. Windows overlap by 4 bytes, so every run of 5 bytes of
the whole text is seen. A document's probabilities are the normalised product of
its windows' (mean of the logarithms, weighted by bytes).

Defined cases: ``und`` with score 0 for null text, text without a letter, and if
nothing was learned; null languages, and texts without a letter, teach nothing;
with one learned language all texts get it; rows that repeat an id are scored
alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fold, prepare, small_side

WINDOW, OVERLAP, WIDTHS, FILTERS, DIMENSIONS = 256, 4, (2, 3, 4, 5), 10, 6
#: Bounds of the training set: documents a language, windows of a document; then passes.
DOCS, SPREAD, PASSES = 400, 2, 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    names: tuple[str, ...]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, padded with zeros, and how many bytes each holds."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    step = WINDOW - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + WINDOW, np.uint8)
    padded[: len(raw)] = raw
    view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]
    return view, np.minimum(WINDOW, len(raw) - step * np.arange(n)).clip(1)


def _convolve(x: np.ndarray, m: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Pooled maxima of (windows, filters), and the runs of bytes' embeddings that the filters saw."""
    widest = WIDTHS[-1]
    runs = np.lib.stride_tricks.sliding_window_view(m.embedding[x].reshape(len(x), -1), widest * DIMENSIONS, axis=1)[:, ::DIMENSIONS]
    runs = np.ascontiguousarray(runs)
    seen = (runs.reshape(-1, widest * DIMENSIONS) @ m.filters).reshape(len(x), runs.shape[1], -1)
    return seen, runs


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def log_probabilities(x: np.ndarray, m: LanguageModel) -> np.ndarray:
    out = []
    for at in range(0, len(x), 32):
        pooled = np.maximum(_convolve(x[at : at + 32], m)[0].max(axis=1) + m.bias, 0)
        out.append(_log_softmax(pooled @ m.out + m.out_bias))
    return np.concatenate(out)


def _mask() -> np.ndarray:
    """Which rows of the filter matrix belong to each filter's width."""
    mask = np.zeros((WIDTHS[-1] * DIMENSIONS, len(WIDTHS) * FILTERS), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[: width * DIMENSIONS, k * FILTERS : (k + 1) * FILTERS] = 1
    return mask


def train(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], seed: int = 7) -> LanguageModel:
    """Adam on the cross-entropy of windows x (n, 256) of the classes y."""
    rng, mask = np.random.default_rng(seed), _mask()
    total = len(WIDTHS) * FILTERS
    m = LanguageModel(
        names,
        rng.normal(0, 0.5, (256, DIMENSIONS)).astype(np.float32),
        (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        np.zeros(total, np.float32),
        rng.normal(0, 0.3, (total, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    weights = [m.embedding, m.filters, m.bias, m.out, m.out_bias]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(PASSES):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 32):
            own, target = x[order[at : at + 32]], y[order[at : at + 32]]
            seen, runs = _convolve(own, m)
            where = seen.argmax(axis=1)
            top = np.take_along_axis(seen, where[:, None], axis=1)[:, 0] + m.bias
            pooled = np.maximum(top, 0)
            g = np.exp(_log_softmax(pooled @ m.out + m.out_bias))
            g[np.arange(len(own)), target] -= 1
            g /= len(own)
            back = (g @ m.out.T) * (top > 0)
            picked = runs[np.arange(len(own))[:, None], where]  # (windows, filters, widest * dimensions)
            to_runs = back[:, :, None] * m.filters.T[None]
            bytes_at = own[np.arange(len(own))[:, None, None], where[:, :, None] + np.arange(WIDTHS[-1])]
            to_embedding = np.zeros_like(m.embedding)
            np.add.at(to_embedding, bytes_at.ravel(), to_runs.reshape(-1, DIMENSIONS))
            gradients = [to_embedding, np.einsum("nf,nfd->df", back, picked) * mask, back.sum(axis=0), pooled.T @ g, g.sum(axis=0)]
            step += 1
            for w, d, a, b in zip(weights, gradients, first, second, strict=True):
                a += 0.1 * (d - a)
                b += 0.01 * (d * d - b)
                w -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return m


def fit(docs: DataFrame, excluded_fold: int = 2, folds: int = 4) -> LanguageModel | None:
    """A model from the texts and non-null languages of the documents outside the excluded fold.

    For each language the ``DOCS`` documents of the least hashes teach it, by at most
    ``SPREAD`` windows each from all over the text; None if there is none.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold("doc_id", folds) != excluded_fold))

    def pieces(batches):
        for batch in batches:
            out = ([], [], [])
            for i, lang, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                all_, held = windows(text)
                chosen = np.unique(np.linspace(0, len(all_) - 1, 2 * SPREAD + 1).astype(int)[1::2]) if len(all_) > SPREAD else np.arange(len(all_))
                for k in chosen:
                    if held[k] >= 32 or len(all_) == 1:
                        for column, value in zip(out, (i, lang, all_[k].tobytes()), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary())], ["doc_id", "lang", "bytes"])

    # each task keeps the least of its own rows of a language before any are exchanged
    by_hash = Window.partitionBy("lang").orderBy("hash", "doc_id")
    hashed = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("hash"))
    taught = cut(hashed.withColumn("place", F.dense_rank().over(by_hash)).where(F.col("place") <= DOCS).select("lang", "doc_id").distinct())
    names = [r.lang for r in taught.select("lang").distinct().orderBy("lang").collect()]
    own = rows.join(small_side(taught), ["lang", "doc_id"]).select("doc_id", "lang", "text")
    got = own.mapInArrow(pieces, "doc_id long, lang string, bytes binary").distinct().collect()
    if not got:
        return None
    got = sorted((r.doc_id, r.lang, bytes(r.bytes)) for r in got)
    x = np.frombuffer(b"".join(g[2] for g in got), np.uint8).reshape(-1, WINDOW)
    y = np.array([names.index(g[1]) for g in got])
    return train(x, y, tuple(names))


def identify(docs: DataFrame, model: LanguageModel | None, text: Column | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs`` (doc_id, text)."""
    text = F.col("text") if text is None else text
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        cut = [windows(t) for t in texts]
        each = log_probabilities(np.concatenate([w for w, _ in cut]), model)
        at = np.concatenate([[0], np.cumsum([len(w) for w, _ in cut])])
        mean = np.array([np.average(each[at[k] : at[k + 1]], axis=0, weights=held) for k, (_, held) in enumerate(cut)])
        p = np.exp(_log_softmax(mean))
        best = p.argmax(axis=1)
        return pd.DataFrame({"lang_pred": [model.names[b] for b in best], "score": p.max(axis=1).astype(float)})

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    told = rows.select("doc_id", lettered.alias("lettered"), predict(F.when(lettered, F.col("text")).otherwise("")).alias("p"))
    return told.select("doc_id", F.when(F.col("lettered"), F.col("p.lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"), F.when(F.col("lettered"), F.col("p.score")).otherwise(0.0).alias("score"))
