"""Packing by power-of-two decomposition.

Each document's ids, closed by the end id, are cut from the left into pieces of
the binary digits of their number: full sequences first, then each lower power
of two at most once. A piece is a sequence of its own, so no sequence crosses
documents and none is padded; the length's exponent leads the sequence id, so
that equal lengths lie together and can be batched (``bucket``, a column to
partition a written table by).

Tokenising keeps each distinct word's ids: the vocabulary's normaliser and
splitter never join text across a space or a line break, so words between these
can be tokenised one by one. Words seen anew in a batch are tokenised together.

Defined cases: null and empty texts give one piece, the end id; strings of the
special tokens in a text are these tokens, as the tokenizer has it; rows that repeat a doc_id are packed
each for itself; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

LONGEST = 2048
#: Distinct words kept by a worker; beyond that the table starts anew.
KEPT_WORDS = 300_000
#: Latin letters beyond ASCII that no normal form changes, and how the vocabulary writes bytes.
_LATIN = {c: "a" for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))}
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordTable(dict):
    """From a word to its ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__({"": b""})
        self.path = path
        self.special = [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]

    def _learn(self, words: set[str]) -> None:
        """Signs that close a word after what is a letter in lower case too are a token run of their own; ASCII and such Latin letters are put in lower case as the normaliser does."""
        ends = {}
        for w in words:
            core = w.rstrip(_SIGNS)
            if not core or not core[-1].isalpha() or not core[-1].lower().isalpha():
                core = w
            lower = core.lower()
            if core.isascii() or lower.translate(_LATIN).isascii():
                ends[w] = lower, w[len(core) :]
            elif core != w:
                ends[w] = core, w[len(core) :]
        new = [c for c in {c for pair in ends.values() for c in pair}.union(words.difference(ends)) if c not in self]
        # a run of letters of these kinds is as the normaliser leaves it and one token run: the merges alone are asked
        tokenize, rest = _tokenizer(self.path).model.tokenize, []
        for w in new:
            if w.isalpha() and w.islower() and (w.isascii() or w.translate(_LATIN).isascii()):
                got = tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES))
                self[w] = struct.pack(f"<{len(got)}I", *[t.id for t in got])
            else:
                rest.append(w)
        self._learn_each(rest)
        for w, (core, end) in ends.items():
            self[w] = self[core] + self[end]

    def _learn_each(self, words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            for word, got in zip(part, _tokenizer(self.path).encode_batch_fast(part, add_special_tokens=False), strict=True):
                self[word] = np.array(got.ids, "<u4").tobytes()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if len(self) > KEPT_WORDS:
            self.clear()
            self[""] = b""
        # added tokens are found in the text before it is split
        special = {i for i, t in enumerate(texts) if t and any(x in t for x in self.special)}
        split = [[] if i in special else (t or "").replace("\n", " ").split(" ") for i, t in enumerate(texts)]
        new = {w for w in set().union(*split) if w not in self}
        if new:
            self._learn(new)
        whole = {i: np.array(_tokenizer(self.path).encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes() for i in special}
        return [whole[i] if i in special else b"".join(map(self.__getitem__, words)) for i, words in enumerate(split)]


@functools.lru_cache(maxsize=2)
def _table(path: str) -> WordTable:
    return WordTable(path)


def cut_lengths(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n ids: full sequences, then the binary digits of the rest, from the highest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, longest: int = LONGEST, end_id: int = 1) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text).

    doc_id; start, length: which of the document's ids; doc_tokens: their number
    with the end id; input_ids: the piece's ids as little-endian unsigned 32-bit
    bytes; bucket: log2 of the length; sequence_id, offset: the sequence and the
    piece's place in it, always 0. longest: a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        for batch in batches:
            doc_ids = batch.column(0)
            sizes, rows, starts, totals, pieces = [], [], [], [], []
            for i, ids in enumerate(_table(tokenizer).ids(batch.column(1).to_pylist())):
                ids += end
                at, n = 0, len(ids) // 4
                for length in cut_lengths(n, longest):
                    rows.append(i)
                    sizes.append(length)
                    starts.append(at)
                    totals.append(n)
                    pieces.append(ids[4 * at : 4 * (at + length)])
                    at += length
            yield pa.RecordBatch.from_arrays(
                [doc_ids.take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in (starts, sizes, totals)], pa.array(pieces, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "input_ids"],
            )

    pieces = docs.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, input_ids binary")
    bucket = F.log2("length").cast("int")
    sequence = F.shiftleft(bucket.cast("long"), 58).bitwiseOR(F.monotonically_increasing_id())
    return pieces.select("*", bucket.alias("bucket"), sequence.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
