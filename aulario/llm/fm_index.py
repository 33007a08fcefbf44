"""Remove long word sequences that occur more than once, with a compressed index per shard.

The engine of ``repeats`` deals the stretches of words that may repeat to shards. A shard numbers its
words, sorts the suffixes of its stretches and keeps the Burrows-Wheeler transform as a wavelet matrix:
one bit vector per bit of a word's number, with counts at block starts, from which symbol and rank of
a row come in one descent. Streaming a stretch backwards, each step leads to the row of the suffix one
word longer; the row tells the class of suffixes with the same ``width`` words, and a class that is
held more than once is reported, every occurrence of it.

Words are runs of bytes other than ASCII white space; null holds none; windows never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from aulario.llm import repeats
from aulario.llm.run_length_index import walk
from aulario.llm.text import flat, mix, span_hashes, words

WIDTH = 35
ANCHOR = 8
_BLOCK = 64


class WaveletMatrix:
    """Bits of a sequence by level, packed, with the number of ones before every block."""

    def __init__(self, values: np.ndarray):
        counts = np.bincount(values, minlength=1)
        self.smaller = np.cumsum(counts) - counts
        self.size, self.levels, self.bits, self.ones, self.zeros = len(values), max(1, int(values.max(initial=0)).bit_length()), [], [], []
        for level in reversed(range(self.levels)):
            bit = (values >> level) & 1
            padded = np.zeros(-(-(len(bit) + 1) // _BLOCK) * _BLOCK, np.uint8)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))]))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        block, inner = at // _BLOCK, (at % _BLOCK).astype(np.uint64)
        below = self.bits[level][block] & ((np.uint64(1) << inner) - np.uint64(1))
        return self.ones[level][block] + np.bitwise_count(below)

    def step(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each row, and its place when all rows are sorted by symbol (the LF step)."""
        symbol, at, start = np.zeros(len(rows), np.int64), rows.astype(np.int64), np.zeros(len(rows), np.int64)
        for level in range(self.levels):
            one = ((self.bits[level][at // _BLOCK] >> (at % _BLOCK).astype(np.uint64)) & np.uint64(1)).astype(bool)
            ones, before = self._rank(level, at), self._rank(level, start)
            symbol = 2 * symbol + one
            at = np.where(one, self.zeros[level] + ones, at - ones)
            start = np.where(one, self.zeros[level] + before, start - before)
        return symbol, self.smaller[symbol] + at - start


def repeated_marks(symbols: np.ndarray, begin: np.ndarray, docs: np.ndarray, several: np.ndarray, width: int) -> np.ndarray:
    """Windows (as positions in ``symbols``) held by more than one place."""
    del docs
    held, order, equal = repeats.classes(symbols, begin, width)
    index = WaveletMatrix(held[order - 1])
    sizes = np.diff(begin)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    inside = np.flatnonzero(np.arange(len(held)) <= (begin[1:] + np.arange(len(sizes)) - width)[owner])
    times = np.bincount(equal[inside], 1 + several[owner[inside]].astype(np.int64), int(equal.max()) + 1)
    return walk(index.step, held, begin, width, lambda rows, own: times[equal[order[rows]]] > 1)


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(part.column(1))
    starts, ends, doc = words(data, offsets)
    return span_hashes(data, starts, ends), np.searchsorted(doc, np.arange(len(offsets)))


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    s = h[:n].copy()
    for j in range(1, k):
        s = s * np.uint64(0x9FB21C651E98DF25) + h[j : j + n]
    return mix(s)


PLAN = repeats.Plan(WIDTH, ANCHOR, _words, _grams, repeated_marks, False, np.uint64)


def _kept(docs: pa.Table, runs: dict[int, np.ndarray]) -> pa.Table:
    rows = []
    for doc, text, rid in zip(docs["doc_id"].to_pylist(), docs["text"].cast(pa.binary()).to_pylist(), docs["rid"].to_pylist(), strict=True):
        own = (text or b"").split()  # bytes split at ASCII white space only
        n = len(own)
        for a, b in reversed(runs.get(rid, ())):
            del own[a:b]
        kept = b" ".join(own)
        rows.append((doc, n, n - len(own), hashlib.sha256(kept).hexdigest(), kept))
    columns = zip(*rows, strict=True) if rows else [()] * 5
    kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    return pa.table({c: pa.array(v, k) for c, v, k in zip(names, columns, kinds, strict=True)})


def remove_repeated(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and the ``kept`` words of every row."""
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept binary"
    return repeats.cut(docs, PLAN, _kept, schema)
