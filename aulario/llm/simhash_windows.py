"""Benchmark decontamination with SimHash over windows of the size of a benchmark item.

Items and windows are bags of word shingles, a shingle weighing as many bytes as its words have. An
item's 64-bit SimHash is looked up among those of all windows with as many words. Fingerprints are cut
into ``BLOCKS`` blocks; of two within ``RADIUS`` bits, some block differs in at most
``RADIUS // BLOCKS``, so the items' blocks are listed with all such flips and the windows' blocks meet
them in an equi-join: no pair within the radius is missed. Survivors are verified by the exact
weighted Jaccard similarity of the bags.

Windows can only reach the threshold if shingles of items of their size make up that share of their
weight. A bitmap of fixed size, filled with the shingles of the benchmark and with its (size, shingle)
pairs, drops all others before anything is shuffled; false hits in it only let more windows through. Only
windows that hold a shingle of the benchmark are looked at, whatever their size.

Null, empty and blank items match nothing; null texts have no windows. Items with fewer than five
words are one shingle. A text is compared without case (A-Z), words being cut at ASCII white space.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulario.llm.text import flat, lower, mix, shingles, sliced, span_hashes, words
from aulario.plans.staging import stage

SHINGLE = 5
THRESHOLD = 0.75
BITS, BLOCKS, RADIUS = 64, 4, 15
_WIDTH = BITS // BLOCKS
#: Bits of the bitmap; its 4 MB as bytes bound what is sent to every worker.
BITMAP = 1 << 22
#: Stands for all sizes in the bitmap.
ANY = 0
_FLIPS = np.array(
    [sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in itertools.combinations(range(_WIDTH), r)], np.int64
)


class Shingled:
    """Shingles of a slice of texts, with their weights, for every shingle length asked for."""

    def __init__(self, part: pa.RecordBatch):
        data, offsets = flat(part.column(1))
        data = lower(data)
        self.starts, self.ends, self.doc = words(data, offsets)
        self.h = span_hashes(data, self.starts, self.ends)
        self.reach = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.likely: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and weight by number of the first word (0 where the text ends before ``k`` words)."""
        if k not in self.by_length:
            s, at = shingles(self.h, self.doc, k)
            hashes = np.zeros(len(self.h), np.uint64)
            weights = np.zeros(len(self.h), np.int64)
            hashes[at], weights[at] = s, self.reach[at + k] - self.reach[at]
            self.by_length[k] = hashes, weights
        return self.by_length[k]

    def met(self, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the shingles of ``k`` words that the benchmark may have, and the weight of all before each place."""
        if k not in self.likely:
            hashes, weights = self.of(k)
            self.likely[k] = np.flatnonzero(known[_slot(hashes, ANY)]), np.append(0, np.cumsum(weights))
        return self.likely[k]


def _slot(hashes: np.ndarray, size: int) -> np.ndarray:
    return (mix(hashes ^ np.uint64(size * 0x9E3779B1)) % np.uint64(BITMAP)).astype(np.int64)


def fingerprints(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, counts: int) -> np.ndarray:
    """SimHash of the ``counts`` shingles from each start on; starts lie close together."""
    if not len(starts):
        return np.empty(0, np.uint64)
    base = int(starts.min())
    own, w = hashes[base : int(starts.max()) + counts], weights[base : int(starts.max()) + counts]
    out = np.zeros(len(starts), np.uint64)
    at = starts - base
    for bit in range(BITS):
        signed = np.where((own >> np.uint64(bit)) & np.uint64(1), w, -w)
        total = np.concatenate([[0], np.cumsum(signed)])
        out |= (total[at + counts] - total[at] > 0).astype(np.uint64) << np.uint64(bit)
    return out


_BAG = "size int, fingerprint bigint, hashes binary, weights binary"


def _items(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1):
                s = Shingled(part)
                rows = []
                for i, name in enumerate(part.column(0).to_pylist()):
                    a, b = np.searchsorted(s.doc, [i, i + 1])
                    size = int(b - a)
                    if size:
                        k = min(SHINGLE, size)
                        h, w = (x[a : b - k + 1] for x in s.of(k))
                        fp = fingerprints(h, w, np.array([0]), len(h)).view(np.int64)
                        rows.append((name, size, int(fp[0]), h.tobytes(), w.tobytes()))
                columns = zip(*rows, strict=True) if rows else [()] * 5
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                names = ["item_id", "size", "fingerprint", "hashes", "weights"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return items.select("item_id", "text").mapInArrow(run, "item_id bigint, " + _BAG)


def _slots(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                _slot(np.frombuffer(h, np.uint64), size)
                for n, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for size in (ANY, n)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([*found, np.empty(0, np.int64)])))], ["slot"])

    return items.select("size", "hashes").mapInArrow(run, "slot bigint").distinct()


def _likely(s: Shingled, size: int, known: np.ndarray) -> np.ndarray:
    """First words of the windows that share enough weight with items of their size, false hits included."""
    k = min(SHINGLE, size)
    count = size - k + 1
    _, w = s.of(k)
    at, total = s.met(k, known)
    at = at[known[_slot(s.of(k)[0][at], size)]]
    # windows that hold one of these shingles, each once
    begins = np.maximum(at - count + 1, np.append(0, at[:-1] + 1))
    lengths = at + 1 - begins
    own = np.repeat(begins - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    own = own[own < len(w) - size + 1]
    own = own[s.doc[own] == s.doc[own + size - 1]]
    shared = np.append(0, np.cumsum(w[at]))
    share = shared[np.searchsorted(at, own + count)] - shared[np.searchsorted(at, own)]
    return own[(share > 0) & (share >= THRESHOLD * (total[own + count] - total[own]))]


def _windows(docs: DataFrame, sizes: list[int], slots: np.ndarray) -> DataFrame:
    bitmap = np.zeros(BITMAP, bool)
    bitmap[slots] = True
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(held.value).astype(bool)
        for batch in batches:
            for part in sliced(batch, 1):
                s = Shingled(part)
                ids = part.column(0).to_pylist()
                first = np.searchsorted(s.doc, np.arange(len(ids) + 1))
                rows = []
                for size in sizes:
                    k = min(SHINGLE, size)
                    count = size - k + 1
                    h, w = s.of(k)
                    at = _likely(s, size, known)
                    for near in np.split(at, np.flatnonzero(np.diff(at) > count) + 1) if len(at) else []:
                        for a, fp in zip(near.tolist(), fingerprints(h, w, near, count).view(np.int64).tolist(), strict=True):
                            d = int(s.doc[a])
                            rows.append((ids[d], a - int(first[d]), size, fp, h[a : a + count].tobytes(), w[a : a + count].tobytes()))
                columns = zip(*rows, strict=True) if rows else [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                names = ["doc_id", "start", "size", "fingerprint", "hashes", "weights"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, start bigint, " + _BAG)


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    names, inverse = np.unique(np.concatenate([ha, hb]), return_inverse=True)
    a = np.bincount(inverse[: len(ha)], wa, len(names))
    b = np.bincount(inverse[len(ha) :], wb, len(names))
    return float(np.minimum(a, b).sum() / np.maximum(a, b).sum())


def _verified(pairs: DataFrame) -> DataFrame:
    names = ["doc_id", "item_id", "start", "size", "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = (batch.column(c).to_pylist() for c in ("hashes", "weights", "item_hashes", "item_weights"))
            s = np.array(
                [
                    similarity(np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64), np.frombuffer(c, np.uint64), np.frombuffer(d, np.int64))
                    for a, b, c, d in zip(*bags, strict=True)
                ]
            )
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(s, pa.float64())], [*names, "similarity"])
            yield out.filter(pa.array(s >= THRESHOLD, pa.bool_()))

    return pairs.mapInArrow(run, "doc_id bigint, item_id bigint, start bigint, size int, distance int, similarity double")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item found in it: the most similar window, its place and how many there are."""
    bags = stage(_items(items), "op1-items")
    sizes = [r[0] for r in bags.select("size").distinct().orderBy("size").collect()]
    slots = np.array([r[0] for r in _slots(bags).collect()], np.int64)
    mask = (1 << _WIDTH) - 1
    block = lambda x, b: F.expr(f"shiftrightunsigned({x}, {_WIDTH * b}) & {mask}L")
    blocks = lambda x: F.array(*[block(x, b) for b in range(BLOCKS)])

    listed = bags.select("*", F.posexplode(blocks("fingerprint")).alias("block", "value"))
    listed = listed.withColumn("value", F.explode(F.transform(F.array(*map(F.lit, _FLIPS.tolist())), lambda f: f.bitwiseXOR(F.col("value")))))
    listed = listed.select("item_id", "size", "block", "value", F.col("fingerprint").alias("item_fingerprint"))
    windows = _windows(docs, sizes, slots).select("*", F.posexplode(blocks("fingerprint")).alias("block", "value"))
    # the list is thousands of times the items, which the planner does not see: no broadcast
    pairs = windows.join(listed.hint("merge"), ["size", "block", "value"])
    apart = F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))
    pairs = pairs.withColumn("apart", apart).withColumn("distance", F.bit_count("apart").cast("int")).filter(F.col("distance") <= RADIUS)
    # a pair that meets in several blocks counts in the first of them
    meets = F.transform(blocks("apart"), lambda x: F.bit_count(x) <= RADIUS // BLOCKS)
    pairs = pairs.filter(F.array_position(meets, True) == F.col("block") + 1)
    items = bags.select("item_id", F.col("hashes").alias("item_hashes"), F.col("weights").alias("item_weights"))
    found = _verified(pairs.join(items, "item_id"))
    best = F.max_by(F.struct("start", "size", "distance"), F.struct("similarity", -F.col("start")))
    return (
        found.groupBy("doc_id", "item_id")
        .agg(F.max("similarity").alias("similarity"), best.alias("best"), F.count("*").alias("n_windows"))
        .select("doc_id", "item_id", "best.start", F.col("best.size").alias("n_words"), "best.distance", "similarity", "n_windows")
    )
