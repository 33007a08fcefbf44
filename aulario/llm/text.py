"""Whole texts as numpy arrays: words, hashes of words, shingles.

Arrow batches hold the bytes of many texts one after the other; everything here works on such a run
of bytes at once, with ``offsets`` telling where each text starts. Words are runs of bytes other than
ASCII white space, which never cut a UTF-8 character.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text worked on at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 21
#: Bytes of rows sent to a Python worker at once, a few slices; one longer row makes a batch of its own.
BATCH_BYTES = 4 * SLICE_BYTES

_INK = np.ones(256, bool)
_INK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the Python workers learn where this package lies."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)
    return in_small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def in_small_batches(spark: SparkSession) -> SparkSession:
    """Hold the rows on their way to a Python worker to ``BATCH_BYTES``, whatever their number (64 MB by default).

    Both ends of the way keep a batch whole, with room to grow, for each task.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shards(spark: SparkSession) -> int:
    """Partitions to deal work into; follows the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null is the empty text."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``limit`` bytes of text; no text is cut.

    What Arrow holds beyond the arrays in use goes back to the system after each slice: workers stay for the next
    stages, and what all of an executor's workers hold adds up.
    """
    if not batch.num_rows:
        return
    _, offsets = flat(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        pa.default_memory_pool().release_unused()
        first = last


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes unchanged."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word."""
    ink = _INK[data]
    edges = offsets[:-1][offsets[1:] > offsets[:-1]]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    first[edges] = ink[edges]
    last[:-1] &= ~ink[1:]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[ends] = ink[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        pair = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _powers[size] = (pair[0], pair[1])
    return _powers[size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of every span, from one running polynomial."""
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=running[1:])
    h = (running[ends] - running[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words, and the number of its first word."""
    if len(h) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    s = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        s = s * np.uint64(0x9FB21C651E98DF25) + h[j : len(h) - k + 1 + j]
    at = np.flatnonzero(doc[: len(h) - k + 1] == doc[k - 1 :])
    return mix(s[at]), at
