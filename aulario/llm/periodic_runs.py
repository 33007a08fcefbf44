"""Find every periodic run of words in every text, and drop what repeats.

A run is a stretch of words with a smallest period q (words q apart are equal) of at least ``SHORTEST``
words and two periods that no neighbouring word extends. Words are compared by 64-bit hashes that also
hold the document, so nothing is equal across texts.

* Periods below ``LAG`` are found by comparing the words with themselves at every such lag.
* A scale P covers the periods from P to below 2P. The grams of P/2 words are hashed, and the least
  hash of every window of P/4 grams is its minimizer. Inside a run the window one period later holds
  the same grams, so its minimizer lies one period later: pairs of equal minimizers between P and 2P
  apart are the seeds. Each is extended to both sides by comparing hashes of spans, doubling the step.
* Grams with a period of P/8 or less of their own (up to half of a gram) would be minimizers over and
  over. They lie in runs found at smaller scales and are left out; all others recur at least P/4 apart,
  so a minimizer has at most eight partners. A run all of whose first period is such a run of a smaller
  period d has a second one of the same period right behind it, as otherwise d were its own period; for
  neighbouring runs of the same words the periods follow from their ends.
* Of runs with the same two ends the smallest period counts. Runs of the scales are compared word by
  word in the end; if span hashes ever misled, that lag is scanned directly.

Null texts have no words; repeated rows are judged each; a row without ``doc_id`` keeps its null. Work
grows with n log n for a text of n words, memory with the longest text of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aulario.llm.text import flat, mix, sliced, span_hashes, words

#: Fewest words of a run.
SHORTEST = 12
#: Periods below this are scanned lag by lag; the first scale. A power of two.
LAG = 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _stretches(h: np.ndarray, lag: int, shortest: int) -> np.ndarray:
    """Rows (start, end, lag) of maximal stretches whose words equal those ``lag`` later."""
    need = max(shortest, 2 * lag) - lag
    at = np.flatnonzero(h[lag:] == h[:-lag]) if len(h) > lag else np.empty(0, np.int64)
    if len(at) < need or not (at[need - 1 :] - at[: len(at) - need + 1] == need - 1).any():
        return np.empty((0, 3), np.int64)
    cut = np.flatnonzero(np.diff(at) != 1)
    first, last = np.append(0, cut + 1), np.append(cut, len(at) - 1)
    long = last - first + 1 >= need
    start, end = at[first[long]], at[last[long]] + 1 + lag
    return np.stack([start, end, np.full(len(start), lag)], 1)


class _Spans:
    """Hashes of any span of a sequence, by running sums of a polynomial."""

    def __init__(self, h: np.ndarray):
        n = len(h) + 1
        power, self.inverse = (np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, b))) for b in (_BASE, _INVERSE))
        self.sums = np.append(np.uint64(0), np.cumsum(h * power[:-1], dtype=np.uint64))

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.inverse[start]

    def common(self, a: np.ndarray, b: np.ndarray, side: int) -> np.ndarray:
        """How many words from ``a`` on (side 1) or before it (side -1) equal those of the later ``b``."""
        room = len(self.sums) - 1 - b if side > 0 else a
        got = np.zeros(len(a), np.int64)
        if not len(a):
            return got
        step = 1 << int(room.max(initial=0)).bit_length()
        while step:
            may = np.flatnonzero(got + step <= room)
            size = got[may] + step
            x, y = (a[may], b[may]) if side > 0 else (a[may] - size, b[may] - size)
            got[may[self.of(x, size) == self.of(y, size)]] += step
            step >>= 1
        return got


def _slide(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Best of every ``width`` (a power of two) values in a row."""
    step = 1
    while step < width:
        values = best(values[:-step], values[step:])
        step *= 2
    return values


def _first_periods(runs: np.ndarray) -> np.ndarray:
    """Of runs with the same ends the one of the smallest period, in the order of start and period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):
        new = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(1))
        runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _seeds(spans: _Spans, left: np.ndarray, known: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal minimizers that are a period of the scale apart; ``left`` words follow each in its text."""
    gram, width = scale // 2, scale // 4
    n = len(left) - gram + 1
    if n < width:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inner = known[(known[:, 2] <= gram // 2) & (known[:, 1] - known[:, 0] >= gram)]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, inner[:, 0], 1)
    np.add.at(edges, inner[:, 1] - gram + 1, -1)
    value = mix(spans.of(np.arange(n), gram))
    value[(left[:n] < gram) | (np.cumsum(edges[:-1]) > 0)] = _NONE
    least = _slide(value, width, np.minimum)
    whole = (left[: len(least)] >= gram + width - 1) & (least != _NONE)
    least = np.where(whole, least, np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero((_slide(padded, width, np.maximum) == value) & (value != _NONE))
    order = np.argsort(value[at], kind="stable")
    at = at[order]
    v = value[at]
    a, b = [], []
    for k in range(1, len(at)):
        near = (v[k:] == v[:-k]) & (at[k:] - at[:-k] < 2 * scale)
        if not near.any():
            break
        near &= at[k:] - at[:-k] >= scale
        a.append(at[:-k][near])
        b.append(at[k:][near])
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _behind(spans: _Spans, known: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places a period apart in runs of the scale that consist of two neighbouring runs of a small period."""
    runs = known[(known[:, 2] <= scale // 4) & (known[:, 1] - known[:, 0] >= scale)]
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    out = []
    meets = np.flatnonzero((runs[1:, 2] == runs[:-1, 2]) & (runs[1:, 0] <= runs[:-1, 1]) & (runs[1:, 0] > runs[:-1, 0]))
    for (s1, e1, d), (s2, e2, _) in zip(runs[meets].tolist(), runs[meets + 1].tolist(), strict=True):
        places = np.arange(e1 - d, e1 - 2 * d, -1)
        same = np.flatnonzero(spans.of(places, d) == spans.of(np.array([s2]), d)[0])
        if not len(same):
            continue
        shift = s2 - int(places[same[0]])
        lowest = scale + (shift - scale) % d
        for q in range(lowest, min(2 * scale - 1, e1 - s1, e2 - s2, (e2 - s1) // 2) + 1, d):
            start, end = max(s1, s2 - q), min(e1, e2 - q) + q
            if end - start >= 2 * q:
                out.append((start, start + q))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def find(h: np.ndarray, begin: np.ndarray, shortest: int = SHORTEST, lag: int = LAG) -> np.ndarray:
    """Rows (start, end, period) of the runs of all texts; text i has the words from begin[i] to begin[i + 1]."""
    sizes = np.diff(begin)
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    h = mix(h ^ mix(doc + np.uint64(1)))
    wanted, shortest = shortest, min(shortest, lag // 2)  # grams of the first scale may lie in shorter runs
    runs = _first_periods(np.concatenate([_stretches(h, q, shortest) for q in range(1, lag)]))
    scale = lag
    while (fits := np.flatnonzero(sizes >= 2 * scale)).size:
        # only the texts that are long enough, one behind the other
        part = np.concatenate([[0], np.cumsum(sizes[fits])])
        shift = np.repeat(begin[fits] - part[:-1], sizes[fits])
        own = h[np.arange(part[-1]) + shift]
        left = np.repeat(part[1:], sizes[fits]) - np.arange(part[-1])
        place = np.searchsorted(begin, runs[:, 0], "right") - 1
        at = np.searchsorted(fits, place)
        inside = (at < len(fits)) & (fits[np.minimum(at, len(fits) - 1)] == place)
        known = runs[inside].copy()
        known[:, :2] -= (begin[fits] - part[:-1])[at[inside], None]
        spans = _Spans(own)
        pairs = (_seeds(spans, left, known, scale), _behind(spans, known, scale))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        q = b - a
        start, end = a - spans.common(a, b, -1), b + spans.common(a, b, 1)
        found = np.stack([start, end, q], 1)[end - start >= np.maximum(2 * q, shortest)]
        found = _checked(own, part, _first_periods(found), shortest)
        if len(found):
            found[:, :2] += shift[found[:, 0], None]
            runs = _first_periods(np.concatenate([runs, found]))
        scale *= 2
    return runs[runs[:, 1] - runs[:, 0] >= wanted]


def _checked(h: np.ndarray, begin: np.ndarray, runs: np.ndarray, shortest: int) -> np.ndarray:
    """The runs, compared word by word."""
    right, again = [], set()
    for s, e, q in runs.tolist():
        if (h[s : e - q] == h[s + q : e]).all():
            right.append((s, e, q))
        else:
            again.add((int(np.searchsorted(begin, s, "right")) - 1, q))
    for doc, q in again:
        scanned = _stretches(h[begin[doc] : begin[doc + 1]], q, shortest)
        right += [(s + int(begin[doc]), e + int(begin[doc]), q) for s, e, q in scanned.tolist()]
    return _first_periods(np.array(right, np.int64).reshape(-1, 3))


def _dropped(runs: np.ndarray, first: int, n: int) -> np.ndarray:
    """Which of the ``n`` words from ``first`` on lie in a run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2] - first, 1)
    np.add.at(edges, runs[:, 1] - first, -1)
    return np.cumsum(edges[:-1]) > 0


def runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row.

    ``runs`` holds start, length and period in words, ordered by start and period; ``collapsed`` the
    words that no run repeats, joined by single spaces.
    """
    schema = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1):
                data, offsets = flat(part.column(1))
                starts, ends, doc = words(data, offsets)
                begin = np.searchsorted(doc, np.arange(len(offsets)))
                found = find(span_hashes(data, starts, ends), begin, shortest)
                owner = np.searchsorted(found[:, 0], begin)
                kept = []
                for i, text in enumerate(pc.fill_null(part.column(1), "").cast(pa.binary()).to_pylist()):
                    own = text.split()  # bytes split at ASCII white space only
                    if owner[i] < owner[i + 1]:
                        gone = _dropped(found[owner[i] : owner[i + 1]], begin[i], len(own))
                        own = [own[j] for j in np.flatnonzero(~gone).tolist()]
                    kept.append(b" ".join(own))
                local = found[:, 0] - np.repeat(begin[:-1], np.diff(owner))
                flat_runs = pa.StructArray.from_arrays(
                    [pa.array(x) for x in (local, found[:, 1] - found[:, 0], found[:, 2])], fields=list(entry)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(begin)),
                        pa.ListArray.from_arrays(pa.array(owner, pa.int32()), flat_runs),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where a tenth of the documents, told by a checksum of the id, repeat some of their words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    all_words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words").cast("long")
    first = F.when(n > 0, F.col("g") % n)
    d = docs.select("doc_id", "text", h.alias("h")).withColumn("g", F.expr("h div 10"))
    d = d.withColumn("words", F.when(F.col("h") % 10 == 0, all_words)).withColumn("a", first)
    d = d.withColumn("p", 1 + F.expr("(size(words) - a) div (3 + g % 8)"))

    def planted(w: Column, i: Column) -> Column:
        return F.when(i >= F.col("a"), F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(w)

    return d.select("doc_id", F.when(n > 0, F.array_join(F.transform("words", planted), " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and checksums of runs and collapsed text."""
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("q")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    d = found.withColumn("longest", F.array_min(order))
    return d.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.s").alias("start"),
        (-F.col("longest.l")).alias("length"),
        F.col("longest.q").alias("period"),
        F.expr("1000 * -longest.l div longest.q").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
