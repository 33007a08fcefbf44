"""Find windows of symbols that occur more than once in a corpus, without comparing all with all.

Every window of ``width`` symbols has an anchor: the run of ``k`` symbols in it whose hash is smallest
(the leftmost of equals). Equal windows have equal anchors, so work can be dealt out by anchor:

1. every bucket of documents sends the names of its anchors to shards, each once, which report those
   seen more than once;
2. buckets send, for each reported anchor, the stretch of text whose windows have that anchor;
   equal stretches of a bucket are sent once;
3. a shard builds an index of its stretches, streams them through it, and returns the windows to mark;
4. documents cut what is marked.

Each step is a shuffle by a hash of content or of row, so a hot document, source or passage spreads;
equal stretches are merged before they are dealt. Rows are known by a hash of id and text, and equal
rows are treated alike. What is sent for an anchor does not depend on the number of shards. The longer
the anchors, the fewer are shared by chance: that share grows with the corpus, and only the index can
tell that such stretches have no window in common.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulario.llm.text import flat, shards, sliced

#: Buckets of documents per shuffle partition, and parts in which a shard's anchors are indexed: one is
#: held in memory at a time.
BUCKETS, PARTS = 4, 16
NEVER = np.iinfo(np.int64).max
#: Symbols hashed at once, so that what is worked on stays in the cache.
_BLOCK = 1 << 15


@dataclass(frozen=True)
class Plan:
    """What a repeat is. ``symbols`` gives symbols and text offsets (in symbols) of a slice of texts;
    ``grams`` the hash of every run of ``k`` of them. ``mark`` gets an index shard's stretches, their
    starts, the first document of each and whether several hold it, and returns the windows to mark.
    ``distinct``: only other documents count. ``kind``: how symbols are stored."""

    width: int
    k: int
    symbols: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]
    grams: Callable[[np.ndarray, int], np.ndarray]
    mark: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]
    distinct: bool
    kind: type

    @property
    def itemsize(self) -> int:
        return np.dtype(self.kind).itemsize


def segments(plan: Plan, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last window, text number and anchor hash of every maximal run of windows with one anchor."""
    n, width, span = len(symbols), plan.width, plan.width - plan.k + 1
    none = np.empty(0, np.int64)
    if n < width:
        return none, none, none, none.astype(np.uint64)
    hashes = np.empty(n - plan.k + 1, np.uint64)
    anchor = np.empty(n - width + 1, np.uint32)
    for at in range(0, len(anchor), _BLOCK):
        h = plan.grams(symbols[at : at + _BLOCK + width - 1], plan.k)
        hashes[at : at + len(h)] = h
        low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(at, at + len(h), dtype=np.uint64)
        step = 1
        while 2 * step <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < span:
            low = np.minimum(low[: step - span], low[span - step :])
        anchor[at : at + _BLOCK] = low
    # windows that begin in the last symbols of a text do not fit; they part the runs of two texts
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, np.maximum(offsets[:-1], offsets[1:] - width + 1), 1)
    np.add.at(edge, offsets[1:], -1)
    fits = np.cumsum(edge[: len(anchor)], dtype=np.int8) == 0
    new = anchor[1:] != anchor[:-1]
    head, tail = fits.copy(), fits.copy()
    head[1:] &= new | ~fits[:-1]
    tail[:-1] &= new | ~fits[1:]
    begin = np.flatnonzero(head)
    return begin, np.flatnonzero(tail), np.searchsorted(offsets, begin, "right") - 1, hashes[anchor[begin]]


def _split(ids: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Arrays cut by the value of ``ids``."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)])
    ends = np.append(first[1:], len(ids))[: len(first)]
    columns = [c[order] for c in columns]
    for v, a, b in zip(ids[first], first, ends, strict=True):
        yield int(v), *(c[a:b] for c in columns)


def _small(ids: np.ndarray, most: int) -> np.ndarray:
    """Whole numbers below ``most`` in a kind that is sorted fast if they are few."""
    return ids.astype(np.uint16 if most <= 1 << 16 else np.int64)


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), dtype)


def _table(rows: list[tuple], names: str, kinds: list[pa.DataType]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.table({c: pa.array(v, k) for c, v, k in zip(names.split(), columns, kinds, strict=True)})


def _packed(rows: np.ndarray) -> bytes:
    """Rows of bytes, compressed column by column."""
    return pa.Codec("zstd").compress(rows.T.tobytes(), asbytes=True)


def _unpacked(packed: list[bytes], sizes: list[int], width: int) -> np.ndarray:
    """All rows of ``_packed``, as one array."""
    codec = pa.Codec("zstd")
    blocks = [np.frombuffer(codec.decompress(p, n * width, asbytes=True), np.uint8).reshape(width, n).T for p, n in zip(packed, sizes, strict=True)]
    return np.concatenate([np.empty((0, width), np.uint8), *blocks])


def _bytes(column: np.ndarray, kind) -> np.ndarray:
    """Values as rows of bytes."""
    return np.ascontiguousarray(column, kind).view(np.uint8).reshape(len(column), np.dtype(kind).itemsize)


def _values(rows: np.ndarray, kind) -> np.ndarray:
    return np.ascontiguousarray(rows).view(kind).ravel()


def _names(h: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of an anchor, and its name there; two anchors with one name only mean a stretch more to look at."""
    return ((h >> np.uint64(32)) % np.uint64(n_shards) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _slices(docs: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in docs.select(["doc_id", "text", "rid"]).combine_chunks().to_batches():
        yield from sliced(batch, 1)


def _once(name: np.ndarray) -> np.ndarray:
    """The different values of a sorted array."""
    return name[np.append(True, name[1:] != name[:-1])[: len(name)]]


def _anchors(plan: Plan, n_shards: int):
    def run(docs: pa.Table) -> pa.Table:
        names, own, before = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        for part in _slices(docs):
            _, _, doc, h = segments(plan, *plan.symbols(part))
            names.append(_names(h, n_shards))
            own.append(doc + before)
            before += part.num_rows
        name = np.concatenate(names)
        held = np.sort(name)
        twice = _once(held[1:][held[1:] == held[:-1]])
        if plan.distinct and len(twice):  # in one document more than once does not count
            at = np.flatnonzero(_among(name, twice))
            again, doc = name[at], np.concatenate(own)[at]
            order = np.argsort(again, kind="stable")  # documents stay in order
            again, doc = again[order], doc[order]
            twice = _once(again[1:][(again[1:] == again[:-1]) & (doc[1:] != doc[:-1])])
        bucket = docs["bucket"][0].as_py() if docs.num_rows else 0
        ends = np.arange(n_shards + 1, dtype=np.uint64) << np.uint64(32)
        held = _once(held)
        a, b = np.searchsorted(held, ends), np.searchsorted(twice, ends)
        held, twice = held.astype(np.uint32), twice.astype(np.uint32)
        rows = [(i, bucket, held[a[i] : a[i + 1]].tobytes(), twice[b[i] : b[i + 1]].tobytes()) for i in np.flatnonzero(a[1:] > a[:-1]).tolist()]
        return _table(rows, "shard bucket keys twice", [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    return run


def _repeated():
    def run(shard: tuple, table: pa.Table) -> pa.Table:
        buckets = table["bucket"].to_numpy().astype(np.uint64)
        keys, twice = ([np.frombuffer(x, np.uint32) for x in table[c].to_pylist()] for c in ("keys", "twice"))
        bucket = np.repeat(buckets, [len(x) for x in keys])
        key = np.concatenate([np.empty(0, np.uint32), *keys]).astype(np.uint64)
        held = np.sort(key << np.uint64(32) | bucket)
        key = held >> np.uint64(32)
        same = key[1:] == key[:-1]
        shared = np.zeros(len(key), bool)
        shared[1:] |= same
        shared[:-1] |= same
        shared |= _among(key, np.unique(np.concatenate([np.empty(0, np.uint32), *twice])).astype(np.uint64))
        held = held[shared]
        held = np.sort(held << np.uint64(32) | held >> np.uint64(32))
        rows = [(b, shard[0].as_py(), k.astype(np.uint32).tobytes()) for b, k in _runs(held)]
        return _table(rows, "bucket shard keys", [pa.int32(), pa.int32(), pa.binary()])

    return run


def _runs(held: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A sorted array cut by the upper half of its values."""
    upper = held >> np.uint64(32)
    first = np.flatnonzero(np.append(True, upper[1:] != upper[:-1])[: len(upper)])
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(held)], strict=False):
        yield int(upper[a]), held[a:b]


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``wanted``; most others are told by a few of their bits."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    bits = min(max(16, 4 + len(wanted).bit_length()), 24)
    some = np.zeros(1 << bits, bool)

    def slot(x: np.ndarray) -> np.ndarray:
        return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    some[slot(wanted)] = True
    found = some[slot(values)]
    at = np.flatnonzero(found)
    near = np.searchsorted(wanted, values[at])
    found[at] = wanted[np.minimum(near, len(wanted) - 1)] == values[at]
    return found


_STRETCHES = "shard int, bucket int, n int, symbols binary, held binary, marks binary"
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
#: Stored kinds of a stretch's values: length, anchor, first document, row, start, whether several hold it;
#: and of a span's: row, start, end. Rows are numbered by their place among the sorted rids of a bucket.
_HELD = (np.uint16, np.uint32, np.int64, np.uint32, np.uint32, np.uint8)
_SPAN = (np.uint32, np.uint32, np.uint32)


def _rows(kinds: tuple, *columns: np.ndarray) -> np.ndarray:
    return np.concatenate([_bytes(c, k) for c, k in zip(columns, kinds, strict=True)], axis=1)


def _columns(kinds: tuple, rows: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum([0, *(np.dtype(k).itemsize for k in kinds)])
    return [_values(rows[:, a:b], k) for k, a, b in zip(kinds, ends, ends[1:], strict=False)]


def _width(kinds: tuple) -> int:
    return sum(np.dtype(k).itemsize for k in kinds)


def _texts(plan: Plan, symbols: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Stretches that lie one after the other."""
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]) * plan.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(symbols)])


def _stretches(plan: Plan, n_shards: int):
    longest = 2 * plan.width - plan.k

    def run(docs: pa.Table, reported: pa.Table) -> pa.Table:
        shard = np.repeat(reported["shard"].to_numpy().astype(np.uint64), [len(x) // 4 for x in reported["keys"].to_pylist()])
        wanted = np.sort(shard << np.uint64(32) | _joined(reported["keys"], np.uint32).astype(np.uint64))
        rids = np.unique(docs["rid"].to_numpy())
        texts, places = [], []
        for part in _slices(docs) if len(wanted) else ():
            symbols, offsets = plan.symbols(part)
            begin, end, doc, h = segments(plan, symbols, offsets)
            name = _names(h, n_shards)
            hit = np.flatnonzero(_among(name, wanted))
            begin, own = begin[hit], doc[hit]
            length = end[hit] + plan.width - begin
            padded = np.append(symbols, np.zeros(longest, plan.kind))
            every = np.lib.stride_tricks.sliding_window_view(padded, longest)[begin]
            texts.append(every[np.arange(longest) < length[:, None]])
            numbers = pc.fill_null(part.column(0), NEVER).to_numpy(zero_copy_only=False)
            row = np.searchsorted(rids, part.column(2).to_numpy(zero_copy_only=False))
            places.append((length, name[hit], numbers[own], row[own], begin - offsets[own]))
        if not places:
            return _table([], _fields(_STRETCHES), _KINDS)
        length, name, number, row, start = (np.concatenate(x) for x in zip(*places, strict=True))
        text = _texts(plan, np.concatenate(texts).astype(plan.kind), length)
        del texts, places
        # the first place of each stretch stays, others are marked on the way
        coded = text.dictionary_encode()
        which, count = coded.indices.to_numpy(), len(coded.dictionary)
        times = np.bincount(which, minlength=count)
        if plan.distinct:
            first = np.full(count, NEVER)
            np.minimum.at(first, which, number)
            mark = number > first[which]
            stay = np.flatnonzero(~mark)
            several = np.zeros(len(which), bool)
        else:
            several = times[which] > 1
            mark = several
            stay = np.sort(np.unique(which, return_index=True)[1])
        bucket = int(docs["bucket"][0].as_py())
        rows = []
        shard = _small(name[stay] >> np.uint64(32), n_shards)
        order = np.argsort(shard, kind="stable")
        stay, shard = stay[order], shard[order].astype(np.uint64) << np.uint64(32)
        text = text.take(pa.array(stay))
        _, ends, data = text.buffers()
        ends = np.frombuffer(ends, np.int64)
        held = _rows(_HELD, length[stay], name[stay] & np.uint64(0xFFFFFFFF), number[stay], row[stay], start[stay], several[stay])
        a = 0
        for i, own in _runs(shard):
            b = a + len(own)
            symbols = data.slice(int(ends[a]), int(ends[b] - ends[a]))
            symbols = pa.Codec("zstd").compress(symbols, asbytes=True) if plan.itemsize == 1 else symbols.to_pybytes()
            rows.append((i, bucket, b - a, symbols, _packed(held[a:b]), None))
            a = b
        if mark.any():
            spans = merged(_placed(row[mark], start[mark], length[mark]))
            rows.append((bucket % n_shards, bucket, len(spans), None, None, _spans(spans)))
        return _table(rows, _fields(_STRETCHES), _KINDS)

    return run


def _fields(schema: str) -> str:
    return " ".join(f.split()[0] for f in schema.split(", "))


def _placed(row: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Spans of all rows of a bucket on one line, with the number of the row in the upper half."""
    begin = (row.astype(np.int64) << 32) + start
    return np.column_stack([begin, begin + length])


def _spans(spans: np.ndarray) -> bytes:
    row = spans[:, 0] >> 32
    return _packed(_rows(_SPAN, row, spans[:, 0] - (row << 32), spans[:, 1] - (row << 32)))


def _unplaced(packed: list[bytes], sizes: list[int]) -> np.ndarray:
    row, start, end = (x.astype(np.int64) for x in _columns(_SPAN, _unpacked(packed, sizes, _width(_SPAN))))
    return _placed(row, start, end - start)


def _found(plan: Plan, held: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and spans of the stretches of a shard; a part of its anchors is indexed at a time."""
    sizes = held["n"].to_pylist()
    bucket = np.repeat(held["bucket"].to_numpy(), sizes)
    blocks = [_columns(_HELD, _unpacked([p], [n], _width(_HELD))) for p, n in zip(held["held"].to_pylist(), sizes, strict=True)]
    length, anchors, docs, row, starts, several = (np.concatenate(x) for x in zip(*blocks, strict=True))
    texts = held["symbols"].to_pylist()
    if plan.itemsize == 1:
        codec = pa.Codec("zstd")
        texts = [codec.decompress(t, int(b[0].sum(dtype=np.int64)), asbytes=True) for t, b in zip(texts, blocks, strict=True)]
    del blocks
    # each different stretch once: its first document, how often it is held, its anchor
    coded = _texts(plan, np.frombuffer(b"".join(texts), plan.kind), length).dictionary_encode()
    del texts
    which, different = coded.indices.to_numpy(), coded.dictionary
    first = np.full(len(different), NEVER)
    np.minimum.at(first, which, docs)
    times = np.bincount(which, 1 + several.astype(np.int64), len(different)).astype(np.int64)
    anchor = np.zeros(len(different), np.uint32)
    anchor[which] = anchors
    whole = docs > first[which] if plan.distinct else times[which] > 1
    spans = [_placed(row[whole], starts[whole], length[whole])]
    buckets = [bucket[whole]]
    # others may share windows with another stretch of the same anchor: those go through the index
    _, group, size = np.unique(anchor, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(size[group] > 1)
    runs = [np.empty((0, 3), np.int64)]
    for _, index in _split(_small(anchor[shared] % np.uint32(PARTS), PARTS), shared):
        own = different.take(pa.array(index))
        _, ends, data = own.buffers()
        begin = np.frombuffer(ends, np.int64) // plan.itemsize
        hit = plan.mark(np.frombuffer(data, plan.kind, begin[-1]), begin, first[index], times[index] > 1, plan.width)
        own = np.searchsorted(begin, hit, "right") - 1
        head = np.ones(len(hit), bool)
        head[1:] = (hit[1:] != hit[:-1] + 1) | (own[1:] != own[:-1])
        a = np.flatnonzero(head)
        b = np.append(a[1:], len(hit)) - 1 if len(hit) else a
        runs.append(np.column_stack([index[own[a]], hit[a] - begin[own[a]], hit[b] - begin[own[a]] + plan.width]))
    run = np.concatenate(runs)
    run = run[np.argsort(run[:, 0], kind="stable")]
    # every place of such a stretch that is not marked as a whole gets its runs
    rest = np.flatnonzero(~whole)
    low, high = np.searchsorted(run[:, 0], which[rest]), np.searchsorted(run[:, 0], which[rest], "right")
    count = high - low
    place = np.repeat(rest, count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    spans.append(_placed(row[place], starts[place] + run[at, 1], run[at, 2] - run[at, 1]))
    buckets.append(bucket[place])
    return np.concatenate(buckets), np.concatenate(spans)


def _marks(plan: Plan, n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        direct = pc.is_valid(table["marks"])
        known, held = table.filter(direct), table.filter(pc.invert(direct))
        rows = list(zip(*(known[c].to_pylist() for c in ("bucket", "n", "marks")), strict=True))
        if held.num_rows:
            buckets, spans = _found(plan, held)
            rows += [(b, len(own), _spans(own)) for b, own in _split(_small(buckets, n_buckets), spans)]
        return _table(rows, "bucket n spans", [pa.int32(), pa.int32(), pa.binary()])

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching (start, end) rows of one text as maximal runs."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.ones(len(spans), bool)
    head[1:] = spans[1:, 0] > reach[:-1]
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(spans)) - 1
    return np.column_stack([spans[first, 0], reach[last]])


def cut(
    docs: DataFrame,
    plan: Plan,
    keep: Callable[[pa.Table, dict[int, np.ndarray]], pa.Table],
    schema: str,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Mark repeats in ``docs(doc_id, text)`` and let ``keep`` make the result of each bucket of rows.

    ``keep`` gets rows (``doc_id, text, rid`` and the ``extra`` columns) and, for each rid that has any,
    its marked runs.
    """
    dealt = shards(docs.sparkSession)
    n = BUCKETS * dealt
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"), *extra)
    rows = rows.withColumn("bucket", F.pmod("rid", F.lit(n)).cast("int"))
    anchors = rows.groupBy("bucket").applyInArrow(_anchors(plan, dealt), "shard int, bucket int, keys binary, twice binary")
    reported = anchors.groupBy("shard").applyInArrow(_repeated(), "bucket int, shard int, keys binary")
    stretches = rows.groupBy("bucket").cogroup(reported.groupBy("bucket")).applyInArrow(_stretches(plan, dealt), _STRETCHES)
    marks = stretches.groupBy("shard").applyInArrow(_marks(plan, n), "bucket int, n int, spans binary")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        spans = _unplaced(right["spans"].to_pylist(), right["n"].to_pylist())
        runs, rids = {}, np.unique(left["rid"].to_numpy())
        if len(spans):
            spans = merged(spans)
            row = spans[:, 0] >> 32
            spans = spans - (row << 32)[:, None]
            runs = {int(rids[r]): own for r, own in _split(row, spans)}
        return keep(left, runs)

    return rows.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(finish, schema)


def classes(symbols: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of stretches: the stretches with a separator (0) after each, the order of all suffixes,
    and for each suffix the class of those equal in ``width`` symbols.

    Ranks by the first symbols are refined, by as many ranks further on as fit into one number, until the
    compared length exceeds every stretch. Nothing after a separator counts; suffixes that are equal up to
    it go by position.
    """
    sizes = np.diff(begin)
    n = int(begin[-1]) + len(sizes)
    ends = begin[1:] + np.arange(len(sizes))
    body = np.ones(n, bool)
    body[ends] = False
    left = np.repeat(ends, sizes + 1) - np.arange(n)  # symbols up to the separator
    if symbols.dtype == np.uint8:
        held = np.zeros(n + 8, np.uint8)
        held[:n][body] = symbols + np.uint8(1)
        word = np.ndarray((n,), np.dtype(">u8"), held.tobytes(), strides=(1,)).astype(np.uint64)
        short = np.flatnonzero(left < 8)
        beyond = (8 * (8 - left[short])).astype(np.uint64)
        word[short] = np.where(left[short] > 0, (word[short] >> beyond % np.uint64(64)) << beyond % np.uint64(64), np.uint64(0))
        rank, length, held = np.unique(word, return_inverse=True)[1], 8, held[:n].astype(np.int64)
    else:
        held = np.zeros(n, np.int64)
        held[body] = np.unique(symbols, return_inverse=True)[1] + 1
        rank, length = held, 1
    rank, equal = rank.astype(np.int64), None

    bits = (n + 1).bit_length()
    fold = max(2, 63 // bits)

    def joined(*shifts: int) -> np.ndarray:
        value = rank
        for shift in shifts:
            after = np.zeros(n, np.int64)
            reach = np.flatnonzero(left >= shift)
            after[reach] = rank[reach + shift] + 1
            value = (value << bits) | after
        return np.unique(value, return_inverse=True)[1].astype(np.int64)

    longest = int(sizes.max(initial=0)) + 1
    while True:
        if equal is None and width <= fold * length:
            equal = joined(*range(length, width - length, length), width - length) if width > length else rank
        if length >= longest and equal is not None:
            return held, np.sort((rank << bits) | np.arange(n)) & ((1 << bits) - 1), equal
        rank = joined(*range(length, fold * length, length))
        length *= fold


def flat_bytes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return flat(part.column(1))
