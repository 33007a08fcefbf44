"""Language-model scores from a probabilistic suffix tree over all words.

Tokens are lower-cased words and one end per text; every word is a symbol. The tree's nodes are contexts
of up to ``DEPTH`` tokens, as many as the training texts have; what precedes a text is an end. A context is
retained if its next-token distribution diverges from that of the context one token shorter by more
than its free parameters pay for (twice the log-likelihood gain against parameters times log count).
The distribution of a retained context is smoothed with ``PRIOR`` pseudo-counts of the shorter one's,
down to the root, the unigram base; a text's tokens are scored by the longest retained suffix. So the
probabilities of a text's continuations sum to at most one.

Counts are exact over all training texts. Slices of texts send each of their words once, dealt by its
hash, and get its count and a number back. Then they deal every token with the two before it by the hash of the
token before, which brings all of a context and of its extensions to one shard. There the contexts are
counted and tested, and each text gets back the sum of what the tree adds to the log-probabilities of
the base. Nothing but two totals reaches the driver. :func:`grow` is the same tree in dense form, for a
small number of symbols; the tests hold the dealt one against it.

A slice must come out the same when the table is read again, which is checked by a sum of its words.
Null texts are empty: their only token is the end. A null id counts as the empty string in the folds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulario.llm.text import SLICE_BYTES, flat, lower, shards, sliced, span_hashes, words
from aulario.plans.staging import stage

#: Symbols of the dense form, and the longest context of both.
SYMBOLS, DEPTH = 192, 2
PRIOR = 10.0
END = np.uint64(0x0E4D)
FOLDS, HELD_OUT = 5, 1
#: Longer slices than elsewhere, as a word is sent once a slice, and just below a power of two for the hashes' tables.
BYTES = 2 * SLICE_BYTES - 2
#: Shards to a partition, so that a shard's contexts fit beside other workers.
FINER = 2

_CODEC = pa.Codec("zstd", compression_level=1)
_HEAD = np.dtype([("id", "i8"), ("null", "u1"), ("held", "u1"), ("n", "i8"), ("known", "i8"), ("base", "f8")])


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every token, an end after each text."""
    data, offsets = flat(part.column(1))
    data = lower(data)
    starts, ends, doc = words(data, offsets)
    texts = np.arange(len(offsets) - 1)
    after = np.searchsorted(doc, texts, "right")
    return np.insert(span_hashes(data, starts, ends), after, END), np.insert(doc, after, texts)


def _states(symbols: np.ndarray, end: int) -> np.ndarray:
    """Number of (context, next symbol) at every place; what precedes a text is the end of another."""
    padded = np.concatenate([np.full(DEPTH, end), symbols])
    first = np.flatnonzero(np.concatenate([[True], symbols[:-1] == end]))
    state = np.zeros(len(symbols), np.int64)
    for k in range(DEPTH + 1):
        state = state * SYMBOLS + padded[k : k + len(symbols)]
    # no context reaches into the text before: its places hold the end there
    for k in reversed(range(DEPTH - 1)):
        at = first + k
        at = at[at < len(symbols)]
        value = np.zeros(len(at), np.int64)
        for back in reversed(range(DEPTH + 1)):
            value = value * SYMBOLS + (end if back > k else symbols[at - back])
        state[at] = value
    return state


def grow(counts: np.ndarray) -> np.ndarray:
    """Log10 probability of every (context, next symbol) by its longest retained suffix."""
    table = counts.reshape(-1, SYMBOLS).astype(np.float64)
    root = table.sum(0) + 0.5
    p = (root / root.sum()).reshape(1, SYMBOLS)
    for depth in range(1, DEPTH + 1):
        n = table.reshape(-1, SYMBOLS**depth, SYMBOLS).sum(0)
        p = np.tile(p, (len(n) // len(p), 1))
        total = n.sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(n > 0, n * np.log(n / total / p), 0).sum(1)
        free = (n > 0).sum(1) - 1
        kept = (free >= 0) & (2 * gain > free * np.log(np.maximum(total[:, 0], 2)))
        p = np.where(kept[:, None], (n + PRIOR * p) / (total + PRIOR), p)
    return np.log10(p).astype(np.float32).reshape(-1)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])


def _pack(n: np.ndarray) -> bytes:
    """Numbers from 0 on, compressed byte by byte of their places; high bytes that are mostly 0 cost little."""
    width = max(1, (int(n.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(n.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return np.array([len(n), width], "<i8").tobytes() + _CODEC.compress(planes.tobytes(), asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data, "<i8", 2).tolist()
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(_CODEC.decompress(data[16:], n * width, asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<i8").reshape(-1)


def _cuts(names: np.ndarray, n_shards: int) -> np.ndarray:
    """Where the words of each shard begin, and the end."""
    return np.searchsorted((names % np.uint64(n_shards)).astype(np.int64), np.arange(n_shards + 1))


def _vocabulary(h: np.ndarray, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words in order of their shards, and the number of each token among them."""
    names, at = np.unique(h, return_inverse=True)
    order = np.argsort(names % np.uint64(n_shards), kind="stable")
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    return names[order], place[at]


def _mark(names: np.ndarray) -> int:
    return int(names.sum(dtype=np.uint64).view(np.int64))


_WORDS = "shard int, slice bigint, words binary, times binary"


def _words(docs: DataFrame, n_shards: int) -> DataFrame:
    """Each slice's words with how often its training texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1, BYTES):
                h, doc = _tokens(part)
                names, at = _vocabulary(h, n_shards)
                train = part.column(2).to_numpy(zero_copy_only=False).astype(bool)[doc]
                times, cuts, key = np.bincount(at[train], minlength=len(names)), _cuts(names, n_shards), part.column(3)[0].as_py()
                spans = [(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
                yield _batch([(i, key, names[a:b].tobytes(), _pack(times[a:b])) for i, a, b in spans], _WORDS)

    return docs.mapInArrow(run, _WORDS)


_COUNTS = "slice bigint, shard int, ranks binary, counts binary, mark bigint, n bigint, v bigint"


def _counted(table: pa.Table) -> pa.Table:
    """Counts over all training texts of a shard's words, and their ranks by them, in the order of each slice."""
    rows = table.to_pylist()
    held = [np.frombuffer(r["words"], np.uint64) for r in rows]
    names, at = np.unique(np.concatenate(held), return_inverse=True)
    times = np.concatenate([_unpack(r["times"]) for r in rows])
    count = np.bincount(at, times, len(names)).astype(np.int64)
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(names))
    ends, out = np.cumsum([len(w) for w in held]), []
    for r, w, e in zip(rows, held, ends, strict=True):
        first = r is rows[0]
        n, v = (int(count.sum()), int((count > 0).sum())) if first else (0, 0)
        own = at[e - len(w) : e]
        out.append((r["slice"], r["shard"], _pack(rank[own]), _pack(count[own]), _mark(w), n, v))
    return pa.Table.from_batches([_batch(out, _COUNTS)])


_TEXTS = "slice bigint, shard int, ranks binary, counts binary, mark bigint, head binary, cuts binary, marks binary, tokens binary, stop bigint"


def _texts(docs: DataFrame, n_shards: int) -> DataFrame:
    """Each slice as one row: its texts, how its words are dealt, and its tokens as numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1, BYTES):
                h, doc = _tokens(part)
                names, at = _vocabulary(h, n_shards)
                ids, head = part.column(0), np.zeros(part.num_rows, _HEAD)
                head["id"], head["null"] = ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()).astype(np.uint8)
                head["held"] = 1 - part.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
                head["n"] = np.bincount(doc, minlength=part.num_rows)
                cuts, stop = _cuts(names, n_shards), int(np.flatnonzero(names == END)[0])
                marks = np.array([_mark(names[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                row = (part.column(3)[0].as_py(), *[None] * 4, head.tobytes(), _pack(cuts), marks.tobytes(), _pack(at), stop)
                yield _batch([row], _TEXTS)

    return docs.mapInArrow(run, _TEXTS)


_DEALT = "shard int, slice bigint, head binary, words binary, counts binary, events binary, texts binary, sizes binary"


def _dealing(n_shards: int, below: float) -> Callable[[pa.Table], pa.Table]:
    """A slice's base scores, and its tokens by the shard of the token before."""

    def deal(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["head"] is not None)
        key, head, end = own["slice"], np.frombuffer(own["head"], _HEAD).copy(), own["stop"]
        at, cuts, marks = _unpack(own["tokens"]), _unpack(own["cuts"]), np.frombuffer(own["marks"], np.int64)
        count, ids = np.full(cuts[-1], -1), np.zeros(cuts[-1], np.int64)
        for r in rows:
            if r["counts"] is not None:
                i = r["shard"]
                if r["mark"] != marks[i]:
                    raise RuntimeError("a slice of texts differs from the one whose words were counted")
                count[cuts[i] : cuts[i + 1]] = _unpack(r["counts"])
                ids[cuts[i] : cuts[i + 1]] = _unpack(r["ranks"]) * n_shards + i
        if count.min() < 0:
            raise RuntimeError("words of a slice of texts were not counted")
        doc = np.repeat(np.arange(len(head)), head["n"])
        logs = np.log10((count + 0.5) / below)
        head["base"], head["known"] = np.bincount(doc, logs[at], len(head)), np.bincount(doc, count[at] > 0, len(head))
        before = np.append(end, at[:-1])
        second = np.concatenate([[end], before[:-1]])
        second[np.cumsum(head["n"]) - head["n"]] = end
        shard = (ids % n_shards).astype(np.int32)[before]
        order = np.argsort(shard, kind="stable")
        order = order[count[before[order]] > 0]  # a context that no training text has is not retained
        ends = np.searchsorted(shard[order], np.arange(n_shards + 1))
        number = np.empty(len(ids), np.int64)
        out = [(int(key % n_shards), key, head.tobytes(), *[None] * 5)]
        for i in range(n_shards):
            e = order[ends[i] : ends[i + 1]]
            if len(e):
                event = np.concatenate([second[e], before[e], at[e]])
                used = np.unique(event)
                used = used[np.argsort(ids[used])]
                number[used] = np.arange(len(used))
                texts, sizes = np.unique(doc[e], return_counts=True)
                texts = 2 * texts + 1 - head["held"][texts]
                data = (np.diff(ids[used], prepend=0), count[used], number[event], texts, sizes)
                out.append((i, key, None, *map(_pack, data)))
        return pa.Table.from_batches([_batch(out, _DEALT)])

    return deal


def _retained(context: np.ndarray, n: np.ndarray, p: np.ndarray, contexts: int) -> np.ndarray:
    """Probability of each (context, next token), given its count and that by the shorter context."""
    total = np.bincount(context, n, contexts)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.bincount(context, np.where(n > 0, n * np.log(n / total[context] / p), 0), contexts)
    free = np.bincount(context, n > 0, contexts) - 1
    kept = (free >= 0) & (2 * gain > free * np.log(np.maximum(total, 2)))
    return np.where(kept[context], (n + PRIOR * p) / (total[context] + PRIOR), p)


_SUMS = "slice bigint, head binary, texts binary, sums binary"


def _growing(below: float) -> Callable[[pa.Table], pa.Table]:
    """What the contexts of a shard add to the base scores of each slice's texts."""

    def tree(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        held = []
        for r in table.to_pylist():
            if r["head"] is not None:
                out.append((r["slice"], r["head"], None, None))
                continue
            w, count, event, texts, sizes = (_unpack(r[c]) for c in ("words", "counts", "events", "texts", "sizes"))
            held.append((r["slice"], np.cumsum(w), count, event.astype(np.int32), texts, sizes))
        if not held:
            return pa.Table.from_batches([_batch(out, _SUMS)])
        names, at = np.unique(np.concatenate([x[1] for x in held]), return_inverse=True)
        count = np.zeros(len(names), np.int64)
        count[at] = np.concatenate([x[2] for x in held])
        at = at.astype(np.int32) if len(names) < 1 << 31 else at
        stops = np.cumsum([len(x[1]) for x in held])
        events, train = [], []
        for (_, w, _, event, texts, sizes), stop in zip(held, stops, strict=True):
            events.append(at[stop - len(w) : stop][event].reshape(3, -1))
            train.append(np.repeat((texts & 1).astype(np.uint8), sizes))
        (second, before, token), counted = np.concatenate(events, axis=1), np.concatenate(train)
        held = [(key, texts, sizes) for key, _, _, _, texts, sizes in held]
        del events, train
        base = (count + 0.5) / below
        pair, own = np.unique(before.astype(np.int64) * len(names) + token, return_inverse=True)
        before, token = pair // len(names), pair % len(names)
        p = _retained(before, np.bincount(own, counted, len(pair)), base[token], len(names))
        own += second.astype(np.int64) * len(pair)
        triple, own = np.unique(own, return_inverse=True)
        second, pair = triple // len(pair), triple % len(pair)
        context = np.unique(second * len(names) + before[pair], return_inverse=True)[1]
        p = _retained(context, np.bincount(own, counted, len(triple)), p[pair], int(context.max()) + 1)
        added = np.log10(p / base[token[pair]])[own]
        first = 0
        for key, texts, sizes in held:
            last = first + int(sizes.sum())
            sums = np.add.reduceat(added[first:last], np.cumsum(sizes) - sizes)
            out.append((key, None, _pack(texts >> 1), sums.tobytes()))
            first = last
        return pa.Table.from_batches([_batch(out, _SUMS)])

    return tree


def _together(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    head = np.frombuffer(next(r["head"] for r in rows if r["head"] is not None), _HEAD)
    score = head["base"].copy()
    for r in rows:
        if r["texts"] is not None:
            score[_unpack(r["texts"])] += np.frombuffer(r["sums"], np.float64)
    ids = pa.array(head["id"], mask=head["null"].astype(bool))
    columns = {"doc_id": ids, "held_out": pa.array(head["held"].astype(bool)), "n_tokens": head["n"], "n_known": head["known"]}
    return pa.table({**columns, "base_score": head["base"], "score": score})


def score(docs: DataFrame) -> DataFrame:
    """Base and tree scores of every row; see the module for the model."""
    n = FINER * shards(docs.sparkSession)
    train = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)) != HELD_OUT
    rows = docs.select("doc_id", "text", train.alias("train"), F.monotonically_increasing_id().alias("slice"))
    counts = stage(_words(rows, n).groupBy("shard").applyInArrow(_counted, _COUNTS), "op5-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    tokens, below = int(total["n"]), float(total["n"] + 0.5 * (total["v"] + 1))
    texts = _texts(rows, n).unionByName(counts.drop("n", "v"), allowMissingColumns=True)
    dealt = texts.groupBy("slice").applyInArrow(_dealing(n, below), _DEALT)
    sums = dealt.groupBy("shard").applyInArrow(_growing(below), _SUMS)
    scored = sums.groupBy("slice").applyInArrow(
        _together, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
