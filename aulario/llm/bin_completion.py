"""Pack token sequences of documents into as few fixed-size sequences as possible.

Documents become token ids plus one end id and are cut into pieces of the capacity; only documents
longer than it have more than one piece. Packing needs the number of pieces of each length alone,
which is at most ``capacity`` numbers, so those are all that reaches the driver. There, bin completion
works on whole classes of equal pieces: around the largest piece left, fillings of the rest of its
sequence are searched by branch and bound (larger pieces first, so the first filling is the best-fit
one and serves as incumbent; a branch ends when even all smaller pieces would leave more waste; a
filling is taken up only if nothing more fits and no piece can be exchanged for a larger one). The
filling is used as often as the classes allow. The pieces are then numbered within their class by
Spark, and the number tells sequence and offset.

Null texts are empty documents of one (end) token. Repeated rows are packed each.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from aulario.llm.text import flat, sliced
from aulario.plans.staging import stage

CAPACITY = 2048
END = b"\0\0\0\0"
#: Parts of words whose ids a worker remembers before it forgets the rare ones (a slice of more goes beyond).
REMEMBERED = 400_000
#: Parts looked at at once; what the library returns for one takes about a kB until its ids are taken out.
AT_ONCE = 4096
#: Nodes that one search for a filling may visit; the incumbent is used after that.
NODES = 3000
#: Pieces of one length that are numbered in one task.
RUN = 2_000
#: How a text must be prepared for its words to be cut here (fixed values of this family of vocabularies).
_PREPARED = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
#: Strings that come out of that as one pre-token, unchanged.
_PLAIN = re.compile(r"[a-z]+|[0-9]|[!-&(-/:-@\[-`{-~]+").fullmatch
#: Letters of which each is prepared alone.
_LATIN = re.compile("[a-zÀ-ÖØ-öø-ÿ]+").fullmatch
_LETTER, _DIGIT, _SIGN, _UNSURE = 1, 2, 4, 8
_KIND = np.full(256, _UNSURE, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[ord("'")] = _UNSURE  # it may begin an ending of its own


def _spans(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of spans one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(first - (ends - lengths), lengths) + np.arange(lengths.sum())


def _parts(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words cut between letters, signs and single digits, and where each word's parts begin (one more at the end).

    Only ASCII signs, digits and the letters of Latin-1 are told apart. Words with anything else, with a digit next to
    a letter or with what may begin a special token stay whole.
    """
    data, offsets = flat(words)
    lengths = np.diff(offsets)
    first = np.zeros(len(data), bool)
    first[offsets[:-1][lengths > 0]] = True
    kind = _KIND[data]
    lead = np.flatnonzero(data == 0xC3)  # the letters from U+00C0 on, but for two signs
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    kept = (kind[1:] | kind[:-1] == _LETTER | _DIGIT) | (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    kind[1:][kept & ~first[1:]] = _UNSURE
    whole = np.zeros(len(lengths), bool)
    whole[np.searchsorted(offsets, np.flatnonzero(kind == _UNSURE), "right") - 1] = True
    cuts = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    first[1:] |= cuts & ~np.repeat(whole, lengths)[1:]
    starts = np.flatnonzero(first)
    bounds = np.append(starts, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)), np.searchsorted(starts, offsets)


class WordIds:
    """Ids of words between ASCII white space; no token of such a vocabulary spans white space.

    Most words are cut here where the library cuts them, and each distinct part is merged by its model alone; all
    other parts go through the whole library in lots.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, normalizer, cutter = (getattr(self.tokenizer, n) for n in ("model", "normalizer", "pre_tokenizer"))
        settings = json.loads(self.tokenizer.to_str())
        special = [t["content"] for t in settings["added_tokens"]]
        prepared = settings["normalizer"], settings["pre_tokenizer"]
        self.cuts = prepared == _PREPARED and all("<|" in t and not _PLAIN(t) for t in special)
        letters = filter(_LATIN, map(chr, range(0xC0, 0x100)))
        self.latin = {ord(c): cutter.pre_tokenize_str(normalizer.normalize_str(c))[0][0] for c in letters if self.cuts}
        self.rank: dict[str, int] = {}  # of each remembered part, in the order of the arrays below
        self.ids = np.empty(0, "<u4")  # of all remembered parts, one after the other
        self.first = np.zeros(1, np.int64)  # where those of each begin
        self.uses = np.empty(0, np.int64)  # slices of text a part was in

    def _forget(self) -> None:
        """Drop the parts that were in one slice alone, and the rarer ones of the others beyond half of what fits."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > REMEMBERED // 2:
            kept = np.sort(kept[np.argsort(self.uses[kept], kind="stable")[-(REMEMBERED // 2) :]])
        parts = list(self.rank)
        self.rank = {parts[k]: i for i, k in enumerate(kept.tolist())}
        lengths = np.diff(self.first)[kept]
        self.ids = self.ids[_spans(self.first[kept], lengths)]
        self.first = np.concatenate([[0], np.cumsum(lengths)])
        self.uses = self.uses[kept] // 2  # what was frequent long ago ages

    def _prepared(self, part: str) -> str | None:
        """What the model gets for a part that is one pre-token; none if that is left to the library."""
        if not self.cuts:
            return None
        if _PLAIN(part):
            return part
        return part.translate(self.latin) if _LATIN(part) else None

    def _ranks(self, parts: list[str]) -> np.ndarray:
        """Number of each distinct part among the remembered ones; the others are encoded and remembered."""
        if len(self.rank) + len(parts) > REMEMBERED:
            self._forget()
        ranks = np.fromiter(map(self.rank.get, parts, repeat(-1)), np.int64, len(parts))
        unknown = np.flatnonzero(ranks < 0)
        new = [parts[i] for i in unknown.tolist()]
        ranks[unknown] = np.arange(len(self.rank), len(self.rank) + len(new))
        ids, ends = array("I"), array("q")
        for at in range(0, len(new), AT_ONCE):
            lot = [(p, self._prepared(p)) for p in new[at : at + AT_ONCE]]
            others = iter(self.tokenizer.encode_batch_fast([p for p, own in lot if own is None], add_special_tokens=False))
            for _, own in lot:
                ids.extend(next(others).ids if own is None else [t.id for t in self.model.tokenize(own)])
                ends.append(len(ids))
        self.rank.update(zip(new, range(len(self.rank), len(self.rank) + len(new)), strict=True))
        self.first = np.concatenate([self.first, self.first[-1] + np.array(ends, np.int64)])
        self.ids = np.concatenate([self.ids, np.array(ids, "<u4")])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.uses[ranks] += 1
        return ranks

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (one more at the end).

        Each distinct word of the texts is cut once and each distinct part looked up once; the rest is a gather
        over their places.
        """
        # the vocabulary is lower case; a special token's string must stay as it is
        texts = pc.fill_null(texts, "")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        lists = pc.ascii_split_whitespace(texts)  # blanks at the ends give empty words, which have no ids
        words = lists.flatten().dictionary_encode()
        parts, bounds = _parts(words.dictionary) if self.cuts else (words.dictionary, np.arange(len(words.dictionary) + 1))
        parts = parts.dictionary_encode()
        distinct = pa.ListArray.from_arrays([0, len(parts.dictionary)], parts.dictionary)
        joined = pc.binary_join(distinct, "\n")[0].as_py()  # no part holds white space; far quicker than one by one
        ranks = self._ranks(joined.split("\n") if len(parts) else [])
        ids, bounds = self._gathered(self.ids, self.first, ranks[parts.indices.to_numpy()], bounds)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        return self._gathered(ids, bounds, words.indices.to_numpy(), offsets - offsets[0])

    @staticmethod
    def _gathered(ids: np.ndarray, first: np.ndarray, chosen: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chosen ones, one after the other, and where those of groups of them begin."""
        lengths = np.diff(first)[chosen]
        return ids[_spans(first[chosen], lengths)], np.concatenate([[0], np.cumsum(lengths)])[bounds]


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every row."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = word_ids(path)
        for batch in batches:
            for part in sliced(batch, 1):
                rows = []
                whole, bounds = v.encode(part.column(1))
                for doc, a, b in zip(part.column(0).to_pylist(), bounds, bounds[1:], strict=False):
                    ids = whole[a:b].tobytes() + END
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((doc, p, at // 4, len(own) // 4, zlib.crc32(own)))
                columns = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def _filling(room: int, counts: dict[int, int], lengths: list[int]) -> list[tuple[int, int]]:
    """Least wasteful (length, copies) that go into ``room``; larger lengths first among equals."""
    below = [0]  # all that the shorter lengths could fill
    for n in lengths:
        below.append(below[-1] + n * counts[n])
    best: list = [room + 1, []]
    nodes = 0
    chosen: list[tuple[int, int]] = []

    def dominated(rest: int) -> bool:
        for n, c in chosen:
            j = bisect_right(lengths, n + rest)
            if j and lengths[j - 1] > n and counts[lengths[j - 1]] > dict(chosen).get(lengths[j - 1], 0) and c:
                return True
        return False

    def search(rest: int, end: int) -> None:
        nonlocal nodes
        nodes += 1
        if rest < best[0] and (not best[1] or rest == 0 or not dominated(rest)):
            best[0], best[1] = rest, list(chosen)
        for j in range(bisect_right(lengths, rest, 0, end) - 1, -1, -1):
            if best[0] == 0 or nodes > NODES or rest - below[j + 1] >= best[0]:
                return
            n = lengths[j]
            for copies in range(min(counts[n], rest // n), 0, -1):
                chosen.append((n, copies))
                search(rest - copies * n, j)
                chosen.pop()
                if best[0] == 0 or nodes > NODES:
                    return

    search(room, len(lengths))
    return best[1]


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns of (length, copies) and how many sequences each fills."""
    counts = {n: c for n, c in counts.items() if c}
    lengths = sorted(counts)
    patterns = []
    while lengths:
        largest = lengths[-1]
        counts[largest] -= 1  # its place is taken while the rest is filled
        pattern = dict(_filling(capacity - largest, counts, lengths))
        counts[largest] += 1
        pattern[largest] = pattern.get(largest, 0) + 1
        times = min(counts[n] // c for n, c in pattern.items())
        for n, c in pattern.items():
            counts[n] -= c * times
            if not counts[n]:
                del counts[n], lengths[bisect_right(lengths, n) - 1]
        patterns.append((sorted(pattern.items(), reverse=True), times))
    return patterns


_SLOT = T.StructType(
    [
        T.StructField("length", T.LongType()),
        T.StructField(
            "slots",
            T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("rank", "end", "sequence", "copies", "offset")])),
        ),
    ]
)


def _slots(patterns: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, list[tuple]]]:
    slots: dict[int, list[tuple]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for n, copies in pattern:
            rank = taken.get(n, 0)
            slots.setdefault(n, []).append((rank, rank + copies * times, sequence, copies, offset))
            taken[n] = rank + copies * times
            offset += n * copies
        sequence += times
    return sorted(slots.items())


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece its ``sequence_id`` and ``offset``.

    The slot table has one row per length, at most ``capacity``; a pattern uses up the copies of at
    least one class, so it stays at a few MB whatever the number of pieces and may be broadcast.
    """
    spark = cut.sparkSession
    cut = stage(cut, "op7-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(_slots(complete_bins(counts, capacity)), _SLOT)
    runs = max(1, sum(counts.values()) // RUN)
    cut = cut.withColumn("run", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(runs)))
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    first = cut.groupBy("length", "run").agg(F.count("*").alias("n")).select(
        "length", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    own = Window.partitionBy("length", "run").orderBy("doc_id", "piece")
    ranked = cut.withColumn("k", F.row_number().over(own) - 1).join(first, ["length", "run"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("k")).alias("rank"))
    placed = ranked.join(F.broadcast(slots), "length").withColumn(
        "slot", F.filter("slots", lambda s: (s["rank"] <= F.col("rank")) & (F.col("rank") < s["end"]))[0]
    )
    within = F.col("rank") - F.col("slot.rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("slot.sequence") + F.expr("(rank - slot.rank) div slot.copies")).alias("sequence_id"),
        (F.col("slot.offset") + within % F.col("slot.copies") * F.col("length")).alias("offset"),
    )
