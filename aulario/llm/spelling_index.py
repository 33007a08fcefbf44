"""Group spelling variants: words one code point apart, each led to its most frequent neighbour.

Words are counted over all texts and those that occur often enough form the vocabulary. Each word is
dealt twice, by its front and by its back half (with its length), so that two words one edit apart
share a half of the shorter or equal one: the edit touches only one of them. A shard holds the words
of some halves, written one behind the other with a delimiter around each, as a bidirectional index:
the Burrows-Wheeler transforms of that text and of the reversed text as wavelet matrices. A pattern
and its reverse have intervals of suffix ranks of the same size in both; adding a symbol on either
side narrows the one and shifts the other by the number of smaller symbols in the interval.

Search schemes: one half with its delimiter is matched exactly, then the search turns round and
extends across the other half with exactly one error. For words of equal length an error is any other
symbol found in the interval (all distinct ones come from one descent of the wavelet matrix); for words
shorter by one it is a skipped symbol, once per row of equal symbols. Insertions are those pairs seen
from the other word. What still matches at the far delimiter is one word, named by its rank.

A half that more words share than a shard may hold is cut into parts, and words and questions of it
meet part by part, so that no task holds more. No pairs are compared that the index does not name.

Null and empty texts have no words; repeated rows count each; a row without ``doc_id`` counts with its
words as they are. Very long runs of letters are words like others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulario.llm.fm_index import WaveletMatrix
from aulario.llm.text import flat, lower, shards, sliced, span_hashes
from aulario.plans.staging import stage

#: Shortest word in code points, fewest occurrences, and how much more frequent a form must be.
MIN_LENGTH, MIN_COUNT, FACTOR = 7, 2, 10
#: One in so many (document, word) pairs loses a code point in the contract's input.
DROP_EVERY = 31
#: Most words of one half in one shard.
SHARD_WORDS = 20_000
#: Questions searched for at a time.
BLOCK = 20_000
#: Runs of letters longer than this have their checksum taken one by one.
_LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text number and code points of runs of A-Z, a-z and U+00C0 to U+00FF (lead byte C3)."""
    lead = data == 0xC3
    ink = _LETTER[data] | lead
    ink[1:] |= lead[:-1]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    filled = offsets[1:] > offsets[:-1]
    first[offsets[:-1][filled]] = ink[offsets[:-1][filled]]
    last[offsets[1:][filled] - 1] = ink[offsets[1:][filled] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    leads = np.append(0, np.cumsum(lead))
    points = ends - starts - (leads[ends] - leads[starts])
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1, points


def _checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each span behind what ``before`` is the checksum of."""
    sizes = ends - starts
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(-sizes, kind="stable")
    long = int(np.searchsorted(-sizes[order], -_LONG))
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    order = order[long:]
    state, at, size = ~before[order], starts[order], sizes[order]
    for j in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -j))
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + j]) & 255] ^ (state[:n] >> 8)
    out[order] = ~state
    return out


def _counted(part: pa.RecordBatch, every: int, shortest: int) -> tuple[list[bytes], list[int]]:
    """Words of a slice of rows and how often each occurs."""
    data, offsets = flat(part.column(1))
    data = lower(data)
    starts, ends, doc, points = _letter_runs(data, offsets)
    long = points >= shortest
    starts, ends, doc, points = starts[long], ends[long], doc[long], points[long]
    gone = np.zeros(len(starts), bool)
    if every:
        ids = part.column(0).to_pylist()
        before = np.array([0 if i is None else zlib.crc32(b"%d:" % i) for i in ids], np.uint32)
        known = np.array([i is not None for i in ids], bool)
        h = _checksums(data, starts, ends, before[doc])
        gone = (h % every == 0) & known[doc]
    found: list[bytes] = []
    for i in np.flatnonzero(gone & (points > shortest)).tolist():
        word, k = data[starts[i] : ends[i]].tobytes().decode(), int(h[i]) % int(points[i])
        found.append((word[:k] + word[k + 1 :]).encode())
    starts, ends = starts[~gone], ends[~gone]
    _, at, n = np.unique(span_hashes(data, starts, ends), return_index=True, return_counts=True)
    whole = data.tobytes()
    spans = zip(starts[at].tolist(), ends[at].tolist(), strict=True)
    return [whole[a:b] for a, b in spans] + found, n.tolist() + [1] * len(found)


def vocabulary(docs: DataFrame, drop_every: int = 0, shortest: int = MIN_LENGTH, least: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of all words of at least ``shortest`` code points that occur at least ``least`` times.

    With ``drop_every``, a run in a document loses one code point if that number divides the checksum
    of ``<doc_id>:<run>``; the checksum also tells which.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1):
                found, n = _counted(part, drop_every, shortest)
                strings = pa.array(found, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([strings, pa.array(n, pa.int64())], ["word", "n"])

    found = docs.select("doc_id", "text").mapInArrow(counted, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class _Ranks(WaveletMatrix):
    """Intervals of suffix ranks over one Burrows-Wheeler transform."""

    def __init__(self, values: np.ndarray):
        super().__init__(values)
        first = np.zeros(int(values.max()) + 1, np.int64)
        symbols = np.arange(len(first))
        for level in range(self.levels):
            one = ((symbols >> (self.levels - 1 - level)) & 1).astype(bool)
            ones = self._rank(level, first)
            first = np.where(one, self.zeros[level] + ones, first - ones)
        self.shift = self.smaller[: len(first)] - first

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Interval with the symbol in front, and how many smaller symbols the given interval has."""
        smaller = np.zeros(len(low), np.int64)
        wanted = symbol
        for level in range(self.levels):
            one = ((wanted >> (self.levels - 1 - level)) & 1).astype(bool)
            a, b = self._rank(level, low), self._rank(level, high)
            smaller += np.where(one, (high - b) - (low - a), 0)
            low, high = np.where(one, self.zeros[level] + a, low - a), np.where(one, self.zeros[level] + b, high - b)
        return low + self.shift[wanted], high + self.shift[wanted], smaller

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """All symbols in front of the intervals: interval number, symbol, and the three values of ``extend``."""
        own, symbol = np.arange(len(low)), np.zeros(len(low), np.int64)
        smaller = np.zeros(len(low), np.int64)
        for level in range(self.levels):
            a, b = self._rank(level, low), self._rank(level, high)
            zeros, ones = (high - b) - (low - a), b - a
            z, o = zeros > 0, ones > 0
            own = np.concatenate([own[z], own[o]])
            symbol = np.concatenate([2 * symbol[z], 2 * symbol[o] + 1])
            smaller = np.concatenate([smaller[z], smaller[o] + zeros[o]])
            base = self.zeros[level]
            low, high = np.concatenate([(low - a)[z], base + a[o]]), np.concatenate([(high - b)[z], base + b[o]])
        return own, symbol, low + self.shift[symbol], high + self.shift[symbol], smaller


def _rotations(symbols: np.ndarray) -> np.ndarray:
    """Order of all rotations of a sequence without a period of its own."""
    bits = int(symbols.max()).bit_length()
    step = max(1, 62 // bits)
    key = np.zeros(len(symbols), np.int64)
    for j in range(step):
        key = (key << bits) | np.roll(symbols, -j)
    while True:
        order = np.argsort(key, kind="stable")
        new = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        rank = np.empty(len(symbols), np.int64)
        rank[order] = new
        if new[-1] == len(symbols) - 1:
            return order
        key = rank * len(symbols) + np.roll(rank, -step)
        step *= 2


class TwoWayIndex:
    """A delimited vocabulary that can be searched to both sides; symbol 0 is the delimiter."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray):
        """``rows`` holds a word of symbols above 0 per row, distinct and padded behind ``sizes``."""
        width = rows.shape[1]
        inside = np.arange(width) < sizes[:, None]
        framed = np.concatenate([np.zeros((len(rows), 1), rows.dtype), rows], 1)
        text = framed[np.concatenate([np.ones((len(rows), 1), bool), inside], 1)].astype(np.int64)
        order = _rotations(text)
        self.forward = _Ranks(text[order - 1])
        back = text[::-1]
        self.backward = _Ranks(back[_rotations(back) - 1])
        self.size = len(text)
        starts = np.append(0, np.cumsum(sizes + 1)[:-1])
        self.word = np.searchsorted(starts, order[: len(rows)])  # ranks of the delimiters come first

    def exact(self, patterns: np.ndarray, sizes: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of patterns read in the direction of the search: own side, other side, size."""
        ranks = self.forward if left else self.backward
        low, other = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        high = np.full(len(sizes), self.size)
        for j in range(int(sizes.max(initial=0))):
            on = np.flatnonzero((sizes > j) & (high > low))
            a, b, smaller = ranks.extend(patterns[on, j], low[on], high[on])
            low[on], high[on], other[on] = a, b, other[on] + smaller
        return low, other, high - low

    def one_error(self, rest: np.ndarray, sizes: np.ndarray, state: tuple[np.ndarray, ...], left: bool, skip: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pattern number and word of every match of ``rest`` with one symbol replaced, or skipped.

        ``rest`` is read in the direction of the search and ends with the delimiter.
        """
        ranks = self.forward if left else self.backward
        low, other, size = state
        sound = np.flatnonzero(size > 0)
        exact = (sound, low[sound], other[sound], size[sound])
        wrong = tuple(np.empty(0, np.int64) for _ in range(4))
        found_row, found_rank = [], []
        alike = np.ones(len(rest), bool)
        for j in range(int(sizes.max(initial=0))):
            row, low, other, size = wrong
            if len(row):
                a, b, smaller = ranks.extend(rest[row, j], low, low + size)
                live = b > a
                wrong = row[live], a[live], (other + smaller)[live], (b - a)[live]
            row, low, other, size = exact
            more = sizes[row] - 1 > j  # the delimiter itself is never wrong
            row, low, other, size = row[more], low[more], other[more], size[more]
            if skip:
                # what may be skipped on the border of the halves is left to the search from the front
                alike &= rest[:, j] == rest[:, 0]
                mine = (rest[row, j] != rest[row, j + 1]) & ~(alike[row] & left)
                fresh = row[mine], low[mine], other[mine], size[mine]
                a, b, smaller = ranks.extend(rest[row, j], low, low + size)
                live = b > a
                exact = row[live], a[live], (other + smaller)[live], (b - a)[live]
            else:
                own, symbol, a, b, smaller = ranks.branches(low, low + size)
                same = symbol == rest[row[own], j]
                nodes = row[own], a, other[own] + smaller, b - a
                exact = tuple(x[same] for x in nodes)
                fresh = tuple(x[~same & (symbol > 0)] for x in nodes)
            wrong = tuple(np.concatenate(x) for x in zip(wrong, fresh, strict=True))
            ended = sizes[wrong[0]] - 1 == j
            if ended.any():
                found_row.append(wrong[0][ended])
                # a whole word with both delimiters: its rank among the delimiters of the forward text
                found_rank.append((wrong[1] if left else wrong[2])[ended])
                wrong = tuple(x[~ended] for x in wrong)
        empty = np.empty(0, np.int64)
        return np.concatenate([empty, *found_row]), self.word[np.concatenate([empty, *found_rank])]


def _matrix(words: list[str], symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the code points of words, one row each, and how many there are."""
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    rows = np.zeros((len(words), int(sizes.max(initial=0)) + 2), np.int64)
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = symbol[points]
    return rows, sizes


def _reversed(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    at = sizes[:, None] - 1 - np.arange(rows.shape[1])
    return np.where(at >= 0, np.take_along_axis(rows, np.maximum(at, 0), 1), 0)


def _shifted(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    at = by[:, None] + np.arange(rows.shape[1])
    return np.where(at < rows.shape[1], np.take_along_axis(rows, np.minimum(at, rows.shape[1] - 1), 1), 0)


def near_words(words: list[str], asked: list[str], front: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (question, word) one edit apart, with the half of the word that the question names exact.

    ``front`` tells which half that is, ``shorter`` whether words shorter by one are asked for instead
    of words of equal length.
    """
    used = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32))
    points = max((ord(max(w)) for w in asked if w), default=0)
    # symbols the vocabulary lacks are one symbol, which a word of its own holds
    symbol = np.full(max(points, int(used.max(initial=0))) + 1, len(used) + 1)
    symbol[used] = np.arange(1, len(used) + 1)
    rows, sizes = _matrix(words, symbol)
    other = np.zeros((1, rows.shape[1]), np.int64)
    other[0, 0] = len(used) + 1
    index = TwoWayIndex(np.concatenate([rows, other]), np.append(sizes, 1))
    out_q, out_w = [], []
    for first in range(0, len(asked), BLOCK):
        block = slice(first, first + BLOCK)
        rows, sizes = _matrix(asked[block], symbol)
        for is_front in (True, False):
            for skip in (False, True):
                pick = np.flatnonzero((front[block] == is_front) & (shorter[block] == skip))
                own, n = rows[pick], sizes[pick]
                half = (n - skip) // 2 if is_front else n - skip - (n - skip) // 2
                toward = own if is_front else _reversed(own, n)  # the exact half first, then the rest
                start = _reversed(np.where(np.arange(toward.shape[1]) < half[:, None], toward, 0), half)
                low, back, size = index.exact(start, half + 1, left=is_front)
                rest = _shifted(toward, half)
                q, w = index.one_error(rest, n - half + 1, (back, low, size), left=not is_front, skip=skip)
                out_q.append(pick[q] + first)
                out_w.append(w)
    empty = np.empty(0, np.int64)
    q, w = np.concatenate([empty, *out_q]), np.concatenate([empty, *out_w])
    return q[w < len(words)], w[w < len(words)]


_DEALT = "word string, n bigint, asks boolean, front boolean, shorter boolean"


def _dealt(words: DataFrame, shortest: int) -> DataFrame:
    """Words to the groups that share a half with them: (shard, i, j) and what the row is for."""
    spark = words.sparkSession

    def rows(asks: bool, front: bool, shorter: bool) -> DataFrame:
        target = "length(word) - 1" if shorter else "length(word)"
        half = f"substring(word, 1, ({target}) div 2)" if front else f"right(word, {target} - ({target}) div 2)"
        key = F.concat_ws(":", F.expr(target).cast("string"), F.lit("front" if front else "back"), F.expr(half))
        some = words.filter(F.expr(target) >= shortest)
        flags = [F.lit(x).alias(c) for x, c in ((asks, "asks"), (front, "front"), (shorter, "shorter"))]
        return some.select("word", "n", *flags, key.alias("key"))

    held = rows(False, True, False).unionByName(rows(False, False, False))
    hot = held.groupBy(F.col("key").alias("hot_key")).agg(F.ceil(F.count("*") / SHARD_WORDS).cast("int").alias("parts"))
    hot = stage(hot.filter("parts > 1"), "op11-hot")
    groups = max(shards(spark), 1 + 2 * words.count() // SHARD_WORDS)
    asked = [rows(True, f, s) for f in (True, False) for s in (False, True)]
    every = held.unionByName(asked[0]).unionByName(asked[1]).unionByName(asked[2]).unionByName(asked[3])
    every = every.join(hot, F.col("key") == F.col("hot_key"), "left")
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    each = F.expr("sequence(0, parts - 1)")
    cold = F.col("parts").isNull()
    none = F.array(F.lit(-1))
    every = every.withColumn("i", F.explode(F.when(cold, none).when(F.col("asks"), each).otherwise(F.array(own))))
    every = every.withColumn("j", F.explode(F.when(cold, none).when(F.col("asks"), F.array(own)).otherwise(each)))
    h = F.xxhash64("key")
    return every.withColumn("shard", F.when(cold, F.pmod(h, F.lit(groups))).otherwise(h)).select(
        "shard", "i", "j", *(f.split()[0] for f in _DEALT.split(", "))
    )


def _searched(group: pa.Table) -> pa.Table:
    """Near pairs of a group, each from both words, with the occurrences of the second."""
    names = ["word", "near", "near_n"]
    asks = group["asks"].to_numpy()
    held, asked = group.filter(pa.array(~asks)), group.filter(pa.array(asks))
    kinds = [pa.string(), pa.string(), pa.int64()]
    if not held.num_rows or not asked.num_rows:
        return pa.table({c: pa.array([], k) for c, k in zip(names, kinds, strict=True)})
    counts = dict(zip(held["word"].to_pylist(), held["n"].to_pylist(), strict=True))
    words, texts = list(counts), asked["word"].to_pylist()
    shorter = asked["shorter"].to_numpy()
    q, w = near_words(words, texts, asked["front"].to_numpy(), shorter)
    questions, found = asked["word"].combine_chunks(), pa.array(words, pa.string())
    n_asked, n_found = asked["n"].to_numpy(), np.array(list(counts.values()), np.int64)
    back = shorter[q]  # the longer word is not asked for from the shorter one
    a, b = questions.take(pa.array(q)), found.take(pa.array(w))
    left = pa.concat_arrays([a, b.filter(pa.array(back))])
    right = pa.concat_arrays([b, a.filter(pa.array(back))])
    n = np.concatenate([n_found[w], n_asked[q[back]]])
    return pa.table([left, right, pa.array(n)], names)


def near_pairs(words: DataFrame, shortest: int = MIN_LENGTH) -> DataFrame:
    """``word, near, near_n`` of all pairs of words (``word, n``, each word once) one edit apart, in both orders."""
    dealt = _dealt(words, shortest)
    return dealt.groupBy("shard", "i", "j").applyInArrow(_searched, "word string, near string, near_n bigint")


def group(words: DataFrame, shortest: int = MIN_LENGTH, factor: int = FACTOR) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a vocabulary as ``vocabulary`` gives it.

    Each step from word to form multiplies the occurrences, so the chains are as short as their
    logarithm; steps are taken for all words at once, only those that still move.
    """
    words = stage(words, "op11-words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    near = near_pairs(words, shortest).groupBy("word").agg(F.count("*").alias("n_near"), best)
    led = -F.col("best.m") >= factor * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(led, F.col("best.near")).alias("form"), F.when(led, -F.col("best.m")).alias("form_n"),
    )
    forms = stage(forms, "op11-forms")
    step = forms.filter("form is not null").select(F.col("word").alias("at"), F.col("form").alias("next"))
    moved = forms.filter("form is not null").select("word", F.col("form").alias("root"), F.lit(1).alias("hops"))
    roots = moved
    while True:
        further = moved.join(step, F.col("root") == F.col("at")).select("word", F.col("next").alias("root"), (F.col("hops") + 1).alias("hops"))
        moved = stage(further, "op11-roots")
        if moved.isEmpty():
            break
        roots = roots.unionByName(moved)
    roots = roots.groupBy("word").agg(F.max_by("root", "hops").alias("root"))
    return forms.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
