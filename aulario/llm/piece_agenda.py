"""Encode and decode whole texts with a merge-type piece vocabulary.

A text is written with a mark for every space and one mark in front. Its characters are the first
symbols; adjacent pairs whose joined string is a piece wait in an agenda ordered by score, the
leftmost of equals first. The best pair is joined, entries that name a joined symbol are stale and
skipped, and the new neighbours enter the agenda. Short parts go through it together: the pairs of one
part are a row of scores, of which the best is joined in every row at once. What stays a character
without a piece is spelled in byte pieces. As no piece has a mark after another character (proved when the vocabulary is read),
pairs never cross the start of a run of marks, so a text is cut into words there. ASCII signs that follow no
letter (of Latin-1) in any piece, and characters that are next to nothing in any piece, cut words further in the same way.
Each distinct word of a slice is cut once, and equal parts are encoded once per worker; the number of
characters remembered is bounded. A vocabulary with longer pieces is taken whole text by whole text.

Every distinct part is compared with the library when it is first met in an Arrow batch: ids, and the
text they decode to; a character that joins with nothing stands before it, so that parts without a mark
can be told to the library. A difference ends the job with an error naming the part.

Null counts as the empty text, which has no ids. Repeated rows are encoded each, a row without
``doc_id`` keeps its null, other columns are not looked at. Time grows with n log n for a long part.
"""

from __future__ import annotations

import codecs
import functools
import gc
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from aulario.llm.text import flat, sliced

MARK = "▁"
#: Characters of parts that a worker remembers before it starts afresh, and the longest part remembered.
REMEMBERED, LONGEST = 4_000_000, 200
#: Longest part that shares a matrix with others, and rows of such a matrix.
SHORT, ROWS = 24, 8192
#: Code points below this have their first pairs in a table.
COMMON = 0x180
_PAD = -1
_SPACE, _OTHER, _LETTER, _SIGN, _ALONE = range(5)

codecs.register_error("one-by-one", lambda e: ("�", e.start + 1))


def _entries(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and length-delimited values of a protocol buffer message, by field."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else {5: 4, 1: 8}[kind]
        yield tag >> 3, message[at : at + size]
        at += size


class Pieces:
    """A vocabulary file: scores and ids of its pieces, and what was encoded lately."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self._read_settings(sp.serialized_model_proto())
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in plain):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        spelled = [i for i in range(size) if sp.is_byte(i)]
        self.byte_of = {i: int(sp.id_to_piece(i)[1:-1], 16) for i in spelled}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        if len(self.byte_ids) < 256 or MARK not in self.ids:
            raise ValueError("a piece for every byte and one for the mark are needed")
        self.silent = {i for i in range(size) if sp.is_control(i)}
        self.surface = {i: p.replace(MARK, " ") for p, i in self.ids.items()}
        self.unknown = sp.unk_id()
        self.surface |= {self.unknown: " ⁇ "}
        self._tabulate()
        self._find_cuts()
        self.known: dict[str, tuple[str, str, int]] = {}
        self.older: dict[str, tuple[str, str, int]] = {}
        self.young = self.old = 0  # characters of the parts in them

    def _read_settings(self, model: bytes) -> None:
        """Refuse what the agenda does not do; fixed values are field numbers of the public format."""
        fields = list(_entries(model))
        trainer = dict(_entries(next(v for f, v in fields if f == 2)))
        normalizer = dict(_entries(next(v for f, v in fields if f == 3)))
        types = {dict(_entries(v)).get(3, 1) for f, v in fields if f == 1}
        merge_type, suffix_mark, user_defined = trainer.get(3) == 2, trainer.get(24, 0), 4 in types
        table, dummy = normalizer.get(2), normalizer.get(3, 1)
        squeeze, escape = normalizer.get(4, 1), normalizer.get(5, 1)
        if not merge_type or suffix_mark or user_defined or table or not dummy or squeeze or not escape:
            raise ValueError("needs a merge-type vocabulary that leaves texts as they are and puts a mark in front")

    def _find_cuts(self) -> None:
        """Where no piece goes across: kinds of bytes, and a character to stand before a part."""
        self.by_word = all(MARK not in p.lstrip(MARK) for p in self.ids)
        pairs = {pair for p in self.ids for pair in zip(p, p[1:], strict=False)}
        ascii_ = {chr(i) for i in range(128)} - {" "}
        alone = ascii_ - {c for pair in pairs for c in pair}
        signs = {c for c in ascii_ - alone if not c.isalpha()} - {b for a, b in pairs if a.isalpha() and ord(a) < 0x100}
        anchor = next((c for c in sorted(alone) if c in self.ids), None)
        self.kind = np.full(256, _OTHER, np.uint8)
        self.anchor, self.anchored = "", []
        if self.by_word and anchor:
            self.kind[[i for i in range(128) if chr(i).isalpha()]] = _LETTER
            self.kind[[ord(c) for c in signs]] = _SIGN
            self.kind[[ord(c) for c in alone]] = _ALONE
            self.anchor, self.anchored = anchor, [self.ids[MARK], self.ids[anchor]]
        self.kind[0x20] = _SPACE

    @property
    def held(self) -> int:
        return self.young + self.old

    def _tabulate(self) -> None:
        """Numbers of characters, and of what adjacent pieces join to, sorted by the numbers of both."""
        ids, size = self.ids, self.library.get_piece_size()
        self.size = size
        self.character = np.full(0x110000, _PAD - 1, np.int64) - np.arange(0x110000)  # below the pad: no piece
        for piece in ids:
            if len(piece) == 1:
                self.character[ord(piece)] = ids[piece]
        joined = [
            (ids[p[:k]] * size + ids[p[k:]], i, self.scores[p])
            for p, i in ids.items()
            for k in range(1, len(p))
            if p[:k] in ids and p[k:] in ids
        ]
        joined.sort()
        keys, results, scores = zip(*joined, strict=True)
        self.pair_keys = np.array([*keys, np.iinfo(np.int64).max])
        self.pair_results, self.pair_scores = np.array([*results, 0]), np.array([*scores, np.inf])
        # first pairs of common characters by a square table instead of a search; the last row is for all others
        common = [*map(chr, range(COMMON)), MARK]
        self.common = np.full(0x110000, len(common), np.int64)
        self.common[[ord(c) for c in common]] = np.arange(len(common))
        own = self.character[[ord(c) for c in common]]
        self.first = np.full((len(common) + 1, len(common) + 1), len(keys))
        key = own[:, None] * size + own
        at = np.searchsorted(self.pair_keys, key)
        fits = (self.pair_keys[at] == key) & (own[:, None] >= 0) & (own >= 0)
        self.first[:-1, :-1] = np.where(fits, at, len(keys))

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and result of joining neighbours; infinite where they do not join."""
        key = a * self.size + b
        at = np.searchsorted(self.pair_keys, key)
        fits = (self.pair_keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(fits, self.pair_scores[at], np.inf), self.pair_results[at]

    def merge_equally_long(self, parts: list[str]) -> list[list[int]]:
        """Symbols left of parts of one length, as ids; characters without a piece are negative."""
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).reshape(len(parts), -1)
        symbols = self.character[points]
        width = symbols.shape[1]
        left = np.full(symbols.shape, _PAD)
        rows, place = np.arange(len(parts)), np.arange(width)
        symbols = np.concatenate([symbols, np.full((len(parts), 1), _PAD)], 1)
        common = self.common[points]
        at = np.full((len(parts), width), len(self.pair_keys) - 1)  # the last column has no right neighbour
        at[:, :-1] = self.first[common[:, :-1], common[:, 1:]]
        score, result = self.pair_scores[at], self.pair_results[at]
        rare = np.flatnonzero((common == len(self.first) - 1).any(1))
        score[rare], result[rare] = self._pairs(symbols[rare, :-1], symbols[rare, 1:])
        while len(rows):
            at = score.argmin(1)
            own = np.arange(len(rows))
            live = score[own, at] < np.inf
            left[rows[~live]] = symbols[~live, :width]
            rows, at, symbols, score, result = rows[live], at[live], symbols[live], score[live], result[live]
            own = np.arange(len(rows))
            joined = result[own, at]
            moved = place + (place > at[:, None])  # close the gap of the right one
            symbols[:, :width] = np.take_along_axis(symbols, moved, 1)
            symbols[own, at] = joined
            moved = np.minimum(moved, width - 1)
            score, result = np.take_along_axis(score, moved, 1), np.take_along_axis(result, moved, 1)
            score[own, at], result[own, at] = self._pairs(joined, symbols[own, at + 1])
            inner = np.flatnonzero(at > 0)
            before = at[inner] - 1
            score[inner, before], result[inner, before] = self._pairs(symbols[inner, before], joined[inner])
        kept = left != _PAD
        ids, ends = left[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part."""
        out: dict[str, list[int]] = {}
        by_length: dict[int, list[str]] = {}
        for part in parts:
            by_length.setdefault(len(part), []).append(part)
        for n, group in by_length.items():
            if n > SHORT:
                out |= {part: self.part_ids(part) for part in group}
                continue
            for first in range(0, len(group), ROWS):
                some = group[first : first + ROWS]
                for part, ids in zip(some, self.merge_equally_long(some), strict=True):
                    if min(ids) < 0:
                        ids = [j for i in ids for j in ([i] if i >= 0 else self._spelled(chr(_PAD - 1 - i)))]
                    out[part] = ids
        return [out[part] for part in parts]

    def _spelled(self, character: str) -> list[int]:
        return [self.byte_ids[b] for b in character.encode()]

    def merge(self, part: str) -> list[str]:
        """Symbols left when no adjacent pair is a piece any more."""
        symbols: list[str | None] = list(part)
        after = list(range(1, len(symbols))) + [-1]
        before = list(range(-1, len(symbols) - 1))
        scores = self.scores
        agenda = [
            (scores[pair], i, i + 1, pair)
            for i, pair in enumerate(map(str.__add__, symbols, symbols[1:]))
            if pair in scores
        ]
        heapify(agenda)
        while agenda:
            _, left, right, pair = heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or after[left] != right or len(a) + len(b) != len(pair):
                continue
            symbols[left], symbols[right] = pair, None
            following = after[left] = after[right]
            if following >= 0:
                before[following] = left
                joined = pair + symbols[following]
                if joined in scores:
                    heappush(agenda, (scores[joined], left, following, joined))
            leading = before[left]
            if leading >= 0:
                joined = symbols[leading] + pair
                if joined in scores:
                    heappush(agenda, (scores[joined], leading, left, joined))
        return [s for s in symbols if s is not None]

    def part_ids(self, part: str) -> list[int]:
        ids: list[int] = []
        for symbol in self.merge(part):
            known = self.ids.get(symbol)
            if known is None:
                ids += self._spelled(symbol)
            else:
                ids.append(known)
        return ids

    def spoken(self, ids: Iterable[int]) -> str:
        """Text of ids, marks as spaces; byte pieces that spell no character give replacement characters."""
        ids = list(ids)
        try:
            return "".join([self.surface[i] for i in ids])
        except KeyError:  # byte pieces or silent ones
            out = []
        for spelled, run in groupby(ids, self.byte_of.__contains__):
            if spelled:
                out.append(bytes(self.byte_of[i] for i in run).decode("utf-8", "one-by-one"))
            else:
                out += [self.surface[i] for i in run if i not in self.silent]
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; the mark in front of the text is taken off."""
        ids = list(ids)
        text = self.spoken(ids)
        first = next((i for i in ids if i not in self.silent), None)
        marked = first in self.surface and first != self.unknown and text.startswith(" ")
        return text[1:] if marked else text

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Texts cut before every run of spaces, one space put in front, and where each text's words begin (one more at the end)."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(" ", texts, ""))
        data, offsets = flat(texts)
        space = data == 0x20
        begins = np.zeros(len(data), bool)
        if self.by_word:
            begins[1:] = space[1:] & ~space[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        return _spans(data, np.flatnonzero(begins), offsets)

    def cut(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words cut where no piece goes across, and where each word's parts begin (one more at the end)."""
        data, offsets = flat(words)
        kind = self.kind[data]
        lead = np.flatnonzero(data == 0xC3)  # the letters from U+00C0 on, but for two signs
        kind[lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)] + 1] = _LETTER
        begins = np.zeros(len(data), bool)
        begins[1:] = (kind[1:] == _SIGN) & (kind[:-1] == _LETTER) | (kind[1:] == _ALONE) | (kind[:-1] == _ALONE)
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        return _spans(data, np.flatnonzero(begins), offsets)

    def parts(self, text: str) -> list[str]:
        """Parts of a text with its marks, the one in front included."""
        return _strings(self.cut(self.words(pa.array([text[1:]], pa.string()))[0])[0])

    def learn(self, parts: list[str]) -> None:
        """Encode distinct parts not met lately and hold them against the library."""
        new = [p for p in parts if p not in self.known]
        more = sum(map(len, new))
        if self.young + more > REMEMBERED // 2:
            self.older, self.old = self.known, self.young
            self.known, self.young, new = {}, 0, parts
            more = sum(map(len, new))
        if self.young + self.old + more > REMEMBERED:
            self.older, self.old = {}, 0
        self.young += more
        self.known.update((p, self.older[p]) for p in new if p in self.older)
        new = [p for p in new if p not in self.known]
        plain = [self.anchor + p.replace(MARK, " ")[not self.anchor :] for p in new]
        theirs = self.library.encode(plain, num_threads=1)
        lead, skipped = self.anchored, len(self.anchor)
        for part, text, ids, other in zip(new, plain, self.encode_parts(new), theirs, strict=True):
            spoken = self.spoken(ids)
            if spoken != (text[skipped:] if skipped else " " + text) or (text and lead + ids != other):
                raise AssertionError(f"{part!r}: {ids} here, {other[len(lead):]} in the library")
            self.known[part] = ",".join([str(i) for i in ids]), spoken, len(ids)

    def release(self, parts: list[str]) -> None:
        """Forget parts too long to be worth remembering."""
        for part in (p for p in parts if len(p) > LONGEST):
            del self.known[part]
            self.young -= len(part)

    def round_trip(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of ids, the ids in decimals joined by commas, and the decoded text of each text."""
        numbers, ids, decoded = self.coded(pa.array(texts, pa.string()))
        return list(zip(numbers.to_pylist(), ids.to_pylist(), decoded.to_pylist(), strict=True))

    def coded(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """As ``round_trip``, by columns; null is the empty text."""
        # nothing here is cyclic, and the collector would look through all that is remembered again and again
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._coded(texts)
        finally:
            if collects:
                gc.enable()

    def _coded(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        words, of_text = self.words(texts)
        words = words.dictionary_encode()
        parts, of_word = self.cut(words.dictionary)
        parts = parts.dictionary_encode()
        distinct = _strings(parts.dictionary)
        self.learn(distinct)
        known = [self.known[p] for p in distinct]
        self.release(distinct)
        at, of = parts.indices, words.indices
        numbers = np.array([n for _, _, n in known], np.int64)
        for chosen, bounds in ((at, of_word), (of, of_text)):
            sums = np.append(0, np.cumsum(numbers[chosen.to_numpy()]))
            numbers = sums[bounds[1:]] - sums[bounds[:-1]]
        joined = []
        for column, between in ((0, ","), (1, "")):
            strings = pa.array([k[column] for k in known], pa.string())
            for chosen, bounds in ((at, of_word), (of, of_text)):
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), strings.take(chosen))
                strings = pc.binary_join(lists, between)
            joined.append(strings)
        ids, spoken = joined
        return pa.array(numbers), ids, pc.binary_replace_slice(spoken.cast(pa.binary()), 0, 1, b"").cast(pa.string())


def _spans(data: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Strings that begin at each start, and where those of each stretch between two offsets begin."""
    bounds = np.append(starts, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)), np.searchsorted(starts, offsets)


def _strings(array: pa.Array) -> list[str]:
    """The strings of an array with marks for spaces; far quicker than one by one."""
    data, offsets = flat(array)
    text = data.tobytes().decode().replace(" ", MARK)
    at = np.append(0, np.cumsum(data & 0xC0 != 0x80))[offsets].tolist()
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _by_row(rows: DataFrame, path: str, work: Callable[[Pieces, pa.RecordBatch], list[pa.Array]], schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path)
        for batch in batches:
            yield from (pa.RecordBatch.from_arrays(work(v, part), names) for part in sliced(batch, 1))

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every row; ``ids`` in decimals joined by commas.

    ``path`` names the vocabulary file on every worker.
    """

    def work(v: Pieces, part: pa.RecordBatch) -> list[pa.Array]:
        return [part.column(0), *v.coded(part.column(1))]

    schema = "doc_id bigint, n_tokens bigint, ids string, decoded string"
    return _by_row(docs.select("doc_id", "text"), path, work, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` of every row, ids as an array; empty for null and empty texts."""

    def work(v: Pieces, part: pa.RecordBatch) -> list[pa.Array]:
        _, ids, _ = v.coded(part.column(1))
        return [part.column(0), pa.array([[int(i) for i in d.split(",") if i] for d in ids.to_pylist()], pa.list_(pa.int32()))]

    return _by_row(docs.select("doc_id", "text"), path, work, "doc_id bigint, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of rows with an array ``ids``; a null array is the empty text."""
    names = ["doc_id", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path)
        for batch in batches:
            texts = [v.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names)

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
