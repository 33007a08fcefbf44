"""Remove long byte strings that an earlier document already has, with a run-length index.

The engine of ``repeats`` deals the stretches of text that may repeat to shards. A shard sorts the
suffixes of its stretches and keeps the Burrows-Wheeler transform as runs only: where each run starts,
its byte, where its first row goes under the LF step, and the text position at its last row. Stretches
are then streamed backwards through the index, all in lockstep: a step looks up the run of the current
row, and the LF step leads to the row of the next longer suffix. As a stretch is itself in the index,
its matching statistics are as long as what is left of it; the row tells in which class of suffixes
with the same ``width`` bytes it lies, and the class knows the first document that has the string.

Texts are UTF-8 bytes, null is empty; matches never cross documents. A document without id comes last.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from aulario.llm import repeats
from aulario.llm.text import mix

WIDTH = 50
#: Runs of 16 bytes are shared by chance once a corpus has some hundred MB; those of 32 hardly ever are.
ANCHOR = 32


@dataclass(frozen=True)
class RunLengthIndex:
    """Run-compressed transform of a text: row ranges with one preceding symbol."""

    start: np.ndarray
    symbol: np.ndarray
    lf: np.ndarray
    end_sample: np.ndarray
    size: int

    @classmethod
    def build(cls, order: np.ndarray, symbols: np.ndarray) -> RunLengthIndex:
        bwt = symbols[order - 1]
        # the row of a whole stretch (preceded by a separator) is a run of its own, so it is sampled
        start = np.flatnonzero(np.append(True, (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)))
        symbol, length = bwt[start], np.diff(np.append(start, len(bwt)))
        by_symbol = np.argsort(symbol, kind="stable")
        lf = np.empty(len(start), np.int64)
        lf[by_symbol] = np.cumsum(length[by_symbol]) - length[by_symbol]
        return cls(start, symbol, lf, order[start + length - 1], len(bwt))

    def step(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Preceding symbol of each row, and the row of the suffix that it begins."""
        run = np.searchsorted(self.start, rows, "right") - 1
        return self.symbol[run], self.lf[run] + rows - self.start[run]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions, by walking to the next sampled run end."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        ends = np.append(self.start[1:], self.size) - 1
        at = np.full(len(rows), -1, np.int64)
        while (open_ := np.flatnonzero(at < 0)).size:
            run = np.searchsorted(self.start, rows[open_], "right") - 1
            hit = ends[run] == rows[open_]
            at[open_[hit]] = (self.end_sample[run[hit]] + steps[open_[hit]]) % self.size
            rest = open_[~hit]
            rows[rest] = self.step(rows[rest])[1]
            steps[rest] += 1
        return at


def first_holder_marks(symbols: np.ndarray, begin: np.ndarray, docs: np.ndarray, several: np.ndarray, width: int) -> np.ndarray:
    """Windows (as positions in ``symbols``) that a document before their own holds."""
    del several
    held, order, equal = repeats.classes(symbols, begin, width)
    index = RunLengthIndex.build(order, held)
    sizes = np.diff(begin)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    # classes of windows that fit into their stretch, with the first document of each
    inside = np.flatnonzero(np.arange(len(held)) <= (begin[1:] + np.arange(len(sizes)) - width)[owner])
    first = np.full(int(equal.max()) + 1, repeats.NEVER)
    np.minimum.at(first, equal[inside], docs[owner[inside]])
    return walk(index.step, held, begin, width, lambda rows, own: first[equal[order[rows]]] < docs[own])


def walk(step, held: np.ndarray, begin: np.ndarray, width: int, marked) -> np.ndarray:
    """Stream all stretches backwards in lockstep; positions of the windows for which ``marked`` holds.

    Separators sort first, in the order of their stretches, so row i is where stretch i ends.
    """
    sizes = np.diff(begin)
    rows, live, found = np.arange(len(sizes)), np.arange(len(sizes)), [np.empty(0, np.int64)]
    for back in range(1, int(sizes.max(initial=0)) + 1):
        live = live[sizes[live] >= back]
        symbol, rows[live] = step(rows[live])
        at = begin[live + 1] - back
        if not (symbol == held[at + live]).all():
            raise AssertionError("a stretch left its own path through the index")
        if back >= width:
            found.append(at[marked(rows[live], live)])
    return np.sort(np.concatenate(found))


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    n = len(data) - k + 1
    padded = np.append(data, np.zeros(8, np.uint8))
    word = np.ndarray((len(padded) - 7,), np.dtype("<u8"), padded.tobytes(), strides=(1,))
    h = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    for at in [*range(8, k - 8, 8), k - 8]:
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h += word[at : at + n]
    return mix(h)


PLAN = repeats.Plan(WIDTH, ANCHOR, repeats.flat_bytes, _grams, first_holder_marks, True, np.uint8)


_DIGEST = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _kept(extra: tuple[str, ...]):
    names = [f.split()[0] for f in _DIGEST.split(", ")]

    def run(docs: pa.Table, runs: dict[int, np.ndarray]) -> pa.Table:
        rows, texts = [], []
        for doc, text, rid in zip(docs["doc_id"].to_pylist(), docs["text"].cast(pa.binary()).to_pylist(), docs["rid"].to_pylist(), strict=True):
            text, at, parts, removed = text or b"", 0, [], 0
            spans = runs.get(rid, ())
            for a, b in spans:
                parts.append(text[at:a])
                at, removed = b, removed + int(b - a)
            kept = b"".join([*parts, text[at:]])
            rows.append((doc, len(text), removed, len(spans), hashlib.sha256(kept).hexdigest()))
            if extra:
                texts.append(kept.decode("utf-8", "ignore"))
        columns = zip(*rows, strict=True) if rows else [()] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        out = pa.table({c: pa.array(v, k) for c, v, k in zip(names, columns, kinds, strict=True)})
        if extra:
            out = out.append_column("text", pa.array(texts, pa.string()))
            for c in extra:
                out = out.append_column(c, docs[c])
        return out

    return run


def remove_seen(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    return repeats.cut(docs, PLAN, _kept(()), _DIGEST)


def without_seen(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The digest columns, the text that is left and the named further columns of every row.

    A character that is cut in the middle goes as a whole.
    """
    kinds = dict(docs.dtypes)
    schema = ", ".join([_DIGEST, "text string", *(f"{c} {kinds[c]}" for c in columns)])
    return repeats.cut(docs, PLAN, _kept(columns), schema, columns)
