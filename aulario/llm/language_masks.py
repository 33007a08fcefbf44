"""Language identification with bit-sliced Bloom filters of n-grams.

Each learned language has a set of byte 4-grams (lower-cased A-Z, everything but letters a space, no
space inside): those that make up at least ``SHARE`` of its grams in the training texts, so the set
does not fill up as the corpus grows. The sets of all languages lie in one table whose cells hold a bit
per language; the AND of a gram's ``HASHES`` cells is the mask of all languages that may contain it.
A text's language is the one whose bit is set most often, after taking off the hits that its filter's
fill rate gives to any gram.

A language has at most ``1 / SHARE`` grams, which bounds what is gathered from the corpus per language.
Texts that are null or have no letter are ``und``, and so is everything if nothing was learned. Ties,
and texts without any gram, go to the language with more training texts, then by name. A null id is
the empty string in the folds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulario.llm.text import flat, lower, mix, sliced

SHARE = 2e-5
HASHES, CELLS_PER_GRAM = 3, 16
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_KEEP = np.full(256, 0x20, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def _grams(part: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Every gram of a slice, and the number of its text."""
    data, offsets = flat(part.column(column))
    data = _KEEP[lower(data)]
    if len(data) < 4:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    gram = np.ndarray((len(data) - 3,), np.dtype("<u4"), data.tobytes(), strides=(1,))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = (doc[:-3] == doc[3:]) & (data[1:-2] != 0x20) & (data[2:-1] != 0x20)
    return gram[ok], doc[:-3][ok]


def _learned(docs: DataFrame) -> DataFrame:
    """Grams per language over the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = {}
        for batch in batches:
            for part in sliced(batch, 0):
                gram, doc = _grams(part, 0)
                names, number = np.unique(np.array(part.column(1).to_pylist(), object), return_inverse=True)
                own = number[doc]
                for i, name in enumerate(names):
                    u, c = np.unique(gram[own == i], return_counts=True)
                    seen.setdefault(name, []).append((u, c))
                    if len(seen[name]) > 32:
                        seen[name] = [_merged(seen[name])]
        for name, parts in seen.items():
            u, c = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(u)), pa.array(u.astype(np.int64)), pa.array(c)], ["lang", "gram", "n"])

    return docs.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return u, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64)


def _cells(gram: np.ndarray, size: int) -> list[np.ndarray]:
    # a hash of its own each, so that tables of any size are filled evenly
    salted = (gram.astype(np.uint64) + np.uint64(0x9E37 + (i << 32)) for i in range(HASHES))
    return [(mix(h) & np.uint64(size - 1)).astype(np.int64) for h in salted]


class Masks:
    """The bit-sliced filter: ``cells`` has 64 languages to a column."""

    def __init__(self, languages: list[str], grams: dict[str, np.ndarray]):
        self.languages = languages
        held = max(1, len(np.unique(np.concatenate([np.empty(0, np.int64), *grams.values()]))))
        self.size = 1 << int(held * CELLS_PER_GRAM - 1).bit_length()
        self.cells = np.zeros((self.size, -(-len(languages) // 64) or 1), np.uint64)
        for i, name in enumerate(languages):
            for at in _cells(grams.get(name, np.empty(0, np.int64)), self.size):
                np.bitwise_or.at(self.cells[:, i // 64], at, np.uint64(1) << np.uint64(i % 64))
        bits = ((self.cells[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(len(languages)))
        self.false_rate = np.array([float(b.mean()) ** HASHES for b in bits])

    def shares(self, gram: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Per text and language, the share of grams that the language holds, false hits taken off."""
        total = np.maximum(np.bincount(doc, minlength=n), 1)
        out = np.zeros((n, len(self.languages)))
        at = _cells(gram, self.size)
        for column in range(self.cells.shape[1]):
            cell = self.cells[:, column]
            mask = cell[at[0]]
            for more in at[1:]:
                mask &= cell[more]
            for i in range(64 * column, min(64 * column + 64, len(self.languages))):
                hits = np.bincount(doc, ((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(np.float64), n) / total
                out[:, i] = np.maximum(0.0, (hits - self.false_rate[i]) / max(1e-9, 1 - self.false_rate[i]))
        return out


def learn(docs: DataFrame) -> Masks:
    """Masks from ``text, lang`` of all given rows."""
    docs = docs.filter("lang is not null and text is not null").select("text", "lang")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    counted = _learned(docs)
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counted.join(total, "lang").filter(F.col("n") >= SHARE * F.col("total")).select("lang", "gram").toArrow()
    names, gram = np.array(kept["lang"].to_pylist(), object), kept["gram"].to_numpy()
    return Masks([r["lang"] for r in sizes], {r["lang"]: gram[names == r["lang"]] for r in sizes})


def predict(docs: DataFrame, masks: Masks) -> DataFrame:
    """``doc_id, lang_pred, score`` and the columns of ``docs`` other than the text."""
    held = docs.sparkSession.sparkContext.broadcast(masks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in sliced(batch, 1):
                n = part.num_rows
                texts = part.column(1).to_pylist()
                named = np.array([bool(t) and _LETTER.search(t) is not None for t in texts], bool) & bool(m.languages)
                share = m.shares(*_grams(part, 1), n) if m.languages else np.zeros((n, 1))
                best = share.argmax(1)  # languages are ordered by training texts
                total = share.sum(1)
                score = np.where(named & (total > 0), share[np.arange(n), best] / np.where(total > 0, total, 1), 0.0)
                names = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best, named, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the training folds and predict every row."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS))
    docs = docs.select("doc_id", "text", "lang", (fold == HELD_OUT).alias("held_out"))
    return predict(docs.drop("lang"), learn(docs.filter("not held_out")))
