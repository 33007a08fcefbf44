"""Token counts of whole texts under a byte-level BPE vocabulary.

Whole-token shortcut: it is proved once per worker, by encoding the vocabulary itself, which strings
come out as one token when they stand alone. A text is cut into pre-tokens; those strings count one,
and only the rest is merged by the library, a bounded number of results being remembered. Pre-tokens
are encoded one by one, which gives the same as the whole text, as merges never cross them.

Strings of special tokens inside a text count as one token, as in the library. Null counts as empty.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from aulario.llm.text import sliced

#: Merged pre-tokens remembered by a worker before it starts afresh.
REMEMBERED = 300_000
#: The pattern by which byte-level vocabularies of this family cut a text. White space
#: is spelled out, as the pattern language of the library means the Unicode property.
PRE_TOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


class Vocabulary:
    """A vocabulary file with the strings that are one token by themselves."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = regex.compile(PRE_TOKENS).findall
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.whole = self._prove(set(special))
        self.known = dict(self.whole)

    def _prove(self, special: set[str]) -> dict[str, int]:
        ids = sorted(self.tokenizer.get_vocab().values())
        strings = [s for s in self.tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False) if "�" not in s]
        strings = [s for s in strings if s and s not in special and self.cut(s) == [s]]
        encoded = self.tokenizer.encode_batch(strings, add_special_tokens=False)
        return {s: 1 for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1}

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        extra, cuts = [], []
        for text in texts:
            parts = [text] if self.special is None else self.special.split(text)
            extra.append(len(parts) - 1)
            cuts.append([p for part in parts for p in self.cut(part)] if len(parts) > 1 else self.cut(text))
        new = list(set().union(*cuts).difference(self.known))
        if len(self.known) + len(new) > len(self.whole) + REMEMBERED:
            self.known = dict(self.whole)
            new = list(set().union(*cuts).difference(self.known))
        encoded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.known.update((p, len(e.ids)) for p, e in zip(new, encoded, strict=True))
        known = self.known.__getitem__
        return [n + sum(map(known, cut)) for n, cut in zip(extra, cuts, strict=True)]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def count_tokens(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; ``path`` is readable on every worker."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for part in sliced(batch, 1):
                text = pc.fill_null(part.column(1), "")
                n = pa.array(v.count(text.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pc.binary_length(text).cast(pa.int64()), n, pc.greater(n, limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        counted, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
