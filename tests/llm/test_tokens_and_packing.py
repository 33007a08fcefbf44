import random
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from corpora import corpus
from tokenizers import Tokenizer

from aulario.llm import bin_completion as bc
from aulario.llm import token_counts as tc

ODD = [
    "  a  b\n\n c<|endoftext|>  <|endoftext|>x", "\x85\x1c a'S 's don't''s", "Ωσς ΑΣ İstanbul é ́x ﬁ 𝔘", "<|ENDOFTEXT|> <|startoftext|>x",
    "x　y z", "中文字 テスト ๑๒ ²", "\r\n \t ",
]


def texts():
    rnd = random.Random(1)
    signs = " \n\t\r\x0b\x0c\x1c\x85\xa0'sStTa1²ßéȩ́中😀.,<|>endoftextΣσ‍ำ"
    return [*corpus(21, 80), *ODD, *("".join(rnd.choice(signs) for _ in range(rnd.randint(1, 60))) for _ in range(300))]


def test_counts_equal_the_library(documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    own = texts()
    got = {r["doc_id"]: r for r in tc.count_tokens(documents(own), path, limit=30).collect()}
    assert len(got) == len(own)
    for i, t in enumerate(own):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[3 * i]["n_tokens"], got[3 * i]["n_bytes"], got[3 * i]["over_limit"]) == (n, len((t or "").encode()), n > 30)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_and_layout(documents, capacity, monkeypatch):
    monkeypatch.setattr(bc, "RUN", 7)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    own = [*texts(), "long " * 5000]
    rows = bc.pack(bc.pieces(documents(own), path, capacity), capacity).collect()
    want = {}
    for i, t in enumerate(own):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[3 * i, p] = (at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(n for _, n, _ in want.values())
    assert len(sequences) <= -(-total // capacity) * 1.05 + 1


def fewest(lengths, capacity):
    """Fewest bins by trying everything."""
    best = len(lengths)
    lengths = sorted(lengths, reverse=True)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= capacity:
                place(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def test_bin_completion_is_near_the_optimum():
    rnd = random.Random(5)
    extra = 0
    for _ in range(60):
        lengths = [rnd.randint(1, 40) for _ in range(rnd.randint(1, 9))]
        patterns = bc.complete_bins(dict(Counter(lengths)), 40)
        placed = Counter()
        for pattern, times in patterns:
            assert sum(n * c for n, c in pattern) <= 40
            for n, c in pattern:
                placed[n] += c * times
        assert placed == Counter(lengths)
        extra += sum(t for _, t in patterns) - fewest(lengths, 40)
    assert extra <= 2


def test_slots_stay_bounded_and_repeated_rows_are_packed_each(spark, documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = documents(["a b c"] * 5)
    twice = docs.union(docs)
    rows = bc.pack(bc.pieces(twice, path)).collect()
    assert len(rows) == 10 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 10
    assert bc.pack(bc.pieces(docs.limit(0), path)).count() == 0
    assert tc.count_tokens(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"), 9).count() == 0


def test_ids_while_words_are_forgotten(monkeypatch):
    """Words that are forgotten, kept or seen again give the ids of the library, slice after slice."""
    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(5)
    common = [f"w{i}" for i in range(12)]
    for limit in (1, 8, 30):
        monkeypatch.setattr(bc, "REMEMBERED", limit)
        v = bc.WordIds(path)
        for _ in range(25):
            own = [" ".join(rnd.choice(common + [f"Rare{rnd.random()}'s"]) for _ in range(rnd.randint(0, 15))) for _ in range(3)]
            own = [*own, None, "  \n", "a <|endoftext|>B"]
            ids, bounds = v.encode(pa.array(own))
            got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
            assert got == [library.encode(t or "", add_special_tokens=False).ids for t in own]


def test_workers_of_packing_hold_little(spark, documents):
    """Rows reach a worker in batches of a few MB; the library gets the unknown words of a slice in lots."""
    import corpus_pipeline as cp
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).nbytes])], ["n"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = documents(["x " * 250_000] * 48).coalesce(1)
    assert cp.packing(spark, docs, "").count() == 48 * -(-250_001 // 2048)
    got = [r["n"] for r in docs.select("text").mapInArrow(sizes, "n bigint").collect()]
    assert sum(got) >= 24_000_000 and max(got) < 10_000_000

    class Library:
        def encode_batch_fast(self, words, **how):
            lots.append(len(words))
            return kept.encode_batch_fast(words, **how)

    v, lots = bc.WordIds(public_tokenizers.path("word_bpe_49k.json")), []
    kept, v.tokenizer = v.tokenizer, Library()
    ids, bounds = v.encode(pa.array([" ".join(f"w{i}q" for i in range(10_000))]))
    assert sum(lots) == 10_000 and max(lots) < 5_000
    assert ids.tolist() == kept.encode(" ".join(f"w{i}q" for i in range(10_000)), add_special_tokens=False).ids


def test_words_that_share_parts_are_merged_once(monkeypatch):
    """Signs and letters of a word are remembered apart, so words that differ in signs cost one merge; ids stay the same."""
    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    v = bc.WordIds(path)
    stems = [f"{a}{b}zu{c}" for a in "klmnp" for b in "aeioü" for c in "rstÉß"]
    v.encode(pa.array([" ".join(s + sign for s in stems for sign in ["", ".", ",", "###", "%%%", "$$$", '"']), "1234567 7654 321"]))
    assert len(v.rank) == len(stems) + 6 + 7

    rnd = random.Random(8)
    signs = "aezEZéÉßÿ×÷µªÀÞø019.,'<|>_~!/:@[`{\x00\x1c\x7f\xa0́　ﬁΣ中😀"
    words = ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 7))) for _ in range(4000)]
    words += ["a<", "|b", "<", "|", "a.<|endoftext|>1", "don't", "..'s", "''s", "é'll", "é.", "1é", "é1", "é.1", "E<|B"]
    own = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)] + words[-14:]
    ids, bounds = v.encode(pa.array(own))
    got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in own]
