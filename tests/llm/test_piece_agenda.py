import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from corpora import corpus

from aulario.llm import piece_agenda as pa
from aulario.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts(seed, n):
    rnd = random.Random(seed)
    signs = "aeiou théÉ ▁\n\t  0123<s>/unk>0x0A漢字🎉\0‍  the and ing "
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_ids_and_texts_equal_the_library(spark, documents, library):
    texts = corpus(11, 120) + odd_texts(2, 400) + [None, "", " ", "  ", "ab" * 30_000, "the end", "the end"]
    rows = {r["doc_id"]: r for r in pa.round_trip(documents(texts), PATH).collect()}
    arrays = pa.encode(documents(texts), PATH)
    ids = {r["doc_id"]: r["ids"] for r in arrays.collect()}
    decoded = {r["doc_id"]: r["text"] for r in pa.decode(arrays, PATH).collect()}
    assert len(rows) == len(ids) == len(decoded) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode(t or "")
        r = rows[3 * i]
        assert (r["n_tokens"], r["ids"], r["decoded"]) == (len(want), ",".join(map(str, want)), library.decode(want)), t
        assert ids[3 * i] == want and decoded[3 * i] == library.decode(want)


def test_any_ids_decode_as_in_the_library(library):
    v, rnd = pa.pieces(PATH), random.Random(5)
    for _ in range(3000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), rnd.randrange(3), 259, 28705]) for _ in range(rnd.randint(0, 8))]
        assert v.decode(ids) == library.decode(ids), ids


def test_a_wrong_merge_is_noticed(monkeypatch):
    v = pa.Pieces(PATH)
    monkeypatch.setattr(v, "scores", {p: -s for p, s in v.scores.items()})
    with pytest.raises(AssertionError):
        v.round_trip(["internationalunderstandingoflongwords"])
    v._tabulate()
    with pytest.raises(AssertionError):
        v.round_trip(["international understanding"])


def test_both_agendas_agree():
    v = pa.Pieces(PATH)
    parts = sorted({p for t in odd_texts(21, 400) for p in v.parts("▁" + t.replace(" ", "▁")) if len(p) <= pa.SHORT})
    assert v.encode_parts(parts) == [v.part_ids(p) for p in parts]


def test_what_a_worker_remembers_is_bounded(monkeypatch, library):
    monkeypatch.setattr(pa, "REMEMBERED", 200)
    v = pa.Pieces(PATH)
    for t in odd_texts(9, 200) + ["x" * 500]:
        assert v.round_trip([t])[0][1] == ",".join(map(str, library.encode(t)))
        assert v.held <= 200 or v.held <= len(t) + 1


def test_other_vocabularies_are_refused():
    with pytest.raises((ValueError, RuntimeError, OSError)):
        pa.Pieces(public_tokenizers.path("word_bpe_49k.json"))


def test_query_digests_whole_table_and_null_ids(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_piece_agenda"](spark, sf).collect()
    assert len(got) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha(",".join(map(str, ids))) and r["decoded_sha256"] == sha(library.decode(ids))
    odd = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id bigint, text string")
    assert sorted(r["n_tokens"] for r in pa.round_trip(odd, PATH).collect()) == [0, 2]
    assert pa.round_trip(odd.limit(0), PATH).count() == 0


def test_words_that_share_parts_are_encoded_once(library):
    """Signs after letters are remembered apart, so words that differ in them cost one encoding; results stay the same."""
    v = pa.Pieces(PATH)
    stems = ["house", "Garten", "élan", "señor"]
    text = " ".join(s + end for s in stems for end in ["", ".", ",", "###", "%%%", "\n", '"']) + " 1234 4321"
    assert v.round_trip([text])[0] == (len(want := library.encode(text)), ",".join(map(str, want)), library.decode(want))
    # the stems, one of each sign, four digits and the mark before them
    assert set(v.known) == {*("▁" + s for s in stems), ".", ",", "###", "%%%", "\n", '"', "1", "2", "3", "4", "▁"}

    rnd = random.Random(12)
    signs = "aenéß 0.,'*#$%&<>|_:-()\"\n\t\0▁中́ the .com ing ..."
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    for t, got in zip(texts, v.round_trip(texts), strict=True):
        want = library.encode(t)
        assert got == (len(want), ",".join(map(str, want)), library.decode(want)), t
