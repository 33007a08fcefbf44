import random
import zlib

import numpy as np

from aulario.llm import language_masks as lm

SYLLABLES = {
    "en": ["the", "ing", "er", "on", "wh", "ly", "and"],
    "de": ["sch", "ung", "keit", "ein", "ü", "der", "heit"],
    "fr": ["eau", "oi", "é", "que", "ment", "aux", "le"],
    "zz": ["xo", "qa", "yk", "zu", "vö"],
}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_folds(documents):
    rnd = random.Random(3)
    langs = [rnd.choice(list(SYLLABLES)) for _ in range(400)]
    texts = [text(rnd, x, rnd.randint(4, 80)) for x in langs]
    extra = [None, "", " 12 $$ \n", "q", "7" * 300]
    rows = lm.identify(documents([*texts, *extra], [*langs, "en", "en", None, "fr", "de"])).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) + len(extra)
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [i for i in range(len(texts)) if got[3 * i]["held_out"]]
    assert sum(got[3 * i]["lang_pred"] == langs[i] for i in held) >= 0.97 * len(held)
    und = [got[3 * (len(texts) + i)]["lang_pred"] for i in range(5)]
    assert und[0] == und[1] == und[2] == und[4] == "und" and und[3] != "und"


def test_signs_that_are_no_letters_name_no_language(documents):
    texts = ["the of and a letter"] * 20 + ["²½ Ⅷ ① ١٢", "_ _", "ª", "字"]
    got = [r["lang_pred"] for r in sorted(lm.identify(documents(texts)).collect(), key=lambda r: r["doc_id"])]
    assert got[20:] == ["und", "und", "en", "en"]


def test_a_big_filter_is_filled_evenly():
    gram = np.arange(400_000).astype(np.uint32)
    masks = lm.Masks(["x", "y"], {"x": gram.astype(np.int64), "y": gram[:1].astype(np.int64)})
    assert masks.size > 1 << 21 and masks.false_rate[0] < 0.01
    assert abs(masks.shares(gram, np.zeros(len(gram), np.int64), 1)[0, 0] - 1) < 1e-6


def test_filter_holds_every_gram_and_corrects_false_hits():
    rnd = np.random.default_rng(1)
    names = [f"l{i:03}" for i in range(130)]  # more than two columns of masks
    grams = {n: rnd.integers(0, 1 << 32, 500) for n in names}
    masks = lm.Masks(names, grams)
    for i in (0, 63, 64, 129):
        share = masks.shares(grams[names[i]].astype(np.uint32), np.zeros(500, np.int64), 1)
        assert share.argmax() == i and abs(share[0, i] - 1) < 1e-6 and np.delete(share[0], i).max() < 0.05


def test_nothing_learned_and_empty_table(documents):
    assert {r["lang_pred"] for r in lm.identify(documents(["the of", "x"], [None, None])).collect()} == {"und"}
    assert lm.identify(documents(["x"]).limit(0)).count() == 0
