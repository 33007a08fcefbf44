import collections
import math
import re
import zlib

import numpy as np
from corpora import corpus

from aulario.llm import suffix_tree_lm as lm


def brute(texts):
    own = {}
    for i, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        own[3 * i] = [*re.findall(r"[^\x20\x09-\x0D]+", low), None]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in own}
    c = collections.Counter(w for d, ws in own.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    return {
        d: (held[d], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        for d, ws in own.items()
    }


def test_base_equals_brute_force_and_tree_tells_more(documents):
    texts = corpus(11, 300) + ["the of and " * 30] * 12
    rows = lm.score(documents(texts)).collect()
    want = brute(texts)
    assert len(rows) == len(texts)
    for r in rows:
        held, n, known, tokens, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, tokens)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, n) and r["score"] < 0
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_states_do_not_reach_into_the_text_before():
    end, k = 3, lm.SYMBOLS
    got = lm._states(np.array([5, 6, end, 7, 8, end, end, 9]), end)
    pairs = [(end, end, 5), (end, 5, 6), (5, 6, end), (end, end, 7), (end, 7, 8), (7, 8, end), (end, end, end), (end, end, 9)]
    assert got.tolist() == [(a * k + b) * k + c for a, b, c in pairs]


def test_distributions_sum_to_one(monkeypatch):
    monkeypatch.setattr(lm, "SYMBOLS", 6)
    counts = np.random.default_rng(2).integers(0, 30, 6**3)
    assert np.allclose((10.0 ** lm.grow(counts).astype(float)).reshape(-1, 6).sum(1), 1, atol=1e-5)


def test_empty_table(documents):
    assert lm.score(documents(["x"]).limit(0)).count() == 0


def test_dealt_tree_equals_the_dense_one_over_all_words(documents, monkeypatch):
    texts = corpus(5, 150) + ["rare%d tells late%d" % (i % 40, i % 40) for i in range(400)]
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for t in texts]
    held = [zlib.crc32(str(3 * i).encode()) % 5 == 1 for i in range(len(texts))]
    number = {w: k for k, w in enumerate({w: 0 for ws, h in zip(words, held) if not h for w in ws})}
    # every trained word is a symbol, and one more stands for any unknown word
    monkeypatch.setattr(lm, "SYMBOLS", len(number) + 1)
    states = [lm._states(np.array([number.get(w, len(number)) for w in ws]), number[None]) for ws in words]
    counts = np.zeros(lm.SYMBOLS ** (lm.DEPTH + 1), np.int64)
    for s, h in zip(states, held):
        if not h:
            np.add.at(counts, s, 1)
    tree = lm.grow(counts)
    for r in lm.score(documents(texts)).collect():
        want = tree[states[r["doc_id"] // 3]].astype(float).sum()
        assert abs(r["score"] - want) < 1e-5 * max(1, r["n_tokens"])


def test_rare_words_keep_contexts(documents):
    texts = ["rare%d late%d" % (i % 1000, i % 1000) for i in range(8000)]
    rows = [r for r in lm.score(documents(texts)).collect() if r["held_out"]]
    assert len(rows) > 1000 and sum(r["score"] > r["base_score"] + 2 for r in rows) > 0.95 * len(rows)
