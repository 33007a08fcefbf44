import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpora import edge_texts

from aulario.llm import spelling_index as si


def near(a, b):
    """One code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, every):
    """Words and their forms by loops over all pairs."""
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if every and doc is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    neighbours = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in neighbours.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(neighbours[w]), n.get(form[w])) for w in n}


def misspelt(seed, docs):
    """Texts over few words with many variants, frequent ones with chains of forms, and letters of two bytes."""
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("aeéßtrÀ÷") for _ in range(rnd.randint(7, 9))) for _ in range(6)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rnd.randint(0, 120)):
            w = stems[min(rnd.randrange(6), rnd.randrange(6))]
            while rnd.random() < 0.15:
                k = rnd.randrange(len(w) + 1)
                w = w[:k] + rnd.choice(["", "a", "É"]) + w[k + rnd.randrange(2) :]
            words.append(w.upper() if rnd.random() < 0.1 else w)
        rows.append((7 * i, rnd.choice([" ", ", ", "-", "1"]).join(words)))
    return rows


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("every", [0, 3])
def test_equals_loops_over_all_pairs(spark, every):
    rows = misspelt(1, 150) + [(None, "zweifeln zweifeln ZWEIFELN"), (5, None), (5, "")]
    rows += [(-2, t) for t in edge_texts()]
    rows += [(None, "grundwort " * 400 + "grundwortx " * 30 + "grundwortxy " * 3)]  # a chain of two forms
    # very long words, repeated rows
    rows += [(8, "a" * 3000 + " " + "a" * 2999 + "b")] * 3
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, n bigint, word string")
    got = result(si.group(si.vocabulary(docs.repartition(3), drop_every=every)))
    want = expected(rows, every)
    assert got == want
    assert any(r[1] != r[0] and r[0] for r in want.values()), "a chain of two forms"


def test_hot_halves_are_cut_into_parts(spark, monkeypatch):
    rnd = random.Random(4)
    words = {"abcdefg" + "".join(rnd.choice("xyz") for _ in range(7)) for _ in range(300)}
    counted = [(w, rnd.choice([2, 30, 400])) for w in sorted(words)]
    table = spark.createDataFrame(counted, "word string, n bigint")
    monkeypatch.setattr(si, "SHARD_WORDS", 40)
    pairs = [(r["word"], r["near"]) for r in si.near_pairs(table).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if a != b and near(a, b)}


def test_index_finds_what_the_loop_finds():
    rnd = random.Random(3)
    for t in range(60):
        letters = "ab" if t % 2 else "aéb÷dx"
        word = lambda extra="": "".join(rnd.choice(letters + extra) for _ in range(rnd.randint(7, 10)))  # noqa: B023, E731
        words = list({word() for _ in range(rnd.randint(1, 60))})
        asked = sorted({word("q") for _ in range(rnd.randint(1, 60))} | set(words[:20]))
        questions = [(a, f, s) for a in asked for f in (True, False) for s in (False, True)]
        texts, front, shorter = zip(*questions)
        q, w = si.near_words(words, list(texts), np.array(front), np.array(shorter))
        got = [(questions[i][0], words[j]) for i, j in zip(q, w)]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a in asked for b in words if a != b and len(b) <= len(a) and near(a, b)}


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "short ones")], "doc_id bigint, text string")
    for d in (docs, docs.limit(0)):
        assert si.group(si.vocabulary(d)).collect() == []
