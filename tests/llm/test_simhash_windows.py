import random
import re

import numpy as np
from corpora import corpus, sentence

from aulario.llm import simhash_windows as sw


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def similar(a, b):
    k = min(5, len(a))
    bag = []
    for w in (a, b):
        bag.append({})
        for j in range(len(w) - k + 1):
            s = tuple(w[j : j + k])
            bag[-1][s] = bag[-1].get(s, 0) + len("".join(s).encode())
    keys = bag[0].keys() | bag[1].keys()
    low, high = (sum(f(x.get(s, 0) for x in bag) for s in keys) for f in (min, max))
    return low / high


def brute(docs, items):
    """Every window of every text against every item of its size."""
    best = {}
    for i, t in enumerate(docs):
        w = words(t)
        for j, item in enumerate(items):
            own = words(item)
            if own:
                scores = [similar(own, w[a : a + len(own)]) for a in range(len(w) - len(own) + 1)]
                if scores and max(scores) >= 0.75:
                    best[3 * i, j] = max(scores)
    return best


def test_exact_passages_all_found_and_no_false_ones(spark, documents):
    rnd = random.Random(9)
    items = [sentence(rnd, n) for n in (15, 22, 22, 40, 57, 3)] + [None, "", " \n"]
    texts = corpus(8, 60)
    for item in items[:5]:
        texts += [sentence(rnd, 12) + "\n" + item.upper() + " " + sentence(rnd, 5), item]
    edited = items[3].split(" ")
    edited[0] = "changed"
    texts.append(sentence(rnd, 9) + " " + " ".join(edited))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = sw.contaminated(documents(texts), bench).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows}
    want = brute(texts, items)
    assert all(abs(want[k] - v) < 1e-9 for k, v in got.items())
    assert all(k in got for k, v in want.items() if v > 0.999)
    assert len(got) >= 0.9 * len(want)


def test_recall_on_edited_items(spark, documents):
    rnd = random.Random(4)
    items = [sentence(rnd, rnd.randint(30, 57)) for _ in range(40)]
    texts = []
    for item in items:
        for _ in range(3):
            w = item.split(" ")
            w[rnd.randrange(len(w))] = "other"
            texts.append(sentence(rnd, 10) + " " + " ".join(w) + " " + sentence(rnd, 10))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in sw.contaminated(documents(texts), bench).collect()}
    want = brute(texts, items)
    assert len(want) > 40 and len(got & want.keys()) >= 0.9 * len(want) and got <= want.keys()


def test_blocks_find_every_fingerprint_within_the_radius():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        apart = sum(1 << int(b) for b in rnd.choice(64, sw.RADIUS, replace=False))
        assert any((apart >> 16 * b) & 0xFFFF in set(sw._FLIPS.tolist()) for b in range(4))


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    docs = documents(["a b c d e f"])
    assert sw.contaminated(docs, bench).count() == 1
    assert sw.contaminated(docs.limit(0), bench).count() == 0
    assert sw.contaminated(docs, bench.limit(0)).count() == 0


def test_only_windows_near_a_shingle_of_the_benchmark_are_looked_at(monkeypatch):
    """A text is hashed once, not once a size; every window with enough weight of its size's shingles is among the likely."""
    import pyarrow as pa

    rnd = random.Random(6)
    items = {n: sentence(rnd, n) for n in (3, 15, 16, 17, 22, 40, 57)}
    shingled = lambda *texts: sw.Shingled(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "text"]))
    known, seen = np.zeros(sw.BITMAP, bool), []
    for n, item in items.items():
        h, _ = shingled(item).of(min(5, n))
        for size in (n, sw.ANY):
            known[sw._slot(h[: n - min(5, n) + 1], size)] = True
    slot = sw._slot
    monkeypatch.setattr(sw, "_slot", lambda hashes, size: (seen.append(len(hashes)), slot(hashes, size))[1])
    text = " ".join(f"{rnd.random()}" for _ in range(3000))
    s = shingled(text)
    for n in items:
        sw._likely(s, n, known)
    assert sum(seen) < 3 * 3000

    mixed = [x for item in items.values() for x in (item, text[:300], item[: len(item) // 2])]
    s = shingled(" ".join(mixed), items[40], "", text[:200] + " " + items[15])
    for n in items:
        k = min(5, n)
        h, w = s.of(k)
        hit = np.where(known[slot(h, n)] & known[slot(h, sw.ANY)], w, 0)
        want = [
            a for a in range(len(h) - n + 1)
            if s.doc[a] == s.doc[a + n - 1] and 0 < hit[a : a + n - k + 1].sum() >= 0.75 * w[a : a + n - k + 1].sum()
        ]
        assert want and sw._likely(s, n, known).tolist() == want
