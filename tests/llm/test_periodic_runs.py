import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from corpora import corpus

from aulario.llm import periodic_runs as pr
from aulario.llm.queries import QUERIES


def brute(w, shortest=12):
    """(start, length, period) of all runs, lag by lag; the smallest period of each stretch."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(shortest, 2 * q) and j > i:
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc, w):
    if doc is None or not w:
        return w
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def repetitive(rnd):
    """Few words, Fibonacci and Thue-Morse words, repeats of repeats, and runs that meet in their middle."""
    kind, n = rnd.randrange(6), rnd.randint(0, 500)
    if kind == 0:
        return [rnd.choice("ab") for _ in range(n)]
    if kind == 1:
        a, b = "a", "ab"
        while len(b) < n:
            a, b = b, b + a
        return list(b[:n])
    if kind == 2:
        return ["ab"[i.bit_count() & 1] for i in range(n)]
    if kind == 3:
        out = []
        while len(out) < n:
            unit = [rnd.choice("abcdefgh"[: rnd.randint(1, 8)]) for _ in range(rnd.randint(1, 90))]
            out += (unit * 5)[: int(len(unit) * rnd.uniform(0.5, 4.5))] + ["x"] * (rnd.random() < 0.3)
        return out[:600]
    if kind == 4:
        unit = [rnd.choice("ab") for _ in range(rnd.randint(1, 6))]
        part = (unit * 80)[: rnd.randint(5, 140)]
        part += [rnd.choice("abc")] * rnd.randint(0, 2)
        return (part * rnd.randint(1, 4) + part)[:700]
    part = repetitive(rnd)
    return (part + part + part[: rnd.randint(0, len(part))])[:800]


@pytest.mark.parametrize(("lag", "shortest"), [(4, 2), (8, 2), (32, 12), (32, 2), (32, 40)])
def test_runs_of_repetitive_texts_equal_all_lags(lag, shortest):
    rnd = random.Random(lag)
    for _ in range(120):
        texts = [repetitive(rnd) for _ in range(rnd.randint(1, 5))]
        begin = np.cumsum([0, *map(len, texts)])
        ids = {c: np.uint64(rnd.getrandbits(64)) for c in "abcdefghx"}
        h = np.array([ids[c] for t in texts for c in t], np.uint64)
        got = [(s, e - s, q) for s, e, q in pr.find(h, begin, shortest, lag).tolist()]
        assert got == [(s + b, n, q) for t, b in zip(texts, begin.tolist()) for s, n, q in brute(t, shortest)]


def test_misleading_span_hashes_are_scanned_again(monkeypatch):
    w = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN"
    texts = [list(w * 3 + "x" + w), list("pqrs" + w * 2)]
    h = np.array([ord(c) * 7919 for t in texts for c in t], np.uint64)
    begin = np.cumsum([0, *map(len, texts)])
    want = pr.find(h, begin).tolist()
    assert want == [[s + b, s + b + n, q] for t, b in zip(texts, begin.tolist()) for s, n, q in brute(t)]
    common = pr._Spans.common
    monkeypatch.setattr(pr._Spans, "common", lambda self, a, b, side: np.minimum(common(self, a, b, side) + 1, a if side < 0 else len(self.sums) - 1 - b))
    assert pr.find(h, begin).tolist() == want


def test_rows_equal_brute_force(spark, documents):
    rnd = random.Random(2)
    texts = corpus(21, 80) + ["\n".join(repetitive(rnd)) for _ in range(60)] + ["a " * 20_000, "é b\t" * 9, "é b\t" * 9]
    rows = {r["doc_id"]: r for r in pr.runs(documents(texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want = brute(w) if len(w) < 5000 else [(0, len(w), 1)]
        r = rows[3 * i]
        assert r["n_words"] == len(w) and [tuple(x) for x in r["runs"]] == want
        assert r["collapsed"] == collapsed(w, want)


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_periodic_runs"](spark, sf).collect()
    assert len(got) == len(texts) and sum(r["n_runs"] > 0 for r in got) >= 10
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        w = planted(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or ""))
        if len(w) > 3000:
            continue
        runs = brute(w)
        first = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *first)
        assert r["exponent_milli"] == (1000 * first[1] // first[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r["collapsed_sha256"] == sha(collapsed(w, runs))


def test_null_ids_and_no_rows(spark):
    odd = spark.createDataFrame([(None, "a b " * 10), (None, None), (4, "")], "doc_id bigint, text string")
    rows = pr.digests(pr.runs(pr.with_planted_runs(odd))).collect()
    assert sorted(r["n_runs"] for r in rows) == [0, 0, 1]
    assert all(r["collapsed_sha256"] and r["runs_sha256"] for r in rows)
    assert pr.digests(pr.runs(pr.with_planted_runs(odd.limit(0)))).count() == 0
