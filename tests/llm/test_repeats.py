import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from corpora import corpus

from aulario.llm import fm_index, repeats, run_length_index


def brute_bytes(texts, width=50):
    seen: dict[bytes, int] = {}
    raw = [(t or "").encode() for t in texts]
    for i, t in enumerate(raw):
        for j in range(len(t) - width + 1):
            seen.setdefault(t[j : j + width], i)
    out = {}
    for i, t in enumerate(raw):
        gone = np.zeros(len(t) + 1, bool)
        for j in range(len(t) - width + 1):
            if seen[t[j : j + width]] < i:
                gone[j : j + width] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out[3 * i] = (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_equal_brute_force(documents, seed):
    texts = corpus(seed, 250)
    rows = run_length_index.remove_seen(documents(texts)).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert got == brute_bytes(texts)


def test_run_length_index_walks_and_locates():
    rnd = random.Random(5)
    parts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 30))).encode() for _ in range(40)]
    symbols = np.frombuffer(b"".join(parts), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    held, order, _ = repeats.classes(symbols, begin, 10)
    index = run_length_index.RunLengthIndex.build(order, held)
    assert (index.locate(np.arange(len(held))) == order).all()
    symbol, row = index.step(np.arange(len(held)))
    inner = symbol != 0
    assert (symbol == held[order - 1]).all() and (order[row] == order - 1)[inner].all()


def brute_words(texts, width=35):
    own = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    times: dict[tuple, int] = {}
    for w in own:
        for j in range(len(w) - width + 1):
            times[tuple(w[j : j + width])] = times.get(tuple(w[j : j + width]), 0) + 1
    out = {}
    for i, w in enumerate(own):
        gone = set()
        for j in range(len(w) - width + 1):
            if times[tuple(w[j : j + width])] > 1:
                gone.update(range(j, j + width))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[3 * i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_words_equal_brute_force(documents, seed):
    texts = corpus(seed, 250)
    rows = fm_index.remove_repeated(documents(texts)).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows}
    assert got == brute_words(texts)


def test_empty_table(documents):
    assert run_length_index.remove_seen(documents(["x"]).limit(0)).count() == 0
    assert fm_index.remove_repeated(documents(["x"]).limit(0)).count() == 0


def _docs(texts):
    n = len(texts)
    columns = {"doc_id": pa.array(range(n), pa.int64()), "text": texts, "rid": pa.array(range(n), pa.int64())}
    return pa.table({**columns, "bucket": pa.array([0] * n, pa.int32())})


def test_phrases_below_the_width_share_no_anchor():
    rnd = random.Random(8)
    phrases = ["".join(rnd.choice("abcdefghij") for _ in range(20)) for _ in range(5)]
    texts = ["".join(rnd.choice(phrases) + "".join(rnd.choice("klmnopqrst") for _ in range(40)) for _ in range(20)) for _ in range(30)]
    plan = run_length_index.PLAN
    symbols, offsets = plan.symbols(pa.RecordBatch.from_pydict({"doc_id": range(30), "text": texts}))
    _, _, doc, h = repeats.segments(plan, symbols, offsets)
    pairs = np.unique(np.column_stack([h, doc.astype(np.uint64)]), axis=0)
    assert len(np.unique(pairs[:, 0])) == len(pairs)


def test_what_is_sent_for_anchors_does_not_grow_with_the_shards():
    rnd = random.Random(9)
    docs = _docs(["".join(rnd.choice("abcdefghij") for _ in range(120)) for _ in range(400)])
    few, many = (repeats._anchors(run_length_index.PLAN, n)(docs) for n in (4, 400))
    sent = [sum(len(x) for c in ("keys", "twice") for x in t[c].to_pylist()) for t in (few, many)]
    assert sent[0] == sent[1] and many.num_rows == 400


@pytest.mark.parametrize("plan", [run_length_index.PLAN, fm_index.PLAN])
def test_anchors_do_not_depend_on_the_block(plan, monkeypatch):
    texts = corpus(6, 60)
    part = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})
    whole = repeats.segments(plan, *plan.symbols(part))
    monkeypatch.setattr(repeats, "_BLOCK", 70)
    for a, b in zip(whole, repeats.segments(plan, *plan.symbols(part)), strict=True):
        assert a.tolist() == b.tolist()


def test_names_found_among_others():
    rnd = np.random.default_rng(4)
    values = rnd.integers(0, 5000, 3000).astype(np.uint64) << np.uint64(30)
    wanted = np.unique(rnd.integers(0, 5000, 700).astype(np.uint64) << np.uint64(30))
    assert (repeats._among(values, wanted) == np.isin(values, wanted)).all()
    assert not repeats._among(values, wanted[:0]).any()
