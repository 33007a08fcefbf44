import random

import corpus_pipeline as cp
import numpy as np
from corpora import corpus, sentence
from pyspark.sql import functions as F
from test_divergence_rules import base
from test_jaccard_join import brute
from test_repeats import brute_bytes
from test_simhash_windows import brute as brute_leaks

from aulario.llm import divergence_rules
from aulario.plans.staging import stage


def test_every_stage_decides_on_what_it_is_given(spark, documents, tmp_path):
    rnd = random.Random(2)
    items = [sentence(rnd, 30), sentence(rnd, 40)]
    texts = [*corpus(41, 150), *(sentence(rnd, 25) + " " + i + " " + sentence(rnd, 25) for i in items)]
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(texts)
    given = {3 * i: t for i, t in enumerate(texts)}

    one = stage(cp.quality(spark, docs, str(tmp_path)), "t")
    verdict = {r["doc_id"]: r["kept"] for r in divergence_rules.judge(docs).collect()}
    rows = {r["doc_id"]: r["text"] for r in one.collect()}
    assert one.columns == list(cp.COLUMNS)
    assert rows == {d: t for d, t in given.items() if verdict[d]} and not any(base(t)[5] for t in rows.values())

    two = stage(cp.near_duplicates(spark, one, str(tmp_path)), "t")
    order = sorted(rows)
    want = {order[d // 3] for d, (_, c) in brute([rows[d] for d in order]).items() if c == d}
    left = {r["doc_id"]: r["text"] for r in two.collect()}
    assert left.keys() == want and two.columns == list(cp.COLUMNS)

    three = stage(cp.seen_passages(spark, two, str(tmp_path)), "t")
    order = sorted(left)
    cut = brute_bytes([left[d] for d in order])
    whole = {order[d // 3] for d, x in cut.items() if x[1] == 0}
    after = {r["doc_id"]: r for r in three.collect()}
    assert whole <= after.keys() <= left.keys() and three.columns == list(cp.COLUMNS)
    assert all(after[d]["text"] == left[d] for d in whole) and len(whole) < len(after)
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())

    four = stage(cp.decontaminate(spark, three, str(tmp_path)), "t")
    order = sorted(after)
    leaks = {order[d // 3] for d, _ in brute_leaks([after[d]["text"] for d in order], items)}
    kept = {r["doc_id"] for r in four.collect()}
    assert leaks and kept == set(order) - leaks and four.columns == list(cp.COLUMNS)

    five = cp.packing(spark, four, str(tmp_path))
    assert {r["doc_id"] for r in five.collect()} == kept
    assert five.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert np.isin(["sequence_id", "offset"], five.columns).all()


def test_empty_documents(spark, documents, tmp_path):
    documents(["x"]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
