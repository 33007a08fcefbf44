"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; the first four
return the columns of ``documents``. ``doc_id`` is the key: rows that share one are kept or dropped
together, and rows without one pass the stages that decide by id, unless a rule rejects them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aulario.llm import bin_completion, divergence_rules, jaccard_join, run_length_index, simhash_windows
from aulario.llm.text import in_small_batches, table
from aulario.plans.staging import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    ids = ids.select(F.col("doc_id").alias("id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]), how).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near the references of their language."""
    return _by_id(docs, divergence_rules.judge(docs).filter("kept"), "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of linked ones."""
    in_small_batches(spark)
    first = jaccard_join.link(docs).filter("component_id = doc_id or component_id is null")
    return _by_id(docs, first, "left_semi")


def seen_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that an earlier document has; nothing is left of some."""
    in_small_batches(spark)
    left = run_length_index.without_seen(docs, ("lang", "source")).filter("n_removed = 0 or trim(text) <> ''")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return _by_id(docs, simhash_windows.contaminated(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset."""
    in_small_batches(spark)
    return bin_completion.pack(bin_completion.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("seen_passages", seen_passages),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Similarity search and packing cannot be stated in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each result but the last written and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
