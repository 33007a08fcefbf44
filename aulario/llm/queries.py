"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from aulario.llm import (
    bin_completion,
    divergence_rules,
    fm_index,
    jaccard_join,
    language_masks,
    min_cut_blocks,
    periodic_runs,
    piece_agenda,
    run_length_index,
    simhash_windows,
    spelling_index,
    suffix_tree_lm,
    token_counts,
)
from aulario.llm.oracles import ORACLES
from aulario.llm.text import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_windows.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_length_index.remove_seen(table(spark, sf_dir, "documents"))


def op3_min_cut_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return min_cut_blocks.extract(table(spark, sf_dir, "pages"))


def op4_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_masks.identify(table(spark, sf_dir, "documents"))


def op5_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


def op7_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bin_completion.pack(bin_completion.pieces(table(spark, sf_dir, "documents"), path))


def op8_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.remove_repeated(table(spark, sf_dir, "documents")).drop("kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path, limit=1024)


def op10_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = divergence_rules.judge(table(spark, sf_dir, "documents"))
    return judged.drop("class_distance", "word_distance")


def op11_spelling_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_index.vocabulary(table(spark, sf_dir, "documents"), drop_every=spelling_index.DROP_EVERY)
    return spelling_index.group(words)


def op12_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_agenda.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.runs(docs))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash_windows,
        op2_run_length_index,
        op3_min_cut_blocks,
        op4_language_masks,
        op5_suffix_tree_lm,
        op6_jaccard_join,
        op7_bin_completion,
        op8_fm_index,
        op9_token_counts,
        op10_divergence_rules,
        op11_spelling_index,
        op12_piece_agenda,
        op13_periodic_runs,
        pipeline,
    )
}

__all__ = ["ORACLES", "QUERIES"]
