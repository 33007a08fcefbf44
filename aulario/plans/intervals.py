"""Merge overlapping or touching date intervals per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(df: DataFrame, key: str, start: str, end: str, id_col: str | None = None, gap_days: int = 1) -> DataFrame:
    """One row per maximal run of intervals that overlap or lie at most ``gap_days`` apart.

    Returns ``key``, ``start``, ``end``, ``n`` (intervals merged) and, if ``id_col`` is given, the
    lowest id of the run. Intervals with the same start are folded first, so the window of a key
    holds at most one row per calendar day, whatever the number of its intervals.
    """
    folded_aggs = [F.max(end).alias(end), F.count("*").alias("n")]
    if id_col:
        folded_aggs.append(F.min(id_col).alias(id_col))
    folded = df.groupBy(key, start).agg(*folded_aggs)

    ordered = Window.partitionBy(key).orderBy(start)
    reach = F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > F.date_add(reach, gap_days)), 1).otherwise(0)
    runs = folded.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(ordered))

    out = [F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("n")]
    if id_col:
        out.append(F.min(id_col).alias(id_col))
    return runs.groupBy(key, "_run").agg(*out).drop("_run")
