"""Running sums per key that no single task has to hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aulario.plans.staging import stage


def dealt_by_range(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The rows written by ranges of key and order, with the number of their range."""
    dealt = df.repartitionByRange(*keys, order)
    return stage(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, keys: Sequence[str], order: Column, sums: Mapping[str, str]) -> DataFrame:
    """Add, for each output name, the sum of a column over the rows of the key up to the own one.

    Rows are dealt by ranges: a running sum is that of the earlier ranges plus the one within the
    own range, so a key with any number of rows is spread.
    """
    dealt = dealt_by_range(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "_range").agg(*[F.sum(c).alias(c) for c in sums.values()])
    starts = totals.select(*keys, "_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_s_{o}") for o, c in sums.items()])
    own = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = dealt.withColumns({f"_i_{o}": F.sum(c).over(own) for o, c in sums.items()})
    added = [(F.col(f"_s_{o}") + F.col(f"_i_{o}")).alias(o) for o in sums]
    return inner.join(starts, [*keys, "_range"]).select(*df.columns, *added)
