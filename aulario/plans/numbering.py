"""Dense row numbers over a whole table without putting it through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aulario.plans.staging import stage

_PLACE_BITS = 33  # of monotonically_increasing_id: the place within the partition


def number_rows(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Add ``out`` = 1-based position of each row in the order of the columns ``order``.

    The rows are dealt by ranges of the order, sorted within each and written to the shared folder
    with range and place: a number once given does not depend on computing the rows again. Ranges are
    cut by sampling, so each is a part of the table whatever the keys are like. Counts per range, as
    many rows as there are ranges, turn into where each starts.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stage(dealt.withColumn("_place", F.monotonically_increasing_id()), out)
    dealt = dealt.withColumn("_range", F.shiftright("_place", _PLACE_BITS))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = starts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_place").bitwiseAND((1 << _PLACE_BITS) - 1)
    return dealt.join(starts, "_range").withColumn(out, F.col("_start") + place + 1).select(*df.columns, out)


def next_ids(new_rows: DataFrame, order: Sequence[str], id_col: str, existing: DataFrame) -> DataFrame:
    """Number ``new_rows`` in the order of columns upwards from the highest ``id_col`` in ``existing``."""
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long").alias("top")).scalar()
    return number_rows(new_rows, order, "_seq").withColumn(id_col, F.col("_seq") + top).drop("_seq")
