"""Lists per key that stay bounded and in order however many items a key has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aulario.functions.numbers import int_div
from aulario.plans.running import dealt_by_range
from aulario.plans.staging import stage

PAGE = 1000


def ranked_within(df: DataFrame, keys: Sequence[str], item: str, out: str) -> DataFrame:
    """Add ``out``: position from 0 of each row among those of its ``keys``, by ``item`` (NULLs last).

    The rows are dealt by ranges of key and item and written so; a position is the number of rows of
    the key in earlier ranges plus the place within the own one. No task holds more than a range,
    whatever a key has.
    """
    dealt = dealt_by_range(df, keys, F.col(item).asc_nulls_last())
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    starts = starts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*keys, "_range").orderBy(F.col(item).asc_nulls_last())
    placed = dealt.withColumn("_place", F.row_number().over(own) - 1).join(starts, [*keys, "_range"])
    return placed.withColumn(out, F.col("_start") + F.col("_place")).select(*df.columns, out)


def paged_lists(
    df: DataFrame, keys: Sequence[str], item: str, out: str, page_size: int = PAGE, rows_as: str | None = None
) -> DataFrame:
    """Sorted lists of ``item`` per ``keys``, cut into pages of ``page_size`` rows.

    Page p holds the rows from p * ``page_size`` on in the order of ``item``, so the pages of a key
    one after the other are its list. Keys that fit into one page need no positions; those that do
    not are ranked in ranges. NULL items come last and are left out of the lists; ``rows_as`` names a
    count of all rows of the page. ``keys`` must not be NULL.
    """
    aggs = [F.sort_array(F.collect_list(item)).alias(out)]
    if rows_as:
        aggs.append(F.count("*").alias(rows_as))
    long = stage(df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > page_size).select(*keys), "long")
    page = F.lit(0).cast("int").alias("pagina")
    if long.isEmpty():
        rows = df.select(*keys, item, page)
    else:
        ranked = ranked_within(df.join(long, list(keys), "left_semi"), keys, item, "_rank")
        pages = int_div(F.col("_rank"), F.lit(page_size)).cast("int").alias("pagina")
        rows = df.join(long, list(keys), "left_anti").select(*keys, item, page).unionByName(ranked.select(*keys, item, pages))
    return rows.groupBy(*keys, "pagina").agg(*aggs)
