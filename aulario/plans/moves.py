"""Moves between places, one after the other: a place left by an earlier move is free for a later one.

Everybody who is somewhere holds a place; a move is granted if nobody else holds its target at its
turn, and then leaves the place held so far. Taken one at a time this is a loop; here all undecided
moves are looked at together, in rounds. Between two changes of the same holder a place is held for a
span of turns. With moves still undecided a span has two readings: what may be held (its start may
still be granted, and it lasts to the next granted move of the holder) and what is surely held (its
start is granted, and no move that may end it comes before). A move is

* refused if somebody else surely holds the target at its turn, and
* granted if nobody else may hold it.

For the first undecided move both readings agree, so every round decides. Moves that find their place
clearly free or clearly held, which are most, are settled in the first round; a chain in which each waits
for the one before to leave takes a round per link, over the moves that are left. Spans are turned into steps up and down per place,
and their running sums tell how many hold it at a turn: no pairs of moves are formed, and a place that
many want is spread over ranges of turns. The moves of one holder are put in order by one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aulario.plans.running import running_sums
from aulario.plans.staging import stage


def held_by_others(asked: DataFrame, moves: DataFrame, initial: DataFrame) -> DataFrame:
    """Add ``may`` and ``sure``: how many others may and do hold ``place`` at the turn ``at``.

    ``moves``: ``who, at, place, stays, ok`` (granted: true, undecided: null; refused ones are left
    out). ``initial``: ``who, place`` held before all turns.
    """
    turn = moves.schema["at"].dataType
    start = initial.select("who", F.lit(None).cast(turn).alias("at"), "place", F.lit(True).alias("stays"), F.lit(True).alias("ok"))
    later = Window.partitionBy("who").orderBy(F.col("at").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    granted_at = F.when(F.col("ok"), F.col("at"))
    spans = start.unionByName(moves.select("who", "at", "place", "stays", "ok")).withColumns(
        {"until": F.last(granted_at, ignorenulls=True).over(later), "until_any": F.last("at", ignorenulls=True).over(later)}
    )
    spans = spans.filter("stays").join(asked.select("place").distinct(), "place", "left_semi")

    def step(at: str, may: int, sure: int):
        return F.struct(F.col(at).alias("at"), F.lit(may).alias("may"), F.lit(sure).alias("sure"))

    opens = F.when(F.col("ok"), step("at", 1, 1)).otherwise(step("at", 1, 0))
    closes = F.when(F.col("until").isNotNull(), step("until", -1, 0))
    unsure = F.when(F.col("ok") & F.col("until_any").isNotNull(), step("until_any", 0, -1))
    events = spans.select("place", "who", F.explode(F.array_compact(F.array(opens, closes, unsure))).alias("e"))
    more = [c for c in asked.columns if c not in ("place", "who", "at")]
    none = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in more]
    events = events.select("place", "who", "e.at", "e.may", "e.sure", F.lit(False).alias("asks"), *none)
    asking = asked.select("place", "who", "at", F.lit(0).alias("may"), F.lit(0).alias("sure"), F.lit(True).alias("asks"), *more)
    rows = events.unionByName(asking)
    turn = F.struct("at", "asks")
    # what the asking holder has there does not count
    own = Window.partitionBy("place", "who").orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"own_may": F.sum("may").over(own), "own_sure": F.sum("sure").over(own)})
    summed = running_sums(rows, ["place"], turn, {"all_may": "may", "all_sure": "sure"}).filter("asks")
    others = [(F.col("all_may") - F.col("own_may")).alias("may"), (F.col("all_sure") - F.col("own_sure")).alias("sure")]
    return summed.select(*asked.columns, *others)


def settle(moves: DataFrame, initial: DataFrame) -> DataFrame:
    """The granted ones of ``moves`` (``who, at, place, stays``) with ``ok`` true; ``at`` orders them."""
    initial = stage(initial.join(moves.select("place").distinct(), "place", "left_semi"), "held")
    open_moves = stage(moves.withColumn("ok", F.lit(None).cast("boolean")), "moves")
    granted = [open_moves.limit(0)]
    while not open_moves.isEmpty():
        known = reduce(DataFrame.unionByName, [*granted, open_moves])
        outcome = F.when(F.col("sure") > 0, False).when(F.col("may") == 0, True)
        decided = stage(held_by_others(open_moves, known, initial).withColumn("ok", outcome).drop("may", "sure"), "moves")
        granted.append(decided.filter("ok"))
        open_moves = decided.filter("ok is null")
    return reduce(DataFrame.unionByName, granted)
