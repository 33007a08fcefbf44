"""First come, first served over a table of claims on limited resources.

Each claim asks for one unit in one or more groups (a room slot, a person's day, the seats of a
reservation...). Taken one at a time in order, a claim succeeds if every group it asks still has a
unit left. The same outcome is reached here in a few rounds over the whole table: a claim is

* refused once the units of one of its groups are gone, and
* granted once even the grant of every undecided claim before it would leave room in all of them.

A grant takes its unit at once, also from undecided claims before it: it was only made because there
was room for all of those too. A claim that only needs a unit to be free is not among those; once a claim
behind it is granted it has room for good, and no longer competes in that group. So a round looks at
undecided claims alone, with the units left. The earliest of them is always decidable, so the rounds end;
in practice a round decides most of what is left, because a group settles as soon as its first few claims
do. Of a group, only as many first claims matter as it still has units itself. They are picked by a ranked
filter; Spark applies its constant part (the most units any group has) before the shuffle too, so no task
ever holds all the claims of a popular group, and a large group does not make the lists of small ones
longer. Only ids leave the ranking: a claim is granted if every group it asks names it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aulario.plans.staging import stage


class Resource(NamedTuple):
    """A kind of group claims compete in.

    ``key`` is a column holding the group (NULL: the claim does not compete), ``free`` the units
    left in it before any claim, and ``uses`` a boolean column: whether a granted claim consumes a
    unit (else it only needs one to be free).
    """

    name: str
    key: str
    free: str
    uses: str | None = None


def _takers(claims: DataFrame, r: Resource) -> DataFrame:
    rows = claims.filter(F.col(r.key).isNotNull())
    return rows.filter(F.col(r.uses)) if r.uses else rows


def _first_claims(claims: DataFrame, r: Resource, order: str, most: int) -> DataFrame:
    """Per group: its first claims that take a unit, as many as it has left (``most`` at the most)."""
    own = F.greatest(F.col(r.free), F.lit(1))
    ranked = Window.partitionBy(r.key).orderBy(order)
    rows = _takers(claims, r).filter(F.col(order).isNotNull()).withColumn("_rank", F.rank().over(ranked))
    return rows.filter((F.col("_rank") <= most) & (F.col("_rank") <= own))


def _sure(claims: DataFrame, r: Resource, order: str, most: int) -> DataFrame:
    """``_id`` of the claims whose group has a unit left even if every undecided claim before them takes one."""
    head = _first_claims(claims.select("_id", order, r.key, r.free, *filter(None, [r.uses])), r, order, most)
    sure = head.select("_id")
    if r.uses:
        # one that takes nothing is sure up to the claim that would take the last unit
        last = head.groupBy(F.col(r.key).alias("_key")).agg(F.count("*").alias("_n"), F.max(order).alias("_last"))
        idle = claims.filter(F.col(r.key).isNotNull() & ~F.coalesce(r.uses, F.lit(False)))
        met = idle.select("_id", order, r.key, r.free).join(last, F.col(r.key) == F.col("_key"), "left")
        room = (F.coalesce("_n", F.lit(0)) < F.col(r.free)) | (F.col(order) <= F.col("_last"))
        sure = sure.unionByName(met.filter(room).select("_id"))
    return sure


def _with_groups(df: DataFrame, rows: DataFrame, key: str, order: str, *facts: Column) -> DataFrame:
    """Add ``facts``, aggregates of ``rows`` per group; rows of ``df`` without a group do not all go to one task.

    They are dealt by their order, as part of the key. For the groups that part is 0, written as an aggregate: a
    constant would be taken out of the join.
    """
    groups = rows.groupBy(F.col(key).alias("_key")).agg(*facts, F.max(F.lit(0)).alias("_part"))
    part = F.when(F.col(key).isNull(), F.hash(order)).otherwise(0)
    return df.join(groups, (F.col(key) == F.col("_key")) & (part == F.col("_part")), "left").drop("_key", "_part")


def _earlier(orders: str, order: str) -> Column:
    own = F.col(order)
    return F.coalesce(F.size(F.filter(F.col(orders), lambda o: o < own)), F.lit(0))


def _after(rest: DataFrame, newly: DataFrame, r: Resource, order: str) -> DataFrame:
    """``rest`` with the units its groups have left after the grants ``newly``, without claims of a used-up group."""
    taken = [F.count("*").alias("_taken"), *([F.max(order).alias("_latest")] if r.uses else [])]
    rest = _with_groups(rest, _takers(newly, r), r.key, order, *taken)
    if r.uses:
        # a grant behind a claim that takes nothing left room for it: there is nothing to wait for any more
        settled = ~F.coalesce(r.uses, F.lit(False)) & (F.col(order) < F.col("_latest"))
        rest = rest.withColumn(r.key, F.when(~F.coalesce(settled, F.lit(False)), F.col(r.key))).drop("_latest")
    rest = rest.withColumn(r.free, F.col(r.free) - F.coalesce("_taken", F.lit(0))).drop("_taken")
    return rest.filter(_open(r))


def _open(r: Resource) -> Column:
    return F.col(r.key).isNull() | F.coalesce(F.col(r.free) > 0, F.lit(True))


def grant_in_order(claims: DataFrame, order: str, resources: Sequence[Resource]) -> DataFrame:
    """The granted claims: the columns of ``claims``, decided in ascending ``order`` (unique)."""
    columns = claims.columns
    # only a claim that takes nothing may leave its group, so the other keys need no copy
    own = [r._replace(key=f"_{r.name}_key" if r.uses else r.key, free=f"_{r.name}_left") for r in resources]
    for r, mine in zip(resources, own):
        claims = claims.withColumns({mine.key: F.col(r.key), mine.free: F.col(r.free).cast("long")})
    for r in own:
        claims = claims.filter(_open(r))
    pending = stage(claims.withColumn("_id", F.monotonically_increasing_id()), "claims")
    most = pending.agg(F.count("*").alias("all"), *[F.max(r.free).alias(r.name) for r in own]).first()
    waiting, granted = most["all"], [pending.limit(0).select(*columns)]
    asks = reduce(lambda a, b: a + b, [F.col(r.key).isNotNull().cast("int") for r in own])
    asks = F.when(F.col(order).isNotNull(), asks).otherwise(0)
    while waiting:
        sure = reduce(DataFrame.unionByName, [_sure(pending, r, order, max(1, most[r.name] or 0)) for r in own])
        sure = sure.groupBy(F.col("_id").alias("_sure")).agg(F.count("*").alias("_n"))
        looked = pending.join(sure, F.col("_id") == F.col("_sure"), "left")
        outcome = F.coalesce("_n", F.lit(0)) >= asks
        decided = stage(looked.withColumn("_ok", outcome).select(*pending.columns, "_ok"), "round")
        newly = decided.filter("_ok")
        granted.append(newly.select(*columns))
        rest = decided.filter(~F.col("_ok")).drop("_ok")
        for r in own:
            rest = _after(rest, newly, r, order)
        pending = stage(rest, "claims")
        left = pending.count()
        if left == waiting:
            raise RuntimeError("a round decided nothing")
        waiting = left
    return reduce(DataFrame.unionByName, granted)


def granted_before(df: DataFrame, granted: DataFrame, order: str, r: Resource, out: str) -> DataFrame:
    """Add ``out``: units of ``r`` that earlier granted claims took in the group of each row."""
    # at most as many orders as the group had units, by construction of the grants
    met = _with_groups(df, _takers(granted, r), r.key, order, F.collect_list(F.col(order)).alias("_won"))
    return met.withColumn(out, F.when(F.col(r.key).isNotNull(), _earlier("_won", order)).otherwise(F.lit(0))).drop("_won")
