"""Judging requests: the first rule that fails gives the reason."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Literal, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aulario.sources.model import Model

Rule = tuple[str, Column]
#: Whether requests meet the state before the batch, or the one that earlier requests left.
Mode = Literal["snapshot", "sequential"]


class Outcome(NamedTuple):
    """State after a batch, and what became of each request."""

    model: Model
    verdicts: DataFrame


def _fails(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def first_failing(rules: Sequence[Rule]) -> Column:
    """Name of the first rule whose condition holds, NULL if none does."""
    out = F.lit(None).cast("string")
    for reason, condition in reversed(rules):
        out = F.when(_fails(condition), reason).otherwise(out)
    return out


def any_fails(rules: Sequence[Rule]) -> Column:
    return reduce(lambda a, b: a | b, [_fails(c) for _, c in rules])


def judge(reqs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``verdict`` (accepted / rejected) and ``reason``."""
    judged = reqs.withColumn("reason", first_failing(rules))
    return judged.withColumn("verdict", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected"))
