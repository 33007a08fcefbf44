"""Sanctions: expiry, new ones merged into what they touch, maintenance and edits."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aulario.functions.dates import today
from aulario.functions.text import is_ci_shape
from aulario.operators.filters import flag_people
from aulario.operators.notices import append_notifications, message, notifications
from aulario.operators.verdicts import Outcome, judge
from aulario.plans.intervals import merge_intervals
from aulario.plans.numbering import next_ids
from aulario.sources import fixed
from aulario.sources.model import Model


def expire_sanctions(t: Model, as_of: dt.datetime) -> Model:
    """Deactivate sanctions that ended before the day."""
    over = F.col("fecha_fin") < today(as_of)
    return t.replace(
        sancion_participante=t.sancion_participante.withColumn("activa", F.when(over, False).otherwise(F.col("activa")))
    )


def two_months(as_of: dt.datetime) -> Column:
    """End of a sanction that starts on the day (month ends are clamped)."""
    return F.add_months(today(as_of), fixed.SANCION_MESES)


def append_sanctions(t: Model, people: DataFrame, start: Column, end: Column) -> DataFrame:
    """The sanction table plus an active sanction for each row of ``people`` (distinct ``ci``)."""
    new = _new_sanctions(people, start, end)
    numbered = next_ids(new, ["ci_participante"], "id_sancion", t.sancion_participante)
    return t.sancion_participante.unionByName(numbered.select(*t.sancion_participante.columns))


def _new_sanctions(people: DataFrame, start: Column, end: Column) -> DataFrame:
    return people.select(
        F.col("ci").alias("ci_participante"),
        start.alias("fecha_inicio"),
        end.alias("fecha_fin"),
        F.lit(True).alias("activa"),
    )


class _Request(NamedTuple):
    day: Column
    end: Column

    def touches(self) -> Column:
        """Whether a sanction overlaps the interval from the day to ``end``, or is next to it."""
        start, stop = F.col("fecha_inicio"), F.col("fecha_fin")
        overlaps = (start <= self.end) & (stop >= self.day)
        return overlaps | (stop == F.date_sub(self.day, 1)) | (start == F.date_add(self.end, 1))


def sanction_verdicts(t: Model, reqs: DataFrame, as_of: dt.datetime) -> DataFrame:
    ci = F.trim("ci")
    known = flag_people(t, reqs.withColumn("ci", ci))
    return judge(
        known,
        [
            ("bad_date", F.col("fecha_fin").isNull()),
            ("ends_in_past", F.col("fecha_fin") < today(as_of)),
            ("bad_ci", ~is_ci_shape("ci")),
            ("unknown_participant", ~F.col("existe")),
            ("no_programme", ~F.col("en_programa")),
        ],
    ).select(*reqs.columns, "verdict", "reason")


def add_sanctions(t: Model, reqs: DataFrame, as_of: dt.datetime) -> Outcome:
    """Take in sanctions (``request_id``, ``ci``, ``fecha_fin``) that start on the day.

    All requests for a person start on the same day, so whatever order they come in, together they
    absorb exactly the active sanctions the longest of them touches, and end as one sanction. Only
    a person's first request can be a plain insertion, and only then is the person notified.
    """
    verdicts = sanction_verdicts(t, reqs, as_of)
    per_person = (
        verdicts.filter(F.col("verdict") == "accepted")
        .groupBy(F.col("ci").alias("ci_participante"))
        .agg(F.max("fecha_fin").alias("_fin"), F.min_by("fecha_fin", "request_id").alias("_fin_primera"))
    )
    day = today(as_of)
    state = t.sancion_participante.join(per_person, "ci_participante", "left")
    asked = F.col("_fin").isNotNull()
    absorbed = F.coalesce(asked & F.col("activa") & _Request(day, F.col("_fin")).touches(), F.lit(False))
    touched_first = F.col("activa") & _Request(day, F.col("_fin_primera")).touches()
    kept = state.filter(~absorbed).select(*t.sancion_participante.columns)

    merged = (
        state.filter(absorbed)
        .groupBy("ci_participante")
        .agg(
            F.min("fecha_inicio").alias("_ini_previo"),
            F.max("fecha_fin").alias("_fin_previo"),
            F.max(touched_first).alias("_habia"),
        )
    )
    result = per_person.join(merged, "ci_participante", "left").select(
        F.col("ci_participante").alias("ci"),
        F.least(day, F.col("_ini_previo")).alias("ini"),
        F.greatest(F.col("_fin"), F.col("_fin_previo")).alias("fin"),
        F.coalesce("_habia", F.lit(False)).alias("fusion"),
    )

    def with_new(_: Model) -> DataFrame:
        # numbered after every id in use, the absorbed ones included
        new = _new_sanctions(result, F.col("ini"), F.col("fin"))
        numbered = next_ids(new, ["ci_participante"], "id_sancion", t.sancion_participante)
        return kept.unionByName(numbered.select(*kept.columns))

    notices = notifications(result.filter(~F.col("fusion")), message("sanction"), as_of)
    return Outcome(
        t.replace(sancion_participante=with_new, notificacion=lambda _: append_notifications(t, notices)), verdicts
    )


def coalesce_sanctions(t: Model) -> Model:
    """Merge each person's active sanctions that overlap or are one day apart; keeps the lowest id."""
    table = t.sancion_participante
    merged = merge_intervals(
        table.filter("activa"), "ci_participante", "fecha_inicio", "fecha_fin", id_col="id_sancion"
    ).withColumn("activa", F.lit(True))
    return t.replace(sancion_participante=table.filter(~F.col("activa")).unionByName(merged.select(*table.columns)))


def edit_sanctions(t: Model, edits: DataFrame) -> Outcome:
    """Set end and state of the sanctions with the given person and start; the last request wins."""
    verdicts = judge(
        edits,
        [
            ("bad_date", F.col("fecha_inicio").isNull() | F.col("fecha_fin").isNull()),
            ("ends_before_start", F.col("fecha_fin") < F.col("fecha_inicio")),
        ],
    )
    last = (
        verdicts.filter(F.col("verdict") == "accepted")
        .groupBy(F.col("ci").alias("ci_participante"), "fecha_inicio")
        .agg(F.max_by(F.struct("fecha_fin", "activa"), "request_id").alias("_e"))
    )
    table = t.sancion_participante
    edited = table.join(last, ["ci_participante", "fecha_inicio"], "left")
    hit = F.col("_e").isNotNull()
    edited = edited.withColumns(
        {
            "fecha_fin": F.when(hit, F.col("_e.fecha_fin")).otherwise(F.col("fecha_fin")),
            "activa": F.when(hit, F.col("_e.activa")).otherwise(F.col("activa")),
        }
    )
    return Outcome(t.replace(sancion_participante=edited.select(*table.columns)), verdicts)
