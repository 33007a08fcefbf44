"""What a change in one table brings about in the others."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aulario.functions.dates import at_minute, now, plus_minutes, today
from aulario.operators.islands import ROOM_DAY
from aulario.operators.notices import append_notifications, message, notifications
from aulario.operators.sanctions import append_sanctions, two_months
from aulario.sources import fixed
from aulario.sources.model import Model


def newly_sanctioned(t: Model, changes: DataFrame) -> DataFrame:
    """People to sanction for reservations that became no-shows: ``ci``, ``id_reserva``.

    A person in several such reservations is sanctioned once, for the lowest-numbered one; a
    person who has an active sanction of any date is not sanctioned again.
    """
    became = (
        changes.filter(
            (F.col("estado_new") == fixed.SIN_ASISTENCIA) & (F.col("estado_old") != fixed.SIN_ASISTENCIA)
        )
        .select("id_reserva")
        .distinct()
    )
    under_sanction = t.sancion_participante.filter("activa").select(F.col("ci_participante").alias("ci"))
    return (
        t.reserva_participante.select(F.col("ci_participante").alias("ci"), "id_reserva")
        .join(became, "id_reserva", "left_semi")
        .groupBy("ci")
        .agg(F.min("id_reserva").alias("id_reserva"))
        .join(under_sanction, "ci", "left_anti")
    )


def sanctions_from_transitions(t: Model, changes: DataFrame, as_of: dt.datetime) -> Model:
    """Sanction and notify the people of reservations that turned into no-shows.

    ``changes`` holds ``id_reserva``, ``estado_old``, ``estado_new``. Who is already sanctioned is
    read from the state before the batch, for the sanction and for its notification alike.
    """
    people = newly_sanctioned(t, changes)
    return t.replace(
        sancion_participante=lambda _: append_sanctions(t, people, today(as_of), two_months(as_of)),
        notificacion=lambda _: append_notifications(t, notifications(people, message("no_show"), as_of)),
    )


def cancel_where(reserva: DataFrame, ids: DataFrame) -> DataFrame:
    """Reservations with those in ``ids`` (distinct ``id_reserva``) set to cancelled."""
    hit = reserva.join(ids.withColumn("_hit", F.lit(True)), "id_reserva", "left")
    return hit.withColumn("estado", F.when(F.col("_hit"), fixed.CANCELADA).otherwise(F.col("estado"))).select(
        *reserva.columns
    )


def left_without_confirmed(rp: DataFrame, touched: DataFrame) -> DataFrame:
    """Those of ``touched`` (distinct ``id_reserva``) in which nobody is confirmed any more."""
    confirmed = rp.filter(F.col("confirmado") == F.lit(True)).select("id_reserva")
    return touched.join(confirmed, "id_reserva", "left_anti")


def apply_confirmations(rp: DataFrame, changes: DataFrame) -> DataFrame:
    """Participations with the new ``confirmado`` of each changed (``ci``, ``id_reserva``)."""
    new = changes.groupBy(F.col("ci").alias("ci_participante"), "id_reserva").agg(
        (F.max_by("confirmado_new", "version") if "version" in changes.columns else F.min("confirmado_new")).alias(
            "_new"
        )
    )
    joined = rp.join(new, ["ci_participante", "id_reserva"], "left")
    return joined.withColumn("confirmado", F.coalesce("_new", "confirmado")).select(*rp.columns)


def cancellations_from_unconfirms(t: Model, changes: DataFrame) -> Model:
    """Apply withdrawals and cancel the reservations they leave without a confirmed person.

    ``changes`` holds ``ci``, ``id_reserva``, ``confirmado_old``, ``confirmado_new``.
    """
    rp = apply_confirmations(t.reserva_participante, changes)
    withdrawn = changes.filter(F.col("confirmado_old") & ~F.col("confirmado_new")).select("id_reserva").distinct()
    return t.replace(reserva_participante=rp, reserva=cancel_where(t.reserva, left_without_confirmed(rp, withdrawn)))


def no_show_from_attendance_change(t: Model, changes: DataFrame, as_of: dt.datetime) -> Model:
    """Turn a room's day into no-shows up to a slot whose attendance changed and stayed empty.

    ``changes`` holds ``ci``, ``id_reserva``, ``asistencia_old``, ``asistencia_new`` and is already
    part of ``t``. A changed slot fires if nobody attended the room that day up to and including
    it and ten minutes have passed since the last end among those slots. Attendance is folded per
    slot first, so the running totals of a room day see one row per slot.
    """
    slot_key = [*ROOM_DAY, "id_turno"]
    placed = t.reserva.select("id_reserva", *slot_key)
    attended = (
        t.reserva_participante.filter(F.col("asistencia") == F.lit(True))
        .groupBy("id_reserva")
        .agg(F.count("*").alias("n"))
    )
    touched = (
        changes.filter(F.col("asistencia_old") != F.col("asistencia_new"))
        .select("id_reserva")
        .distinct()
        .withColumn("cambio", F.lit(True))
    )
    per_slot = (
        placed.join(attended, "id_reserva", "left")
        .join(touched, "id_reserva", "left")
        .groupBy(*slot_key)
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("cambio").alias("cambio"))
        .join(t.turno.select("id_turno", "fin_min"), "id_turno")
    )
    up_to = Window.partitionBy(*ROOM_DAY).orderBy("id_turno").rowsBetween(Window.unboundedPreceding, 0)
    running = per_slot.withColumn("total", F.sum("n").over(up_to)).withColumn("fin", F.max("fin_min").over(up_to))
    due = plus_minutes(at_minute("fecha", "fin"), fixed.GRACIA_MIN) <= now(as_of)
    fired = (
        running.filter(F.col("cambio") & (F.col("total") == 0) & due)
        .groupBy(*ROOM_DAY)
        .agg(F.max("id_turno").alias("_hasta"))
    )
    swept = t.reserva.join(fired, ROOM_DAY, "left")
    state = F.when(F.col("id_turno") <= F.col("_hasta"), fixed.SIN_ASISTENCIA).otherwise(F.col("estado"))
    return t.replace(reserva=swept.withColumn("estado", state).select(*t.reserva.columns))
