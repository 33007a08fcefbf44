"""Time-driven sweeps: what a timer does, for a given instant."""

from __future__ import annotations

import datetime as dt
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulario.functions.dates import at_minute, now, plus_minutes, today
from aulario.operators.islands import ROOM_DAY, active_with_slot, empty_island_slots, with_attended
from aulario.operators.propagation import sanctions_from_transitions
from aulario.operators.sanctions import append_sanctions, expire_sanctions, two_months
from aulario.plans.staging import stage
from aulario.sources import fixed
from aulario.sources.model import Model

Policy = Literal["block", "per_reservation", "both"]


def finalize_attended(t: Model, as_of: dt.datetime) -> Model:
    """Active reservations that have ended and were attended become finished."""
    active = F.col("estado") == fixed.ACTIVA
    ended = at_minute("fecha", "fin_min") <= now(as_of)
    # only active rows of days up to today can change; attendance is looked up for those alone
    due = (
        t.reserva.filter(active & (F.col("fecha") <= today(as_of)))
        .join(t.turno, "id_turno")
        .filter(ended)
        .select("id_reserva")
    )
    attended = t.reserva_participante.filter(F.col("asistencia") == F.lit(True)).select("id_reserva")
    done = due.join(attended, "id_reserva", "left_semi").withColumn("_done", F.lit(True))
    out = t.reserva.join(done, "id_reserva", "left")
    state = F.when(active & F.col("_done"), fixed.FINALIZADA).otherwise(F.col("estado"))
    return t.replace(reserva=out.withColumn("estado", state).select(*t.reserva.columns))


def sweep_blocks(t: Model, as_of: dt.datetime) -> Model:
    """Active reservations of an unattended island become no-shows ten minutes after its end."""
    rows = with_attended(t, active_with_slot(t).filter(F.col("fecha") <= today(as_of)))
    over = plus_minutes(at_minute("fecha", "fin_bloque_min"), fixed.GRACIA_MIN) <= now(as_of)
    turno = t.turno.select("id_turno", "inicio_min")
    # islands never leave their day, so only starts on days up to today are looked at; back to
    # slots by start minute, which is what island members share
    missed = (
        empty_island_slots(rows)
        .filter(over)
        .join(turno, "inicio_min")
        .select(*ROOM_DAY, "id_turno")
        .withColumn("_missed", F.lit(True))
    )
    out = t.reserva.join(missed, [*ROOM_DAY, "id_turno"], "left")
    hit = (F.col("estado") == fixed.ACTIVA) & F.col("_missed")
    return t.replace(
        reserva=out.withColumn("estado", F.when(hit, fixed.SIN_ASISTENCIA).otherwise(F.col("estado"))).select(
            *t.reserva.columns
        )
    )


def sweep_reservations(t: Model, as_of: dt.datetime) -> Model:
    """Active reservations more than ten minutes past their own end: finished if attended, else no-shows."""
    active = F.col("estado") == fixed.ACTIVA
    overdue = plus_minutes(at_minute("fecha", "fin_min"), fixed.GRACIA_MIN) < now(as_of)
    due = t.reserva.filter(active & (F.col("fecha") <= today(as_of))).join(t.turno, "id_turno").filter(overdue)
    outcome = with_attended(t, due.select("id_reserva")).select(
        "id_reserva", F.when(F.col("asistida"), fixed.FINALIZADA).otherwise(fixed.SIN_ASISTENCIA).alias("_nuevo")
    )
    out = t.reserva.join(outcome, "id_reserva", "left")
    return t.replace(
        reserva=out.withColumn("estado", F.when(active, F.coalesce("_nuevo", "estado")).otherwise(F.col("estado"))).select(
            *t.reserva.columns
        )
    )


def sanction_no_shows(t: Model, as_of: dt.datetime, since: dt.date | None = None) -> Model:
    """Sanction everybody who was in a no-show reservation and is not covered by a sanction today.

    An old no-show is sanctioned again once its sanction has passed; ``since`` leaves out
    reservations of earlier dates.
    """
    missed = t.reserva.filter(F.col("estado") == fixed.SIN_ASISTENCIA)
    if since is not None:
        missed = missed.filter(F.col("fecha") >= F.lit(since))
    covered = t.sancion_participante.filter(today(as_of).between(F.col("fecha_inicio"), F.col("fecha_fin"))).select(
        F.col("ci_participante").alias("ci")
    )
    people = (
        t.reserva_participante.select(F.col("ci_participante").alias("ci"), "id_reserva")
        .join(missed.select("id_reserva"), "id_reserva", "left_semi")
        .select("ci")
        .distinct()
        .join(covered, "ci", "left_anti")
    )
    return t.replace(sancion_participante=lambda _: append_sanctions(t, people, today(as_of), two_months(as_of)))


def state_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Reservations whose state differs: ``id_reserva``, ``estado_old``, ``estado_new``."""
    old = before.select("id_reserva", F.col("estado").alias("estado_old"))
    new = after.select("id_reserva", F.col("estado").alias("estado_new"))
    return old.join(new, "id_reserva").filter(F.col("estado_old") != F.col("estado_new"))


def _stage_sweep(t: Model, swept: Model, as_of: dt.datetime) -> Model:
    """Write the swept reservations, then sanction the people of those that became no-shows."""
    reserva = stage(swept.reserva, "reserva")
    sanctioned = sanctions_from_transitions(swept.replace(reserva=reserva), state_changes(t.reserva, reserva), as_of)
    return sanctioned.replace(
        sancion_participante=stage(sanctioned.sancion_participante, "sanciones"),
        notificacion=stage(sanctioned.notificacion, "notificaciones"),
    )


def run_sweep(t: Model, as_of: dt.datetime, policy: Policy = "both", since: dt.date | None = None) -> Model:
    """All timers once: expiry, finished, no-shows (with their sanctions), general sanctions.

    The steps feed each other, so each one's reservations, sanctions and notifications are written
    to the shared folder before the next reads them, as are the inputs all steps share.
    """
    names = ("reserva", "reserva_participante")
    t = t.replace(**{n: stage(getattr(t, n), n) for n in names})
    t = expire_sanctions(t, as_of)
    if policy in ("block", "both"):
        t = _stage_sweep(t, sweep_blocks(finalize_attended(t, as_of), as_of), as_of)
    if policy in ("per_reservation", "both"):
        t = _stage_sweep(t, sweep_reservations(t, as_of), as_of)
        t = sanction_no_shows(t, as_of, since)
    return t
