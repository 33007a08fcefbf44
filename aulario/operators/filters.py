"""Report filters, condition sets, reference lists and existence flags."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulario.functions.dates import today
from aulario.functions.text import text_key
from aulario.sources import fixed
from aulario.sources.model import Model

SLOT = ["nombre_sala", "edificio", "fecha", "id_turno"]
ROOM = ["nombre_sala", "edificio"]


class ReportFilter(NamedTuple):
    """Optional conditions; an empty value or the sentinel means no condition."""

    desde: str | None = None
    hasta: str | None = None
    edificio: str | None = None
    tipo_sala: str | None = None

    def days(self) -> tuple[dt.date | None, dt.date | None]:
        """First and last day, None where open."""
        return tuple(dt.date.fromisoformat(d) if d else None for d in (self.desde, self.hasta))


def report_filter(base: DataFrame, f: ReportFilter = ReportFilter()) -> DataFrame:
    """Keep the reservations (joined to their room) that meet every given condition; case does not matter."""
    first, last = f.days()
    if first:
        base = base.filter(F.col("fecha") >= F.lit(first))
    if last:
        base = base.filter(F.col("fecha") <= F.lit(last))
    if f.edificio and f.edificio.lower() != fixed.TODOS_EDIFICIOS.lower():
        base = base.filter(text_key("edificio") == text_key(F.lit(f.edificio)))
    if f.tipo_sala and f.tipo_sala.lower() != fixed.TODAS_SALAS.lower():
        # stored types have one spelling each, so the comparison reaches the files
        stored = next((x for x in fixed.TIPOS_SALA if x.lower() == f.tipo_sala.strip().lower()), f.tipo_sala)
        base = base.filter(F.col("tipo_sala") == stored)
    return base


def sanctioned(t: Model, as_of: dt.datetime) -> DataFrame:
    """People under an active sanction on the day, with the latest end among them."""
    covering = F.col("activa") & today(as_of).between(F.col("fecha_inicio"), F.col("fecha_fin"))
    return (
        t.sancion_participante.filter(covering)
        .groupBy(F.col("ci_participante").alias("ci"))
        .agg(F.max("fecha_fin").alias("fin"))
    )


def occupied_slots(t: Model, states: Sequence[str] = (fixed.ACTIVA,)) -> DataFrame:
    """Room slots held by a reservation in one of ``states``."""
    return t.reserva.filter(F.col("estado").isin(*states)).select(*SLOT).distinct()


def open_slots(t: Model, first: dt.date, last: dt.date) -> DataFrame:
    """Every room slot between two dates (inclusive) that no active reservation holds.

    Rooms are expanded to days, the slots taken in each room and day (at most the timetable) are
    subtracted as arrays, and only what is left is expanded to slots: the join runs on room days.
    """
    in_range = t.between(first, last).reserva.filter(F.col("estado") == fixed.ACTIVA)
    taken = in_range.groupBy(*ROOM, "fecha").agg(F.collect_set("id_turno").alias("tomados"))
    timetable = t.turno.agg(F.sort_array(F.collect_set("id_turno")).alias("turnos")).scalar()
    days = F.sequence(F.lit(first), F.lit(last))
    grid = t.sala.select(*ROOM, F.explode(days).alias("fecha"))
    free = F.array_except(timetable, F.coalesce(F.col("tomados"), F.array().cast("array<int>")))
    return grid.join(taken, [*ROOM, "fecha"], "left").select(*ROOM, "fecha", F.explode(free).alias("id_turno"))


# --- reference lists -------------------------------------------------------------------------


def buildings(t: Model) -> DataFrame:
    return t.edificio.select("nombre_edificio").orderBy("nombre_edificio")


def rooms(t: Model) -> DataFrame:
    return t.sala.select(*ROOM).orderBy("edificio", "nombre_sala")


def slots(t: Model) -> DataFrame:
    return t.turno.select("id_turno", "inicio_min", "fin_min").orderBy("id_turno")


def faculties(t: Model) -> DataFrame:
    return t.facultad.select("id_facultad", "nombre").orderBy("nombre")


# --- existence flags -------------------------------------------------------------------------


def flag_existing(reqs: DataFrame, keys: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """Add boolean ``flag``: whether the request's key columns occur in ``keys``."""
    known = keys.select(*on).distinct().withColumn(flag, F.lit(True))
    return reqs.join(known, list(on), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def flag_people(t: Model, reqs: DataFrame) -> DataFrame:
    """Add ``existe`` (is a participant) and ``en_programa`` (has a programme) by ``ci``."""
    out = flag_existing(reqs, t.participantes, ["ci"], "existe")
    members = t.participantes_programa_academico.select(F.col("ci_participante").alias("ci"))
    return flag_existing(out, members, ["ci"], "en_programa")


def flag_room(t: Model, reqs: DataFrame) -> DataFrame:
    """Add ``sala_existe`` by room name and building."""
    return flag_existing(reqs, t.sala, ROOM, "sala_existe")


def flag_taken_identity(t: Model, reqs: DataFrame) -> DataFrame:
    """Add ``ci_tomada`` and ``email_tomado``: two keyed lookups in place of one OR join."""
    emails = t.participantes.select(text_key("email").alias("_email"))
    out = flag_existing(reqs, t.participantes, ["ci"], "ci_tomada").withColumn("_email", text_key("email"))
    return flag_existing(out, emails, ["_email"], "email_tomado").drop("_email")


def flag_in_reservation(t: Model, reqs: DataFrame) -> DataFrame:
    """Add ``ya_esta``: whether the person already has a row in the reservation."""
    pairs = t.reserva_participante.select(F.col("ci_participante").alias("ci"), "id_reserva")
    return flag_existing(reqs, pairs, ["ci", "id_reserva"], "ya_esta")


# --- flag filters ----------------------------------------------------------------------------


def confirmed_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("confirmado") == F.lit(True))


def attended_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("asistencia") == F.lit(True))


def active_only(df: DataFrame) -> DataFrame:
    """Active reservations, or active sanctions."""
    if "estado" in df.columns:
        return df.filter(F.col("estado") == fixed.ACTIVA)
    return df.filter(F.col("activa") == F.lit(True))
