"""The eleven management reports.

All take a :class:`ReportFilter`, which ``sanctions_by_role`` does not heed, and optionally the
:class:`Inputs` that several reports share. A filter on days reads the months in question alone, of
reservations and participations. Participations are counted per
reservation, and attendances per person, before they meet the other tables, so what is shuffled
for a join is at most one row per key. Ties are ordered by the key columns.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulario.functions.numbers import mean2, percent2
from aulario.operators.filters import ROOM, ReportFilter, report_filter
from aulario.sources import fixed
from aulario.sources.model import Model

NO_FILTER = ReportFilter()


def base(t: Model, f: ReportFilter = NO_FILTER) -> DataFrame:
    """Reservations with their room, filtered."""
    room = t.sala.select(*ROOM, "capacidad", "tipo_sala")
    return report_filter(t.between(*f.days()).reserva.join(room, ROOM), f)


class Inputs:
    """What reports are made of, for one filter: each relation is built when first asked for."""

    def __init__(self, t: Model, f: ReportFilter = NO_FILTER):
        self.t, self.f = t, f
        self._kept: list[DataFrame] = []

    @cached_property
    def base(self) -> DataFrame:
        return base(self.t, self.f)

    @cached_property
    def participations(self) -> DataFrame:
        """Participations of the months in question."""
        return self.t.between(*self.f.days()).reserva_participante

    @cached_property
    def taking_part(self) -> DataFrame:
        """Participations in the reservations of the filter, with the day."""
        rows = self.participations.select("ci_participante", "id_reserva", "fecha_solicitud_reserva", "asistencia")
        return rows.join(self.base.select("id_reserva", "fecha"), "id_reserva")

    @cached_property
    def sizes(self) -> DataFrame:
        """People per reservation; under a filter only those it keeps are counted."""
        rows = self.participations.select("id_reserva")
        if self.f != NO_FILTER:
            rows = rows.join(self.base.select("id_reserva"), "id_reserva", "left_semi")
        return rows.groupBy("id_reserva").agg(F.count("*").alias("cant"))

    def keep(self) -> Inputs:
        """Persist what several reports read: reservations with rooms, participations, and their counts."""
        self.base = self.base.persist()
        self.taking_part = self.taking_part.persist()
        self.sizes = self.taking_part.groupBy("id_reserva").agg(F.count("*").alias("cant")).persist()
        self._kept = [self.base, self.taking_part, self.sizes]
        return self

    def release(self) -> None:
        for df in self._kept:
            df.unpersist()


def _programmes(t: Model) -> DataFrame:
    """One row per person and programme."""
    return t.participantes_programa_academico.select("ci_participante", "nombre_programa", "rol").join(
        t.programas_academicos, "nombre_programa"
    )


def top_rooms(t: Model, f: ReportFilter = NO_FILTER, given: Inputs | None = None) -> DataFrame:
    counted = (given or Inputs(t, f)).base.groupBy(*ROOM).agg(F.count("*").alias("cantidad_reservas"))
    return counted.orderBy(F.desc("cantidad_reservas"), *ROOM).limit(10)


def turno_demand(t: Model, f: ReportFilter = NO_FILTER, given: Inputs | None = None) -> DataFrame:
    counted = (given or Inputs(t, f)).base.groupBy("id_turno").agg(F.count("*").alias("reservas"))
    return (
        counted.join(t.turno, "id_turno")
        .select(F.col("inicio_min").alias("hora_inicio"), F.col("fin_min").alias("hora_fin"), "reservas")
        .orderBy(F.desc("reservas"), "hora_inicio")
    )


def avg_participants(t: Model, f: ReportFilter = NO_FILTER, given: Inputs | None = None) -> DataFrame:
    i = given or Inputs(t, f)
    sized = i.base.join(i.sizes, "id_reserva")
    return (
        sized.groupBy(*ROOM)
        .agg(mean2(F.sum("cant"), F.count("*")).alias("promedio_participantes"))
        .orderBy(F.desc("promedio_participantes"), *ROOM)
    )


def bookings_by_programme(t: Model, f: ReportFilter = NO_FILTER, given: Inputs | None = None) -> DataFrame:
    taking_part = (given or Inputs(t, f)).taking_part.select("ci_participante", "id_reserva")
    named = _programmes(t).join(t.facultad.withColumnRenamed("nombre", "facultad"), "id_facultad")
    return (
        taking_part.join(named.select("ci_participante", "nombre_programa", "facultad"), "ci_participante")
        .groupBy("nombre_programa", "facultad")
        .agg(F.count_distinct("id_reserva").alias("reservas"))
        .orderBy(F.desc("reservas"), "nombre_programa", "facultad")
    )


def building_occupancy(t: Model, f: ReportFilter = NO_FILTER, given: Inputs | None = None) -> DataFrame:
    i = given or Inputs(t, f)
    sized = i.base.join(i.sizes, "id_reserva")
    return (
        sized.groupBy("edificio")
        .agg(percent2(F.sum("cant"), F.sum("capacidad")).alias("porcentaje_ocupacion"))
        .orderBy(F.desc("porcentaje_ocupacion"), "edificio")
    )


def bookings_by_role(t: Model, f: ReportFilter = NO_FILTER, given: Inputs | None = None) -> DataFrame:
    taking_part = (given or Inputs(t, f)).taking_part.select("ci_participante", "id_reserva", "asistencia")
    # a person in several programmes counts once in each, attendances included
    return (
        taking_part.join(_programmes(t).select("ci_participante", "rol", "tipo"), "ci_participante")
        .groupBy("rol", "tipo")
        .agg(
            F.count_distinct("id_reserva").alias("reservas"),
            F.count_if(F.col("asistencia")).alias("asistencias"),
        )
        .orderBy(F.desc("reservas"), "rol", "tipo")
    )


def sanctions_by_role(t: Model, f: ReportFilter = NO_FILTER, given: Inputs | None = None) -> DataFrame:
    per_person = t.sancion_participante.groupBy("ci_participante").agg(F.count("*").alias("n"))
    return (
        per_person.join(_programmes(t), "ci_participante")
        .groupBy("rol", "tipo")
        .agg(F.sum("n").alias("sanciones"))
        .orderBy(F.desc("sanciones"), "rol", "tipo")
    )


def state_share(t: Model, f: ReportFilter = NO_FILTER, given: Inputs | None = None) -> DataFrame:
    # the whole table is the denominator, so filtered shares need not add up to 100
    everything = t.reserva.agg(F.count("*").alias("n")).scalar()
    return (
        (given or Inputs(t, f))
        .base.groupBy("estado")
        .agg(F.count("*").alias("n"))
        .select("estado", percent2(F.col("n"), everything).alias("porcentaje"))
        .orderBy(F.desc("porcentaje"), "estado")
    )


def cancellation_rate(t: Model, f: ReportFilter = NO_FILTER, given: Inputs | None = None) -> DataFrame:
    cancelled = F.count_if(F.col("estado") == fixed.CANCELADA)
    rate = (given or Inputs(t, f)).base.groupBy(*ROOM).agg(percent2(cancelled, F.count("*")).alias("tasa_cancelacion"))
    return rate.orderBy(F.desc("tasa_cancelacion"), *ROOM).limit(10)


def top_participants(t: Model, f: ReportFilter = NO_FILTER, given: Inputs | None = None) -> DataFrame:
    attended = (given or Inputs(t, f)).taking_part.filter(F.col("asistencia") == F.lit(True))
    counted = attended.groupBy(F.col("ci_participante").alias("ci")).agg(
        F.count_distinct("id_reserva").alias("reservas_confirmadas")
    )
    return (
        counted.join(t.participantes, "ci")
        .select("ci", "nombre", "apellido", "reservas_confirmadas")
        .orderBy(F.desc("reservas_confirmadas"), "ci")
        .limit(10)
    )


def mean_lead_days(t: Model, f: ReportFilter = NO_FILTER, given: Inputs | None = None) -> DataFrame:
    lead = F.datediff("fecha", "fecha_solicitud_reserva")
    return (given or Inputs(t, f)).taking_part.agg(mean2(F.sum(lead), F.count(lead)).alias("antelacion_promedio_dias"))


REPORTS = {
    "top_rooms": top_rooms,
    "turno_demand": turno_demand,
    "avg_participants": avg_participants,
    "bookings_by_programme": bookings_by_programme,
    "building_occupancy": building_occupancy,
    "bookings_by_role": bookings_by_role,
    "sanctions_by_role": sanctions_by_role,
    "state_share": state_share,
    "cancellation_rate": cancellation_rate,
    "top_participants": top_participants,
    "mean_lead_days": mean_lead_days,
}
