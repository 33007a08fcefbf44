"""Population-wide listings: what a page shows for one person or reservation, for all of them."""

from __future__ import annotations

import datetime as dt
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aulario.functions.dates import at_minute, clock, now, plus_minutes, today
from aulario.operators.filters import ROOM
from aulario.plans.paging import PAGE, paged_lists
from aulario.sources import fixed
from aulario.sources.model import Model

Labels = Literal["long", "short", "bare"]


# --- people ----------------------------------------------------------------------------------


def memberships(t: Model) -> DataFrame:
    """Per person in a programme: role and programme type of the earliest membership."""
    joined = t.participantes_programa_academico.join(
        t.programas_academicos.select("nombre_programa", "tipo"), "nombre_programa"
    )
    first = F.min_by(F.struct("rol", "tipo"), "id_alumno_programa")
    return joined.groupBy(F.col("ci_participante").alias("ci")).agg(first.alias("m")).select("ci", "m.rol", "m.tipo")


def person_label(labels: Labels, rol: str = "rol", tipo: str = "tipo") -> Column:
    """What kind of user a role and programme type make."""
    grado, posgrado, other = {
        "long": (fixed.LABEL_GRADO, fixed.LABEL_POSGRADO, fixed.LABEL_SIN_PROGRAMA),
        "short": (fixed.SHORT_GRADO, fixed.SHORT_POSGRADO, fixed.SHORT_SIN_PROGRAMA),
        "bare": (fixed.SHORT_GRADO, fixed.SHORT_POSGRADO, None),
    }[labels]
    student = F.col(rol) == "Estudiante"
    return (
        F.when(F.col(rol) == "Docente", fixed.LABEL_DOCENTE)
        .when(student & (F.col(tipo) == "Grado"), grado)
        .when(student & (F.col(tipo) == "Posgrado"), posgrado)
        .otherwise(F.lit(other).cast("string"))
    )


def participant_profile(t: Model, labels: Labels = "long") -> DataFrame:
    """Every participant with the kind of user they are."""
    people = t.participantes.join(memberships(t), "ci", "left")
    return people.select("ci", "nombre", "apellido", "email", person_label(labels).alias("tipo_persona"))


def participant_directory(t: Model, admin_email: str = fixed.EMAIL_PROTEGIDO) -> DataFrame:
    """People with each of their programmes, the administrator first."""
    ppa = t.participantes_programa_academico.withColumnRenamed("ci_participante", "ci")
    faculty = t.facultad.withColumnRenamed("nombre", "facultad")
    return (
        t.participantes.join(ppa, "ci", "left")
        .join(t.programas_academicos, "nombre_programa", "left")
        .join(faculty, "id_facultad", "left")
        .orderBy(F.when(F.col("email") == admin_email, 0).otherwise(1), "apellido", "nombre", "ci", "nombre_programa")
        .select("ci", "nombre", "apellido", "email", "nombre_programa", "id_facultad", "facultad", "rol")
    )


def programmes_by_faculty(t: Model, page_size: int = PAGE) -> DataFrame:
    """Programmes of each faculty in order, in pages."""
    named = t.programas_academicos.join(t.facultad.withColumnRenamed("nombre", "facultad"), "id_facultad")
    return paged_lists(named, ["facultad"], "nombre_programa", "programas", page_size).orderBy("facultad", "pagina")


# --- rooms -----------------------------------------------------------------------------------


def rooms_by_building(t: Model, page_size: int = PAGE) -> DataFrame:
    """Rooms of each building in order, in pages."""
    return paged_lists(t.sala, ["edificio"], "nombre_sala", "salas", page_size)


def rooms_json(t: Model) -> DataFrame:
    """:func:`rooms_by_building` with each page of names as a JSON list."""
    return rooms_by_building(t).withColumn("salas", F.to_json("salas"))


def room_list(t: Model) -> DataFrame:
    return t.sala.select("nombre_sala", "edificio", "capacidad", "tipo_sala").orderBy("edificio", "nombre_sala")


# --- reservations ----------------------------------------------------------------------------


def _with_room_and_turno(t: Model, reserva: DataFrame) -> DataFrame:
    return reserva.join(t.turno, "id_turno").join(t.sala, ROOM)


def confirmed_counts(t: Model) -> DataFrame:
    confirmed = t.reserva_participante.filter(F.col("confirmado") == F.lit(True))
    return confirmed.groupBy("id_reserva").agg(F.count("*").alias("confirmados"))


def roster_pages(t: Model, page_size: int = fixed.MAX_CAPACIDAD) -> DataFrame:
    """Confirmed people of each active reservation, sorted by name, in pages of ``page_size``.

    No room seats more people than a page holds by default, so a lawful reservation has one page; an
    overfull one has several, in order. ``confirmados`` counts the page's participations.
    """
    active = t.reserva.filter(F.col("estado") == fixed.ACTIVA).select("id_reserva")
    confirmed = (
        t.reserva_participante.filter(F.col("confirmado") == F.lit(True))
        .select(F.col("ci_participante").alias("ci"), "id_reserva")
        .join(active, "id_reserva")
    )
    full_name = F.concat_ws(" ", "nombre", "apellido").alias("nombre_completo")
    named = confirmed.join(t.participantes.select("ci", "nombre", "apellido"), "ci", "left").select(
        "id_reserva", F.when(F.col("nombre").isNotNull(), F.struct(full_name, "ci")).alias("persona")
    )
    return paged_lists(named, ["id_reserva"], "persona", "personas", page_size, rows_as="confirmados")


def _own_confirmed(t: Model) -> DataFrame:
    return t.reserva_participante.filter(F.col("confirmado") == F.lit(True)).select(
        F.col("ci_participante").alias("ci"), "id_reserva"
    )


def _others(people: Column) -> Column:
    """Names of ``people``, in their order, without the one of the row's ``ci``."""
    own = F.col("ci")
    return F.transform(F.filter(people, lambda p: p["ci"] != own), lambda p: p["nombre_completo"])


def my_reservations(t: Model) -> DataFrame:
    """Each person's active, confirmed reservations and who else confirmed, one row of the same shape each.

    ``otros`` names all the others by name, whatever their number; ``paginas`` says in how many pages
    :func:`roster_pages` has the people per reservation and :func:`others_in_reservation` per person.
    """
    active = t.reserva.filter(F.col("estado") == fixed.ACTIVA)
    pages = F.sort_array(F.collect_list(F.struct("pagina", "personas")))
    rosters = roster_pages(t).groupBy("id_reserva").agg(
        F.count("*").cast("int").alias("paginas"),
        F.flatten(F.transform(pages, lambda p: p["personas"])).alias("personas"),
        F.sum("confirmados").alias("confirmados"),
    )
    per_reservation = _with_room_and_turno(t, active).join(rosters, "id_reserva")
    columns = ["ci", "id_reserva", *ROOM, "fecha", "inicio_min", "fin_min", "estado", "capacidad", "confirmados", "paginas"]
    mine = _own_confirmed(t).join(per_reservation, "id_reserva").select(*columns, _others(F.col("personas")).alias("otros"))
    return mine.orderBy("ci", F.desc("fecha"), "id_reserva")


def others_in_reservation(t: Model, page_size: int = fixed.MAX_CAPACIDAD) -> DataFrame:
    """Who else confirmed, per person and active reservation, by name, in the pages of the roster.

    Every person has all pages, whatever the size of the reservation; on their own page their name is
    left out, so a page may be one short, or empty for somebody alone.
    """
    names = _others(F.col("personas")).alias("otros")
    return _own_confirmed(t).join(roster_pages(t, page_size), "id_reserva").select("ci", "id_reserva", "pagina", names)


def active_reservations(t: Model) -> DataFrame:
    """Active reservations with the number of people in them, confirmed or not."""
    sizes = t.reserva_participante.groupBy("id_reserva").agg(F.count("ci_participante").alias("n"))
    active = t.reserva.filter(F.col("estado") == fixed.ACTIVA)
    return (
        _with_room_and_turno(t, active)
        .join(sizes, "id_reserva", "left")
        .select(
            "id_reserva",
            "id_turno",
            "fecha",
            "inicio_min",
            "fin_min",
            "estado",
            "nombre_sala",
            "edificio",
            "capacidad",
            F.coalesce("n", F.lit(0)).alias("ocupacion"),
        )
        .orderBy("id_reserva")
    )


def reservation_detail(t: Model) -> DataFrame:
    """Every reservation with its room and hours, also as HH:MM."""
    return _with_room_and_turno(t, t.reserva).select(
        "id_reserva",
        "nombre_sala",
        "edificio",
        "fecha",
        "inicio_min",
        "fin_min",
        clock("inicio_min").alias("hora_inicio"),
        clock("fin_min").alias("hora_fin"),
        "capacidad",
        "tipo_sala",
        "estado",
    )


def roster(t: Model, mode: Literal["all", "confirmed", "attendance"] = "all") -> DataFrame:
    """People of every reservation: all, only the confirmed, or all with their attendance."""
    rp = t.reserva_participante
    if mode == "confirmed":
        rp = rp.filter(F.col("confirmado") == F.lit(True))
    extra = ["asistencia"] if mode == "attendance" else []
    people = t.participantes.select(F.col("ci").alias("ci_participante"), "nombre", "apellido")
    return rp.join(people, "ci_participante").select("id_reserva", "ci_participante", "nombre", "apellido", *extra)


def seats(t: Model) -> DataFrame:
    """Confirmed people against capacity for active reservations."""
    active = t.reserva.filter(F.col("estado") == fixed.ACTIVA)
    occupied = F.coalesce("confirmados", F.lit(0))
    return (
        active.join(t.sala, ROOM)
        .join(confirmed_counts(t), "id_reserva", "left")
        .select(
            "id_reserva",
            "fecha",
            "id_turno",
            "capacidad",
            "tipo_sala",
            occupied.alias("ocupados"),
            (F.col("capacidad") - occupied).alias("libres"),
        )
    )


def attendance_editable(t: Model, as_of: dt.datetime) -> DataFrame:
    """Whether the attendance sheet of each reservation may still be edited."""
    until = plus_minutes(at_minute("fecha", "fin_min"), fixed.GRACIA_MIN)
    open_now = (F.col("estado") == fixed.ACTIVA) & (now(as_of) <= until)
    return t.reserva.join(t.turno, "id_turno").select("id_reserva", "estado", open_now.alias("editable"))


# --- sanctions and notifications -------------------------------------------------------------


def sanction_history(t: Model, as_of: dt.datetime) -> DataFrame:
    """All sanctions with state and days left; each person's running ones first, newest first."""
    left = F.datediff("fecha_fin", today(as_of))
    running = F.col("activa") & (left >= 0)
    return (
        t.sancion_participante.select(
            F.col("ci_participante").alias("ci"),
            "id_sancion",
            "fecha_inicio",
            "fecha_fin",
            F.when(running, "Activa").otherwise("Expirada").alias("estado"),
            F.when(running, left).alias("dias_restantes"),
        )
    ).orderBy("ci", "estado", F.desc("fecha_inicio"), "id_sancion")


def current_sanctions(t: Model, as_of: dt.datetime) -> DataFrame:
    """Sanctions in force or still to start."""
    day = today(as_of)
    state = F.when(day < F.col("fecha_inicio"), "Pendiente").when(
        day.between(F.col("fecha_inicio"), F.col("fecha_fin")), "Activa"
    )
    people = t.participantes.select(F.col("ci").alias("ci_participante"), "nombre", "apellido")
    return (
        t.sancion_participante.filter(F.col("activa") & (F.col("fecha_fin") >= day))
        .join(people, "ci_participante")
        .select(
            "id_sancion",
            "ci_participante",
            "nombre",
            "apellido",
            "fecha_inicio",
            "fecha_fin",
            "activa",
            state.alias("estado"),
        )
        .orderBy(F.desc("fecha_inicio"), "id_sancion")
    )


def notification_feed(t: Model) -> DataFrame:
    return t.notificacion.select(
        F.col("ci_participante").alias("ci"), "id_notificacion", "mensaje", "fecha", "leida"
    ).orderBy("ci", F.desc("fecha"), F.desc("id_notificacion"))

