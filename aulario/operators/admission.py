"""Admission of booking and join requests, with the reason of each refusal.

``mode="snapshot"`` judges every request against the given state. ``mode="sequential"`` gives the
outcome of handling the requests one by one in (``request_ts``, ``request_id``) order, each
accepted one changing what later ones meet; it writes intermediate tables to the shared folder.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aulario.functions.dates import at_minute, monday_of, now, sunday_week, today, week_bounds
from aulario.functions.text import contains_ci, is_ci_shape
from aulario.operators.filters import ROOM, SLOT, flag_in_reservation, flag_people, occupied_slots, sanctioned
from aulario.operators.listings import confirmed_counts, memberships, person_label
from aulario.operators.verdicts import Mode, Rule, any_fails, judge
from aulario.plans.first_come import Resource, grant_in_order, granted_before
from aulario.plans.staging import stage
from aulario.sources import fixed
from aulario.sources.model import Model

ORDER = "_orden"


# --- quotas ----------------------------------------------------------------------------------


def quota_usage(
    t: Model,
    period: Literal["day", "week"],
    confirmed_only: bool = False,
    week_def: Literal["monday", "sunday"] = "monday",
) -> DataFrame:
    """Active reservations per person and day or week.

    Weeks start on Monday (``semana_inicio``) or are the Sunday-start weeks of a year (``anio``,
    ``semana``).
    """
    rp = t.reserva_participante
    if confirmed_only:
        rp = rp.filter(F.col("confirmado") == F.lit(True))
    active = t.reserva.filter(F.col("estado") == fixed.ACTIVA).select("id_reserva", "fecha")
    rows = rp.select(F.col("ci_participante").alias("ci"), "id_reserva").join(active, "id_reserva")
    if period == "day":
        return rows.groupBy("ci", "fecha").agg(F.count("*").alias("bloques"))
    if week_def == "monday":
        return rows.groupBy("ci", monday_of("fecha").alias("semana_inicio")).agg(F.count("*").alias("cantidad"))
    return rows.groupBy("ci", *_sunday_week_key()).agg(F.count("*").alias("cantidad"))


def _with_use(
    t: Model,
    facts: DataFrame,
    as_of: dt.datetime,
    week: Literal["current", "booking"],
    since: dt.date | None,
    confirmed_only: bool = False,
) -> DataFrame:
    """Add ``dia`` and ``semana_uso``: reservations the person has on the day and in the week.

    The week is that of ``as_of`` or the Sunday week of the booked day. Both counts come from one
    count per person and day, so participations meet reservations once. ``since`` leaves out
    reservations that no request can run into.
    """
    by_day = quota_usage(t.between(since, None), "day", confirmed_only)
    days = by_day.withColumnRenamed("bloques", "_dia")
    if week == "current":
        # a conditional sum, not a filter: the count per day below it stays the same and is shared
        in_week = F.when(_in_current_week(as_of), F.col("bloques"))
        weeks, keys = by_day.groupBy("ci").agg(F.sum(in_week).alias("_sem")), ["ci"]
    else:
        keys = ["ci", "anio", "semana"]
        weeks = by_day.groupBy("ci", *_sunday_week_key()).agg(F.sum("bloques").alias("_sem"))
        facts = facts.withColumns({"anio": F.year("fecha"), "semana": sunday_week("fecha")})
    return (
        facts.join(days, ["ci", "fecha"], "left")
        .join(weeks, keys, "left")
        .withColumns({"dia": F.coalesce("_dia", F.lit(0)), "semana_uso": F.coalesce("_sem", F.lit(0))})
        .drop("_dia", "_sem")
    )


def _sunday_week_key() -> list[Column]:
    return [F.year("fecha").alias("anio"), sunday_week("fecha").alias("semana")]


def _in_current_week(as_of: dt.datetime) -> Column:
    monday, sunday = week_bounds(as_of)
    return F.col("fecha").between(monday, sunday)


def _week_began(as_of: dt.datetime) -> dt.date:
    """A day no later than the first of the week of ``as_of``, however weeks are cut."""
    monday, _ = week_bounds(as_of)
    return monday - dt.timedelta(days=1)


# --- facts about a request -------------------------------------------------------------------


def _with_person(t: Model, reqs: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Add sanction end and membership; one relation per person, one join."""
    person = memberships(t).withColumn("con_tipo", F.lit(True)).join(sanctioned(t, as_of), "ci", "full_outer")
    return reqs.join(person, "ci", "left").withColumn("con_tipo", F.coalesce("con_tipo", F.lit(False)))


def _with_slot_facts(t: Model, reqs: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Add start minute, room type, whether room and slot exist, whether the slot is taken."""
    taken = occupied_slots(t.between(as_of.date(), None))
    room = t.sala.select(*ROOM, "tipo_sala", F.lit(True).alias("_sala"))
    return (
        reqs.join(t.turno.select("id_turno", "inicio_min"), "id_turno", "left")
        .join(room, ROOM, "left")
        .join(taken.withColumn("_tomado", F.lit(True)), SLOT, "left")
        .withColumn("sala_existe", F.coalesce("_sala", F.lit(False)))
        .withColumn("ocupado", F.coalesce("_tomado", F.lit(False)))
        .drop("_sala", "_tomado")
    )


def _ordered(reqs: DataFrame) -> DataFrame:
    return reqs.withColumn(ORDER, F.struct("request_ts", "request_id"))


def _resolve(
    facts: DataFrame,
    rules: Callable[[DataFrame], Sequence[Rule]],
    resources: Sequence[tuple[Resource, Column, Column]],
    advance: Sequence[tuple[str, Callable[[Column], Column]]],
    uses: dict[str, Column] | None = None,
) -> DataFrame:
    """Sequential outcome: grant in order what no rule refuses outright, then judge again.

    ``resources`` pairs each resource with its group and free-unit columns; ``advance`` says, in
    the same order, how a fact moves with the units taken by earlier accepted requests.
    """
    keyed = _ordered(facts)
    for r, key, free in resources:
        keyed = keyed.withColumns({r.key: key, r.free: free.cast("long")})
    for name, column in (uses or {}).items():
        keyed = keyed.withColumn(name, column)
    keyed = stage(keyed, "facts")
    viable = keyed.filter(~any_fails(rules(keyed)))
    needed = [ORDER, *[c for r, _, _ in resources for c in (r.key, r.free)], *(uses or {})]
    kinds = [r for r, _, _ in resources]
    granted = grant_in_order(viable.select(*needed), ORDER, kinds)
    out = keyed
    for r, (fact, step) in zip(kinds, advance):
        out = granted_before(out, granted, ORDER, r, f"_{r.name}_antes")
        out = out.withColumn(fact, step(F.col(f"_{r.name}_antes")))
    return judge(out, rules(out))


def _report(judged: DataFrame, reqs: DataFrame, *extra: str) -> DataFrame:
    return judged.select(*reqs.columns, "verdict", "reason", *extra)


# --- bookings --------------------------------------------------------------------------------


def _slot_resource() -> tuple[Resource, Column, Column]:
    return Resource("slot", "_k_slot", "_f_slot"), F.struct(*SLOT), F.when(F.col("ocupado"), 0).otherwise(1)


def _day_resource(bound: Column) -> tuple[Resource, Column, Column]:
    key = F.when(bound, F.struct("ci", "fecha"))
    return Resource("dia", "_k_dia", "_f_dia"), key, fixed.MAX_POR_DIA - F.col("dia")


def admit_bookings_self(t: Model, reqs: DataFrame, as_of: dt.datetime, mode: Mode = "snapshot") -> DataFrame:
    """Bookings people make for themselves.

    Quotas bind every kind of student and count any participation; the week is the Monday week of
    ``as_of`` whatever day is booked. ``reqs``: request_id, request_ts, ci, nombre_sala, edificio,
    fecha, id_turno.
    """
    facts = _with_slot_facts(t, _with_person(t, reqs, as_of), as_of)
    facts = _with_use(t, facts, as_of, "current", _week_began(as_of))
    facts = facts.withColumn("persona", F.when(F.col("con_tipo"), person_label("long"))).withColumn(
        "cuota", contains_ci("persona", "grado")
    )

    def rules(_: DataFrame) -> list[Rule]:
        is_today = F.col("fecha") == today(as_of)
        no_turno = F.col("inicio_min").isNull()
        return [
            ("sanctioned", F.col("fin").isNotNull()),
            ("bad_date", F.col("fecha").isNull()),
            ("past_date", F.col("fecha") < today(as_of)),
            ("unknown_turno", is_today & no_turno),
            ("turno_started", is_today & (at_minute("fecha", "inicio_min") < now(as_of))),
            ("slot_taken", F.col("ocupado")),
            ("no_type", ~F.col("con_tipo")),
            ("unknown_room", ~F.col("sala_existe")),
            ("room_for_docentes", (F.col("tipo_sala") == "Docente") & (F.col("persona") != fixed.LABEL_DOCENTE)),
            ("room_for_posgrado", (F.col("tipo_sala") == "Posgrado") & (F.col("persona") != fixed.LABEL_POSGRADO)),
            ("daily_limit", F.col("cuota") & (F.col("dia") >= fixed.MAX_POR_DIA)),
            ("weekly_limit", F.col("cuota") & (F.col("semana_uso") >= fixed.MAX_POR_SEMANA)),
            ("unknown_turno", no_turno),
        ]

    if mode == "snapshot":
        return _report(judge(facts, rules(facts)), reqs)
    week = Resource("sem", "_k_sem", "_f_sem", uses="_u_sem")
    judged = _resolve(
        facts,
        rules,
        [
            _slot_resource(),
            _day_resource(F.col("cuota")),
            (week, F.when(F.col("cuota"), F.col("ci")), fixed.MAX_POR_SEMANA - F.col("semana_uso")),
        ],
        [
            ("ocupado", lambda n: F.col("ocupado") | (n > 0)),
            ("dia", lambda n: F.col("dia") + n),
            ("semana_uso", lambda n: F.col("semana_uso") + n),
        ],
        uses={"_u_sem": _in_current_week(as_of)},
    )
    return _report(judged, reqs)


def admit_bookings_admin(t: Model, reqs: DataFrame, as_of: dt.datetime, mode: Mode = "snapshot") -> DataFrame:
    """Bookings an administrator makes for a person.

    Quotas bind undergraduate students only; the week is the Sunday week of the booked day. Same
    input as :func:`admit_bookings_self`.
    """
    trimmed = reqs.withColumn("ci", F.trim("ci"))
    facts = _with_slot_facts(t, flag_people(t, _with_person(t, trimmed, as_of)), as_of)
    facts = _with_use(t, facts, as_of, "booking", _week_began(as_of))
    facts = facts.withColumn("persona", F.when(F.col("con_tipo"), person_label("short")))

    def rules(_: DataFrame) -> list[Rule]:
        is_today = F.col("fecha") == today(as_of)
        quota = F.col("persona") == fixed.SHORT_GRADO
        return [
            ("bad_date", F.col("fecha").isNull()),
            ("past_date", F.col("fecha") < today(as_of)),
            ("turno_started", is_today & (at_minute("fecha", "inicio_min") <= now(as_of))),
            ("bad_ci", ~is_ci_shape("ci")),
            ("unknown_participant", ~F.col("existe")),
            ("no_programme", ~F.col("en_programa")),
            ("no_type", ~F.col("con_tipo")),
            ("unknown_room", ~F.col("sala_existe")),
            ("room_for_docentes", (F.col("tipo_sala") == "Docente") & (F.col("persona") != fixed.LABEL_DOCENTE)),
            ("room_for_posgrado", (F.col("tipo_sala") == "Posgrado") & (F.col("persona") != fixed.SHORT_POSGRADO)),
            ("sanctioned", F.col("fin").isNotNull()),
            ("daily_limit", quota & (F.col("dia") >= fixed.MAX_POR_DIA)),
            ("weekly_limit", quota & (F.col("semana_uso") >= fixed.MAX_POR_SEMANA)),
            ("slot_taken", F.col("ocupado")),
            ("unknown_turno", F.col("inicio_min").isNull()),
        ]

    if mode == "snapshot":
        return _report(judge(facts, rules(facts)), reqs)
    bound = F.col("persona") == fixed.SHORT_GRADO
    week = Resource("sem", "_k_sem", "_f_sem")
    judged = _resolve(
        facts,
        rules,
        [
            _slot_resource(),
            _day_resource(bound),
            (
                week,
                F.when(bound, F.struct("ci", "anio", "semana")),
                fixed.MAX_POR_SEMANA - F.col("semana_uso"),
            ),
        ],
        [
            ("ocupado", lambda n: F.col("ocupado") | (n > 0)),
            ("dia", lambda n: F.col("dia") + n),
            ("semana_uso", lambda n: F.col("semana_uso") + n),
        ],
    )
    return _report(judged, reqs)


# --- joins and additions ---------------------------------------------------------------------


def _with_reservation(t: Model, reqs: DataFrame, counts: DataFrame) -> DataFrame:
    """Add state, day, capacity, room type and people so far (``ocupados``) of the reservation."""
    reservation = (
        t.reserva.select("id_reserva", *ROOM, "fecha", "estado")
        .join(t.sala.select(*ROOM, "capacidad", "tipo_sala"), ROOM)
        .drop(*ROOM)
    )
    return (
        reqs.join(reservation, "id_reserva", "left")
        .join(counts, "id_reserva", "left")
        .withColumn("ocupados", F.coalesce("_n", F.lit(0)))
        .drop("_n")
    )


def _seat_resource() -> tuple[Resource, Column, Column]:
    seat = Resource("lugar", "_k_lugar", "_f_lugar")
    return seat, F.col("id_reserva"), F.col("capacidad") - F.col("ocupados")


def admit_joins(t: Model, reqs: DataFrame, as_of: dt.datetime, mode: Mode = "snapshot") -> DataFrame:
    """People joining a reservation; accepted ones get ``action`` insert or reactivate.

    Quotas count confirmed participations in the Monday week of ``as_of``. ``reqs``: request_id,
    request_ts, ci, id_reserva.
    """
    counts = confirmed_counts(t).withColumnRenamed("confirmados", "_n")
    own = t.reserva_participante.select(
        F.col("ci_participante").alias("ci"), "id_reserva", "confirmado", F.lit(True).alias("_fila")
    )
    facts = _with_reservation(t, _with_person(t, reqs, as_of), counts).join(own, ["ci", "id_reserva"], "left")
    known = t.participantes.select("ci", F.lit(True).alias("_existe"))
    facts = facts.join(known, "ci", "left")
    # the reservation joined may be of any day
    facts = _with_use(t, facts, as_of, "current", None, confirmed_only=True)
    # whoever has no programme is an administrator here: no quotas
    facts = facts.withColumns(
        {
            "persona": F.coalesce(person_label("long"), F.lit(fixed.LABEL_SIN_PROGRAMA)),
            "confirmada": F.coalesce(F.col("confirmado"), F.lit(False)),
            "fila": F.coalesce("_fila", F.lit(False)),
        }
    ).withColumn("cuota", contains_ci("persona", "grado"))

    def rules(_: DataFrame) -> list[Rule]:
        return [
            ("not_active", F.col("estado").isNull() | (F.col("estado") != fixed.ACTIVA)),
            ("sanctioned", F.col("fin").isNotNull()),
            ("room_for_posgrado", (F.col("tipo_sala") == "Posgrado") & F.col("cuota")),
            ("room_for_docentes", (F.col("tipo_sala") == "Docente") & ~contains_ci("persona", "docente")),
            ("already_confirmed", F.col("confirmada")),
            ("full", F.col("ocupados") >= F.col("capacidad")),
            ("daily_limit", F.col("cuota") & (F.col("dia") >= fixed.MAX_POR_DIA)),
            ("weekly_limit", F.col("cuota") & (F.col("semana_uso") >= fixed.MAX_POR_SEMANA)),
            ("duplicate_row", F.col("fila") & F.col("confirmado").isNull()),
            ("unknown_participant", F.col("_existe").isNull()),
        ]

    if mode == "snapshot":
        judged = judge(facts, rules(facts))
    else:
        once = Resource("fila", "_k_fila", "_f_fila")
        week = Resource("sem", "_k_sem", "_f_sem", uses="_u_sem")
        judged = _resolve(
            facts,
            rules,
            [
                (once, F.struct("ci", "id_reserva"), F.lit(1)),
                _seat_resource(),
                _day_resource(F.col("cuota")),
                (week, F.when(F.col("cuota"), F.col("ci")), fixed.MAX_POR_SEMANA - F.col("semana_uso")),
            ],
            [
                ("confirmada", lambda n: F.col("confirmada") | (n > 0)),
                ("ocupados", lambda n: F.col("ocupados") + n),
                ("dia", lambda n: F.col("dia") + n),
                ("semana_uso", lambda n: F.col("semana_uso") + n),
            ],
            uses={"_u_sem": _in_current_week(as_of)},
        )
    action = F.when(F.col("verdict") == "accepted", F.when(F.col("fila"), "reactivate").otherwise("insert"))
    return _report(judged.withColumn("action", action), reqs, "action")


def admit_adds_admin(t: Model, reqs: DataFrame, as_of: dt.datetime, mode: Mode = "snapshot") -> DataFrame:
    """People an administrator adds to a reservation. Same input as :func:`admit_joins`.

    Every participation takes a seat here, confirmed or not.
    """
    trimmed = reqs.withColumn("ci", F.trim("ci"))
    counts = t.reserva_participante.groupBy("id_reserva").agg(F.count("*").alias("_n"))
    facts = flag_people(t, _with_person(t, trimmed, as_of))
    facts = flag_in_reservation(t, _with_reservation(t, facts, counts))
    facts = facts.withColumn("persona", person_label("bare"))
    facts = facts.withColumn("en_sala", F.col("estado").isNotNull())

    def rules(_: DataFrame) -> list[Rule]:
        persona = F.coalesce("persona", F.lit(""))
        return [
            ("unknown_reservation", ~F.col("en_sala")),
            ("not_active", F.col("estado") != fixed.ACTIVA),
            ("bad_ci", ~is_ci_shape("ci")),
            ("unknown_participant", ~F.col("existe")),
            ("no_programme", ~F.col("en_programa")),
            ("room_for_docentes", (F.col("tipo_sala") == "Docente") & (persona != fixed.LABEL_DOCENTE)),
            ("room_for_posgrado", (F.col("tipo_sala") == "Posgrado") & (persona != fixed.SHORT_POSGRADO)),
            ("sanctioned", F.col("fin").isNotNull()),
            ("full", F.col("ocupados") >= F.col("capacidad")),
            ("already_present", F.col("ya_esta")),
        ]

    if mode == "snapshot":
        judged = judge(facts, rules(facts))
    else:
        once = Resource("fila", "_k_fila", "_f_fila")
        judged = _resolve(
            facts,
            rules,
            [(once, F.struct("ci", "id_reserva"), F.lit(1)), _seat_resource()],
            [
                ("ya_esta", lambda n: F.col("ya_esta") | (n > 0)),
                ("ocupados", lambda n: F.col("ocupados") + n),
            ],
        )
    return _report(judged, reqs)
