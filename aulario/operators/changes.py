"""Applying batches of changes: each function maps (state, batch) to a new state and verdicts."""

from __future__ import annotations

import datetime as dt
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aulario.functions.dates import at_minute, now, today
from aulario.functions.text import (
    canonical,
    check_digit_ok,
    email_domain_ok,
    is_person_name,
    is_room_name,
    proper_name,
    text_key,
)
from aulario.operators.filters import ROOM, SLOT, flag_existing
from aulario.operators.listings import attendance_editable
from aulario.operators.notices import append_notifications, message, notifications
from aulario.operators.propagation import cancel_where, left_without_confirmed, sanctions_from_transitions
from aulario.operators.verdicts import Mode, Outcome, Rule, any_fails, judge
from aulario.plans.first_come import Resource, grant_in_order, granted_before
from aulario.plans.moves import held_by_others, settle
from aulario.plans.numbering import next_ids
from aulario.plans.staging import stage
from aulario.sources import fixed
from aulario.sources.model import Model


def accepted(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(F.col("verdict") == "accepted")


def last_edit(done: DataFrame, keys: list[str]) -> DataFrame:
    """Of several accepted edits of one row the last counts: by ``request_id`` where the batch has one,
    else by the values, so that the outcome does not depend on how the batch is read."""
    values = [c for c in done.columns if c not in keys]
    values.sort(key=lambda c: c != "request_id")
    last = done.groupBy(*keys).agg(F.max(F.struct(*values)).alias("_ultimo"))
    return last.select(*keys, *[F.col("_ultimo")[c].alias(c) for c in values])


# --- effects of admission --------------------------------------------------------------------


def apply_bookings(t: Model, verdicts: DataFrame, as_of: dt.datetime) -> Model:
    """Accepted bookings become active reservations holding their requester."""

    @cache
    def numbered() -> DataFrame:  # both tables must see the same ids
        return next_ids(accepted(verdicts), ["request_id"], "id_reserva", t.reserva)

    def reserva(_: Model) -> DataFrame:
        new = numbered().withColumn("estado", F.lit(fixed.ACTIVA))
        return t.reserva.unionByName(new.select(*t.reserva.columns))

    def participation(_: Model) -> DataFrame:
        people = numbered().select(
            F.col("ci").alias("ci_participante"),
            "id_reserva",
            today(as_of).alias("fecha_solicitud_reserva"),
            F.lit(False).alias("asistencia"),
            F.lit(True).alias("confirmado"),
        )
        return t.reserva_participante.unionByName(people)

    return t.replace(reserva=reserva, reserva_participante=participation)


def apply_joins(t: Model, verdicts: DataFrame, as_of: dt.datetime) -> Model:
    """Accepted joins: existing rows are confirmed again, the others inserted (once per person)."""
    pairs = (
        accepted(verdicts)
        .select(F.col("ci").alias("ci_participante"), "id_reserva")
        .distinct()
        .withColumn("_pedido", F.lit(True))
    )
    key = ["ci_participante", "id_reserva"]
    rp = t.reserva_participante
    # one full join: rows on both sides are confirmed, request-only rows are new
    joined = rp.withColumn("_fila", F.lit(True)).join(pairs, key, "full_outer")
    new = F.col("_fila").isNull()
    return t.replace(
        reserva_participante=joined.select(
            *key,
            F.when(new, today(as_of)).otherwise(F.col("fecha_solicitud_reserva")).alias("fecha_solicitud_reserva"),
            F.when(new, False).otherwise(F.col("asistencia")).alias("asistencia"),
            F.when(F.col("_pedido"), True).otherwise(F.col("confirmado")).alias("confirmado"),
        )
    )


# --- leaving a reservation -------------------------------------------------------------------


def cancel_participation(t: Model, pairs: DataFrame, as_of: dt.datetime, order: str = "ci") -> Outcome:
    """People withdraw from reservations (``ci``, ``id_reserva``), in ``order``.

    A pair asked for again is the same withdrawal: it gets the same verdict and changes nothing more.

    A reservation left without a confirmed person is cancelled. The text each person gets depends
    on whether anybody was still confirmed right after their own withdrawal: that is so until the
    last confirmed person of a reservation has withdrawn.
    """
    rp = t.reserva_participante
    key = ["ci_participante", "id_reserva"]
    asked = pairs.select(F.col("ci").alias("ci_participante"), "id_reserva", F.col(order).alias("_ord"))
    asked = asked.groupBy(*key).agg(F.min("_ord").alias("_ord"), F.count("*").alias("_veces"))
    joined = rp.withColumn("_fila", F.lit(True)).join(asked, key, "full_outer")
    row, withdrawn = F.col("_fila").isNotNull(), F.col("_ord").isNotNull()
    confirmed = F.col("confirmado") == F.lit(True)

    per_reservation = joined.filter(row).groupBy("id_reserva").agg(
        F.count_if(confirmed & ~withdrawn).alias("_quedan"),
        F.max(F.when(confirmed & withdrawn, F.col("_ord"))).alias("_ultima"),
        F.max(withdrawn).alias("_tocada"),
    )
    touched = per_reservation.filter("_tocada")
    emptied = touched.filter(F.col("_quedan") == 0).select("id_reserva")

    requests = joined.filter(withdrawn).join(touched.drop("_tocada"), "id_reserva", "left")
    verdicts = judge(
        requests.select(F.col("ci_participante").alias("ci"), "id_reserva", "_fila", "_ord", "_veces", "_quedan", "_ultima"),
        [("not_in_reservation", F.col("_fila").isNull())],
    )
    told = accepted(verdicts)
    nobody_left = (F.col("_quedan") == 0) & F.coalesce(F.col("_ord") >= F.col("_ultima"), F.lit(True))
    text = F.when(nobody_left, message("reservation_cancelled")).otherwise(message("left_reservation"))

    new_rp = joined.filter(row).withColumn(
        "confirmado", F.when(withdrawn, False).otherwise(F.col("confirmado"))
    )
    return Outcome(
        t.replace(
            reserva_participante=new_rp.select(*rp.columns),
            reserva=cancel_where(t.reserva, emptied),
            notificacion=lambda _: append_notifications(t, notifications(told, text, as_of)),
        ),
        verdicts.withColumn("_vez", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_veces")))).select(
            "ci", "id_reserva", "verdict", "reason"
        ),
    )


def remove_participants(t: Model, pairs: DataFrame) -> Outcome:
    """An administrator takes people out of active reservations; an emptied one is cancelled."""
    state = t.reserva.select("id_reserva", F.col("estado").alias("_estado"))
    verdicts = judge(
        pairs.join(state, "id_reserva", "left"),
        [
            ("unknown_reservation", F.col("_estado").isNull()),
            ("not_active", F.col("_estado") != fixed.ACTIVA),
        ],
    )
    gone = accepted(verdicts).select(F.col("ci").alias("ci_participante"), "id_reserva")
    rp = t.reserva_participante.join(gone, ["ci_participante", "id_reserva"], "left_anti")
    emptied = gone.select("id_reserva").distinct().join(rp.select("id_reserva"), "id_reserva", "left_anti")
    return Outcome(
        t.replace(
            reserva_participante=rp.select(*t.reserva_participante.columns),
            reserva=cancel_where(t.reserva, emptied),
        ),
        verdicts.select("ci", "id_reserva", "verdict", "reason"),
    )


# --- editing reservations --------------------------------------------------------------------


def edit_verdicts(t: Model, edits: DataFrame, as_of: dt.datetime, mode: Mode = "snapshot") -> DataFrame:
    """Judge edits (``id_reserva``, ``fecha_nueva``, ``id_turno_nuevo``, ``estado_nuevo``).

    A slot is taken if an active reservation other than the edited one holds it. With
    ``mode="snapshot"`` every edit meets the state before the batch: the holders of a slot are folded
    to their number and one id. Of the edits that would otherwise move active reservations into one
    free slot, those of the lowest reservation have it, and the slot is taken for the others; a slot
    that an edit leaves stays closed until the next batch. With ``mode="sequential"`` the edits are
    taken one after the other, by ``request_id`` where the batch has one, then by reservation and
    values: a slot left by an earlier edit is free for a later one.
    """
    current = t.reserva.select("id_reserva", *ROOM, F.col("estado").alias("_estado_previo"))
    turno = t.turno.select(F.col("id_turno").alias("id_turno_nuevo"), "inicio_min")
    facts = (
        edits.join(current, "id_reserva", "left")
        .join(turno, "id_turno_nuevo", "left")
        .withColumn("_estado", canonical("estado_nuevo", fixed.ESTADOS))
    )
    is_today = F.col("fecha_nueva") == today(as_of)
    before = [
        ("unknown_reservation", F.col("_estado_previo").isNull()),
        ("bad_date", F.col("fecha_nueva").isNull()),
        ("past_date", F.col("fecha_nueva") < today(as_of)),
        ("turno_started", is_today & (at_minute("fecha_nueva", "inicio_min") <= now(as_of))),
    ]
    after = [("unknown_turno", F.col("inicio_min").isNull()), ("bad_state", F.col("_estado").isNull())]
    slot = [*ROOM, "fecha_nueva", "id_turno_nuevo"]
    holders = t.between(as_of.date(), None).reserva.filter(F.col("estado") == fixed.ACTIVA)
    holders = holders.withColumnsRenamed({"fecha": "fecha_nueva", "id_turno": "id_turno_nuevo"})
    if mode == "sequential":
        return _edits_in_order(facts, holders, slot, before, after)
    folded = holders.groupBy(*slot).agg(F.count("*").alias("_n"), F.min("id_reserva").alias("_id"))
    facts = facts.join(folded, slot, "left")
    by_another = (F.col("_n") > 1) | (F.col("_id") != F.col("id_reserva"))
    rules = [*before, ("slot_taken", by_another), *after]
    wants = F.col("_estado") == fixed.ACTIVA
    first = facts.filter(~any_fails(rules)).filter(wants).groupBy(*slot).agg(F.min("id_reserva").alias("_primera"))
    late = wants & (F.col("_primera") < F.col("id_reserva"))
    return judge(facts.join(first, slot, "left"), [*rules, ("slot_taken", late)])


def _edits_in_order(
    facts: DataFrame, holders: DataFrame, slot: list[str], before: list[Rule], after: list[Rule]
) -> DataFrame:
    """Verdicts of edits taken one after the other; see :mod:`aulario.plans.moves`."""
    place = F.struct(*slot)
    first = [F.col("request_id")] if "request_id" in facts.columns else []
    turn = F.struct(*first, "id_reserva", "fecha_nueva", "id_turno_nuevo", "_estado")
    facts = facts.withColumns({"_who": F.col("id_reserva"), "_at": turn, "_place": place})
    facts = stage(facts, "edits")
    stays = F.col("_estado") == fixed.ACTIVA
    asked = facts.filter(~any_fails(before)).select(
        F.col("_who").alias("who"), F.col("_at").alias("at"), F.col("_place").alias("place"), stays.alias("stays"),
        any_fails(after).alias("hopeless"),
    ).distinct()
    initial = holders.select(F.col("id_reserva").alias("who"), place.alias("place"))
    moves = asked.filter(~F.col("hopeless")).drop("hopeless")
    granted = stage(settle(moves, initial), "granted")
    # with every move decided, what may be held is held; moves were decided by it, so only the others ask again
    seen = held_by_others(asked.filter("hopeless").select("who", "at", "place"), granted, initial)
    taken = seen.select(F.col("at").alias("_at"), (F.col("may") > 0).alias("_tomado"))
    taken = taken.unionByName(granted.select(F.col("at").alias("_at"), F.lit(False).alias("_tomado")))
    move = ~any_fails(before) & ~any_fails(after)
    rules = [*before, ("slot_taken", F.coalesce("_tomado", move)), *after]
    return judge(facts.join(taken, "_at", "left"), rules)


def modify_reservations(t: Model, edits: DataFrame, as_of: dt.datetime, mode: Mode = "snapshot") -> Outcome:
    """Move reservations and set their state; of several edits of one the last accepted counts.

    People of an edited reservation are notified, then removed if it was cancelled; a reservation
    set to no-show has its people sanctioned like any other no-show. ``mode`` as in
    :func:`edit_verdicts`; a sequential batch is decided when this is called.
    """
    verdicts = edit_verdicts(t, edits, as_of, mode)
    if mode == "sequential":
        verdicts = stage(verdicts, "verdicts")
    named = [c for c in ("request_id",) if c in edits.columns]
    done = accepted(verdicts).select("id_reserva", "fecha_nueva", "id_turno_nuevo", "_estado", "_estado_previo", *named)
    done = last_edit(done, ["id_reserva"]).drop("request_id")
    hit = F.col("_estado").isNotNull()
    moved = t.reserva.join(done.drop("_estado_previo"), "id_reserva", "left").withColumns(
        {
            "fecha": F.when(hit, F.col("fecha_nueva")).otherwise(F.col("fecha")),
            "id_turno": F.when(hit, F.col("id_turno_nuevo")).otherwise(F.col("id_turno")),
            "estado": F.coalesce("_estado", "estado"),
        }
    )
    rp = t.reserva_participante
    told = rp.select(F.col("ci_participante").alias("ci"), "id_reserva").join(done, "id_reserva", "left_semi")
    with_notice = t.replace(
        notificacion=lambda _: append_notifications(
            t, notifications(told, message("reservation_modified"), as_of)
        )
    )
    changes = done.select(
        "id_reserva", F.col("_estado_previo").alias("estado_old"), F.col("_estado").alias("estado_new")
    )
    sanctioned = sanctions_from_transitions(with_notice, changes, as_of)
    cancelled = done.filter(F.col("_estado") == fixed.CANCELADA).select("id_reserva")
    return Outcome(
        sanctioned.replace(
            reserva=moved.select(*t.reserva.columns),
            reserva_participante=rp.join(cancelled, "id_reserva", "left_anti").select(*rp.columns),
        ),
        verdicts.select(*edits.columns, "verdict", "reason"),
    )


def record_attendance(t: Model, marks: DataFrame, as_of: dt.datetime) -> Outcome:
    """Save attendance sheets: every person of a sheet gets their mark, absent if they have none.

    A sheet is the marks of one reservation; it is refused once the reservation is no longer
    active or more than ten minutes past its end.
    """
    sheets = marks.select("id_reserva").distinct().join(attendance_editable(t, as_of), "id_reserva", "left")
    verdicts = judge(
        sheets,
        [
            ("unknown_reservation", F.col("estado").isNull()),
            ("not_editable", ~F.col("editable")),
        ],
    ).select("id_reserva", "verdict", "reason")
    open_sheets = accepted(verdicts).select("id_reserva", F.lit(True).alias("_hoja"))
    mark = marks.groupBy(F.col("ci").alias("ci_participante"), "id_reserva").agg(
        F.max("asistencia").alias("_marca")
    )
    rp = t.reserva_participante
    out = (
        rp.join(open_sheets, "id_reserva", "left")
        .join(mark, ["ci_participante", "id_reserva"], "left")
        .withColumn(
            "asistencia",
            F.when(F.col("_hoja"), F.coalesce("_marca", F.lit(False))).otherwise(F.col("asistencia")),
        )
    )
    return Outcome(t.replace(reserva_participante=out.select(*rp.columns)), verdicts)


# --- people ----------------------------------------------------------------------------------


def delete_participants(t: Model, cis: DataFrame, protected: str = fixed.EMAIL_PROTEGIDO) -> Outcome:
    """Delete people with what hangs from them; whoever has notifications cannot be deleted.

    Their participations are withdrawn first, which cancels reservations left without a confirmed
    person.
    """
    people = t.participantes.select("ci", F.col("email").alias("_email"))
    notified = t.notificacion.select(F.col("ci_participante").alias("ci"))
    facts = flag_existing(cis.select("ci").distinct().join(people, "ci", "left"), notified, ["ci"], "_notificado")
    verdicts = judge(
        facts,
        [
            ("unknown_participant", F.col("_email").isNull()),
            ("protected", F.col("_email") == protected),
            ("has_notifications", F.col("_notificado")),
        ],
    ).select("ci", "verdict", "reason")
    gone = accepted(verdicts).select(F.col("ci").alias("ci_participante"))

    def without(table: DataFrame) -> DataFrame:
        return table.join(gone, "ci_participante", "left_anti").select(*table.columns)

    rp = without(t.reserva_participante)
    withdrawn = (
        t.reserva_participante.filter(F.col("confirmado") == F.lit(True))
        .join(gone, "ci_participante", "left_semi")
        .select("id_reserva")
        .distinct()
    )
    kept_people = t.participantes.join(gone.withColumnRenamed("ci_participante", "ci"), "ci", "left_anti")
    return Outcome(
        t.replace(
            reserva=cancel_where(t.reserva, left_without_confirmed(rp, withdrawn)),
            reserva_participante=rp,
            sancion_participante=without(t.sancion_participante),
            participantes_programa_academico=without(t.participantes_programa_academico),
            participantes=kept_people.select(*t.participantes.columns),
        ),
        verdicts,
    )


def _name_rules() -> list[tuple[str, Column]]:
    return [
        ("bad_name", ~is_person_name("nombre")),
        ("bad_surname", ~is_person_name("apellido")),
        ("name_too_long", F.length("_nombre") > fixed.MAX_NOMBRE),
        ("surname_too_long", F.length("_apellido") > fixed.MAX_NOMBRE),
    ]


def _cleaned(reqs: DataFrame) -> DataFrame:
    return reqs.withColumns(
        {"_nombre": proper_name("nombre"), "_apellido": proper_name("apellido"), "_clave": text_key("email")}
    )


def _known_programme(t: Model, reqs: DataFrame) -> DataFrame:
    programmes = t.programas_academicos.select(F.col("nombre_programa").alias("programa"))
    return flag_existing(reqs, programmes, ["programa"], "_programa")


def edit_participants(t: Model, edits: DataFrame, protected: str = fixed.EMAIL_PROTEGIDO) -> Outcome:
    """Change name, e-mail, programme and role of people (one edit per person).

    An e-mail that belongs to somebody else, or that an earlier edit of the batch takes, is
    refused as the unique key would.
    """
    owner = t.participantes.select(text_key("email").alias("_clave"), F.col("ci").alias("_de"))
    facts = _known_programme(t, _cleaned(edits)).join(owner, "_clave", "left")
    rules = [
        *_name_rules(),
        ("bad_email", ~email_domain_ok("email", "rol")),
        ("protected", F.col("email") == protected),
        ("duplicate_email", F.col("_de").isNotNull() & (F.col("_de") != F.col("ci"))),
        ("unknown_programme", ~F.col("_programa")),
    ]
    usable = facts.filter(~any_fails(rules)).groupBy("_clave").agg(F.min("request_id").alias("_primera"))
    judged = judge(
        facts.join(usable, "_clave", "left"),
        [*rules, ("duplicate_email", F.col("_primera") < F.col("request_id"))],
    )
    done = accepted(judged).select(
        "ci", "request_id", "_nombre", "_apellido", F.col("email").alias("_email"), "programa", F.col("rol").alias("_rol")
    )
    done = last_edit(done, ["ci"]).drop("request_id")
    people = t.participantes.join(done, "ci", "left").select(
        "ci",
        F.coalesce("_nombre", "nombre").alias("nombre"),
        F.coalesce("_apellido", "apellido").alias("apellido"),
        F.coalesce("_email", "email").alias("email"),
    )
    ppa = t.participantes_programa_academico
    moved = ppa.join(
        done.select(F.col("ci").alias("ci_participante"), "programa", "_rol"), "ci_participante", "left"
    ).withColumns(
        {"nombre_programa": F.coalesce("programa", "nombre_programa"), "rol": F.coalesce("_rol", "rol")}
    )
    return Outcome(
        t.replace(participantes=people, participantes_programa_academico=moved.select(*ppa.columns)),
        judged.select(*edits.columns, "verdict", "reason"),
    )


def intake_participants(t: Model, reqs: DataFrame) -> Outcome:
    """New people in ``request_id`` order; an identity number or e-mail in use is a duplicate.

    Within the batch the first acceptable row of a number and of an e-mail wins; a row refused for
    one of them does not hold the other.
    """
    stored = t.participantes.select("ci", F.lit(True).alias("_ci"))
    emails = t.participantes.select(text_key("email").alias("_clave")).distinct().withColumn("_mail", F.lit(True))
    facts = _known_programme(t, _cleaned(reqs)).join(stored, "ci", "left").join(emails, "_clave", "left")
    facts = facts.withColumn("_en_uso", F.coalesce("_ci", F.lit(False)) | F.coalesce("_mail", F.lit(False)))
    facts = stage(facts.drop("_ci", "_mail"), "people")
    rules = [
        *_name_rules(),
        ("bad_ci", ~check_digit_ok("ci")),
        ("bad_email", ~email_domain_ok("email", "rol")),
        ("duplicate", F.col("_en_uso")),
    ]
    late = [("unknown_programme", ~F.col("_programa")), ("ci_too_long", F.length("ci") > 8)]
    viable = facts.filter(~any_fails([*rules, *late]))
    by_ci, by_email = Resource("ci", "ci", "_uno"), Resource("email", "_clave", "_uno")
    claims = viable.select("request_id", "ci", "_clave", F.lit(1).cast("long").alias("_uno"))
    granted = grant_in_order(claims, "request_id", [by_ci, by_email])
    out = granted_before(facts, granted, "request_id", by_ci, "_antes_ci")
    out = granted_before(out, granted, "request_id", by_email, "_antes_email")
    taken = (F.col("_antes_ci") > 0) | (F.col("_antes_email") > 0)
    judged = judge(out, [*rules, ("duplicate", taken), *late])

    new = accepted(judged)
    people = new.select("ci", F.col("_nombre").alias("nombre"), F.col("_apellido").alias("apellido"), "email")
    ppa = t.participantes_programa_academico

    def memberships(_: Model) -> DataFrame:
        rows = new.select(
            "request_id", F.col("ci").alias("ci_participante"), F.col("programa").alias("nombre_programa"), "rol"
        )
        numbered = next_ids(rows, ["request_id"], "id_alumno_programa", ppa)
        return ppa.unionByName(numbered.select(*ppa.columns))

    return Outcome(
        t.replace(
            participantes=t.participantes.unionByName(people), participantes_programa_academico=memberships
        ),
        judged.select(*reqs.columns, "verdict", "reason"),
    )


# --- rooms -----------------------------------------------------------------------------------


def _capacity(c: str = "capacidad") -> Column:
    return F.trim(F.col(c).cast("string")).try_cast("int")


def _bad_capacity() -> Column:
    return ~F.coalesce(F.col("_capacidad").between(fixed.MIN_CAPACIDAD, fixed.MAX_CAPACIDAD), F.lit(False))


def intake_rooms(t: Model, reqs: DataFrame) -> Outcome:
    """New rooms in ``request_id`` order; a name already used in the building is a duplicate."""
    stored = t.sala.select(text_key("nombre_sala").alias("_sala"), text_key("edificio").alias("_edificio"))
    buildings = t.edificio.select(F.col("nombre_edificio").alias("edificio"))
    facts = reqs.withColumns(
        {
            "_nombre": proper_name("nombre_sala"),
            "_capacidad": _capacity(),
            "_tipo": canonical("tipo_sala", fixed.TIPOS_SALA),
            "_sala": text_key(proper_name("nombre_sala")),
            "_edificio": text_key("edificio"),
        }
    )
    facts = flag_existing(facts, stored, ["_sala", "_edificio"], "_en_uso")
    facts = flag_existing(facts, buildings, ["edificio"], "_hay_edificio")
    rules = [
        ("bad_length", ~F.length("nombre_sala").between(1, fixed.MAX_NOMBRE_SALA)),
        ("bad_name", ~is_room_name("nombre_sala")),
        ("bad_capacity", _bad_capacity()),
        ("duplicate", F.col("_en_uso")),
    ]
    late = [
        ("unknown_building", ~F.col("_hay_edificio")),
        ("bad_type", F.col("tipo_sala").isNotNull() & F.col("_tipo").isNull()),
    ]
    # a room competes only with rooms of the same name and building: the lowest request wins
    first = (
        facts.filter(~any_fails([*rules, *late]))
        .groupBy("_sala", "_edificio")
        .agg(F.min("request_id").alias("_primera"))
    )
    judged = judge(
        facts.join(first, ["_sala", "_edificio"], "left"),
        [*rules, ("duplicate", F.col("_primera") < F.col("request_id")), *late],
    )
    new = accepted(judged).select(
        F.col("_nombre").alias("nombre_sala"),
        "edificio",
        F.col("_capacidad").cast("short").alias("capacidad"),
        F.col("_tipo").alias("tipo_sala"),
    )
    return Outcome(t.replace(sala=t.sala.unionByName(new)), judged.select(*reqs.columns, "verdict", "reason"))


def edit_rooms(t: Model, edits: DataFrame) -> Outcome:
    """Set capacity and type of rooms; of several edits of one room the last accepted counts."""
    judged = judge(
        edits.withColumns({"_capacidad": _capacity(), "_tipo": canonical("tipo_sala", fixed.TIPOS_SALA)}),
        [
            ("bad_capacity", _bad_capacity()),
            ("bad_type", F.col("tipo_sala").isNotNull() & F.col("_tipo").isNull()),
        ],
    )
    named = [c for c in ("request_id",) if c in edits.columns]
    done = accepted(judged).select(*ROOM, F.col("_capacidad").cast("short").alias("_capacidad"), "_tipo", *named)
    done = last_edit(done, ROOM).drop("request_id")
    hit = F.col("_capacidad").isNotNull()
    sala = t.sala.join(done, ROOM, "left").select(
        *ROOM,
        F.coalesce("_capacidad", "capacidad").alias("capacidad"),
        F.when(hit, F.col("_tipo")).otherwise(F.col("tipo_sala")).alias("tipo_sala"),
    )
    return Outcome(t.replace(sala=sala), judged.select(*edits.columns, "verdict", "reason"))


def delete_rooms(t: Model, keys: DataFrame) -> Outcome:
    """Delete rooms (``nombre_sala``, ``edificio``); one that has reservations is kept."""
    used = flag_existing(keys.select(*ROOM).distinct(), t.reserva, ROOM, "_usada")
    verdicts = judge(used, [("has_reservations", F.col("_usada"))]).select(*ROOM, "verdict", "reason")
    gone = accepted(verdicts).select(*ROOM)
    return Outcome(t.replace(sala=t.sala.join(gone, ROOM, "left_anti").select(*t.sala.columns)), verdicts)


# --- notifications ---------------------------------------------------------------------------


def mark_notifications_read(t: Model, cis: DataFrame) -> Model:
    """Everything the given people have received is read."""
    table = t.notificacion
    readers = cis.select(F.col("ci").alias("ci_participante")).distinct().withColumn("_lee", F.lit(True))
    read = table.join(readers, "ci_participante", "left").withColumn(
        "leida", F.when(F.col("_lee"), True).otherwise(F.col("leida"))
    )
    return t.replace(notificacion=read.select(*table.columns))
