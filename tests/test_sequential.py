"""Sequential admission against a plain one-by-one loop on random small states."""

import datetime as dt
import random

import pytest
from demo_rows import table

from aulario.operators import admission, changes, intake
from aulario.operators.verdicts import Outcome
from aulario.plans.first_come import Resource, grant_in_order
from aulario.sources.model import Model
from aulario.sources.schema import REQUESTS

AS_OF = dt.datetime(2025, 2, 5, 10, 0)  # a Wednesday; slot 3 starts at 10:00
TODAY = AS_OF.date()
ROOMS = [("S1", "E", 3, "Libre"), ("S2", "E", 2, "Posgrado"), ("S3", "E", 2, "Docente"), ("S4", "E", 1, None)]
PEOPLE = [f"1000000{i}" for i in range(8)]
ROLES = {0: ("Docente", "G"), 1: ("Estudiante", "P"), 2: ("Estudiante", "P")}


def random_state(spark, seed):
    rnd = random.Random(seed)
    members = [(i + 1, ci, ROLES.get(i, ("Estudiante", "G"))[1], ROLES.get(i, ("Estudiante", "G"))[0])
               for i, ci in enumerate(PEOPLE[:7])]
    bookings, taking_part = [], []
    for k in range(12):
        room = rnd.choice(ROOMS)
        day = TODAY + dt.timedelta(days=rnd.randint(-2, 6))
        bookings.append((k + 1, room[0], "E", day, rnd.randint(1, 4), rnd.choice(["Activa", "Activa", "Activa", "Cancelada"])))
        for ci in rnd.sample(PEOPLE, rnd.randint(0, 3)):
            taking_part.append((ci, k + 1, TODAY, False, rnd.random() < 0.7))
    sanctions = [(1, PEOPLE[6], TODAY - dt.timedelta(days=1), TODAY, True), (2, PEOPLE[3], TODAY, TODAY, False)]
    rows = {
        "participantes": [(ci, "N", "A", f"{ci}@x") for ci in PEOPLE],
        "facultad": [(1, "F")],
        "programas_academicos": [("G", 1, "Grado"), ("P", 1, "Posgrado")],
        "participantes_programa_academico": members,
        "edificio": [("E", "-", "-")],
        "sala": ROOMS,
        "turno": [(i, (7 + i) * 60, (8 + i) * 60) for i in range(1, 5)],
        "reserva": bookings,
        "reserva_participante": taking_part,
        "sancion_participante": sanctions,
        "notificacion": [],
    }
    return rows, Model(spark, {n: table(spark, n, r) for n, r in rows.items()}), rnd


class Loop:
    """The state as one user after the other meets it."""

    def __init__(self, rows):
        self.bookings = {b[0]: list(b[1:]) for b in rows["reserva"]}
        self.people = {(ci, r): ok for ci, r, _, _, ok in rows["reserva_participante"]}
        self.kind = {m[1]: (m[3], m[2]) for m in rows["participantes_programa_academico"]}
        self.rooms = {r[0]: r for r in rows["sala"]}
        self.punished = {s[1] for s in rows["sancion_participante"] if s[4] and s[2] <= TODAY <= s[3]}

    def taken(self, room, day, slot):
        return any(b[0] == room and b[2] == day and b[3] == slot and b[4] == "Activa" for b in self.bookings.values())

    def used(self, ci, ok, confirmed=False):
        return sum(
            1 for (c, r), yes in self.people.items()
            if c == ci and self.bookings[r][4] == "Activa" and ok(self.bookings[r][2]) and (yes or not confirmed)
        )

    def book(self, ci, room, day, slot):
        key = max(self.bookings) + 1
        self.bookings[key] = [room, "E", day, slot, "Activa"]
        self.people[ci, key] = True


MONDAY = TODAY - dt.timedelta(days=TODAY.weekday())


def this_week(d):
    return MONDAY <= d <= MONDAY + dt.timedelta(days=6)


def sunday_week(d):
    return d.year, int(d.strftime("%U"))


def started(day, slot, inclusive):
    at = dt.datetime.combine(day, dt.time(7 + slot))
    return at <= AS_OF if inclusive else at < AS_OF


def self_reason(w, ci, room, day, slot):
    if ci in w.punished:
        return "sanctioned"
    if day < TODAY:
        return "past_date"
    if day == TODAY and slot > 4:
        return "unknown_turno"
    if day == TODAY and started(day, slot, False):
        return "turno_started"
    if w.taken(room, day, slot):
        return "slot_taken"
    if ci not in w.kind:
        return "no_type"
    if room not in w.rooms:
        return "unknown_room"
    role, level = w.kind[ci]
    if w.rooms[room][3] == "Docente" and role != "Docente":
        return "room_for_docentes"
    if w.rooms[room][3] == "Posgrado" and (role, level) != ("Estudiante", "P"):
        return "room_for_posgrado"
    if role == "Estudiante" and w.used(ci, lambda d: d == day) >= 2:
        return "daily_limit"
    if role == "Estudiante" and w.used(ci, this_week) >= 3:
        return "weekly_limit"
    return "unknown_turno" if slot > 4 else None


def admin_reason(w, ci, room, day, slot):
    if day < TODAY:
        return "past_date"
    if day == TODAY and slot <= 4 and started(day, slot, True):
        return "turno_started"
    if not (ci.isdigit() and len(ci) in (7, 8)):
        return "bad_ci"
    if ci not in PEOPLE:
        return "unknown_participant"
    if ci not in w.kind:
        return "no_programme"
    if room not in w.rooms:
        return "unknown_room"
    role, level = w.kind[ci]
    if w.rooms[room][3] == "Docente" and role != "Docente":
        return "room_for_docentes"
    if w.rooms[room][3] == "Posgrado" and (role, level) != ("Estudiante", "P"):
        return "room_for_posgrado"
    if ci in w.punished:
        return "sanctioned"
    if (role, level) == ("Estudiante", "G"):
        if w.used(ci, lambda d: d == day) >= 2:
            return "daily_limit"
        if w.used(ci, lambda d: sunday_week(d) == sunday_week(day)) >= 3:
            return "weekly_limit"
    if w.taken(room, day, slot):
        return "slot_taken"
    return "unknown_turno" if slot > 4 else None


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("who", ["self", "admin"])
def test_bookings(spark, seed, who):
    rows, t, rnd = random_state(spark, seed)
    reqs = []
    for k in range(60):
        ci = rnd.choice(PEOPLE + ["12A", "99999999"] if who == "admin" else PEOPLE)
        room = rnd.choice(["S1", "S1", "S1", "S2", "S3", "S4", "S9"])
        day = TODAY + dt.timedelta(days=rnd.choice([-1, 0, 0, 1, 1, 2, 4, 7]))
        reqs.append((k, AS_OF + dt.timedelta(seconds=rnd.randint(0, 9)), ci, room, "E", day, rnd.randint(1, 5)))
    w, expected = Loop(rows), {}
    reason = self_reason if who == "self" else admin_reason
    for k, _, ci, room, _, day, slot in sorted(reqs, key=lambda r: (r[1], r[0])):
        expected[k] = reason(w, ci, room, day, slot)
        if expected[k] is None:
            w.book(ci, room, day, slot)
    admit = admission.admit_bookings_self if who == "self" else admission.admit_bookings_admin
    batch = spark.createDataFrame(reqs, REQUESTS["booking"])
    got = {r.request_id: r.reason for r in admit(t, batch, AS_OF, "sequential").collect()}
    assert got == expected
    assert None in expected.values() and "slot_taken" in expected.values()


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_joins(spark, seed):
    rows, t, rnd = random_state(spark, seed)
    reqs = [(k, AS_OF + dt.timedelta(seconds=rnd.randint(0, 9)), rnd.choice(PEOPLE), rnd.randint(1, 13)) for k in range(70)]
    w, expected = Loop(rows), {}
    for k, _, ci, res in sorted(reqs, key=lambda r: (r[1], r[0])):
        booking = w.bookings.get(res)
        role, level = w.kind.get(ci, (None, None))
        student = role == "Estudiante"
        inside = sum(1 for (_, r), ok in w.people.items() if r == res and ok)
        kind = w.rooms[booking[0]][3] if booking else None
        if not booking or booking[4] != "Activa":
            out = "not_active"
        elif ci in w.punished:
            out = "sanctioned"
        elif kind == "Posgrado" and student:
            out = "room_for_posgrado"
        elif kind == "Docente" and role != "Docente":
            out = "room_for_docentes"
        elif w.people.get((ci, res)):
            out = "already_confirmed"
        elif inside >= w.rooms[booking[0]][2]:
            out = "full"
        elif student and w.used(ci, lambda d: d == booking[2], True) >= 2:
            out = "daily_limit"
        elif student and w.used(ci, this_week, True) >= 3:
            out = "weekly_limit"
        else:
            out = None
            w.people[ci, res] = True
        expected[k] = out
    batch = spark.createDataFrame(reqs, REQUESTS["join"])
    verdicts = admission.admit_joins(t, batch, AS_OF, "sequential")
    assert {r.request_id: r.reason for r in verdicts.collect()} == expected
    after = changes.apply_joins(t, verdicts, AS_OF).reserva_participante
    assert {(r.ci_participante, r.id_reserva): r.confirmado for r in after.collect()} == w.people


@pytest.mark.parametrize("seed", [7, 8])
def test_additions(spark, seed):
    rows, t, rnd = random_state(spark, seed)
    reqs = [(k, AS_OF, rnd.choice(PEOPLE + ["12A", "99999999"]), rnd.randint(1, 13)) for k in range(60)]
    w, expected = Loop(rows), {}
    for k, _, ci, res in reqs:
        booking = w.bookings.get(res)
        role, level = w.kind.get(ci, (None, None))
        kind = w.rooms[booking[0]][3] if booking else None
        if not booking:
            out = "unknown_reservation"
        elif booking[4] != "Activa":
            out = "not_active"
        elif not ci.isdigit():
            out = "bad_ci"
        elif ci not in PEOPLE:
            out = "unknown_participant"
        elif role is None:
            out = "no_programme"
        elif kind == "Docente" and role != "Docente":
            out = "room_for_docentes"
        elif kind == "Posgrado" and (role, level) != ("Estudiante", "P"):
            out = "room_for_posgrado"
        elif ci in w.punished:
            out = "sanctioned"
        elif sum(1 for (_, r) in w.people if r == res) >= w.rooms[booking[0]][2]:
            out = "full"
        elif (ci, res) in w.people:
            out = "already_present"
        else:
            out = None
            w.people[ci, res] = True
        expected[k] = out
    batch = spark.createDataFrame(reqs, REQUESTS["add"])
    got = {r.request_id: r.reason for r in admission.admit_adds_admin(t, batch, AS_OF, "sequential").collect()}
    assert got == expected


def test_people_colliding_on_number_and_email(spark, demo):
    # numbers pass the check digit; the second row loses its e-mail to the first, so the third,
    # which shares only the second row's number, is free to enter
    from aulario.functions.text import check_digit_ok

    valid = [str(n) for n in range(20000000, 20000400)]
    df = spark.createDataFrame([(v,) for v in valid], "ci string")
    good = sorted(r.ci for r in df.filter(check_digit_ok("ci")).limit(20).collect())
    rows = [
        (1, good[0], "Ana", "Paz", "a@correo.ucu.edu.uy", "Medicina", "Estudiante"),
        (2, good[1], "Eva", "Paz", "A@correo.ucu.edu.uy", "Medicina", "Estudiante"),
        (3, good[1], "Eva", "Paz", "b@correo.ucu.edu.uy", "Medicina", "Estudiante"),
        (4, good[2], "Leo", "Paz", "b@correo.ucu.edu.uy", "Medicina", "Estudiante"),
        (5, good[2], "leo  o'NEILL", "Paz", "c@correo.ucu.edu.uy", "Medicina", "Estudiante"),
        (6, good[3], "Leo1", "Paz", "d@correo.ucu.edu.uy", "Medicina", "Estudiante"),
        (7, good[4], "Leo", "Paz", "ana.perez@correo.ucu.edu.uy", "Medicina", "Estudiante"),
        (8, good[5], "Leo", "Paz", "e@correo.ucu.edu.uy", "Alquimia", "Estudiante"),
    ]
    out: Outcome = changes.intake_participants(demo, spark.createDataFrame(rows, REQUESTS["participant"]))
    got = {r.request_id: r.reason for r in out.verdicts.collect()}
    assert got == {1: None, 2: "duplicate", 3: None, 4: "duplicate", 5: None, 6: "bad_name", 7: "duplicate",
                   8: "unknown_programme"}
    names = {r.ci: r.nombre for r in out.model.participantes.collect()}
    assert names[good[2]] == "Leo O'Neill"


def test_grants_with_a_group_holding_most_claims(spark):
    """Half of all claims want the same unit; a long chain runs through the rest."""
    rnd = random.Random(11)
    claims = []
    for k in range(600):
        claims.append((k, 0 if rnd.random() < 0.5 else rnd.randint(1, 40), rnd.randint(0, 60)))
    expected, left_a, left_b = set(), {}, {}
    for k, a, b in claims:
        if left_a.get(a, 1) > 0 and left_b.get(b, 2) > 0:
            expected.add(k)
            left_a[a], left_b[b] = left_a.get(a, 1) - 1, left_b.get(b, 2) - 1
    df = spark.createDataFrame(claims, "k long, a long, b long").selectExpr("*", "1L as fa", "2L as fb")
    granted = grant_in_order(df, "k", [Resource("a", "a", "fa"), Resource("b", "b", "fb")])
    assert {r.k for r in granted.collect()} == expected


def test_a_long_chain_is_decided_whatever_its_length(spark):
    rows = [(k, k // 2, (k + 1) // 2) for k in range(40)]  # each claim contends with the one before
    df = spark.createDataFrame(rows, "k long, a long, b long").selectExpr("*", "1L as f")
    granted = grant_in_order(df, "k", [Resource("a", "a", "f"), Resource("b", "b", "f")])
    assert {r.k for r in granted.collect()} == set(range(0, 40, 2))


def test_units_of_a_group_come_from_the_data(spark):
    """More units than any room has by rule, fewer than claims; some claims take none."""
    df = spark.range(200).selectExpr("id as k", "0 as a", "70L as f", "id % 4 <> 0 as u")
    granted = {r.k for r in grant_in_order(df, "k", [Resource("a", "a", "f", "u")]).collect()}
    expected, left = set(), 70
    for k in range(200):
        if left > 0:
            expected.add(k)
            left -= k % 4 != 0
    assert granted == expected


def test_a_claim_that_takes_nothing_keeps_the_room_it_had(spark):
    """Claim 2 waits for a slot while a later claim takes the last unit it only needs to be free."""
    rows = [(0, 1, None, None, True), (1, 1, 7, None, True), (2, None, 7, 5, False), (3, None, None, 5, True),
            (4, None, 7, None, True), (5, None, None, 5, False)]
    df = spark.createDataFrame(rows, "k long, q long, s long, p long, u boolean").selectExpr("*", "1L as f")
    resources = [Resource("q", "q", "f"), Resource("s", "s", "f"), Resource("p", "p", "f", "u")]
    assert {r.k for r in grant_in_order(df, "k", resources).collect()} == {0, 2, 3}


@pytest.mark.parametrize("seed", range(3))
def test_grants_are_those_of_a_loop_with_takers_and_others(spark, seed):
    rnd = random.Random(70 + seed)
    some = lambda n: None if rnd.random() < 0.3 else rnd.randint(1, n)
    claims = [(k, some(40), some(25), some(15), rnd.random() < 0.4) for k in range(300)]
    expected, left = set(), {}
    for k, a, b, c, takes in claims:
        groups = [(n, g) for n, g in (("a", a), ("b", b), ("c", c)) if g is not None]
        units = {"a": 1, "b": 2, "c": 3}
        if all(left.setdefault(g, units[g[0]]) > 0 for g in groups):
            expected.add(k)
            for g in groups:
                left[g] -= takes if g[0] == "c" else 1
    df = spark.createDataFrame(claims, "k long, a long, b long, c long, u boolean").selectExpr("*", "1 fa", "2 fb", "3 fc")
    resources = [Resource("a", "a", "fa"), Resource("b", "b", "fb"), Resource("c", "c", "fc", "u")]
    granted = grant_in_order(df, "k", resources)
    assert granted.columns == df.columns and {r.k for r in granted.collect()} == expected


@pytest.mark.parametrize("seed", range(2))
def test_requests_become_a_state_without_conflicts(spark, seed):
    rows, t, rnd = random_state(spark, 50 + seed)
    asked = [
        (k, dt.datetime(2025, 2, 5, 9, rnd.randint(0, 3)), rnd.choice(PEOPLE), rnd.choice(ROOMS)[0], "E",
         TODAY + dt.timedelta(days=rnd.randint(0, 3)), rnd.randint(1, 4))
        for k in range(60)
    ]
    for by, reason in (("self", self_reason), ("admin", admin_reason)):
        w, granted = Loop(rows), {}
        for k, _, ci, room, _, day, slot in sorted(asked, key=lambda r: (r[1], r[0])):
            if reason(w, ci, room, day, slot) is None:
                granted[k] = (room, day, slot, ci)
                w.book(ci, room, day, slot)
        after, verdicts = intake.book(t, spark.createDataFrame(asked, REQUESTS["booking"]), AS_OF, by)
        assert {r["request_id"] for r in verdicts.filter("verdict = 'accepted'").collect()} == set(granted)
        new = after.reserva.filter("id_reserva > 12").join(
            after.reserva_participante.withColumnRenamed("ci_participante", "ci"), "id_reserva"
        )
        got = {r["id_reserva"]: (r["nombre_sala"], r["fecha"], r["id_turno"], r["ci"]) for r in new.collect()}
        assert got == {13 + i: granted[k] for i, k in enumerate(sorted(granted))}


def test_the_gate_refuses_what_must_not_happen(spark):
    rows, t, _ = random_state(spark, 9)
    held = next(b for b in rows["reserva"] if b[5] == "Activa")
    slots = spark.createDataFrame([held[1:5]], "nombre_sala string, edificio string, fecha date, id_turno int")
    with pytest.raises(intake.BrokenRule, match="one_per_slot"):
        intake.gate_bookings(t, slots)
    free = slots.withColumn("id_turno", slots["id_turno"] + 50)
    intake.gate_bookings(t, free)
    with pytest.raises(intake.BrokenRule, match="one_per_slot"):
        intake.gate_bookings(t, free.union(free))
    crowd = t.reserva_participante.limit(0).union(
        spark.createDataFrame([(ci, held[0], TODAY, False, True) for ci in PEOPLE], t.reserva_participante.schema)
    )
    with pytest.raises(intake.BrokenRule, match="seats"):
        intake.gate_joins(t.replace(reserva_participante=crowd), t.reserva.select("id_reserva"), True)
    intake.gate_joins(t.replace(reserva_participante=crowd), t.reserva.filter(f"id_reserva <> {held[0]}"), True)
