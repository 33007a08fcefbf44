"""Moves in order, and edits of reservations in order, against a plain loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from aulario.operators import changes
from aulario.plans.moves import settle
from aulario.plans.running import running_sums


def in_turn(moves, initial):
    """Turns of the moves that find their place free of others."""
    held = dict(initial)
    granted = set()
    for who, at, place, stays in sorted(moves, key=lambda m: m[1]):
        if not any(p == place for w, p in held.items() if w != who):
            granted.add(at)
            held.pop(who, None)
            if stays:
                held[who] = place
    return granted


def cases():
    for seed in range(2):  # few places, many moves of the same people
        rnd = random.Random(seed)
        initial = [(w, p) for p, w in enumerate(rnd.sample(range(12), 6))]
        moves = [(rnd.randrange(15), at, rnd.randrange(9), rnd.random() < 0.8) for at in range(40)]
        yield f"random {seed}", moves, initial
    yield "chain", [(w, w, w + 1, True) for w in range(6)], [(w, w) for w in range(6)]
    yield "chain that opens", [(w, 6 - w, w + 1, True) for w in range(6)], [(w, w) for w in range(6)]
    yield "swaps", [(0, 1, 1, True), (1, 2, 0, True), (0, 3, 2, True), (1, 4, 0, True), (0, 5, 1, True)], [(0, 0), (1, 1)]
    yield "one place", [(w, w, 7, w % 3 == 0) for w in range(200)], [(500, 7)]
    yield "left at last", [(w, w, 7, True) for w in range(50)] + [(500, 50, 8, True)] + [(w, 51 + w, 7, True) for w in range(50)], [(500, 7)]
    yield "held twice", [(1, 1, 5, True), (2, 2, 5, True), (3, 3, 4, True)], [(1, 4), (2, 4), (3, 5)]
    yield "nothing", [], [(1, 4)]


@pytest.mark.parametrize(("name", "moves", "initial"), list(cases()), ids=lambda c: c if isinstance(c, str) else "")
def test_moves_equal_the_loop(spark, name, moves, initial):
    asked = spark.createDataFrame(moves, "who long, at long, place long, stays boolean").repartition(3)
    got = [r["at"] for r in settle(asked, spark.createDataFrame(initial, "who long, place long")).collect()]
    assert len(got) == len(set(got)) and set(got) == in_turn(moves, initial)


def test_running_sums_with_one_key_in_many_ranges(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice("ab"), k, rnd.randint(-2, 2)) for k in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(5)
    got = {r["o"]: r["s"] for r in running_sums(df, ["k"], F.col("o"), {"s": "v"}).collect()}
    sums, want = {}, {}
    for k, o, v in rows:
        want[o] = sums[k] = sums.get(k, 0) + v
    assert got == want


def test_edits_in_order_equal_the_loop(spark, demo):
    rnd = random.Random(3)
    as_of = dt.datetime(2025, 2, 5, 10, 0)
    day = as_of.date()
    rooms = [(r["nombre_sala"], r["edificio"]) for r in demo.sala.limit(2).collect()]
    slots = sorted(r["id_turno"] for r in demo.turno.collect())[:4]
    state = {}
    for k in range(1, 13):
        state[k] = [*rooms[k % 2], day + dt.timedelta(1 + k % 3), slots[k % 4], "Activa" if k % 4 else "Cancelada"]
    reserva = spark.createDataFrame([(k, *v) for k, v in state.items()], demo.reserva.schema)
    t = demo.replace(reserva=reserva, reserva_participante=demo.reserva_participante.limit(0))
    edits = [
        (n, rnd.randint(1, 13), None if rnd.random() < 0.05 else day + dt.timedelta(rnd.randint(-1, 3)),
         rnd.choice([*slots, 99]), rnd.choice(["activa", "Activa", "Cancelada", "Sin Asistencia", "otra"]))
        for n in range(80)
    ]
    known = {"activa": "Activa", "cancelada": "Cancelada", "sin asistencia": "Sin Asistencia", "finalizada": "Finalizada"}
    starts = {r["id_turno"]: r["inicio_min"] for r in demo.turno.collect()}
    want = {}
    for n, k, when, slot, estado in edits:
        room = state[k][:2] if k in state else None
        taken = any(
            s[:2] == room and s[2] == when and s[3] == slot and s[4] == "Activa" for o, s in state.items() if o != k
        )
        begun = when == day and slot in starts and starts[slot] <= 600
        reason = (
            "unknown_reservation" if room is None else "bad_date" if when is None else "past_date" if when < day
            else "turno_started" if begun else "slot_taken" if taken else "unknown_turno" if slot not in starts
            else "bad_state" if estado.lower() not in known else None
        )
        want[n] = reason
        if reason is None:
            state[k][2:] = [when, slot, known[estado.lower()]]
    schema = "request_id long, id_reserva long, fecha_nueva date, id_turno_nuevo int, estado_nuevo string"
    schema = schema.replace("id_reserva long", f"id_reserva {dict(demo.reserva.dtypes)['id_reserva']}")
    after, verdicts = changes.modify_reservations(t, spark.createDataFrame(edits, schema), as_of, "sequential")
    assert {r["request_id"]: r["reason"] for r in verdicts.collect()} == want
    assert sum(r is None for r in want.values()) > 15
    assert {r[0]: list(r[1:]) for r in after.reserva.select(*demo.reserva.columns).collect()} == state
