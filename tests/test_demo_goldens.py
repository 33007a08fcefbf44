"""Results worked out by hand for the demo scenario."""

import datetime as dt

from aulario.operators import changes, islands, propagation, quality, reports, sanctions, sweeps


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()] if cols else [tuple(r) for r in df.collect()]


def states(t):
    return dict(rows(t.reserva, "id_reserva", "estado"))


def test_top_rooms(demo):
    assert [(r[0], r[2]) for r in rows(reports.top_rooms(demo))] == [
        ("Sala C1", 2), ("Sala A1", 1), ("Sala A2", 1), ("Sala B1", 1),
    ]


def test_turno_demand(demo):
    assert rows(reports.turno_demand(demo)) == [(480, 540, 3), (540, 600, 2)]


def test_avg_participants(demo):
    got = {r[0]: r[2] for r in rows(reports.avg_participants(demo))}
    assert got == {"Sala A1": 3.0, "Sala C1": 3.0, "Sala A2": 2.0, "Sala B1": 2.0}


def test_bookings_by_programme(demo):
    got = {r[0]: r[2] for r in rows(reports.bookings_by_programme(demo))}
    assert got == {
        "Psicología": 3, "Arquitectura": 3, "Medicina": 3, "Ingeniería en Informática": 2, "Dirección de Empresas": 2,
    }


def test_building_occupancy(demo):
    got = [(r[0].split(" ", 1)[1], r[1]) for r in rows(reports.building_occupancy(demo))]
    assert got == [("Semprún", 8.0), ("Sacré Cœur", 7.14), ("San José", 6.0)]


def test_roles_and_sanctions(demo):
    assert rows(reports.bookings_by_role(demo)) == [("Estudiante", "Grado", 5, 5)]
    assert rows(reports.sanctions_by_role(demo)) == [("Estudiante", "Grado", 1)]


def test_shares_and_rates(demo):
    assert rows(reports.state_share(demo)) == [("Activa", 100.0)]
    assert {r[2] for r in rows(reports.cancellation_rate(demo))} == {0.0}


def test_top_participants_and_lead(demo):
    top = [(r[1], r[3]) for r in rows(reports.top_participants(demo))]
    assert top == [("Ana", 2), ("Luis", 2), ("María", 1)]
    assert rows(reports.mean_lead_days(demo)) == [(19.0,)]


def test_share_of_filtered_reservations_uses_all_as_denominator(demo):
    f = reports.ReportFilter(edificio="Edificio San José")
    assert rows(reports.state_share(demo, f)) == [("Activa", 40.0)]


def test_lead_of_nothing_is_one_null_row(demo):
    f = reports.ReportFilter(desde="2030-01-01")
    assert rows(reports.mean_lead_days(demo, f)) == [(None,)]


def block_sweep(t, as_of):
    return sweeps.sweep_blocks(sweeps.finalize_attended(t, as_of), as_of)


def test_sweep_of_islands_at_and_before_the_grace(demo):
    done = {1: "Finalizada", 3: "Finalizada"}
    at = dt.datetime(2025, 11, 20, 10, 10)
    assert states(block_sweep(demo, at)) == {**done, 2: "Sin Asistencia", 4: "Sin Asistencia", 5: "Sin Asistencia"}
    before = dt.datetime(2025, 11, 20, 10, 9)
    assert states(block_sweep(demo, before)) == {**done, 2: "Activa", 4: "Activa", 5: "Activa"}


def test_sweep_of_single_reservations_is_strict(demo):
    got = states(sweeps.sweep_reservations(demo, dt.datetime(2025, 11, 20, 9, 30)))
    assert got == {1: "Finalizada", 3: "Finalizada", 4: "Sin Asistencia", 2: "Activa", 5: "Activa"}
    at_grace = states(sweeps.sweep_reservations(demo, dt.datetime(2025, 11, 20, 10, 10)))
    assert at_grace[2] == at_grace[5] == "Activa"


def test_no_shows_are_sanctioned_and_told(demo):
    at = dt.datetime(2025, 11, 20, 10, 10)
    swept = block_sweep(demo, at)
    after = propagation.sanctions_from_transitions(swept, sweeps.state_changes(demo.reserva, swept.reserva), at)
    new = rows(after.sancion_participante.filter("id_sancion > 1"), "ci_participante", "fecha_inicio", "fecha_fin")
    day, end = dt.date(2025, 11, 20), dt.date(2026, 1, 20)
    assert sorted(new) == [(ci, day, end) for ci in ("40672157", "43782512", "53910675")]
    told = rows(after.notificacion.orderBy("id_notificacion"), "id_notificacion", "ci_participante", "mensaje")
    assert [t[:2] for t in told] == [(1, "40672157"), (2, "53910675"), (3, "43782512")]
    assert told[2][2].endswith("#4")


def test_running_the_sweep_again_changes_nothing(demo):
    at = dt.datetime(2025, 11, 20, 10, 30)
    once = sweeps.run_sweep(demo, at)
    twice = sweeps.run_sweep(once, at)
    assert states(once) == states(twice)
    for name in ("sancion_participante", "notificacion"):
        assert sorted(rows(getattr(once, name))) == sorted(rows(getattr(twice, name)))


def test_both_leaving_cancels_the_reservation(demo, spark):
    pairs = spark.createDataFrame([("48562347", 3), ("51238903", 3)], "ci string, id_reserva long")
    out = changes.cancel_participation(demo, pairs, dt.datetime(2025, 11, 10, 9, 0))
    assert states(out.model)[3] == "Cancelada"
    texts = dict(rows(out.model.notificacion, "ci_participante", "mensaje"))
    assert texts["48562347"].startswith("Cancelaste") and texts["51238903"].startswith("Tu reserva #3 fue cancelada")


def test_one_leaving_keeps_the_reservation(demo, spark):
    pairs = spark.createDataFrame([("48562347", 3), ("40672157", 3)], "ci string, id_reserva long")
    out = changes.cancel_participation(demo, pairs, dt.datetime(2025, 11, 10, 9, 0))
    assert states(out.model)[3] == "Activa"
    assert dict(rows(out.verdicts, "ci", "verdict")) == {"48562347": "accepted", "40672157": "rejected"}


def test_identity_numbers(demo):
    bad = {r[0] for r in rows(quality.check_people(demo.participantes, demo.participantes_programa_academico), "ci")}
    assert bad == {"48562347", "51238903", "40672157", "53910675", "29875645"}


def test_expiry_and_island_numbers(demo):
    flags = rows(islands.island_flags(islands.active_with_slot(demo)), "id_reserva", "comienza_bloque", "bloque_id")
    assert sorted(flags) == [(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (5, 0, 1)]
    kept = sanctions.expire_sanctions(demo, dt.datetime(2025, 11, 2)).sancion_participante
    assert rows(kept, "activa") == [(False,)]
