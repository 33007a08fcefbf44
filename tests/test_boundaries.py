"""Edges of the rules: inclusive ends, weeks, adjacency, order of effects, NULL flags, bad input."""

import datetime as dt
import random

import pytest
from demo_rows import table
from pyspark.sql import functions as F

from aulario.functions import dates, numbers, text
from aulario.operators import admission, changes, filters, listings, propagation, quality, reports, sanctions, sweeps
from aulario.sources.schema import REQUESTS
from aulario.sources.tables import read_requests, split_corrupt, write_reports

DAY = dt.date(2025, 11, 20)
NINE = dt.datetime(2025, 11, 20, 9, 0)


def d(day, month=11):
    return dt.date(2025, month, day)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def states(t):
    return {r.id_reserva: r.estado for r in t.reserva.collect()}


# --- functions -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "raw, clean",
    [("  ana   maría ", "Ana María"), ("o'neill", "O'Neill"), ("D'ELÍA o'", "D'Elía O'"), ("josé-luis", "José-luis"), ("", "")],
)
def test_proper_names(spark, raw, clean):
    assert value(spark, text.proper_name(F.lit(raw))) == clean


@pytest.mark.parametrize("ci, ok", [("43782512", True), ("10000014", True), ("4.378.251-2", True), ("48562347", False),
                                    ("123456", False), ("123456789", False), ("", False)])
def test_check_digit(spark, ci, ok):
    assert value(spark, text.check_digit_ok(F.lit(ci))) is ok


def test_closed_sets_and_keys(spark):
    assert value(spark, text.canonical(F.lit(" sin ASISTENCIA"), ("Activa", "Sin Asistencia"))) == "Sin Asistencia"
    assert value(spark, text.canonical(F.lit("Pendiente"), ("Activa",))) is None
    assert value(spark, text.text_key(F.lit("PÉREZ")) == text.text_key(F.lit("perez"))) is True
    assert value(spark, text.text_key(F.lit("año")) == text.text_key(F.lit("ano"))) is False
    # letters no list of accents would name, and blanks at the end
    assert value(spark, text.text_key(F.lit("Šimić  ")) == text.text_key(F.lit("SIMIC"))) is True


def test_keys_compare_as_in_the_database(spark):
    rows = spark.createDataFrame([("Šimić@x",), ("simic@X ",), ("año@x",), ("ano@x",), (None,)], "email string")
    got = [tuple(r) for r in quality.check_unique(rows, ["email"]).collect()]
    assert got == [("simic@X ", 2, "unique")]
    child = spark.createDataFrame([("AÑO@X",), ("anó@x",), ("SIMIC@x",), ("nadie",), (None,)], "de string")
    lost = quality.check_reference(child, ["de"], rows, ["email"]).collect()
    assert [r.de for r in lost] == ["nadie"]


def test_rooms_and_people_in_any_spelling_are_taken(spark, demo):
    email = demo.participantes.orderBy("ci").first().email
    asked = spark.createDataFrame([("1", email.upper().replace("A", "Ǎ") + " "), ("2", "nuevo@x")], "ci string, email string")
    got = {r.ci: r.email_tomado for r in filters.flag_taken_identity(demo, asked).collect()}
    assert got == {"1": True, "2": False}


@pytest.mark.parametrize("a, b, out", [(1, 8, 12.5), (1, 3, 33.33), (2, 3, 66.67), (1, 1600, 0.06), (5, 0, None)])
def test_percentages(spark, a, b, out):
    assert value(spark, numbers.percent2(F.lit(a), F.lit(b))) == out


@pytest.mark.parametrize("total, n, out", [(1, 8, 0.13), (-1, 8, -0.13), (-7, 2, -3.5), (0, 5, 0.0)])
def test_means_round_half_away_from_zero(spark, total, n, out):
    assert value(spark, numbers.mean2(F.lit(total), F.lit(n))) == out


def test_sunday_weeks_against_the_calendar(spark):
    days = spark.range(0, 1500).select(F.date_add(F.lit(dt.date(2023, 1, 1)), F.col("id").cast("int")).alias("d"))
    for r in days.select("d", dates.sunday_week("d").alias("w")).collect():
        assert r.w == int(r.d.strftime("%U"))


def test_dates_as_text(spark):
    assert value(spark, dates.clock(F.lit(485))) == "08:05"
    assert value(spark, dates.dmy(F.lit(DAY))) == "20/11/2025"
    assert value(spark, dates.dmy_clock(F.lit("2025-11-20 09:05:00").cast("timestamp"))) == "20/11/2025 09:05"
    assert value(spark, dates.iso_date(F.lit("2025-02-30"))) is None
    assert value(spark, dates.iso_date(F.lit("20/11/2025"))) is None
    assert value(spark, dates.iso_date(F.lit("2025-11-20"))) == DAY
    assert dates.week_bounds(dt.datetime(2025, 2, 2, 1)) == (d(27, 1), d(2, 2))


# --- filters and listings --------------------------------------------------------------------


def test_sentinels_and_empty_values_are_no_condition(demo):
    everything = reports.base(demo).count()
    for f in (filters.ReportFilter("", "", "", ""), filters.ReportFilter(edificio="todos", tipo_sala="todas")):
        assert reports.base(demo, f).count() == everything
    assert reports.base(demo, filters.ReportFilter(desde="2025-11-20", hasta="2025-11-20")).count() == everything
    assert reports.base(demo, filters.ReportFilter(hasta="2025-11-19")).count() == 0


def test_null_flags_count_as_neither(spark, demo):
    rows = table(spark, "reserva_participante", [("29875645", 3, d(1), None, None)])
    t = demo.replace(reserva_participante=demo.reserva_participante.unionByName(rows))
    assert {r.id_reserva: r.confirmados for r in listings.confirmed_counts(t).collect()}[3] == 2
    assert "29875645" not in {r.ci for r in reports.top_participants(t).collect()}
    assert {r.id_reserva: r.ocupacion for r in listings.active_reservations(t).collect()}[3] == 3


def test_latest_of_several_sanctions(spark, demo):
    rows = [(5, "48562347", d(1), d(20), True), (6, "48562347", d(20), d(25), True), (7, "43782512", d(21), d(25), True),
            (8, "40672157", d(1), d(30), False)]
    t = demo.replace(sancion_participante=table(spark, "sancion_participante", rows))
    assert [(r.ci, r.fin) for r in filters.sanctioned(t, NINE).collect()] == [("48562347", d(25))]
    kinds = {r.id_sancion: r.estado for r in listings.current_sanctions(t, NINE).collect()}
    assert kinds == {5: "Activa", 6: "Activa", 7: "Pendiente"}


def test_sheet_is_editable_through_the_tenth_minute(demo):
    def first(at):
        return {r.id_reserva: r.editable for r in listings.attendance_editable(demo, at).collect()}[1]

    assert first(dt.datetime(2025, 11, 20, 9, 10)) is True
    assert first(dt.datetime(2025, 11, 20, 9, 10, 1)) is False


# --- admission -------------------------------------------------------------------------------


def booking(spark, *rows):
    full = [(i, NINE, ci, room, building, day, slot) for i, (ci, room, building, day, slot) in enumerate(rows)]
    return spark.createDataFrame(full, REQUESTS["booking"])


def test_slot_that_starts_right_now(spark, demo):
    reqs = booking(spark, ("48562347", "Sala A1", "Edificio Sacré Cœur", DAY, 2))
    own = admission.admit_bookings_self(demo, reqs, NINE).collect()[0]
    assert own.reason == "daily_limit"  # it may still be booked; two bookings that day stand against it
    assert admission.admit_bookings_admin(demo, reqs, NINE).collect()[0].reason == "turno_started"
    late = dt.datetime(2025, 11, 20, 9, 0, 1)
    assert admission.admit_bookings_self(demo, reqs, late).collect()[0].reason == "turno_started"


def test_staff_may_not_book_postgraduate_rooms_but_may_join_them(spark, demo):
    reqs = booking(spark, ("29875645", "Sala B2", "Edificio Semprún", d(21), 1))
    assert admission.admit_bookings_self(demo, reqs, NINE).collect()[0].reason == "room_for_posgrado"
    joins = spark.createDataFrame([(1, NINE, "29875645", 3), (2, NINE, "43782512", 3), (3, NINE, "10000014", 3)],
                                  REQUESTS["join"])
    got = {r.request_id: r.reason for r in admission.admit_joins(demo, joins, NINE).collect()}
    assert got == {1: None, 2: "room_for_posgrado", 3: None}  # the administrator has no programme and no limits


def test_missing_slot_is_found_last_unless_it_is_today(spark, demo):
    reqs = booking(
        spark,
        ("29875645", "Sala A1", "Edificio Sacré Cœur", DAY, 99),
        ("29875645", "Sala A1", "Edificio Sacré Cœur", d(22), 99),
        ("29875645", "Sala B1", "Edificio Semprún", d(22), 99),
        ("10000014", "Sala A1", "Edificio Sacré Cœur", d(22), 1),
        ("29875645", "Nada", "Edificio Semprún", d(22), 1),
    )
    got = {r.request_id: r.reason for r in admission.admit_bookings_self(demo, reqs, NINE).collect()}
    assert got == {0: "unknown_turno", 1: "unknown_turno", 2: "room_for_posgrado", 3: "no_type", 4: "unknown_room"}


def test_weeks_of_the_two_booking_paths(spark, demo):
    # three active bookings in the week of the demo; the person asks for a day of the next week
    extra = table(spark, "reserva", [(9, "Sala C2", "Edificio San José", d(19), 5, "Activa")])
    people = table(spark, "reserva_participante", [("48562347", 9, d(1), False, False)])
    t = demo.replace(
        reserva=demo.reserva.unionByName(extra), reserva_participante=demo.reserva_participante.unionByName(people)
    )
    reqs = booking(spark, ("48562347", "Sala A1", "Edificio Sacré Cœur", d(25), 1),
                   ("48562347", "Sala A1", "Edificio Sacré Cœur", d(22), 1))
    own = {r.request_id: r.reason for r in admission.admit_bookings_self(t, reqs, NINE).collect()}
    assert own == {0: "weekly_limit", 1: "weekly_limit"}  # the week of today, whatever day is asked
    admin = {r.request_id: r.reason for r in admission.admit_bookings_admin(t, reqs, NINE).collect()}
    assert admin == {0: None, 1: "weekly_limit"}  # the week of the day asked


# --- changes ---------------------------------------------------------------------------------


def test_editing_reservations(spark, demo):
    edits = [
        (1, d(21), 1, "ACTIVA"),
        (2, d(21), 2, "cancelada"),
        (3, d(19), 1, "Activa"),
        (4, DAY, 2, "Activa"),
        (5, DAY, 4, "Sin asistencia"),
        (77, d(21), 1, "Activa"),
    ]
    batch = spark.createDataFrame(edits, REQUESTS["edit"])
    out = changes.modify_reservations(demo, batch, NINE)
    got = {r.id_reserva: r.reason for r in out.verdicts.collect()}
    assert got == {1: None, 2: None, 3: "past_date", 4: "turno_started", 5: None, 77: "unknown_reservation"}
    assert states(out.model) == {1: "Activa", 2: "Cancelada", 3: "Activa", 4: "Activa", 5: "Sin Asistencia"}
    assert out.model.reserva_participante.filter("id_reserva = 2").count() == 0
    notes = [r.mensaje for r in out.model.notificacion.collect()]
    assert sum("modificada" in n for n in notes) == 8 and sum("sancionado" in n for n in notes) == 3
    same = spark.createDataFrame([(4, DAY, 2, "Activa"), (5, DAY, 2, "Activa")], REQUESTS["edit"])
    early = dt.datetime(2025, 11, 20, 8, 0)
    kept = {r.id_reserva: r.reason for r in changes.edit_verdicts(demo, same, early).collect()}
    assert kept == {4: "slot_taken", 5: None}  # a reservation does not block itself


def test_attendance_sheets(spark, demo):
    marks = spark.createDataFrame(
        [("40672157", 2, True), ("43782512", 4, True), ("x", 88, True)], REQUESTS["attendance"]
    )
    out = changes.record_attendance(demo, marks, dt.datetime(2025, 11, 20, 9, 11))
    assert {r.id_reserva: r.reason for r in out.verdicts.collect()} == {2: None, 4: "not_editable", 88: "unknown_reservation"}
    seen = {(r.ci_participante, r.id_reserva): r.asistencia for r in out.model.reserva_participante.collect()}
    assert seen["40672157", 2] is True and seen["53910675", 2] is False and seen["43782512", 4] is False


def test_removing_the_last_row_cancels(spark, demo):
    pairs = spark.createDataFrame([("48562347", 3), ("51238903", 3), ("40672157", 2), ("x", 99)], REQUESTS["cancel"])
    out = changes.remove_participants(demo, pairs)
    assert states(out.model)[3] == "Cancelada" and states(out.model)[2] == "Activa"
    assert {r.reason for r in out.verdicts.collect()} == {None, "unknown_reservation"}


def test_deleting_people(spark, demo):
    notes = table(spark, "notificacion", [(1, "43782512", "hola", NINE, False)])
    cis = spark.createDataFrame([(c,) for c in ("48562347", "51238903", "43782512", "10000014", "0")], "ci string")
    out = changes.delete_participants(demo.replace(notificacion=notes), cis)
    assert {r.ci: r.reason for r in out.verdicts.collect()} == {
        "48562347": None, "51238903": None, "43782512": "has_notifications", "10000014": "protected",
        "0": "unknown_participant",
    }
    assert states(out.model)[3] == "Cancelada" and states(out.model)[1] == "Activa"
    assert out.model.sancion_participante.count() == 0 and out.model.participantes.count() == 5


def test_rooms(spark, demo):
    rows = [
        (1, "sala  nueva", "Edificio Mullin", "10", "libre"),
        (2, "SALA NUEVA", "Edificio Mullin", "12", "Libre"),
        (3, "sala a1", "Edificio Sacré Cœur", "10", "Libre"),
        (4, "Sala-X", "Edificio Mullin", "10", "Libre"),
        (5, "Sala X", "Edificio Mullin", "61", "Libre"),
        (6, "Sala X", "Edificio Mullin", "diez", "Libre"),
        (7, "", "Edificio Mullin", "10", "Libre"),
        (8, "Sala X", "Otro", "10", "Libre"),
    ]
    out = changes.intake_rooms(demo, spark.createDataFrame(rows, REQUESTS["room"]))
    assert {r.request_id: r.reason for r in out.verdicts.collect()} == {
        1: None, 2: "duplicate", 3: "duplicate", 4: "bad_name", 5: "bad_capacity", 6: "bad_capacity", 7: "bad_length",
        8: "unknown_building",
    }
    assert out.model.sala.filter("nombre_sala = 'Sala Nueva' AND tipo_sala = 'Libre'").count() == 1
    gone = changes.delete_rooms(out.model, out.model.sala)
    assert {r.nombre_sala for r in gone.model.sala.collect()} == {"Sala A1", "Sala A2", "Sala B1", "Sala C1"}


# --- sanctions -------------------------------------------------------------------------------


def one_by_one(rows, reqs, today):
    """Sanctions after handling each request on its own, and who was notified."""
    live, told = [(ci, a, b) for _, ci, a, b, on in rows if on], set()
    one = dt.timedelta(1)
    for _, ci, end in reqs:
        hit = [s for s in live if s[0] == ci and (
            (s[1] <= end and s[2] >= today) or s[2] == today - one or s[1] == end + one)]
        if not hit:
            told.add(ci)
        live = [s for s in live if s not in hit]
        live.append((ci, min([today] + [s[1] for s in hit]), max([end] + [s[2] for s in hit])))
    return sorted(live), told


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_new_sanctions_against_one_by_one(spark, demo, seed):
    rnd = random.Random(seed)
    people = [p.ci for p in demo.participantes.collect()][:6]
    rows, reqs = [], []
    for k in range(30):
        start = DAY + dt.timedelta(rnd.randint(-25, 25))
        rows.append((k + 10, rnd.choice(people[:5]), start, start + dt.timedelta(rnd.randint(0, 5)), rnd.random() < 0.7))
    for k in range(8):
        reqs.append((k, rnd.choice(people), DAY + dt.timedelta(rnd.randint(0, 12))))
    t = demo.replace(sancion_participante=table(spark, "sancion_participante", rows))
    out = sanctions.add_sanctions(t, spark.createDataFrame(reqs, REQUESTS["sanction"]), NINE)
    live, told = one_by_one(rows, reqs, DAY)
    got = out.model.sancion_participante.filter("activa").collect()
    # rows that were equal before count once in the loop too
    assert sorted((r.ci_participante, r.fecha_inicio, r.fecha_fin) for r in got) == live
    assert {r.ci_participante for r in out.model.notificacion.collect()} == told
    ids = [r.id_sancion for r in out.model.sancion_participante.collect()]
    assert len(ids) == len(set(ids))


def test_bad_sanction_requests(spark, demo):
    reqs = [(1, "48562347", None), (2, "48562347", d(19)), (3, "12A", d(21)), (4, "99999999", d(21)), (5, "10000014", d(21)),
            (6, " 48562347 ", DAY)]
    got = sanctions.sanction_verdicts(demo, spark.createDataFrame(reqs, REQUESTS["sanction"]), NINE)
    assert {r.request_id: r.reason for r in got.collect()} == {
        1: "bad_date", 2: "ends_in_past", 3: "bad_ci", 4: "unknown_participant", 5: "no_programme", 6: None,
    }


def test_old_no_show_is_sanctioned_again_unless_since(spark, demo):
    missed = demo.replace(reserva=demo.reserva.withColumn("estado", F.lit("Sin Asistencia")))
    covered = table(spark, "sancion_participante", [(1, "48562347", d(1), d(30), False), (2, "51238903", d(1), d(2), True)])
    t = missed.replace(sancion_participante=covered)
    again = sweeps.sanction_no_shows(t, NINE).sancion_participante.filter("id_sancion > 2")
    assert {r.ci_participante for r in again.collect()} == {"51238903", "43782512", "40672157", "53910675"}
    assert sweeps.sanction_no_shows(t, NINE, since=d(21)).sancion_participante.count() == 2


def test_attendance_taken_back_empties_the_room_day(spark, demo):
    rp = demo.reserva_participante.withColumn("asistencia", F.lit(False))
    t = demo.replace(reserva_participante=rp)
    change = spark.createDataFrame([("43782512", 5, True, False), ("48562347", 1, False, False)],
                                   "ci string, id_reserva long, asistencia_old boolean, asistencia_new boolean")

    def swept(at):
        return states(propagation.no_show_from_attendance_change(t, change, at))

    base = dict.fromkeys(range(1, 6), "Activa")
    assert swept(dt.datetime(2025, 11, 20, 10, 9, 59)) == base
    assert swept(dt.datetime(2025, 11, 20, 10, 10)) == {**base, 4: "Sin Asistencia", 5: "Sin Asistencia"}


# --- sources ---------------------------------------------------------------------------------


def test_malformed_requests_keep_their_text(spark, tmp_path):
    good = '{"ci": "1", "id_reserva": 2}'
    (tmp_path / "a.json").write_text(f'{good}\n{{"ci": "1", "id_reserva": "x"}}\nnot json\n')
    batch = read_requests(spark, "cancel", str(tmp_path / "a.json"), "json")
    ok, bad = split_corrupt(batch)
    assert [tuple(r) for r in ok.collect()] == [("1", 2)] and bad.count() == 2
    (tmp_path / "a.csv").write_text("ci,id_reserva\n1,2\n3,x\n")
    ok, bad = split_corrupt(read_requests(spark, "cancel", str(tmp_path / "a.csv"), "csv"))
    assert [tuple(r) for r in ok.collect()] == [("1", 2)]
    assert [tuple(r) for r in bad.collect()] == [("3,x", "bad_id_reserva")]


def test_csv_by_name_with_line_breaks_and_strict_dates(spark, tmp_path):
    head = "id_turno_nuevo,extra,estado_nuevo,fecha_nueva,id_reserva\n"
    rows = '3,x,"Acti\nva, ""si""",2025-02-03,7\n3,x,Activa,03/02/2025,8\n3,x,Activa,2025-02-30,9\n,,,,10\n3,x,Activa,2025-2-3,11\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(head + rows)
    # a record like the header is a record
    (tmp_path / "in" / "b.csv").write_text(head + "4.5,x,Activa,2025-02-03,12\n" + head + "5,short\n")
    ok, bad = split_corrupt(read_requests(spark, "edit", str(tmp_path / "in"), "csv"))
    assert sorted(map(tuple, ok.collect())) == [(7, d(3, 2), 3, 'Acti\nva, "si"'), (10, None, None, None)]
    assert sorted(r[1] for r in bad.collect()) == ["bad_fecha_nueva"] * 3 + ["bad_id_reserva", "bad_id_turno_nuevo", "malformed"]
    (tmp_path / "c.csv").write_text("id_reserva,estado_nuevo\n1,Activa\n")
    with pytest.raises(ValueError, match="fecha_nueva"):
        read_requests(spark, "edit", str(tmp_path / "c.csv"), "csv")


def test_reports_written_in_one_run_equal_the_reports(spark, demo, tmp_path):
    f = filters.ReportFilter(edificio="Edificio San José")
    write_reports(demo, f, str(tmp_path / "r"))
    for name, report in reports.REPORTS.items():
        written = sorted(tuple(map(str, r)) for r in spark.read.parquet(str(tmp_path / "r" / name)).collect())
        assert written == sorted(tuple(map(str, r)) for r in report(demo, f).collect()), name


def test_model_constraints_find_planted_violations(spark, demo):
    t = demo.replace(
        reserva=demo.reserva.unionByName(
            table(spark, "reserva", [(5, "Sala A1", "Edificio Sacré Cœur", DAY, 1, "activa"), (8, "No", "No", DAY, 99, "Activa")])
        ),
        sala=demo.sala.withColumn("capacidad", F.when(F.col("nombre_sala") == "Sala C1", 2).otherwise(F.col("capacidad")).cast("short")),
    )
    names = ["unique:reserva(id_reserva)", "reference:reserva(nombre_sala,edificio)", "reference:reserva(id_turno)",
             "domain:reserva(estado)", "rule:seats", "rule:people", "unique:sala(nombre_sala,edificio)"]
    found = {n: df.count() for n, df in quality.model_checks(t).items() if n in names}
    assert found == {
        "unique:reserva(id_reserva)": 1, "reference:reserva(nombre_sala,edificio)": 1, "reference:reserva(id_turno)": 1,
        "domain:reserva(estado)": 1, "rule:seats": 2, "rule:people": 5, "unique:sala(nombre_sala,edificio)": 0,
    }


# --- repeated keys in one batch --------------------------------------------------------------


def test_a_pair_that_withdraws_twice_stays_one_row(spark, demo):
    pairs = spark.createDataFrame([("48562347", 3), ("48562347", 3)], "ci string, id_reserva long")
    out = changes.cancel_participation(demo, pairs, NINE)
    assert out.model.reserva_participante.count() == demo.reserva_participante.count()
    assert [r.verdict for r in out.verdicts.collect()] == ["accepted"] * 2


def test_repeated_and_competing_edits_of_reservations(spark, demo):
    edits = [(1, d(21), 1, "Activa"), (1, d(22), 1, "Activa"), (4, d(24), 5, "Activa"), (5, d(24), 5, "Activa")]
    out = changes.modify_reservations(demo, spark.createDataFrame(edits, REQUESTS["edit"]), NINE)
    rows = {r.id_reserva: r for r in out.model.reserva.collect()}
    assert out.model.reserva.count() == demo.reserva.count() == len(rows)
    assert rows[1].fecha == d(22)
    same_room = (rows[4].nombre_sala, rows[4].edificio) == (rows[5].nombre_sala, rows[5].edificio)
    held = {r.id_reserva: r.reason for r in out.verdicts.filter("id_reserva > 1").collect()}
    assert held == {4: None, 5: "slot_taken" if same_room else None}


def test_repeated_edits_of_a_room_keep_one_row(spark, demo):
    room = demo.sala.first()
    edits = [(1, room.nombre_sala, room.edificio, "7", "Libre"), (2, room.nombre_sala, room.edificio, "9", "docente")]
    out = changes.edit_rooms(demo, spark.createDataFrame(edits, REQUESTS["room"]))
    hit = out.model.sala.filter((F.col("nombre_sala") == room.nombre_sala) & (F.col("edificio") == room.edificio))
    assert [(r.capacidad, r.tipo_sala) for r in hit.collect()] == [(9, "Docente")]
    assert out.model.sala.count() == demo.sala.count()


def test_case_does_not_matter_in_filters_and_domains(spark, demo):
    base = reports.base(demo, reports.NO_FILTER)
    for a, b in (("libre", "Libre"), ("POSGRADO", "Posgrado")):
        one, two = (filters.report_filter(base, filters.ReportFilter(tipo_sala=x)).count() for x in (a, b))
        assert one == two
    batch = spark.createDataFrame([(1, "cancelada"), (2, "Sin asistencia"), (3, "Otra"), (4, None)], "i int, e string")
    bad = quality.check_domain(batch, "e", ("Activa", "Cancelada", "Sin Asistencia"))
    assert [r.i for r in bad.collect()] == [3]
