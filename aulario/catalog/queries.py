"""Registered queries: name -> function of (session, test directory)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aulario.catalog.batches import Batches
from aulario.operators import admission, changes, filters, intake, islands, listings, propagation, quality, reports
from aulario.operators import sanctions, sweeps
from aulario.operators.filters import ReportFilter
from aulario.plans.intervals import merge_intervals
from aulario.plans.staging import scratch_path
from aulario.session import AS_OF, tune
from aulario.sources import fixed
from aulario.sources.model import Model
from aulario.sources.tables import load_tables, read_requests, row_counts, split_corrupt, write_reports, write_snapshot
from aulario.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

FILTER = ReportFilter(desde="2025-01-08", hasta="2025-02-20", edificio="todos", tipo_sala="Posgrado")
ALL_CONDITIONS = ReportFilter("2025-01-08", "2025-02-20", "Edificio NATION_20", "Posgrado")
GRID = (dt.date(2025, 2, 1), dt.date(2025, 2, 7))
STATE = ["id_reserva", "estado"]


def query(name: str):
    def add(body: Callable[[Batches], DataFrame]) -> Callable[[Batches], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return body(Batches(tune(spark), sf_dir))

        run.__name__, run.__doc__ = name, body.__doc__
        QUERIES[name] = run
        return body

    return add


def on_model(name: str, body: Callable[[Model], DataFrame]) -> None:
    query(name)(lambda b: body(b.model))


# --- sources and sinks -----------------------------------------------------------------------


@query("src1_snk1_snapshot_counts")
def _(b: Batches) -> DataFrame:
    """Write every table as a snapshot, load it back with the declared schema, count."""
    path = scratch_path(b.spark, "snapshot")
    write_snapshot(b.model, path)
    stored = load_tables(b.spark, path)
    return row_counts({n: getattr(stored, n) for n in stored.names()})


@query("src2_projection_participation")
def _(b: Batches) -> DataFrame:
    return b.model.reserva_participante


@query("src4_requests_json")
def _(b: Batches) -> DataFrame:
    """Booking requests through JSON files and the permissive reader."""
    path = scratch_path(b.spark, "requests")
    b.booking().write.json(path)
    good, _bad = split_corrupt(read_requests(b.spark, "booking", path, "json"))
    return good


@query("src4_requests_csv")
def _(b: Batches) -> DataFrame:
    """Booking requests through CSV files with line breaks and quotes in a field and the columns in another order."""
    path = scratch_path(b.spark, "requests")
    asked = b.booking().withColumn("nombre_sala", F.concat("nombre_sala", F.lit('\n"sala", 1')))
    asked.select("id_turno", "nombre_sala", "fecha", "edificio", "ci", "request_ts", "request_id").write.csv(path, header=True, escape='"')
    good, _bad = split_corrupt(read_requests(b.spark, "booking", path, "csv"))
    return good


@query("src4_requests_parquet")
def _(b: Batches) -> DataFrame:
    """Booking requests through parquet files."""
    path = scratch_path(b.spark, "requests")
    b.booking().write.parquet(path)
    return read_requests(b.spark, "booking", path)


@query("src4_rejected_requests")
def _(b: Batches) -> DataFrame:
    """Reasons why booking requests with odd dates and slots do not fit."""
    path = scratch_path(b.spark, "requests")
    key = F.col("request_id") % 7
    odd = F.when(key == 0, F.date_format("fecha", "dd/MM/yyyy")).when(key == 1, "2025-02-30").when(key == 2, "2025-2-3")
    slot = F.when(F.col("request_id") % 11 == 0, "1.5").otherwise(F.col("id_turno").cast("string"))
    asked = b.booking().withColumns({"fecha": F.coalesce(odd, F.col("fecha").cast("string")), "id_turno": slot})
    asked.write.csv(path, header=True)
    _good, bad = split_corrupt(read_requests(b.spark, "booking", path, "csv", multi_line=False))
    return bad.groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))


@query("snk2_report_rows")
def _(b: Batches) -> DataFrame:
    """Write all filtered reports in one run and count the rows of each."""
    path = scratch_path(b.spark, "reports")
    write_reports(b.model, FILTER, path)
    return row_counts({n: b.spark.read.parquet(f"{path}/{n}") for n in reports.REPORTS})


# --- filters ---------------------------------------------------------------------------------

_BASE = ["id_reserva", "nombre_sala", "edificio", "fecha", "id_turno", "estado", "tipo_sala"]
on_model("flt1_report_filter", lambda t: reports.base(t, FILTER).select(*_BASE))
on_model("flt1_report_filter_all_conditions", lambda t: reports.base(t, ALL_CONDITIONS).select(*_BASE))
on_model("flt2_sanctioned", lambda t: filters.sanctioned(t, AS_OF))
on_model("flt3_occupied_slots", filters.occupied_slots)
on_model("flt4_open_slots", lambda t: filters.open_slots(t, *GRID))
on_model("flt5_buildings", filters.buildings)
on_model("flt5_rooms", filters.rooms)
on_model("flt5_slots", filters.slots)
on_model("flt5_faculties", filters.faculties)


@query("flt6_people_and_rooms")
def _(b: Batches) -> DataFrame:
    flagged = filters.flag_room(b.model, filters.flag_people(b.model, b.booking()))
    return flagged.select("request_id", "existe", "en_programa", "sala_existe")


@query("flt6_identity_taken")
def _(b: Batches) -> DataFrame:
    # half of the numbers asked for belong to somebody already
    return filters.flag_taken_identity(b.model, b.participant_edit()).select("request_id", "ci_tomada", "email_tomado")


@query("flt6_in_reservation")
def _(b: Batches) -> DataFrame:
    return filters.flag_in_reservation(b.model, b.join()).select("request_id", "ya_esta")


on_model("flt7_confirmed", lambda t: filters.confirmed_only(t.reserva_participante).select("ci_participante", "id_reserva"))
on_model("flt7_attended", lambda t: filters.attended_only(t.reserva_participante).select("ci_participante", "id_reserva"))
on_model("flt7_active_reservations", lambda t: filters.active_only(t.reserva).select(*STATE))
on_model("flt7_active_sanctions", lambda t: filters.active_only(t.sancion_participante))

# --- listings --------------------------------------------------------------------------------

on_model("vw01_profile_long", lambda t: listings.participant_profile(t, "long"))
on_model("vw01_profile_short", lambda t: listings.participant_profile(t, "short"))
on_model("vw01_profile_bare", lambda t: listings.participant_profile(t, "bare"))
on_model("vw02_directory", lambda t: listings.participant_directory(t))
on_model(
    "vw03_programmes_by_faculty",
    lambda t: listings.programmes_by_faculty(t).withColumn("programas", F.array_join("programas", "|")),
)
on_model(
    "vw04_rooms_by_building",
    lambda t: listings.rooms_by_building(t).withColumn("salas", F.array_join("salas", "|")),
)
on_model(
    "vw03_programmes_by_faculty_short_pages",
    lambda t: listings.programmes_by_faculty(t, 3).withColumn("programas", F.array_join("programas", "|")),
)
on_model(
    "vw04_rooms_by_building_short_pages",
    lambda t: listings.rooms_by_building(t, 3).withColumn("salas", F.array_join("salas", "|")),
)
on_model("vw04_rooms_json", listings.rooms_json)
on_model("vw05_room_list", listings.room_list)
on_model(
    "vw06_my_reservations",
    lambda t: listings.my_reservations(t).withColumn("otros", F.array_join("otros", "|")),
)
on_model(
    "vw06_others_in_reservation",
    lambda t: listings.others_in_reservation(t).withColumn("otros", F.array_join("otros", "|")),
)
on_model(
    "vw06_others_in_reservation_short_pages",
    lambda t: listings.others_in_reservation(t, 3).withColumn("otros", F.array_join("otros", "|")),
)
on_model(
    "vw06_rosters",
    lambda t: listings.roster_pages(t)
    .withColumn("cis", F.array_join("personas.ci", "|"))
    .withColumn("personas", F.array_join("personas.nombre_completo", "|")),
)
on_model("vw07_active_reservations", listings.active_reservations)
on_model("vw08_reservation_detail", listings.reservation_detail)
on_model("vw09_roster_all", lambda t: listings.roster(t, "all"))
on_model("vw09_roster_confirmed", lambda t: listings.roster(t, "confirmed"))
on_model("vw09_roster_attendance", lambda t: listings.roster(t, "attendance"))
on_model("vw10_sanction_history", lambda t: listings.sanction_history(t, AS_OF))
on_model("vw11_current_sanctions", lambda t: listings.current_sanctions(t, AS_OF))
on_model("vw12_notification_feed", listings.notification_feed)
on_model("vw13_seats", listings.seats)
on_model("vw14_attendance_editable", lambda t: listings.attendance_editable(t, AS_OF))

# --- reports ---------------------------------------------------------------------------------


def _report(number: int, name: str) -> None:
    report = reports.REPORTS[name]
    on_model(f"rp{number:02d}_{name}", lambda t: report(t, reports.NO_FILTER))
    if name != "sanctions_by_role":
        on_model(f"rp{number:02d}_{name}_filtered", lambda t: report(t, FILTER))


for _number, _name in enumerate(reports.REPORTS, start=1):
    _report(_number, _name)

# --- islands and intervals -------------------------------------------------------------------

on_model("wn1_wn2_island_flags", lambda t: islands.island_flags(islands.active_with_slot(t)))
on_model("wn3_island_summary", lambda t: islands.island_summary(islands.with_attended(t, islands.active_with_slot(t))))
on_model(
    "wn4_merge_intervals",
    lambda t: merge_intervals(t.sancion_participante, "ci_participante", "fecha_inicio", "fecha_fin"),
)

# --- admission -------------------------------------------------------------------------------

_ADMISSIONS = {
    "ad1_bookings_self": (admission.admit_bookings_self, "booking"),
    "ad2_bookings_admin": (admission.admit_bookings_admin, "booking"),
    "ad3_joins": (admission.admit_joins, "join"),
    "ad4_adds_admin": (admission.admit_adds_admin, "join"),
}


def _admission(name: str, admit, batch: str) -> None:
    keep = ["request_id", "ci", "verdict", "reason"] + (["action"] if name == "ad3_joins" else [])
    for mode in ("snapshot", "sequential"):
        query(f"{name}_{mode}")(
            lambda b, mode=mode: admit(b.model, getattr(b, batch)(), AS_OF, mode).select(*keep)
        )


for _name, (_admit, _batch) in _ADMISSIONS.items():
    _admission(_name, _admit, _batch)

on_model("ad5_quota_day", lambda t: admission.quota_usage(t, "day"))
on_model("ad5_quota_day_confirmed", lambda t: admission.quota_usage(t, "day", True))
on_model("ad5_quota_week_monday", lambda t: admission.quota_usage(t, "week", True, "monday"))
on_model("ad5_quota_week_sunday", lambda t: admission.quota_usage(t, "week", False, "sunday"))

# --- change application ----------------------------------------------------------------------


def _booked(b: Batches, by: str = "admin") -> Model:
    return intake.book(b.model, b.booking(), AS_OF, by).model


def _joined(b: Batches, by: str = "self") -> Model:
    return intake.join(b.model, b.join(), AS_OF, by).model


query("ch01_apply_bookings_reserva")(lambda b: _booked(b).reserva)
query("ch01_apply_bookings_participation")(lambda b: _booked(b).reserva_participante)
query("ch01_apply_own_bookings_reserva")(lambda b: _booked(b, "self").reserva)
query("ch01_apply_joins")(lambda b: _joined(b).reserva_participante)
query("ch01_apply_adds")(lambda b: _joined(b, "admin").reserva_participante)


@query("ch01_slots_held_twice")
def _(b: Batches) -> DataFrame:
    """Slots with several active reservations after the bookings: those that had them before."""
    reserva = _booked(b).reserva
    return quality.check_slots(filters.active_only(reserva))


def _outcome(name: str, run: Callable[[Batches], changes.Outcome], **tables: Callable[[Model], DataFrame]) -> None:
    """One query for the verdicts of a batch and one per table it changes."""
    query(f"{name}_verdicts")(lambda b: run(b).verdicts)
    for table, pick in tables.items():
        query(f"{name}_{table}")(lambda b, pick=pick: pick(run(b).model))


def _reserva(t: Model) -> DataFrame:
    return t.reserva.select(*STATE)


def _participation(t: Model) -> DataFrame:
    return t.reserva_participante


def _sanctions(t: Model) -> DataFrame:
    return t.sancion_participante


def _notices(t: Model) -> DataFrame:
    return t.notificacion


_outcome(
    "ch02_cancel",
    lambda b: changes.cancel_participation(b.model, b.cancel(), AS_OF),
    reserva=_reserva,
    participation=_participation,
    notifications=_notices,
)
_outcome(
    "ch03_remove",
    lambda b: changes.remove_participants(b.model, b.cancel()),
    reserva=_reserva,
    participation=_participation,
)
_outcome(
    "ch04_modify",
    lambda b: changes.modify_reservations(b.model, b.edit(), AS_OF),
    reserva=lambda t: t.reserva,
    participation=_participation,
    sanctions=_sanctions,
)
_outcome(
    "ch04_modify_sequential",
    lambda b: changes.modify_reservations(b.model, b.edit(), AS_OF, "sequential"),
    reserva=lambda t: t.reserva,
)


@query("ch04_slots_held_twice")
def _(b: Batches) -> DataFrame:
    """Slots with several active reservations after the edits in order."""
    after = changes.modify_reservations(b.model, b.edit(), AS_OF, "sequential").model
    return quality.check_slots(filters.active_only(after.reserva))


_outcome(
    "ch05_attendance",
    lambda b: changes.record_attendance(b.model, b.attendance(), AS_OF),
    participation=_participation,
)
_outcome(
    "ch06_delete_people",
    lambda b: changes.delete_participants(b.model, b.leavers()),
    reserva=_reserva,
    participation=_participation,
    people=lambda t: t.participantes,
    memberships=lambda t: t.participantes_programa_academico,
    sanctions=_sanctions,
)
_outcome(
    "ch07_edit_people",
    lambda b: changes.edit_participants(b.model, b.participant_edit()),
    people=lambda t: t.participantes,
    memberships=lambda t: t.participantes_programa_academico,
)
query("ch08_mark_read")(lambda b: changes.mark_notifications_read(b.model, b.readers()).notificacion)
_outcome(
    "ch09_intake_people",
    lambda b: changes.intake_participants(b.model, b.participant()),
    people=lambda t: t.participantes,
    memberships=lambda t: t.participantes_programa_academico,
)
_outcome("ch10_intake_rooms", lambda b: changes.intake_rooms(b.model, b.room()), rooms=lambda t: t.sala)
_outcome("ch11_edit_rooms", lambda b: changes.edit_rooms(b.model, b.room_edit()), rooms=lambda t: t.sala)


def _after_intake(b: Batches) -> changes.Outcome:
    grown = changes.intake_rooms(b.model, b.room()).model
    return changes.delete_rooms(grown, grown.sala)


_outcome("ch11_delete_rooms", _after_intake, rooms=lambda t: t.sala)
query("ch12_notifications")(lambda b: changes.modify_reservations(b.model, b.edit(), AS_OF).model.notificacion)

# --- sanctions -------------------------------------------------------------------------------

on_model("sn1_expire", lambda t: sanctions.expire_sanctions(t, AS_OF).sancion_participante)
_outcome(
    "sn2_add",
    lambda b: sanctions.add_sanctions(b.model, b.sanction(), AS_OF),
    sanctions=_sanctions,
    notifications=_notices,
)
on_model("sn3_coalesce", lambda t: sanctions.coalesce_sanctions(t).sancion_participante)
_outcome("sn4_edit", lambda b: sanctions.edit_sanctions(b.model, b.sanction_edit()), sanctions=_sanctions)

# --- sweeps ----------------------------------------------------------------------------------

on_model("sw1_finalize_attended", lambda t: _reserva(sweeps.finalize_attended(t, AS_OF)))
on_model("sw2_sweep_blocks", lambda t: _reserva(sweeps.sweep_blocks(sweeps.finalize_attended(t, AS_OF), AS_OF)))
on_model("sw3_sweep_reservations", lambda t: _reserva(sweeps.sweep_reservations(t, AS_OF)))
on_model("sw4_sanction_no_shows", lambda t: sweeps.sanction_no_shows(t, AS_OF).sancion_participante)
on_model("sw5_run_sweep_reserva", lambda t: _reserva(sweeps.run_sweep(t, AS_OF)))
on_model("sw5_run_sweep_sanctions", lambda t: sweeps.run_sweep(t, AS_OF).sancion_participante)

# --- propagation and streams -----------------------------------------------------------------


def _pr1(b: Batches) -> Model:
    return propagation.sanctions_from_transitions(b.model, b.state_changes(), AS_OF)


query("pr1_sanctions")(lambda b: _pr1(b).sancion_participante)
query("pr1_notifications")(lambda b: _pr1(b).notificacion)


@query("pr2_cancellations")
def _(b: Batches) -> DataFrame:
    return _reserva(propagation.cancellations_from_unconfirms(b.model, b.withdrawals()))


@query("pr3_no_shows")
def _(b: Batches) -> DataFrame:
    """Attendance marks applied first, then the no-shows they uncover."""
    t, key = b.model, ["ci_participante", "id_reserva"]
    new = b.attendance_changes().select(F.col("ci").alias("ci_participante"), "id_reserva", "asistencia_new")
    rp = t.reserva_participante.join(new, key, "left")
    marked = rp.withColumn("asistencia", F.coalesce("asistencia_new", "asistencia"))
    after = t.replace(reserva_participante=marked.select(*t.reserva_participante.columns))
    return _reserva(propagation.no_show_from_attendance_change(after, b.attendance_changes(), AS_OF))


def _feed(b: Batches, kind: str, rows: DataFrame) -> tuple[DataFrame, str, str]:
    """Put change rows into several files and open them as a stream of several micro-batches."""
    root = scratch_path(b.spark, "feed")
    rows.repartition(4).write.parquet(f"{root}/in")
    return feeds.read_feed(b.spark, kind, f"{root}/in", files_per_batch=2), f"{root}/out", f"{root}/state"


@query("st1_no_show_stream")
def _(b: Batches) -> DataFrame:
    stream, out, state = _feed(b, "reserva", b.state_changes())
    feeds.sanction_no_show_stream(b.model, stream, out, state, AS_OF).awaitTermination()
    return b.spark.read.parquet(f"{out}/sancion_participante").select(
        "ci_participante", "fecha_inicio", "fecha_fin", "activa"
    )


@query("st2_withdrawal_stream")
def _(b: Batches) -> DataFrame:
    stream, out, state = _feed(b, "confirmado", b.withdrawals())
    feeds.cancel_emptied_stream(b.model, stream, out, state).awaitTermination()
    return b.spark.read.parquet(f"{out}/canceladas").select("id_reserva").distinct()


@query("st3_attendance_stream")
def _(b: Batches) -> DataFrame:
    stream, out, state = _feed(b, "asistencia", b.marks())
    feeds.attendance_stream(b.model, stream, out, state).awaitTermination()
    return feeds.read_marks(b.spark, out)


# --- integrity -------------------------------------------------------------------------------


@query("dq1_duplicate_emails")
def _(b: Batches) -> DataFrame:
    return quality.check_unique(b.participant(), ["email"])


@query("dq2_unknown_people")
def _(b: Batches) -> DataFrame:
    return quality.check_reference(b.cancel(), ["ci"], b.model.participantes, ["ci"])


@query("dq3_missing_room")
def _(b: Batches) -> DataFrame:
    return quality.check_not_null(b.booking(), ["nombre_sala"]).select("request_id", "regla")


@query("dq4_capacity_range")
def _(b: Batches) -> DataFrame:
    rooms = b.room().withColumn("capacidad", F.col("capacidad").cast("int"))
    return quality.check_capacity_range(rooms).select("request_id", "capacidad", "regla")


@query("dq5_state_domain")
def _(b: Batches) -> DataFrame:
    return quality.check_domain(b.edit(), "estado_nuevo", fixed.ESTADOS).select("id_reserva", "estado_nuevo", "regla")


query("dq6_contested_slots")(lambda b: quality.check_slots(b.booking()))
on_model("dq7_overfull", lambda t: quality.check_seats(t, confirmed_only=False))
on_model("dq7_overfull_confirmed", lambda t: quality.check_seats(t, confirmed_only=True))


@query("dq8_people")
def _(b: Batches) -> DataFrame:
    return quality.check_people(b.participant())


on_model("dq_all_model_constraints", quality.violation_counts)
