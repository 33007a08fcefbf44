"""Building blocks against brute force, with one key holding much of the rows."""

import datetime as dt
import random
from types import SimpleNamespace

import pytest
from demo_rows import table
from pyspark.sql import functions as F

from aulario.catalog.queries import QUERIES
from aulario.operators import islands, listings
from aulario.plans.intervals import merge_intervals
from aulario.plans.numbering import next_ids, number_rows
from aulario.plans.paging import paged_lists

DAY0 = dt.date(2025, 1, 1)


def test_numbering_of_sparse_ids(spark):
    rnd = random.Random(1)
    ids = sorted({rnd.choice([rnd.randint(0, 50), rnd.randint(0, 2**21), rnd.randint(0, 2**45)]) for _ in range(500)})
    df = spark.createDataFrame([(i,) for i in rnd.sample(ids, len(ids))], "k long")
    got = {r.k: r.n for r in number_rows(df, ["k"], "n").collect()}
    assert got == {k: i + 1 for i, k in enumerate(ids)}


def test_numbering_deals_a_single_key_by_the_rest_of_the_order(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = number_rows(spark.range(20_000).select(F.lit(5).alias("r"), (20_000 - F.col("id")).alias("k")), ["r", "k"], "n")
        parts = numbered.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert numbered.filter("n <> k").isEmpty()
        assert len(parts) > 1 and max(r["count"] for r in parts) < 10_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_numbering_continues_after_existing_ids(spark):
    rnd = random.Random(2)
    rows = sorted({(rnd.choice([7, 7, rnd.randint(0, 2**22)]), f"{rnd.randint(0, 99999999):08d}") for _ in range(400)})
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), "r long, ci string")
    old = spark.createDataFrame([(5,), (41,)], "id long")
    got = {(x.r, x.ci): x.id for x in next_ids(df, ["r", "ci"], "id", old).collect()}
    assert got == {row: 42 + i for i, row in enumerate(rows)}
    first = next_ids(df.limit(1), ["ci"], "id", old.limit(0)).collect()
    assert [x.id for x in first] == [1]


@pytest.mark.parametrize("seed", [3, 4])
def test_merging_intervals(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(600):
        key = "hot" if rnd.random() < 0.5 else f"k{rnd.randint(0, 30)}"
        start = rnd.randint(0, 200)
        rows.append((k, key, DAY0 + dt.timedelta(start), DAY0 + dt.timedelta(start + rnd.randint(0, 4))))
    df = spark.createDataFrame(rows, "id long, k string, a date, b date")
    expected = []
    for key in {r[1] for r in rows}:
        run = None
        for i, _, a, b in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[3])):
            if run and a <= run[2] + dt.timedelta(1):
                run = [key, run[1], max(run[2], b), run[3] + 1, min(run[4], i)]
            else:
                if run:
                    expected.append(tuple(run))
                run = [key, a, b, 1, i]
        expected.append(tuple(run))
    got = merge_intervals(df, "k", "a", "b", id_col="id").select("k", "a", "b", "n", "id")
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_touching_by_a_day_merges_and_by_two_does_not(spark):
    d = lambda n: DAY0 + dt.timedelta(n)
    df = spark.createDataFrame([("x", d(0), d(1)), ("x", d(2), d(3)), ("x", d(5), d(6))], "k string, a date, b date")
    got = [(r.a, r.b) for r in merge_intervals(df, "k", "a", "b").orderBy("a").collect()]
    assert got == [(d(0), d(3)), (d(5), d(6))]


@pytest.mark.parametrize("page_size", [1, 50, 999, 1000, 1001])
def test_pages_one_after_the_other_are_the_sorted_list(spark, page_size):
    rnd = random.Random(8)
    rows = [("big", f"i{k:04d}") for k in range(1000)] + [("small", "z"), ("small", "a"), ("small", "a"), ("none", None)]
    rows += [("some", None), ("some", "b")]
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), "k string, i string").repartition(3)
    got = paged_lists(df, ["k"], "i", "l", page_size=page_size, rows_as="n").collect()
    for key in ("big", "small", "none", "some"):
        mine = sorted((i for k, i in rows if k == key), key=lambda i: (i is None, i or ""))
        cut = [mine[a : a + page_size] for a in range(0, len(mine), page_size)]
        pages = sorted((r.pagina, r.n, r.l) for r in got if r.k == key)
        assert pages == [(p, len(c), [i for i in c if i is not None]) for p, c in enumerate(cut)]


@pytest.mark.parametrize("seed", [5, 6])
def test_islands_with_slots_booked_many_times(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(300):
        room = "hot" if rnd.random() < 0.5 else f"s{rnd.randint(0, 9)}"
        start = rnd.choice([480, 540, 600, 720, 780])
        rows.append((k, DAY0, room, "E", 1, start, start + rnd.choice([60, 60, 120]), rnd.random() < 0.1))
    df = spark.createDataFrame(
        rows, "id_reserva long, fecha date, nombre_sala string, edificio string, id_turno int, inicio_min int, "
        "fin_min int, asistida boolean"
    )
    flags, numbers, summary = {}, {}, {}
    for room in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == room), key=lambda r: (r[5], r[0]))
        for i, r in enumerate(mine):
            flags[r[0]] = 0 if i and mine[i - 1][6] == r[5] else 1
        for r in mine:
            numbers[r[0]] = sum(flags[o[0]] for o in mine if o[5] <= r[5])  # equal starts share the number
        for r in mine:
            end, n, seen = summary.get((room, numbers[r[0]]), (0, 0, 0))
            summary[room, numbers[r[0]]] = (max(end, r[6]), n + 1, seen + r[7])
    got = islands.island_flags(df).collect()
    assert {r.id_reserva: r.comienza_bloque for r in got} == flags
    assert {r.id_reserva: r.bloque_id for r in got} == numbers
    folded = {
        (r.nombre_sala, r.bloque_id): (r.fin_bloque.hour * 60 + r.fin_bloque.minute, r.reservas, r.total_asistencias)
        for r in islands.island_summary(df).collect()
    }
    assert folded == summary
    empty = {(r.nombre_sala, r.inicio_min) for r in islands.empty_island_slots(df).collect()}
    assert empty == {(r[2], r[5]) for r in rows if summary[r[2], numbers[r[0]]][2] == 0}


def test_overfull_reservation_has_its_names_in_pages(spark, demo):
    crowd = [(f"2{k:07d}", f"N{k}", "X", f"{k}@x") for k in range(150)]
    people = demo.participantes.unionByName(table(spark, "participantes", crowd))
    rows = table(spark, "reserva_participante", [(c[0], 1, DAY0, False, True) for c in crowd])
    t = demo.replace(participantes=people, reserva_participante=demo.reserva_participante.unionByName(rows))
    mine = listings.my_reservations(t).cache()
    packed = mine.filter("id_reserva = 1")
    assert packed.count() == 153 and packed.filter("confirmados <> 153").count() == 0
    others = listings.others_in_reservation(t).filter("id_reserva = 1").collect()
    assert len(others) == 153 * 3 and {r.pagina for r in others} == {0, 1, 2}
    one = sorted((r for r in others if r.ci == "20000007"), key=lambda r: r.pagina)
    names = [n for r in one for n in r.otros]
    assert names == sorted(names) and len(names) == 152 and "N7 X" not in names
    listed = {r.ci: list(r.otros) for r in packed.filter("paginas = 3").collect()}
    assert len(listed) == 153 and listed["20000007"] == names and all(len(n) == 152 for n in listed.values())
    ana = listings.others_in_reservation(t).filter("ci = '48562347' AND id_reserva = 3").collect()
    assert [(r.pagina, r.otros) for r in ana] == [(0, ["Luis González"])]


def test_names_of_an_overfull_reservation_are_registered(spark, demo):
    crowd = [(f"2{k:07d}", f"N{k}", "X", f"{k}@x") for k in range(150)]
    people = demo.participantes.unionByName(table(spark, "participantes", crowd))
    rows = table(spark, "reserva_participante", [(c[0], 1, DAY0, False, True) for c in crowd])
    t = demo.replace(participantes=people, reserva_participante=demo.reserva_participante.unionByName(rows))
    with pytest.MonkeyPatch.context() as held:
        held.setattr("aulario.catalog.queries.Batches", lambda *_: SimpleNamespace(model=t))
        pages = QUERIES["vw06_rosters"](spark, "").filter("id_reserva = 1").collect()
    cis = [ci for p in pages for ci in p.cis.split("|")]
    assert len(pages) > 1 and len(cis) == len(set(cis)) == 153 == sum(p.confirmados for p in pages)
    assert {c[0] for c in crowd} < set(cis) and all(len(p.personas.split("|")) == p.confirmados for p in pages)


LAZY = [
    "flt4_open_slots", "vw06_my_reservations", "rp04_bookings_by_programme", "rp08_state_share", "wn3_island_summary",
    "ad1_bookings_self_snapshot", "ad2_bookings_admin_snapshot", "ad3_joins_snapshot", "sw2_sweep_blocks",
    "sn3_coalesce", "ch03_remove_reserva", "ch04_modify_reserva", "pr3_no_shows", "dq7_overfull",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_joins_and_no_python_in_plans(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert node not in plan


def test_popular_groups_are_cut_before_the_shuffle(spark, tmp_path):
    """Only the first few claims of a group leave a map task."""
    from aulario.plans.first_come import Resource, _first_claims

    claims = spark.range(1000).selectExpr("id % 3 as k", "id as o", "2L as free")
    plan = _first_claims(claims, Resource("x", "k", "free"), "o", 2)._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("WindowGroupLimit", plan.index("Exchange hashpartitioning"))
    assert "Partial" in plan[partial : partial + 200]


def test_rows_without_a_group_are_dealt_by_their_order(spark):
    """Rows whose group is null do not meet the units of the groups in one task."""
    from aulario.plans import first_come

    sizes, kept = [], first_come.stage

    def recorded(df, label):
        stored = kept(df, label)
        per_file = stored.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("c")).collect()
        sizes.append([r["c"] for r in per_file])
        return stored

    df = spark.range(20_000).selectExpr("id as o", "if(id % 10 = 0, id div 20, null) as k", "id div 2 as j", "1L as f")
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        with pytest.MonkeyPatch.context() as held:
            held.setattr(first_come, "stage", recorded)
            resources = [first_come.Resource("j", "j", "f"), first_come.Resource("k", "k", "f")]
            granted = first_come.grant_in_order(df.repartition(8, "o"), "o", resources).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    large = [s for s in sizes if sum(s) > 1000]
    assert granted > 0 and large and all(max(s) < 2 * sum(s) / len(s) for s in large)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from aulario.operators import reports
    from aulario.sources.projection import project_testdata
    from aulario.sources.tables import load_tables, write_snapshot

    path = str(tmp_path / "v1")
    write_snapshot(project_testdata(spark, "/root/testdata/sf0.001"), path)
    t = load_tables(spark, path)
    f = reports.ReportFilter(desde="2025-01-10", hasta="2025-01-20", tipo_sala="Libre")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        plan = reports.top_rooms(t, f)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    booked = next(line for line in scans if "GreaterThanOrEqual(fecha,2025-01-10)" in line)
    assert "LessThanOrEqual(fecha,2025-01-20)" in booked
    assert booked.split("ReadSchema")[1].count(":") == 4  # room, building, date
    assert any("EqualTo(tipo_sala,Libre)" in line for line in scans)


def _scans(spark, df):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    return [line for line in plan.splitlines() if "FileScan" in line]


def test_days_prune_the_months_of_both_stored_tables(spark, tmp_path):
    from aulario.operators import admission, filters, reports
    from aulario.sources.projection import project_testdata
    from aulario.sources.tables import load_tables, write_snapshot

    path = str(tmp_path / "v1")
    whole = project_testdata(spark, "/root/testdata/sf0.001")
    write_snapshot(whole, path)
    t = load_tables(spark, path)
    f = reports.ReportFilter(desde="2025-02-03", hasta="2025-02-07")
    months = "PartitionFilters: [isnotnull(mes#"
    for name in ("avg_participants", "bookings_by_programme", "building_occupancy", "bookings_by_role", "top_participants", "mean_lead_days"):
        scans = _scans(spark, reports.REPORTS[name](t, f))
        assert scans
        for table in ("reserva", "reserva_participante"):
            own = [s for s in scans if f"/{table}]" in s.split("PartitionFilters")[0]]
            assert own and all(months in s and ">= 2025-02)" in s and "<= 2025-02)" in s for s in own), (name, table)
        got = reports.REPORTS[name](t, f).collect()
        assert got == reports.REPORTS[name](whole, f).collect(), name
    taken = _scans(spark, filters.open_slots(t, dt.date(2025, 2, 1), dt.date(2025, 2, 7)))
    assert any(months in s for s in taken)
    # state that differs from what is stored is not cut
    moved = t.replace(reserva=t.reserva.withColumn("fecha", F.date_add("fecha", 31)))
    later = moved.between(dt.date(2025, 3, 1), None)
    assert later.reserva.count() == t.reserva.filter("fecha >= date'2025-01-29'").count() > 0
    assert later.reserva_participante.count() == t.reserva_participante.count()
    used = admission.quota_usage(t.between(dt.date(2025, 2, 1), None), "day")
    assert used.count() == admission.quota_usage(whole, "day").filter("fecha >= date'2025-02-01'").count()


def test_a_run_of_all_reports_scans_big_tables_once(spark, tmp_path):
    from aulario.operators import reports
    from aulario.sources.projection import project_testdata
    from aulario.sources.tables import load_tables, write_snapshot

    path = str(tmp_path / "v1")
    write_snapshot(project_testdata(spark, "/root/testdata/sf0.001"), path)
    t = load_tables(spark, path)
    f = reports.ReportFilter(desde="2025-02-03", hasta="2025-02-07", tipo_sala="Libre")
    shared = reports.Inputs(t, f).keep()
    try:
        for name, report in reports.REPORTS.items():
            df = report(t, f, shared)
            assert df.collect() == report(t, f).collect(), name
            leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
            read = [str(leaves.apply(k)) for k in range(leaves.size())]
            stored = [leaf for leaf in read if leaf.startswith("Relation")]
            # rooms and participations come from what is kept
            assert not any("capacidad" in leaf or "asistencia" in leaf for leaf in stored), name
    finally:
        shared.release()
