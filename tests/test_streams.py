"""Streams fed by several files, restarted on the way, against the batch operators."""

import datetime as dt

import pytest
from demo_rows import table

from aulario.operators import propagation
from aulario.sources.schema import CHANGES
from aulario.streaming import feeds

AS_OF = dt.datetime(2025, 11, 20, 12, 0)


@pytest.fixture
def feed(spark, tmp_path):
    """Append change rows as one more file of a feed."""

    def add(kind, rows, fmt="parquet"):
        df = spark.createDataFrame(rows, CHANGES[kind]).coalesce(1)
        df.write.mode("append").format(fmt).save(str(tmp_path / "in"))

    add.path, add.out, add.state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    return add


def no_show(r, version=1, old="Activa", new="Sin Asistencia"):
    return (r, version, old, new, AS_OF)


def test_no_shows_over_restarts(spark, demo, feed):
    def run():
        stream = feeds.read_feed(spark, "reserva", feed.path, files_per_batch=1)
        feeds.sanction_no_show_stream(demo, stream, feed.out, feed.state, AS_OF).awaitTermination()

    feed("reserva", [no_show(4), no_show(1, old="Sin Asistencia")])
    feed("reserva", [no_show(2, new="Finalizada")])
    run()
    feed("reserva", [no_show(2, version=2), no_show(4)])  # the second is a repetition
    feed("reserva", [no_show(5), no_show(3)])
    run()
    run()  # nothing new

    out = spark.read.parquet(f"{feed.out}/sancion_participante")
    got = {r.ci_participante: r.fecha_fin for r in out.collect()}
    batch = propagation.sanctions_from_transitions(
        demo, spark.createDataFrame([no_show(r) for r in (4, 2, 5, 3)], CHANGES["reserva"]), AS_OF
    ).sancion_participante
    assert got == {r.ci_participante: r.fecha_fin for r in batch.filter("id_sancion > 1").collect()}
    ids = sorted(r.id_sancion for r in out.collect())
    assert ids == list(range(2, 2 + len(ids)))
    told = spark.read.parquet(f"{feed.out}/notificacion").collect()
    assert len(told) == len(got) and len({r.id_notificacion for r in told}) == len(told)


def test_changes_count_however_late_they_come(spark, demo, feed):
    def at(row, days):
        return (*row[:-1], AS_OF - dt.timedelta(days=days))

    def run(job, kind, *more):
        stream = feeds.read_feed(spark, kind, feed.path, files_per_batch=1)
        job(demo, stream, feed.out, feed.state, *more).awaitTermination()

    feed("reserva", [no_show(4)])
    run(feeds.sanction_no_show_stream, "reserva", AS_OF)
    feed("reserva", [at(no_show(5), 30), at(no_show(4), 30), at(no_show(5), 30)])
    run(feeds.sanction_no_show_stream, "reserva", AS_OF)
    out = spark.read.parquet(f"{feed.out}/sancion_participante").select("ci_participante")
    batch = propagation.sanctions_from_transitions(
        demo, spark.createDataFrame([no_show(4), no_show(5)], CHANGES["reserva"]), AS_OF
    ).sancion_participante
    got = [r.ci_participante for r in out.collect()]
    assert sorted(got) == sorted(r.ci_participante for r in batch.filter("id_sancion > 1").collect())


def test_a_batch_run_again_writes_the_same(spark, demo, feed):
    """Losing the commit of the last batch makes the stream run it again."""
    import glob
    import os

    def run():
        stream = feeds.read_feed(spark, "reserva", feed.path)
        feeds.sanction_no_show_stream(demo, stream, feed.out, feed.state, AS_OF).awaitTermination()

    def written():
        return sorted(tuple(r) for r in spark.read.parquet(f"{feed.out}/sancion_participante").collect())

    feed("reserva", [no_show(4)])
    run()
    feed("reserva", [no_show(3)])
    run()
    before = written()
    last = max(glob.glob(f"{feed.state}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    for path in (last, os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")):
        if os.path.exists(path):
            os.remove(path)
    run()
    assert written() == before


def test_a_store_reads_few_folders_of_many_batches(spark, tmp_path):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])
    path = str(tmp_path / "store")
    store = feeds.BatchStore(spark, path, schema, ["k"], fan_in=4)
    batches, opened = 40, 0
    for lote in range(batches):
        opened = max(opened, len(store.folders(lote)))
        store.write(spark.range(2).select((F.col("id") + lote).alias("k"), F.lit(lote).cast("long").alias("v")), lote)
    assert opened <= 1 + 3 * 3  # the empty one, and three of each of three levels
    want = [(lote + i, lote) for lote in range(batches) for i in range(2)]
    assert sorted(map(tuple, store.before(batches).collect())) == sorted(want)
    assert sorted(map(tuple, store.before(21).collect())) == sorted(w for w in want if w[1] < 21)
    assert spark.read.parquet(path).count() == len(want)  # the copies do not show

    # a copy that broke off lacks its mark and is written again; batches run again are final for others
    merged = tmp_path / "store" / "_merged" / "l1-9"
    (merged / "_SUCCESS").unlink()
    spark.createDataFrame([], schema).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(str(merged))
    again = feeds.BatchStore(spark, path, schema, ["k"], fan_in=4)
    assert sorted(map(tuple, again.before(batches).collect())) == sorted(want)


def test_a_long_feed_through_merged_folders(spark, demo, feed, monkeypatch):
    """Many small batches with repetitions and restarts give what one batch gives, ids in a row."""
    monkeypatch.setattr(feeds.BatchStore.__init__, "__defaults__", (None, 2))

    def run():
        stream = feeds.read_feed(spark, "reserva", feed.path, files_per_batch=1)
        feeds.sanction_no_show_stream(demo, stream, feed.out, feed.state, AS_OF).awaitTermination()

    ids = (4, 2, 5, 3)
    for r in (4, 4, 2, 4, 5):
        feed("reserva", [no_show(r)])
    run()
    for r in (2, 3, 4, 5):
        feed("reserva", [no_show(r)])
    run()
    out = spark.read.parquet(f"{feed.out}/sancion_participante").collect()
    batch = propagation.sanctions_from_transitions(
        demo, spark.createDataFrame([no_show(r) for r in ids], CHANGES["reserva"]), AS_OF
    ).sancion_participante
    assert sorted(r.ci_participante for r in out) == sorted(r.ci_participante for r in batch.filter("id_sancion > 1").collect())
    assert sorted(r.id_sancion for r in out) == list(range(2, 2 + len(out)))


def test_batches_read_the_months_they_touch(spark, demo, tmp_path):
    from aulario.sources.tables import load_tables, write_snapshot

    write_snapshot(demo, str(tmp_path / "v1"))
    t = load_tables(spark, str(tmp_path / "v1"))
    ids = spark.createDataFrame([(1,)], "id_reserva long")
    cut = feeds._in_months_of(t, ids)
    plan = cut.reserva_participante._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(mes" in plan
    unknown = feeds._in_months_of(t, ids.union(spark.createDataFrame([(999,)], "id_reserva long")))
    assert unknown.reserva_participante.count() == demo.reserva_participante.count()


def leave(ci, r, version=1, new=False):
    return (ci, r, version, not new, new, AS_OF)


def test_withdrawals_over_restarts(spark, demo, feed):
    def run():
        stream = feeds.read_feed(spark, "confirmado", feed.path, files_per_batch=1)
        feeds.cancel_emptied_stream(demo, stream, feed.out, feed.state).awaitTermination()

    def cancelled():
        return sorted(r.id_reserva for r in spark.read.parquet(f"{feed.out}/canceladas").distinct().collect())

    feed("confirmado", [leave("48562347", 3), leave("40672157", 2), leave("48562347", 1)])
    run()
    assert cancelled() == []
    feed("confirmado", [leave("51238903", 3)])
    feed("confirmado", [leave("40672157", 2, 2, new=True), leave("53910675", 2)])  # one is back
    run()
    assert cancelled() == [3]
    feed("confirmado", [leave("40672157", 2, 3)])
    run()
    assert cancelled() == [2, 3]


def test_marks_up_to_the_grace_count(spark, demo, feed):
    end = dt.datetime(2025, 11, 20, 9, 0)
    closed = table(spark, "reserva", [(9, "Sala A1", "Edificio Sacré Cœur", end.date(), 1, "Cancelada")])
    t = demo.replace(reserva=demo.reserva.unionByName(closed))
    late = dt.timedelta(minutes=10)
    rows = [
        ("a", 1, True, end),
        ("b", 1, True, end + late),
        ("c", 1, True, end + late + dt.timedelta(seconds=1)),
        ("d", 9, True, end),
        ("e", 77, True, end),
    ]
    feed("asistencia", rows[:2], "json")
    feed("asistencia", rows[2:], "json")
    stream = feeds.read_feed(spark, "asistencia", feed.path, "json", files_per_batch=1)
    feeds.attendance_stream(t, stream, feed.out, feed.state).awaitTermination()
    got = {r.ci: r.a_tiempo for r in feeds.read_marks(spark, feed.out).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False, "e": False}
