"""Streaming jobs over change feeds.

Each job keeps its output in folders numbered by micro-batch (``lote``) and overwrites only the
folder of the batch it runs. A batch that is run again after a failure sees the base state plus the
output of *earlier* batches, so it writes the same rows: the outputs are exactly-once. What earlier
batches wrote is read from merged copies, so a batch opens a bounded number of folders however many
came before it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from aulario.functions.dates import at_minute, plus_minutes, today
from aulario.operators.notices import message, notifications
from aulario.operators.propagation import newly_sanctioned
from aulario.operators.sanctions import two_months
from aulario.plans.numbering import next_ids
from aulario.sources import fixed
from aulario.sources.model import Model
from aulario.sources.schema import CHANGES, TABLES

LOTE = "lote"
#: Folders of a level that are merged into one of the next.
FAN_IN = 16

_WITHDRAWALS = T.StructType(
    [
        T.StructField("ci", T.StringType()),
        T.StructField("id_reserva", T.LongType()),
        T.StructField("version", T.LongType()),
        T.StructField("confirmado", T.BooleanType()),
    ]
)
_SEEN = T.StructType([T.StructField("id_reserva", T.LongType()), T.StructField("version", T.LongType())])
_CANCELLED = T.StructType([T.StructField("id_reserva", T.LongType())])


def read_feed(spark: SparkSession, kind: str, path: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A change feed arriving as files under ``path``."""
    reader = spark.readStream.schema(CHANGES[kind]).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


class BatchStore:
    """Rows written per micro-batch under one folder, with merged copies of those of earlier batches.

    ``lote=N`` holds the rows of batch N; these folders are the output and stay as they are. Every
    ``fan_in`` batches become one folder ``_merged/l1-i``, every ``fan_in`` of those one of the next
    level, and so on: the batches before N are read from at most ``fan_in - 1`` folders a level. A
    merged folder covers batches that are final, so it never changes; one that was not written to its
    end lacks Spark's success mark and is written again. Its rows are dealt by ranges of ``keys`` and
    sorted, so that files and row groups can be skipped; ``latest`` may fold rows that later ones replace.
    The leading underscore keeps the copies out of plain reads of the folder.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        keys: Sequence[str],
        latest: Callable[[DataFrame], DataFrame] | None = None,
        fan_in: int = FAN_IN,
    ):
        self.spark, self.path, self.schema = spark, path, schema
        self.keys, self.latest, self.fan_in = list(keys), latest, fan_in
        # an empty batch before the first one, so that the folder can always be read
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{LOTE}=-1")

    def write(self, rows: DataFrame, lote: int) -> None:
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/{LOTE}={lote}")

    def _complete(self, folder: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(mark)

    def _read(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _folder(self, level: int, i: int) -> str:
        """The folder of the ``i``-th run of ``fan_in ** level`` batches, merged if it is not there yet."""
        if level == 0:
            return f"{self.path}/{LOTE}={i}"
        folder = f"{self.path}/_merged/l{level}-{i}"
        if not self._complete(folder):
            rows = self._read([self._folder(level - 1, i * self.fan_in + k) for k in range(self.fan_in)])
            rows = self.latest(rows) if self.latest else rows
            rows = rows.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys)
            rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(folder)
        return folder

    def folders(self, lote: int) -> list[str]:
        """Folders that hold the rows of all batches before ``lote``, each once."""
        out, level, left = [], 0, lote
        while left:
            left, extra = divmod(left, self.fan_in)
            out += [self._folder(level, left * self.fan_in + k) for k in range(extra)]
            level += 1
        return [f"{self.path}/{LOTE}=-1", *out]

    def before(self, lote: int) -> DataFrame:
        return self._read(self.folders(lote))

    def upto(self, lote: int) -> DataFrame:
        """Batches before ``lote``, and ``lote`` itself as it is now."""
        return self._read([*self.folders(lote), f"{self.path}/{LOTE}={lote}"])


def _start(changes: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        changes.writeStream.foreachBatch(body)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _in_months_of(t: Model, ids: DataFrame) -> Model:
    """The bundle cut to the days of the reservations in ``ids``.

    Tables stored by month are read from the months between the first and the last of those days;
    without stored months, or if a reservation is not known, nothing is cut.
    """
    days = ids.join(t.reserva.select("id_reserva", "fecha"), "id_reserva", "left")
    span = days.agg(F.min("fecha").alias("first"), F.max("fecha").alias("last"), F.count_if(F.col("fecha").isNull()).alias("unknown"))
    first, last, unknown = span.first()
    return t if unknown else t.between(first, last)


def sanction_no_show_stream(t: Model, changes: DataFrame, out: str, checkpoint: str, as_of: dt.datetime) -> StreamingQuery:
    """Sanction and notify people as reservations turn into no-shows.

    New rows go to ``out/sancion_participante`` and ``out/notificacion``, the changes dealt with to
    ``out/cambios_vistos``. A change counts however late it comes; delivered again, in the same batch
    or a later one, it is known by (reservation, version).
    """
    seen = BatchStore(t.spark, f"{out}/cambios_vistos", _SEEN, ["id_reserva", "version"])
    sanctions = BatchStore(
        t.spark, f"{out}/sancion_participante", TABLES["sancion_participante"], ["ci_participante", "id_sancion"]
    )
    notices = BatchStore(t.spark, f"{out}/notificacion", TABLES["notificacion"], ["id_notificacion"])

    def body(delivered: DataFrame, lote: int) -> None:
        key = ["id_reserva", "version"]
        batch = delivered.dropDuplicates(key).join(seen.before(lote), key, "left_anti")
        seen.write(batch, lote)
        now_state = _in_months_of(t, batch.select("id_reserva").distinct()).replace(
            sancion_participante=t.sancion_participante.unionByName(sanctions.before(lote)),
            notificacion=t.notificacion.unionByName(notices.before(lote)),
        )
        people = newly_sanctioned(now_state, batch).persist()
        try:
            rows = people.select(
                F.col("ci").alias("ci_participante"),
                today(as_of).alias("fecha_inicio"),
                two_months(as_of).alias("fecha_fin"),
                F.lit(True).alias("activa"),
            )
            new = next_ids(rows, ["ci_participante"], "id_sancion", now_state.sancion_participante)
            sanctions.write(new, lote)
            texts = notifications(people, message("no_show"), as_of)
            # one text per person in a batch, so the person alone orders them
            told = next_ids(texts, ["ci_participante"], "id_notificacion", now_state.notificacion)
            notices.write(told, lote)
        finally:
            people.unpersist()

    return _start(changes, body, checkpoint)


def cancel_emptied_stream(t: Model, changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Cancel reservations as the last confirmed person withdraws.

    ``out/confirmaciones`` logs the latest value of each participation in each batch,
    ``out/canceladas`` the reservations cancelled, once each. Only reservations touched by a batch
    are recounted; of two values the higher version counts, in whatever order they come.
    """

    def latest_value(rows: DataFrame) -> DataFrame:
        return rows.groupBy("ci", "id_reserva").agg(
            F.max("version").alias("version"), F.max_by("confirmado", "version").alias("confirmado")
        )

    log = BatchStore(t.spark, f"{out}/confirmaciones", _WITHDRAWALS, ["id_reserva", "ci"], latest_value)
    cancelled = BatchStore(t.spark, f"{out}/canceladas", _CANCELLED, ["id_reserva"])

    def body(batch: DataFrame, lote: int) -> None:
        latest = batch.groupBy("ci", "id_reserva").agg(
            F.max("version").alias("version"), F.max_by("confirmado_new", "version").alias("confirmado")
        )
        log.write(latest, lote)
        touched = batch.filter(F.col("confirmado_old") & ~F.col("confirmado_new")).select("id_reserva").distinct()
        base = _in_months_of(t, touched).reserva_participante.select(
            F.col("ci_participante").alias("ci"), "id_reserva", F.lit(-1).cast("long").alias("version"), "confirmado"
        )
        values = base.unionByName(log.upto(lote)).join(touched, "id_reserva", "left_semi")
        current = values.groupBy("ci", "id_reserva").agg(F.max_by("confirmado", "version").alias("confirmado"))
        held = current.filter(F.col("confirmado") == F.lit(True)).select("id_reserva")
        emptied = touched.join(held, "id_reserva", "left_anti")
        cancelled.write(emptied.join(cancelled.before(lote), "id_reserva", "left_anti"), lote)

    return _start(changes, body, checkpoint)


def attendance_stream(t: Model, marks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Split attendance marks into those in time and the late ones.

    A mark counts while its reservation is active and until ten minutes after its end, that
    instant included. Both kinds go to ``out``, in folders ``a_tiempo=true`` and ``a_tiempo=false``.
    """
    ends = (
        t.reserva.filter(F.col("estado") == fixed.ACTIVA)
        .join(t.turno, "id_turno")
        .select("id_reserva", plus_minutes(at_minute("fecha", "fin_min"), fixed.GRACIA_MIN).alias("_hasta"))
    )
    split = marks.join(ends, "id_reserva", "left").withColumn(
        "a_tiempo", F.coalesce(F.col("marked_at") <= F.col("_hasta"), F.lit(False))
    )
    return (
        split.select("ci", "id_reserva", "asistencia", "marked_at", "a_tiempo")
        .writeStream.format("parquet")
        .partitionBy("a_tiempo")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_marks(spark: SparkSession, out: str) -> DataFrame:
    """What :func:`attendance_stream` wrote."""
    schema = T.StructType([*CHANGES["asistencia"].fields, T.StructField("a_tiempo", T.BooleanType())])
    return spark.read.schema(schema).parquet(out)
