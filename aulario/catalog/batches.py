"""Request and change batches derived from the test tables, whole."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aulario.functions.dates import at_minute
from aulario.functions.numbers import int_div
from aulario.session import AS_OF
from aulario.sources.model import Model
from aulario.sources.projection import StarSchema, day, padded, project_testdata, sala_with_key


class Batches:
    """Batches of one test directory; ``model`` is the state they are applied to."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.raw = StarSchema(spark, sf_dir)
        self.model: Model = project_testdata(spark, sf_dir, self.raw)

    def booking(self) -> DataFrame:
        room = (F.col("o_custkey") * 7 + F.col("o_orderkey")) % (self.raw.count("supplier") + 1)
        asked = self.raw.orders.select("o_orderkey", "o_orderdate", "o_custkey", room.alias("room"))
        return asked.join(sala_with_key(self.raw), F.col("s_suppkey") == F.col("room"), "left").select(
            F.col("o_orderkey").alias("request_id"),
            F.col("o_orderdate").cast("timestamp").alias("request_ts"),
            padded("o_custkey").alias("ci"),
            "nombre_sala",
            "edificio",
            day(int_div(F.col("o_orderkey"), F.lit(5)) % 12, dt.date(2025, 1, 28)).alias("fecha"),
            (F.col("o_custkey") % 16 + 1).cast("int").alias("id_turno"),
        )

    def join(self) -> DataFrame:
        return self.raw.orders.select(
            F.col("o_orderkey").alias("request_id"),
            F.col("o_orderdate").cast("timestamp").alias("request_ts"),
            padded("o_custkey").alias("ci"),
            (F.col("o_orderkey") * 13 % (self.raw.count("orders") + 50)).alias("id_reserva"),
        )

    def cancel(self) -> DataFrame:
        absent = self.model.reserva_participante.filter(~F.col("asistencia"))
        strangers = self.raw.orders.select(F.lit("99999999").alias("ci"), F.col("o_orderkey").alias("id_reserva"))
        return absent.select(F.col("ci_participante").alias("ci"), "id_reserva").unionByName(strangers)

    def edit(self) -> DataFrame:
        key = F.col("id_reserva")
        state = F.when(key % 7 == 5, "Pospuesta").when(key % 3 == 0, "cancelada").when(key % 3 == 1, "Activa")
        state = state.otherwise("Sin asistencia")
        return self.model.reserva.select(
            key,
            day(key % 25, dt.date(2025, 1, 30)).alias("fecha_nueva"),
            (key % 15 + 1).cast("int").alias("id_turno_nuevo"),
            state.alias("estado_nuevo"),
        )

    def attendance(self) -> DataFrame:
        return self.model.reserva_participante.select(
            F.col("ci_participante").alias("ci"), "id_reserva", (F.col("id_reserva") % 2 == 0).alias("asistencia")
        )

    def sanction(self) -> DataFrame:
        key = F.col("o_orderkey")
        person = padded(int_div(F.col("o_custkey"), F.lit(4)))
        return self.raw.orders.select(
            key.alias("request_id"),
            F.when(key % 70 == 5, "12A").otherwise(person).alias("ci"),
            day(key % 61, dt.date(2025, 1, 25)).alias("fecha_fin"),
        )

    def sanction_edit(self) -> DataFrame:
        key = F.col("id_sancion")
        return self.model.sancion_participante.select(
            key.alias("request_id"),
            F.col("ci_participante").alias("ci"),
            "fecha_inicio",
            F.date_add("fecha_inicio", (key % 90 - 10).cast("int")).alias("fecha_fin"),
            (key % 3 != 0).alias("activa"),
        )

    def participant(self) -> DataFrame:
        key = F.col("p_partkey")
        domain = F.when(key % 7 == 0, "@other.org").otherwise("@correo.ucu.edu.uy")
        surname = F.when(key % 11 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("o'"), F.lower("p_type")))
        nation = self.raw.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("programa"))
        return self.raw.part.join(nation, F.col("k") == key % 25).select(
            key.alias("request_id"),
            (key * 37 + 10000000).cast("string").alias("ci"),
            F.col("p_name").alias("nombre"),
            surname.alias("apellido"),
            F.concat(F.lit("p"), (int_div(key, F.lit(2)) * 2).cast("string"), domain).alias("email"),
            "programa",
            F.lit("Estudiante").alias("rol"),
        )

    def participant_edit(self) -> DataFrame:
        return self.participant().withColumn("ci", padded("request_id"))

    def room(self) -> DataFrame:
        key = F.col("p_partkey")
        nation = self.raw.nation.select(
            F.col("n_nationkey").cast("long").alias("k"), F.concat(F.lit("Edificio "), F.col("n_name")).alias("edificio")
        )
        return self.raw.part.join(nation, F.col("k") == key % 25).select(
            key.alias("request_id"),
            F.when(key % 9 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("nombre_sala"),
            "edificio",
            (F.col("p_size") * 2 - 3).cast("string").alias("capacidad"),
            F.lit("Libre").alias("tipo_sala"),
        )

    def room_edit(self) -> DataFrame:
        return sala_with_key(self.raw).select(
            "nombre_sala",
            "edificio",
            (F.col("s_suppkey") % 70 - 3).cast("string").alias("capacidad"),
            F.when(F.col("s_suppkey") % 2 == 0, "libre").otherwise("DOCENTE").alias("tipo_sala"),
        )

    def leavers(self) -> DataFrame:
        """People to delete: everybody, and somebody unknown; whoever has notifications stays."""
        people = self.model.participantes.select("ci")
        unknown = self.raw.region.filter(F.col("r_regionkey") == 0).select(F.lit("99999999").alias("ci"))
        return people.unionByName(unknown)

    def readers(self) -> DataFrame:
        return self.model.participantes.filter(F.col("nombre") == "BUILDING").select("ci")

    # --- change feeds ------------------------------------------------------------------------

    def state_changes(self) -> DataFrame:
        key = F.col("id_reserva")
        return self.model.reserva.select(
            key,
            F.lit(1).cast("long").alias("version"),
            F.when(key % 5 == 0, "Sin Asistencia").otherwise("Activa").alias("estado_old"),
            F.when(key % 7 == 0, "Finalizada").otherwise("Sin Asistencia").alias("estado_new"),
            F.lit(AS_OF.isoformat(sep=" ")).cast("timestamp").alias("changed_at"),
        )

    def withdrawals(self) -> DataFrame:
        return self.model.reserva_participante.filter(F.col("confirmado") & ~F.col("asistencia")).select(
            F.col("ci_participante").alias("ci"),
            "id_reserva",
            F.lit(1).cast("long").alias("version"),
            F.lit(True).alias("confirmado_old"),
            F.lit(False).alias("confirmado_new"),
            F.lit(AS_OF.isoformat(sep=" ")).cast("timestamp").alias("changed_at"),
        )

    def attendance_changes(self) -> DataFrame:
        """Confirmed people whose mark differs from what is stored."""
        mark = F.col("id_reserva") % 2 == 0
        return self.model.reserva_participante.filter(F.col("confirmado") & (F.col("asistencia") != mark)).select(
            F.col("ci_participante").alias("ci"),
            "id_reserva",
            F.col("asistencia").alias("asistencia_old"),
            mark.alias("asistencia_new"),
        )

    def marks(self) -> DataFrame:
        """Attendance marks made up to 20 minutes after the end of the reservation."""
        ends = self.model.reserva.join(self.model.turno, "id_turno").select(
            "id_reserva", at_minute("fecha", "fin_min").alias("_fin")
        )
        delay = F.col("ci").cast("int") % 21
        return (
            self.attendance()
            .join(ends, "id_reserva")
            .select("ci", "id_reserva", "asistencia", (F.col("_fin") + F.make_dt_interval(mins=delay)).alias("marked_at"))
        )
