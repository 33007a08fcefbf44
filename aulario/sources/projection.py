"""Derive the booking model from the star-schema test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aulario.functions.numbers import int_div
from aulario.sources.model import Model

_DAY0 = dt.date(2025, 1, 1)
_TURNOS = 15


# Schemas already read from file footers: inferring one costs a job, and every query opens the
# same few tables.
_SCHEMAS: dict[str, StructType] = {}


class StarSchema:
    """The raw tables, each opened once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._dir = sf_dir
        self._open: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._open:
            path = f"{self._dir}/{name}.parquet"
            reader = self.spark.read if path not in _SCHEMAS else self.spark.read.schema(_SCHEMAS[path])
            self._open[name] = reader.parquet(path)
            _SCHEMAS[path] = self._open[name].schema
        return self._open[name]

    def count(self, name: str) -> Column:
        """Row count of a raw table as a one-value subquery (parquet footers, no join)."""
        return getattr(self, name).agg(F.count("*").alias("n")).scalar()


def padded(key: Column | str) -> Column:
    """A numeric key written as an eight-digit identity number."""
    return F.lpad((F.col(key) if isinstance(key, str) else key).cast("string"), 8, "0")


def day(offset: Column, base: dt.date = _DAY0) -> Column:
    return F.date_add(F.lit(base), offset.cast("int"))


def _facultad(raw: StarSchema) -> DataFrame:
    return raw.region.select(F.col("r_regionkey").alias("id_facultad"), F.col("r_name").alias("nombre"))


def _programas(raw: StarSchema) -> DataFrame:
    return raw.nation.select(
        F.col("n_name").alias("nombre_programa"),
        F.col("n_regionkey").alias("id_facultad"),
        F.when(F.col("n_nationkey") % 3 == 0, "Posgrado").otherwise("Grado").alias("tipo"),
    )


def _participantes(raw: StarSchema) -> DataFrame:
    domain = F.when(F.col("c_mktsegment") == "MACHINERY", "@ucu.edu.uy").otherwise("@correo.ucu.edu.uy")
    return raw.customer.select(
        padded("c_custkey").alias("ci"),
        F.col("c_mktsegment").alias("nombre"),
        F.col("c_name").alias("apellido"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), domain).alias("email"),
    )


def _memberships(raw: StarSchema) -> DataFrame:
    # Nobody for every 50th person, a second programme for every 20th: one scan, one join.
    key, home = F.col("c_custkey"), F.col("c_nationkey")
    first = F.when(key % 50 != 0, F.struct((2 * key).alias("id"), home.cast("long").alias("nation")))
    second = F.when(key % 20 == 1, F.struct((2 * key + 1).alias("id"), ((home + 1) % 25).cast("long").alias("nation")))
    people = raw.customer.select(
        padded("c_custkey").alias("ci_participante"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Docente").otherwise("Estudiante").alias("rol"),
        F.explode(F.array_compact(F.array(first, second))).alias("m"),
    )
    nation = raw.nation.select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_name").alias("nombre_programa"))
    return people.withColumn("nation", F.col("m.nation")).join(nation, "nation").select(
        F.col("m.id").alias("id_alumno_programa"), "ci_participante", "nombre_programa", "rol"
    )


def _edificio(raw: StarSchema) -> DataFrame:
    return raw.nation.select(
        F.concat(F.lit("Edificio "), F.col("n_name")).alias("nombre_edificio"),
        F.lit(None).cast("string").alias("direccion"),
        F.lit(None).cast("string").alias("departamento"),
    )


def sala_with_key(raw: StarSchema) -> DataFrame:
    kind = F.when(F.col("s_suppkey") % 3 == 0, "Libre").when(F.col("s_suppkey") % 3 == 1, "Posgrado").otherwise("Docente")
    nation = raw.nation.select("n_nationkey", "n_name")
    return raw.supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_name").alias("nombre_sala"),
        F.concat(F.lit("Edificio "), F.col("n_name")).alias("edificio"),
        (F.col("s_suppkey") % 9 + 2).cast("short").alias("capacidad"),
        kind.alias("tipo_sala"),
        "s_suppkey",
    )


def _turno(raw: StarSchema) -> DataFrame:
    slot = (F.col("n_nationkey") % _TURNOS + 1).cast("int").alias("id")
    return raw.nation.select(slot).distinct().select(
        F.col("id").alias("id_turno"),
        ((F.col("id") + 7) * 60).alias("inicio_min"),
        ((F.col("id") + 8) * 60).alias("fin_min"),
    )


def _reserva(raw: StarSchema) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    placed = raw.orders.select("o_orderkey", "o_orderstatus").withColumns(
        {"room": int_div(key, F.lit(60)) % raw.count("supplier"), "k": int_div(key, F.lit(60) * raw.count("supplier"))}
    )
    k, room = F.col("k"), F.col("room")
    shift = F.when(k == 2, room % 3).otherwise(0)
    state = (
        F.when((status == "P") & (key % 2 == 0), "Cancelada")
        .when((status == "F") & (key % 3 == 0), "Sin Asistencia")
        .when(status == "F", "Finalizada")
        .otherwise("Activa")
    )
    return placed.join(sala_with_key(raw), F.col("s_suppkey") == room).select(
        key.alias("id_reserva"),
        "nombre_sala",
        "edificio",
        day(key % 60).alias("fecha"),
        (1 + k + shift + key % 10).cast("int").alias("id_turno"),
        state.alias("estado"),
    )


def _participation(raw: StarSchema, reserva: DataFrame) -> DataFrame:
    person = (F.col("l_partkey") * 31 + F.col("l_suppkey")) % raw.count("customer")
    gathered = (
        raw.lineitem.select(
            person.alias("c"),
            F.col("l_orderkey").alias("id_reserva"),
            "l_quantity",
            (F.col("l_returnflag") == "A").alias("a"),
            ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("rf"),
        )
        .groupBy("c", "id_reserva")
        .agg(
            F.max("l_quantity").cast("int").alias("dias"),
            F.max("a").alias("a"),
            F.max("rf").alias("rf"),
        )
    )
    return gathered.join(reserva.select("id_reserva", "fecha", "estado"), "id_reserva").select(
        padded("c").alias("ci_participante"),
        "id_reserva",
        F.date_sub("fecha", F.col("dias")).alias("fecha_solicitud_reserva"),
        (F.col("a") & (F.col("id_reserva") % 4 != 0) & ~F.col("estado").isin("Sin Asistencia", "Cancelada")).alias(
            "asistencia"
        ),
        (~F.col("rf")).alias("confirmado"),
    )


def _sancion(raw: StarSchema) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return raw.orders.select(
        key.alias("id_sancion"),
        padded(int_div(cust, F.lit(4))).alias("ci_participante"),
        day(key % 97).alias("fecha_inicio"),
        day(key % 97 + cust % 40).alias("fecha_fin"),
        ((F.col("o_orderstatus") != "F") & (key % 10 == 0)).alias("activa"),
    )


def _notificacion(raw: StarSchema) -> DataFrame:
    return raw.events.select(
        F.col("event_id").alias("id_notificacion"),
        padded("user_id").alias("ci_participante"),
        F.col("event_type").alias("mensaje"),
        F.col("ts").cast("timestamp").alias("fecha"),
        (F.col("value") < 50).alias("leida"),
    )


def project_testdata(spark: SparkSession, sf_dir: str, raw: StarSchema | None = None) -> Model:
    """The booking model seen in the star schema stored under ``sf_dir`` (nothing is read yet)."""
    raw = raw or StarSchema(spark, sf_dir)
    return Model(
        spark,
        {
            "participantes": lambda m: _participantes(raw),
            "facultad": lambda m: _facultad(raw),
            "programas_academicos": lambda m: _programas(raw),
            "participantes_programa_academico": lambda m: _memberships(raw),
            "edificio": lambda m: _edificio(raw),
            "sala": lambda m: sala_with_key(raw).drop("s_suppkey"),
            "turno": lambda m: _turno(raw),
            "reserva": lambda m: _reserva(raw),
            "reserva_participante": lambda m: _participation(raw, m.reserva),
            "sancion_participante": lambda m: _sancion(raw),
            "notificacion": lambda m: _notificacion(raw),
        },
    )
