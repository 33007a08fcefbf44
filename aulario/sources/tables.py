"""Load and save the booking tables, read request batches, write reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aulario.functions.dates import iso_date
from aulario.operators import reports
from aulario.operators.filters import ReportFilter
from aulario.operators.verdicts import first_failing
from aulario.sources.model import Model
from aulario.sources.schema import REQUESTS, TABLES

#: Big tables are stored by month of the reservation, so date filters prune whole folders.
MONTH = "mes"
_BY_MONTH = ("reserva", "reserva_participante")
CORRUPT, REASON = "_corrupt_record", "_reason"
#: Table of table names that completes a snapshot.
MANIFEST = "manifest"
_MANIFEST = T.StructType([T.StructField("tabla", T.StringType())])


def load_tables(spark: SparkSession, path: str) -> Model:
    """The model stored as parquet folders under ``path``, with the declared schema.

    Fails if the snapshot was not written to its end. The month folders do not show as a column:
    ``Model.between`` reads only those of the months it is asked for, of both tables stored by month.
    """

    spark.read.schema(_MANIFEST).parquet(f"{path}/{MANIFEST}")

    def opener(name: str):
        columns = TABLES[name].fieldNames()
        return lambda m: spark.read.schema(TABLES[name]).parquet(f"{path}/{name}").select(*columns)

    def reader(name: str):
        with_month = T.StructType([*TABLES[name].fields, T.StructField(MONTH, T.StringType())])

        def read(first: dt.date | None, last: dt.date | None) -> DataFrame:
            rows = spark.read.schema(with_month).parquet(f"{path}/{name}")
            if first is not None:
                rows = rows.filter(F.col(MONTH) >= first.strftime("%Y-%m"))
            if last is not None:
                rows = rows.filter(F.col(MONTH) <= last.strftime("%Y-%m"))
            return rows.drop(MONTH)

        return read

    return Model(spark, {name: opener(name) for name in TABLES}, {name: reader(name) for name in _BY_MONTH})


def write_snapshot(t: Model, path: str) -> None:
    """Write every table of the model as a new version; refuses to touch an existing one.

    The list of tables is written last: a version without it broke off and does not load.
    """
    month = F.date_format("fecha", "yyyy-MM")
    for name in t.names():
        table = getattr(t, name).select(*TABLES[name].fieldNames())
        if name == "reserva":
            table = table.withColumn(MONTH, month)
        elif name == "reserva_participante":
            months = t.reserva.select("id_reserva", month.alias(MONTH))
            # left: a row without its reservation is still state, in the default folder
            table = table.join(months, "id_reserva", "left").select(*TABLES[name].fieldNames(), MONTH)
        if name in _BY_MONTH:
            # a month goes to few tasks, so that few files make up its folder; big months are split
            table.hint("rebalance", MONTH).write.mode("errorifexists").partitionBy(MONTH).parquet(f"{path}/{name}")
        else:
            table.write.mode("errorifexists").parquet(f"{path}/{name}")
    written = t.spark.createDataFrame([(name,) for name in t.names()], _MANIFEST)
    written.coalesce(1).write.mode("errorifexists").parquet(f"{path}/{MANIFEST}")


def write_reports(t: Model, f: ReportFilter, out: str) -> None:
    """Write all eleven reports in one run; what several of them need is computed once and kept for the run."""
    shared = reports.Inputs(t, f).keep()
    try:
        for name, report in reports.REPORTS.items():
            report(t, f, shared).write.mode("errorifexists").parquet(f"{out}/{name}")
    finally:
        shared.release()


def _parsed(text: Column, kind: T.DataType) -> Column:
    """A form field as the declared type; NULL if it does not fit (dates are YYYY-MM-DD and nothing else)."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.DateType):
        return iso_date(text)
    if isinstance(kind, T.IntegralType):
        text = F.when(text.rlike("^[+-]?[0-9]+$"), text)
    return text.try_cast(kind)


def _typed(texts: DataFrame, schema: T.StructType, raw: Column) -> DataFrame:
    """Declared columns from text ones; what does not fit keeps ``raw`` and says which field is to blame."""
    parsed = {f.name: _parsed(F.col(f.name), f.dataType) for f in schema.fields}
    unfit = [(f"bad_{name}", F.col(name).isNotNull() & value.isNull()) for name, value in parsed.items()]
    reason = first_failing([("malformed", F.col(CORRUPT).isNotNull()), *unfit])
    columns = [value.alias(name) for name, value in parsed.items()]
    return texts.select(*columns, F.when(reason.isNotNull(), raw).alias(CORRUPT), reason.alias(REASON))


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in (*names, CORRUPT)])


def _read_csv(spark: SparkSession, schema: T.StructType, path: str, multi_line: bool) -> DataFrame:
    header = spark.read.option("header", True).csv(path).columns
    missing = [n for n in schema.fieldNames() if n not in header]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    # every file must have the same header; Spark compares it by name
    options = {"header": True, "enforceSchema": False, "multiLine": multi_line, "escape": '"', "mode": "PERMISSIVE"}
    texts = spark.read.schema(_text_schema(header)).options(columnNameOfCorruptRecord=CORRUPT, **options).csv(path)
    return _typed(texts, schema, F.coalesce(CORRUPT, F.to_csv(F.struct(*[F.col(f"`{c}`") for c in header]))))


def read_requests(spark: SparkSession, kind: str, path: str, fmt: str = "parquet", multi_line: bool = True) -> DataFrame:
    """A batch of requests in parquet, JSON lines or CSV with a header.

    Text formats hold form fields: they are read as texts and converted strictly. A record that does
    not fit keeps its raw text in ``_corrupt_record`` and a reason (``malformed`` or ``bad_<field>``) in
    ``_reason``, for the caller to report or drop. CSV columns are found by name, in any order, others
    are left out; quoted fields may hold line breaks. A CSV file with those cannot be split between
    tasks: pass ``multi_line=False`` for big files without them.
    """
    schema = REQUESTS[kind]
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    if fmt == "csv":
        return _read_csv(spark, schema, path, multi_line)
    if fmt != "json":
        raise ValueError(f"unknown request format: {fmt}")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    # parsed as an expression, so that any subset of the columns can be read on its own
    record = F.from_json("value", _text_schema(schema.fieldNames()), options)
    return _typed(lines.select("value", record.alias("r")).select("value", "r.*"), schema, F.col("value"))


def split_corrupt(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Well-formed requests, and the raw text and reason of the others."""
    good = batch.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, REASON)
    return good, batch.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT, REASON)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    parts = [df.agg(F.count("*").alias("filas")).select(F.lit(n).alias("tabla"), "filas") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


__all__ = [
    "load_tables",
    "read_requests",
    "row_counts",
    "split_corrupt",
    "write_reports",
    "write_snapshot",
]
