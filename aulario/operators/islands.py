"""Runs of back-to-back reservations in a room on a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aulario.functions.dates import at_minute
from aulario.sources import fixed
from aulario.sources.model import Model

ROOM_DAY = ["fecha", "nombre_sala", "edificio"]


def active_with_slot(t: Model, reserva: DataFrame | None = None) -> DataFrame:
    """Active reservations with the start and end minute of their slot."""
    reserva = t.reserva if reserva is None else reserva
    active = reserva.filter(F.col("estado") == fixed.ACTIVA)
    return active.join(t.turno, "id_turno").select("id_reserva", *ROOM_DAY, "id_turno", "inicio_min", "fin_min")


def with_attended(t: Model, rows: DataFrame) -> DataFrame:
    """Add ``asistida``: whether anybody attended the reservation."""
    attended = (
        t.reserva_participante.filter(F.col("asistencia") == F.lit(True))
        .select("id_reserva")
        .distinct()
        .withColumn("asistida", F.lit(True))
    )
    return rows.join(attended, "id_reserva", "left").withColumn("asistida", F.coalesce("asistida", F.lit(False)))


def slot_islands(rows: DataFrame, attended: bool = False) -> DataFrame:
    """Number the islands over the distinct start minutes of each room and day.

    Walking a room's day by (start, id), a reservation continues the island when the previous one
    ends at its start, else it opens one; reservations with the same start share the island number
    reached after all of them. Rows with the same start are folded first: only the first of them
    can continue an island (a later one follows a row that ends after their common start), so
    the fold keeps the first id and the end of the last id and counts the rest as openings. The
    window of a room day then has one row per start minute even if a slot was booked many times.
    """
    folded = [
        F.count("*").alias("n"),
        F.min("id_reserva").alias("primera"),
        F.max_by("fin_min", "id_reserva").alias("fin_ultima"),
        F.max("fin_min").alias("fin_max"),
    ]
    if attended:
        folded.append(F.count_if(F.col("asistida")).alias("asistidas"))
    starts = rows.groupBy(*ROOM_DAY, "inicio_min").agg(*folded)
    walk = Window.partitionBy(*ROOM_DAY).orderBy("inicio_min")
    continues = F.lag("fin_ultima").over(walk) == F.col("inicio_min")
    return starts.withColumn("abre", F.when(continues, 0).otherwise(1)).withColumn(
        "bloque_id", F.sum(F.col("abre") + F.col("n") - 1).over(walk).cast("long")
    )


def island_flags(rows: DataFrame) -> DataFrame:
    """Per reservation: ``comienza_bloque`` (0/1) and ``bloque_id``."""
    marks = slot_islands(rows).select(*ROOM_DAY, "inicio_min", "primera", "abre", "bloque_id")
    first = F.col("id_reserva") == F.col("primera")
    return rows.join(marks, [*ROOM_DAY, "inicio_min"]).select(
        "id_reserva",
        *ROOM_DAY,
        "id_turno",
        "inicio_min",
        "fin_min",
        F.when(first, F.col("abre")).otherwise(1).alias("comienza_bloque"),
        "bloque_id",
    )


def island_summary(rows: DataFrame) -> DataFrame:
    """Per island: end instant, reservations, and how many of them somebody attended."""
    return (
        slot_islands(rows, attended=True)
        .groupBy(*ROOM_DAY, "bloque_id")
        .agg(
            at_minute(F.col("fecha"), F.max("fin_max")).alias("fin_bloque"),
            F.sum("n").alias("reservas"),
            F.sum("asistidas").alias("total_asistencias"),
        )
    )


def empty_island_slots(rows: DataFrame) -> DataFrame:
    """Starts (room, day, minute) that belong to an island nobody attended, with its end minute."""
    marked = slot_islands(rows, attended=True)
    island = Window.partitionBy(*ROOM_DAY, "bloque_id")
    return (
        marked.withColumn("fin_bloque_min", F.max("fin_max").over(island))
        .withColumn("total", F.sum("asistidas").over(island))
        .filter(F.col("total") == 0)
        .select(*ROOM_DAY, "inicio_min", "fin_bloque_min")
    )
