"""Notifications appended by other operators."""

from __future__ import annotations

import datetime as dt
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aulario.functions.dates import now
from aulario.functions.text import fill
from aulario.plans.numbering import next_ids
from aulario.sources import fixed
from aulario.sources.model import Model

Kind = Literal["reservation_cancelled", "left_reservation", "reservation_modified", "sanction", "no_show"]

_TEMPLATES: dict[str, str] = {
    "reservation_cancelled": fixed.MSG_RESERVA_CANCELADA,
    "left_reservation": fixed.MSG_PARTICIPACION_CANCELADA,
    "reservation_modified": fixed.MSG_RESERVA_MODIFICADA,
    "sanction": fixed.MSG_SANCION,
    "no_show": fixed.MSG_SANCION_RESERVA,
}


def message(kind: Kind, id_reserva: str = "id_reserva") -> Column:
    template = _TEMPLATES[kind]
    return fill(template, id_reserva) if "{}" in template else F.lit(template)


def notifications(rows: DataFrame, mensaje: Column, as_of: dt.datetime) -> DataFrame:
    """New notifications (without id) for rows with ``ci`` and, where the text names one, ``id_reserva``."""
    about = F.col("id_reserva") if "id_reserva" in rows.columns else F.lit(0)
    return rows.select(
        F.col("ci").alias("ci_participante"),
        mensaje.alias("mensaje"),
        now(as_of).alias("fecha"),
        F.lit(False).alias("leida"),
        about.cast("long").alias("sobre"),
    )


def append_notifications(t: Model, new: DataFrame) -> DataFrame:
    """The notification table with ``new`` numbered after the existing ones by (reservation, person)."""
    numbered = next_ids(new, ["sobre", "ci_participante"], "id_notificacion", t.notificacion)
    return t.notificacion.unionByName(numbered.select(*t.notificacion.columns))
