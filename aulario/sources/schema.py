"""Declared schema of the booking model, its keys and its references."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

from aulario.sources import fixed

_S, _I, _L, _D, _B, _TS, _SH = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DateType(),
    T.BooleanType(),
    T.TimestampType(),
    T.ShortType(),
)


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# Surrogate ids are long: the model has to hold more rows than a 32-bit counter can number.
TABLES: dict[str, T.StructType] = {
    "participantes": _struct(
        ("ci", _S, False), ("nombre", _S, False), ("apellido", _S, False), ("email", _S, False)
    ),
    "facultad": _struct(("id_facultad", _I, False), ("nombre", _S, False)),
    "programas_academicos": _struct(
        ("nombre_programa", _S, False), ("id_facultad", _I, False), ("tipo", _S, False)
    ),
    "participantes_programa_academico": _struct(
        ("id_alumno_programa", _L, False),
        ("ci_participante", _S, False),
        ("nombre_programa", _S, False),
        ("rol", _S, True),
    ),
    "edificio": _struct(
        ("nombre_edificio", _S, False), ("direccion", _S, True), ("departamento", _S, True)
    ),
    "sala": _struct(
        ("nombre_sala", _S, False),
        ("edificio", _S, False),
        ("capacidad", _SH, False),
        ("tipo_sala", _S, True),
    ),
    "turno": _struct(("id_turno", _I, False), ("inicio_min", _I, False), ("fin_min", _I, False)),
    "reserva": _struct(
        ("id_reserva", _L, False),
        ("nombre_sala", _S, False),
        ("edificio", _S, False),
        ("fecha", _D, False),
        ("id_turno", _I, False),
        ("estado", _S, False),
    ),
    "reserva_participante": _struct(
        ("ci_participante", _S, False),
        ("id_reserva", _L, False),
        ("fecha_solicitud_reserva", _D, False),
        ("asistencia", _B, True),
        ("confirmado", _B, True),
    ),
    "sancion_participante": _struct(
        ("id_sancion", _L, False),
        ("ci_participante", _S, False),
        ("fecha_inicio", _D, False),
        ("fecha_fin", _D, False),
        ("activa", _B, False),
    ),
    "notificacion": _struct(
        ("id_notificacion", _L, False),
        ("ci_participante", _S, False),
        ("mensaje", _S, False),
        ("fecha", _TS, True),
        ("leida", _B, True),
    ),
}

#: Primary and unique keys.
KEYS: dict[str, list[list[str]]] = {
    "participantes": [["ci"], ["email"]],
    "facultad": [["id_facultad"], ["nombre"]],
    "programas_academicos": [["nombre_programa"]],
    "participantes_programa_academico": [["id_alumno_programa"]],
    "edificio": [["nombre_edificio"]],
    "sala": [["nombre_sala", "edificio"]],
    "turno": [["id_turno"]],
    "reserva": [["id_reserva"]],
    "reserva_participante": [["ci_participante", "id_reserva"]],
    "sancion_participante": [["id_sancion"]],
    "notificacion": [["id_notificacion"]],
}


class Reference(NamedTuple):
    child: str
    child_cols: list[str]
    parent: str
    parent_cols: list[str]


REFERENCES: list[Reference] = [
    Reference("programas_academicos", ["id_facultad"], "facultad", ["id_facultad"]),
    Reference("participantes_programa_academico", ["ci_participante"], "participantes", ["ci"]),
    Reference(
        "participantes_programa_academico",
        ["nombre_programa"],
        "programas_academicos",
        ["nombre_programa"],
    ),
    Reference("sala", ["edificio"], "edificio", ["nombre_edificio"]),
    Reference("reserva", ["nombre_sala", "edificio"], "sala", ["nombre_sala", "edificio"]),
    Reference("reserva", ["id_turno"], "turno", ["id_turno"]),
    Reference("reserva_participante", ["ci_participante"], "participantes", ["ci"]),
    Reference("reserva_participante", ["id_reserva"], "reserva", ["id_reserva"]),
    Reference("sancion_participante", ["ci_participante"], "participantes", ["ci"]),
    Reference("notificacion", ["ci_participante"], "participantes", ["ci"]),
]

#: Closed sets of values; NULL is allowed where the column is nullable.
DOMAINS: dict[tuple[str, str], tuple[str, ...]] = {
    ("programas_academicos", "tipo"): fixed.TIPOS_PROGRAMA,
    ("participantes_programa_academico", "rol"): fixed.ROLES,
    ("sala", "tipo_sala"): fixed.TIPOS_SALA,
    ("reserva", "estado"): fixed.ESTADOS,
}

#: Longest text each column holds.
LENGTHS: dict[tuple[str, str], int] = {
    ("participantes", "ci"): 8,
    ("participantes", "nombre"): 50,
    ("participantes", "apellido"): 50,
    ("participantes", "email"): 150,
    ("facultad", "nombre"): 100,
    ("programas_academicos", "nombre_programa"): 150,
    ("edificio", "nombre_edificio"): 100,
    ("sala", "nombre_sala"): 50,
    ("notificacion", "mensaje"): 255,
}

#: Request batches (one row per submitted form).
REQUESTS: dict[str, T.StructType] = {
    "booking": _struct(
        ("request_id", _L, True),
        ("request_ts", _TS, True),
        ("ci", _S, True),
        ("nombre_sala", _S, True),
        ("edificio", _S, True),
        ("fecha", _D, True),
        ("id_turno", _I, True),
    ),
    "join": _struct(
        ("request_id", _L, True), ("request_ts", _TS, True), ("ci", _S, True), ("id_reserva", _L, True)
    ),
    "add": _struct(
        ("request_id", _L, True), ("request_ts", _TS, True), ("ci", _S, True), ("id_reserva", _L, True)
    ),
    "cancel": _struct(("ci", _S, True), ("id_reserva", _L, True)),
    "edit": _struct(
        ("id_reserva", _L, True),
        ("fecha_nueva", _D, True),
        ("id_turno_nuevo", _I, True),
        ("estado_nuevo", _S, True),
    ),
    "attendance": _struct(("ci", _S, True), ("id_reserva", _L, True), ("asistencia", _B, True)),
    "sanction": _struct(("request_id", _L, True), ("ci", _S, True), ("fecha_fin", _D, True)),
    "sanction_edit": _struct(
        ("request_id", _L, True),
        ("ci", _S, True),
        ("fecha_inicio", _D, True),
        ("fecha_fin", _D, True),
        ("activa", _B, True),
    ),
    "participant": _struct(
        ("request_id", _L, True),
        ("ci", _S, True),
        ("nombre", _S, True),
        ("apellido", _S, True),
        ("email", _S, True),
        ("programa", _S, True),
        ("rol", _S, True),
    ),
    "room": _struct(
        ("request_id", _L, True),
        ("nombre_sala", _S, True),
        ("edificio", _S, True),
        ("capacidad", _S, True),
        ("tipo_sala", _S, True),
    ),
}

#: Change feeds (row before and after an update).
CHANGES: dict[str, T.StructType] = {
    "reserva": _struct(
        ("id_reserva", _L, True),
        ("version", _L, True),
        ("estado_old", _S, True),
        ("estado_new", _S, True),
        ("changed_at", _TS, True),
    ),
    "confirmado": _struct(
        ("ci", _S, True),
        ("id_reserva", _L, True),
        ("version", _L, True),
        ("confirmado_old", _B, True),
        ("confirmado_new", _B, True),
        ("changed_at", _TS, True),
    ),
    "asistencia": _struct(
        ("ci", _S, True), ("id_reserva", _L, True), ("asistencia", _B, True), ("marked_at", _TS, True)
    ),
}
