"""DuckDB SQL the registered queries are checked against.

Every statement is self-contained: the views it names are prepended as CTEs over the raw tables.
The SQL follows the questions in their plain relational form (row-level windows, correlated
EXISTS), on purpose not the shape of the Spark plans.
"""

from __future__ import annotations

import re

from aulario.sources.schema import DOMAINS, KEYS, LENGTHS, REFERENCES, TABLES

NOW = "TIMESTAMP '2025-02-01 12:00:00'"
TODAY = "DATE '2025-02-01'"
MONDAY, SUNDAY = "DATE '2025-01-27'", "DATE '2025-02-02'"
TWO_MONTHS = "DATE '2025-04-01'"

VIEWS: dict[str, str] = {}

# --- the booking model -----------------------------------------------------------------------
VIEWS["facultad"] = "SELECT r_regionkey AS id_facultad, r_name AS nombre FROM region"
VIEWS["programas_academicos"] = """
SELECT n_name AS nombre_programa, n_regionkey AS id_facultad,
       CASE WHEN n_nationkey % 3 = 0 THEN 'Posgrado' ELSE 'Grado' END AS tipo FROM nation"""
VIEWS["participantes"] = """
SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS ci, c_mktsegment AS nombre, c_name AS apellido,
       concat('c', c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN '@ucu.edu.uy'
                                   ELSE '@correo.ucu.edu.uy' END) AS email FROM customer"""
VIEWS["ppa"] = """
SELECT 2 * c_custkey AS id_alumno_programa, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS ci_participante,
       n_name AS nombre_programa, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Docente' ELSE 'Estudiante' END AS rol
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 50 <> 0
UNION ALL
SELECT 2 * c_custkey + 1, lpad(CAST(c_custkey AS VARCHAR), 8, '0'), n_name,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Docente' ELSE 'Estudiante' END
FROM customer JOIN nation ON n_nationkey = (c_nationkey + 1) % 25 WHERE c_custkey % 20 = 1"""
VIEWS["edificio_v"] = "SELECT concat('Edificio ', n_name) AS nombre_edificio FROM nation"
VIEWS["sala_k"] = """
SELECT s_name AS nombre_sala, concat('Edificio ', n_name) AS edificio, CAST(2 + s_suppkey % 9 AS SMALLINT) AS capacidad,
       CASE s_suppkey % 3 WHEN 0 THEN 'Libre' WHEN 1 THEN 'Posgrado' ELSE 'Docente' END AS tipo_sala, s_suppkey
FROM supplier JOIN nation ON n_nationkey = s_nationkey"""
VIEWS["sala"] = "SELECT nombre_sala, edificio, capacidad, tipo_sala FROM sala_k"
VIEWS["turno"] = """
SELECT CAST(i AS INTEGER) AS id_turno, CAST((7 + i) * 60 AS INTEGER) AS inicio_min,
       CAST((8 + i) * 60 AS INTEGER) AS fin_min FROM (SELECT DISTINCT 1 + n_nationkey % 15 AS i FROM nation)"""
VIEWS["reserva"] = """
SELECT o.o_orderkey AS id_reserva, s.nombre_sala, s.edificio,
       DATE '2025-01-01' + CAST(o.o_orderkey % 60 AS INTEGER) AS fecha,
       CAST(1 + o.k + CASE WHEN o.k = 2 THEN o.room % 3 ELSE 0 END + o.o_orderkey % 10 AS INTEGER) AS id_turno,
       CASE WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 2 = 0 THEN 'Cancelada'
            WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 3 = 0 THEN 'Sin Asistencia'
            WHEN o.o_orderstatus = 'F' THEN 'Finalizada' ELSE 'Activa' END AS estado
FROM (SELECT o_orderkey, o_orderstatus, (o_orderkey // 60) % (SELECT count(*) FROM supplier) AS room,
             o_orderkey // (60 * (SELECT count(*) FROM supplier)) AS k FROM orders) o
JOIN sala_k s ON s.s_suppkey = o.room"""
VIEWS["rp"] = """
SELECT lpad(CAST(x.c AS VARCHAR), 8, '0') AS ci_participante, x.id_reserva,
       r.fecha - x.dias AS fecha_solicitud_reserva,
       x.vino AND r.estado NOT IN ('Sin Asistencia', 'Cancelada') AS asistencia, x.confirmado
FROM (SELECT (l_partkey * 31 + l_suppkey) % (SELECT count(*) FROM customer) AS c, l_orderkey AS id_reserva,
             CAST(max(l_quantity) AS INTEGER) AS dias,
             bool_or(l_returnflag = 'A') AND l_orderkey % 4 <> 0 AS vino,
             NOT bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AS confirmado
      FROM lineitem GROUP BY 1, 2) x JOIN reserva r USING (id_reserva)"""
VIEWS["sancion"] = """
SELECT o_orderkey AS id_sancion, lpad(CAST(o_custkey // 4 AS VARCHAR), 8, '0') AS ci_participante,
       DATE '2025-01-01' + CAST(o_orderkey % 97 AS INTEGER) AS fecha_inicio,
       DATE '2025-01-01' + CAST(o_orderkey % 97 + o_custkey % 40 AS INTEGER) AS fecha_fin,
       o_orderstatus <> 'F' AND o_orderkey % 10 = 0 AS activa
FROM orders"""
VIEWS["notificacion"] = """
SELECT event_id AS id_notificacion, lpad(CAST(user_id AS VARCHAR), 8, '0') AS ci_participante,
       event_type AS mensaje, ts AS fecha, value < 50 AS leida FROM events"""

# --- request and change batches --------------------------------------------------------------
VIEWS["q_booking"] = """
SELECT o.o_orderkey AS request_id, o.o_orderdate AS request_ts, lpad(CAST(o.o_custkey AS VARCHAR), 8, '0') AS ci,
       s.nombre_sala, s.edificio, DATE '2025-01-28' + CAST((o.o_orderkey // 5) % 12 AS INTEGER) AS fecha,
       CAST(1 + o.o_custkey % 16 AS INTEGER) AS id_turno
FROM orders o LEFT JOIN sala_k s
  ON s.s_suppkey = (o.o_custkey * 7 + o.o_orderkey) % ((SELECT count(*) FROM supplier) + 1)"""
VIEWS["q_join"] = """
SELECT o_orderkey AS request_id, o_orderdate AS request_ts, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS ci,
       (o_orderkey * 13) % ((SELECT count(*) FROM orders) + 50) AS id_reserva FROM orders"""
VIEWS["q_cancel"] = """
SELECT ci_participante AS ci, id_reserva FROM rp WHERE NOT asistencia
UNION ALL SELECT '99999999', o_orderkey FROM orders"""
VIEWS["q_edit"] = """
SELECT id_reserva, DATE '2025-01-30' + CAST(id_reserva % 25 AS INTEGER) AS fecha_nueva,
       CAST(1 + id_reserva % 15 AS INTEGER) AS id_turno_nuevo,
       CASE WHEN id_reserva % 7 = 5 THEN 'Pospuesta' WHEN id_reserva % 3 = 0 THEN 'cancelada'
            WHEN id_reserva % 3 = 1 THEN 'Activa' ELSE 'Sin asistencia' END AS estado_nuevo
FROM reserva"""
VIEWS["q_attendance"] = """
SELECT ci_participante AS ci, id_reserva, id_reserva % 2 = 0 AS asistencia FROM rp"""
VIEWS["q_sanction"] = """
SELECT o_orderkey AS request_id,
       CASE WHEN o_orderkey % 70 = 5 THEN '12A' ELSE lpad(CAST(o_custkey // 4 AS VARCHAR), 8, '0') END AS ci,
       DATE '2025-01-25' + CAST(o_orderkey % 61 AS INTEGER) AS fecha_fin FROM orders"""
VIEWS["q_sanction_edit"] = """
SELECT id_sancion AS request_id, ci_participante AS ci, fecha_inicio,
       fecha_inicio + CAST(id_sancion % 90 - 10 AS INTEGER) AS fecha_fin, id_sancion % 3 <> 0 AS activa FROM sancion"""
VIEWS["q_participant"] = """
SELECT p_partkey AS request_id, CAST(10000000 + p_partkey * 37 AS VARCHAR) AS ci, p_name AS nombre,
       CASE WHEN p_partkey % 11 = 0 THEN p_brand ELSE concat('o''', lower(p_type)) END AS apellido,
       concat('p', (p_partkey // 2) * 2, CASE WHEN p_partkey % 7 = 0 THEN '@other.org'
                                              ELSE '@correo.ucu.edu.uy' END) AS email,
       n_name AS programa, 'Estudiante' AS rol
FROM part JOIN nation ON n_nationkey = p_partkey % 25"""
VIEWS["q_participant_edit"] = """
SELECT * REPLACE (lpad(CAST(request_id AS VARCHAR), 8, '0') AS ci) FROM q_participant"""
VIEWS["q_room"] = """
SELECT p_partkey AS request_id, CASE WHEN p_partkey % 9 = 0 THEN p_brand ELSE p_name END AS nombre_sala,
       concat('Edificio ', n_name) AS edificio, CAST(p_size * 2 - 3 AS VARCHAR) AS capacidad, 'Libre' AS tipo_sala
FROM part JOIN nation ON n_nationkey = p_partkey % 25"""
VIEWS["q_room_edit"] = """
SELECT nombre_sala, edificio, CAST(s_suppkey % 70 - 3 AS VARCHAR) AS capacidad,
       CASE WHEN s_suppkey % 2 = 0 THEN 'libre' ELSE 'DOCENTE' END AS tipo_sala FROM sala_k"""
VIEWS["q_leavers"] = """
SELECT ci FROM participantes UNION ALL SELECT '99999999'"""
VIEWS["c_state"] = """
SELECT id_reserva, CASE WHEN id_reserva % 5 = 0 THEN 'Sin Asistencia' ELSE 'Activa' END AS estado_old,
       CASE WHEN id_reserva % 7 = 0 THEN 'Finalizada' ELSE 'Sin Asistencia' END AS estado_new FROM reserva"""
VIEWS["c_withdrawal"] = "SELECT ci_participante AS ci, id_reserva FROM rp WHERE confirmado AND NOT asistencia"

# --- shared answers --------------------------------------------------------------------------
VIEWS["base"] = """
SELECT r.*, s.capacidad, s.tipo_sala FROM reserva r JOIN sala s USING (nombre_sala, edificio)"""
VIEWS["base_f"] = """
SELECT * FROM base WHERE fecha BETWEEN DATE '2025-01-08' AND DATE '2025-02-20' AND tipo_sala = 'Posgrado'"""
VIEWS["persona"] = """
SELECT p.ci_participante AS ci, p.rol, g.tipo FROM ppa p JOIN programas_academicos g USING (nombre_programa)
QUALIFY row_number() OVER (PARTITION BY p.ci_participante ORDER BY p.id_alumno_programa) = 1"""
VIEWS["sancionado"] = f"""
SELECT ci_participante AS ci, max(fecha_fin) AS fin FROM sancion
WHERE activa AND {TODAY} BETWEEN fecha_inicio AND fecha_fin GROUP BY ALL"""
VIEWS["confirmados"] = "SELECT id_reserva, count(*) AS n FROM rp WHERE confirmado GROUP BY ALL"
VIEWS["asistida"] = "SELECT DISTINCT id_reserva FROM rp WHERE asistencia"
VIEWS["fin_de"] = """
SELECT r.id_reserva, r.fecha + to_minutes(t.fin_min) AS fin FROM reserva r JOIN turno t USING (id_turno)"""
VIEWS["uso"] = """
SELECT p.ci_participante AS ci, r.fecha, p.confirmado, date_trunc('week', r.fecha)::DATE AS lunes,
       CAST(year(r.fecha) AS INTEGER) AS anio, CAST(strftime(r.fecha, '%U') AS INTEGER) AS semana
FROM rp p JOIN reserva r USING (id_reserva) WHERE r.estado = 'Activa'"""

_VERDICT = "CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS verdict"



def _before(x: str, condition: str) -> str:
    """Requests granted before request q, as a source to count."""
    return f"FROM {x}_dado g WHERE {condition} AND (g.request_ts, g.request_id) < (q.request_ts, q.request_id)"


_SAME_SLOT = "g.nombre_sala = q.nombre_sala AND g.edificio = q.edificio AND g.fecha = q.fecha AND g.id_turno = q.id_turno"
_DAY_USE = "(SELECT count(*) FROM uso u WHERE u.ci = q.ci AND u.fecha = q.fecha)"
_WEEK_USE = f"(SELECT count(*) FROM uso u WHERE u.ci = q.ci AND u.fecha BETWEEN {MONDAY} AND {SUNDAY})"
_SUNDAY_USE = """(SELECT count(*) FROM uso u WHERE u.ci = q.ci
       AND u.anio = year(q.fecha) AND u.semana = CAST(strftime(q.fecha, '%U') AS INTEGER))"""


def _ad1(taken: str = "false", day: str = "0", week: str = "0") -> str:
    return f"""
SELECT request_id, request_ts, ci, nombre_sala, edificio, fecha, id_turno, rol, CASE
  WHEN EXISTS (FROM sancionado z WHERE z.ci = q.ci) THEN 'sanctioned'
  WHEN fecha < {TODAY} THEN 'past_date'
  WHEN fecha = {TODAY} AND inicio_min IS NULL THEN 'unknown_turno'
  WHEN fecha = {TODAY} AND fecha + to_minutes(inicio_min) < {NOW} THEN 'turno_started'
  WHEN EXISTS (FROM reserva r WHERE r.estado = 'Activa' AND r.nombre_sala = q.nombre_sala AND r.edificio = q.edificio
               AND r.fecha = q.fecha AND r.id_turno = q.id_turno) OR {taken} THEN 'slot_taken'
  WHEN rol IS NULL THEN 'no_type'
  WHEN tipo_sala IS NULL THEN 'unknown_room'
  WHEN tipo_sala = 'Docente' AND rol <> 'Docente' THEN 'room_for_docentes'
  WHEN tipo_sala = 'Posgrado' AND NOT (rol = 'Estudiante' AND tipo = 'Posgrado') THEN 'room_for_posgrado'
  WHEN rol = 'Estudiante' AND {_DAY_USE} + {day} >= 2 THEN 'daily_limit'
  WHEN rol = 'Estudiante' AND {_WEEK_USE} + {week} >= 3 THEN 'weekly_limit'
  WHEN inicio_min IS NULL THEN 'unknown_turno' END AS reason
FROM q_booking q LEFT JOIN persona USING (ci) LEFT JOIN turno USING (id_turno) LEFT JOIN sala USING (nombre_sala, edificio)"""


def _ad2(taken: str = "false", day: str = "0", week: str = "0") -> str:
    return f"""
SELECT request_id, request_ts, ci, nombre_sala, edificio, fecha, id_turno, rol, tipo, CASE
  WHEN fecha < {TODAY} THEN 'past_date'
  WHEN fecha = {TODAY} AND fecha + to_minutes(inicio_min) <= {NOW} THEN 'turno_started'
  WHEN NOT regexp_full_match(ci, '[0-9]{{7,8}}') THEN 'bad_ci'
  WHEN ci NOT IN (SELECT ci FROM participantes) THEN 'unknown_participant'
  WHEN rol IS NULL THEN 'no_programme'
  WHEN tipo_sala IS NULL THEN 'unknown_room'
  WHEN tipo_sala = 'Docente' AND rol <> 'Docente' THEN 'room_for_docentes'
  WHEN tipo_sala = 'Posgrado' AND NOT (rol = 'Estudiante' AND tipo = 'Posgrado') THEN 'room_for_posgrado'
  WHEN EXISTS (FROM sancionado z WHERE z.ci = q.ci) THEN 'sanctioned'
  WHEN rol = 'Estudiante' AND tipo = 'Grado' AND {_DAY_USE} + {day} >= 2 THEN 'daily_limit'
  WHEN rol = 'Estudiante' AND tipo = 'Grado' AND {_SUNDAY_USE} + {week} >= 3 THEN 'weekly_limit'
  WHEN EXISTS (FROM reserva r WHERE r.estado = 'Activa' AND r.nombre_sala = q.nombre_sala AND r.edificio = q.edificio
               AND r.fecha = q.fecha AND r.id_turno = q.id_turno) OR {taken} THEN 'slot_taken'
  WHEN inicio_min IS NULL THEN 'unknown_turno' END AS reason
FROM q_booking q LEFT JOIN persona USING (ci) LEFT JOIN turno USING (id_turno) LEFT JOIN sala USING (nombre_sala, edificio)"""
_JOIN_DAY_USE = "(SELECT count(*) FROM uso u WHERE u.confirmado AND u.ci = q.ci AND u.fecha = b.fecha)"
_JOIN_WEEK_USE = f"(SELECT count(*) FROM uso u WHERE u.confirmado AND u.ci = q.ci AND u.fecha BETWEEN {MONDAY} AND {SUNDAY})"


def _ad3(there: str = "false", seats: str = "0", day: str = "0", week: str = "0") -> str:
    return f"""
SELECT q.request_id, q.request_ts, q.ci, q.id_reserva, b.fecha, b.capacidad, h.rol, p.ci_participante IS NOT NULL AS fila, CASE
  WHEN b.estado IS NULL OR b.estado <> 'Activa' THEN 'not_active'
  WHEN EXISTS (FROM sancionado z WHERE z.ci = q.ci) THEN 'sanctioned'
  WHEN b.tipo_sala = 'Posgrado' AND h.rol = 'Estudiante' THEN 'room_for_posgrado'
  WHEN b.tipo_sala = 'Docente' AND h.rol IS DISTINCT FROM 'Docente' THEN 'room_for_docentes'
  WHEN p.confirmado OR {there} THEN 'already_confirmed'
  WHEN coalesce(c.n, 0) + {seats} >= b.capacidad THEN 'full'
  WHEN h.rol = 'Estudiante' AND {_JOIN_DAY_USE} + {day} >= 2 THEN 'daily_limit'
  WHEN h.rol = 'Estudiante' AND {_JOIN_WEEK_USE} + {week} >= 3 THEN 'weekly_limit' END AS reason
FROM q_join q LEFT JOIN base b ON b.id_reserva = q.id_reserva LEFT JOIN persona h ON h.ci = q.ci
LEFT JOIN confirmados c ON c.id_reserva = q.id_reserva
LEFT JOIN rp p ON p.ci_participante = q.ci AND p.id_reserva = q.id_reserva"""


def _ad4(there: str = "false", seats: str = "0") -> str:
    return f"""
SELECT q.request_id, q.request_ts, q.ci, q.id_reserva, b.capacidad, CASE
  WHEN b.estado IS NULL THEN 'unknown_reservation'
  WHEN b.estado <> 'Activa' THEN 'not_active'
  WHEN NOT regexp_full_match(q.ci, '[0-9]{{7,8}}') THEN 'bad_ci'
  WHEN q.ci NOT IN (SELECT ci FROM participantes) THEN 'unknown_participant'
  WHEN h.rol IS NULL THEN 'no_programme'
  WHEN b.tipo_sala = 'Docente' AND h.rol <> 'Docente' THEN 'room_for_docentes'
  WHEN b.tipo_sala = 'Posgrado' AND NOT (h.rol = 'Estudiante' AND h.tipo = 'Posgrado') THEN 'room_for_posgrado'
  WHEN EXISTS (FROM sancionado z WHERE z.ci = q.ci) THEN 'sanctioned'
  WHEN (SELECT count(*) FROM rp WHERE rp.id_reserva = q.id_reserva) + {seats} >= b.capacidad THEN 'full'
  WHEN EXISTS (FROM rp WHERE rp.id_reserva = q.id_reserva AND rp.ci_participante = q.ci) OR {there} THEN 'already_present' END AS reason
FROM q_join q LEFT JOIN base b ON b.id_reserva = q.id_reserva LEFT JOIN persona h ON h.ci = q.ci"""


VIEWS |= {"ad1": _ad1(), "ad2": _ad2(), "ad3": _ad3(), "ad4": _ad4()}

# --- the same requests one after the other ---------------------------------------------------
# Requests no rule refuses outright are folded in order: a state of units used per resource, a row
# '#' with the number of the last request, and a row 'g' per grant. One request is looked at a step.


def _unit(key: str, free: str, uses: str = "true", bound: str = "true") -> str:
    return f"{{'k': CASE WHEN {bound} THEN concat({key}) END, 'free': CAST({free} AS BIGINT), 'uses': {uses}}}"


def _one_by_one(x: str, units: list[str]) -> None:
    VIEWS[f"{x}_pedido"] = f"""
SELECT row_number() OVER (ORDER BY request_ts, request_id) AS n, request_id,
       list_filter([{", ".join(units)}], lambda c: c.k IS NOT NULL) AS claves FROM {x}_uso q"""
    VIEWS[f"{x}_turnos"] = f"""
SELECT '#' AS k, CAST(0 AS BIGINT) AS usado, CAST(0 AS BIGINT) AS n
UNION
SELECT e.k, e.usado, v.n FROM (
  SELECT p.n, p.request_id, bool_and(coalesce(f.usado, 0) < c.free) AS dado,
         list({{'k': c.k, 'usado': coalesce(f.usado, 0) + 1}}) FILTER (c.uses) AS toma
  FROM {x}_turnos w JOIN {x}_pedido p ON w.k = '#' AND p.n = w.n + 1, unnest(p.claves) AS t(c)
  LEFT JOIN recurring.{x}_turnos f ON f.k = c.k GROUP BY ALL) v,
  unnest(list_concat([{{'k': '#', 'usado': CAST(0 AS BIGINT)}}],
    CASE WHEN v.dado THEN list_prepend({{'k': concat('g', v.request_id), 'usado': CAST(1 AS BIGINT)}}, v.toma) END)) AS s(e)"""
    HEADS[f"{x}_turnos"] = "(k, usado, n) USING KEY (k)"
    VIEWS[f"{x}_dado"] = f"SELECT * FROM {x} WHERE concat('g', request_id) IN (SELECT k FROM {x}_turnos)"


HEADS: dict[str, str] = {}
_SLOT_UNIT = _unit("'s|', nombre_sala, '|', edificio, '|', fecha, '|', id_turno", "1")
_DAY_UNIT = "'d|', ci, '|', fecha"
VIEWS["ad1_uso"] = f"SELECT q.*, {_DAY_USE} AS dia, {_WEEK_USE} AS sem FROM ad1 q WHERE reason IS NULL"
_one_by_one("ad1", [
    _SLOT_UNIT,
    _unit(_DAY_UNIT, "2 - dia", bound="rol = 'Estudiante'"),
    _unit("'w|', ci", "3 - sem", f"fecha BETWEEN {MONDAY} AND {SUNDAY}", "rol = 'Estudiante'"),
])
VIEWS["ad2_uso"] = f"SELECT q.*, {_DAY_USE} AS dia, {_SUNDAY_USE} AS sem FROM ad2 q WHERE reason IS NULL"
_GRADO = "rol = 'Estudiante' AND tipo = 'Grado'"
_one_by_one("ad2", [
    _SLOT_UNIT,
    _unit(_DAY_UNIT, "2 - dia", bound=_GRADO),
    _unit("'w|', ci, '|', year(fecha), '|', strftime(fecha, '%U')", "3 - sem", bound=_GRADO),
])
VIEWS["ad3_uso"] = f"""
SELECT q.*, {_JOIN_DAY_USE.replace("b.fecha", "q.fecha")} AS dia, {_JOIN_WEEK_USE} AS sem,
       coalesce((SELECT n FROM confirmados c WHERE c.id_reserva = q.id_reserva), 0) AS gente FROM ad3 q WHERE reason IS NULL"""
_one_by_one("ad3", [
    _unit("'f|', ci, '|', id_reserva", "1"),
    _unit("'r|', id_reserva", "capacidad - gente"),
    _unit(_DAY_UNIT, "2 - dia", bound="rol = 'Estudiante'"),
    _unit("'w|', ci", "3 - sem", f"fecha BETWEEN {MONDAY} AND {SUNDAY}", "rol = 'Estudiante'"),
])
VIEWS["ad4_uso"] = """
SELECT q.*, (SELECT count(*) FROM rp WHERE rp.id_reserva = q.id_reserva) AS gente FROM ad4 q WHERE reason IS NULL"""
_one_by_one("ad4", [_unit("'f|', ci, '|', id_reserva", "1"), _unit("'r|', id_reserva", "capacidad - gente")])


def _count(x: str, condition: str) -> str:
    return f"(SELECT count(*) {_before(x, condition)})"


_SAME_DAY = "g.ci = q.ci AND g.fecha = {}"
_SAME_WEEK = f"g.ci = q.ci AND g.fecha BETWEEN {MONDAY} AND {SUNDAY}"
_SAME_SUNDAY_WEEK = "g.ci = q.ci AND year(g.fecha) = year(q.fecha) AND strftime(g.fecha, '%U') = strftime(q.fecha, '%U')"
_SAME_ROW = "g.ci = q.ci AND g.id_reserva = q.id_reserva"
VIEWS["ad1_seguido"] = _ad1(
    f"EXISTS ({_before('ad1', _SAME_SLOT)})", _count("ad1", _SAME_DAY.format("q.fecha")), _count("ad1", _SAME_WEEK)
)
VIEWS["ad2_seguido"] = _ad2(
    f"EXISTS ({_before('ad2', _SAME_SLOT)})", _count("ad2", _SAME_DAY.format("q.fecha")), _count("ad2", _SAME_SUNDAY_WEEK)
)
VIEWS["ad3_seguido"] = _ad3(
    f"EXISTS ({_before('ad3', _SAME_ROW)})", _count("ad3", "g.id_reserva = q.id_reserva"),
    _count("ad3", _SAME_DAY.format("b.fecha")), _count("ad3", _SAME_WEEK),
)
VIEWS["ad4_seguido"] = _ad4(f"EXISTS ({_before('ad4', _SAME_ROW)})", _count("ad4", "g.id_reserva = q.id_reserva"))

VIEWS["isla_fila"] = """
SELECT *, CASE WHEN lag(fin_min) OVER dia = inicio_min THEN 0 ELSE 1 END AS comienza_bloque
FROM (SELECT r.id_reserva, r.fecha, r.nombre_sala, r.edificio, r.id_turno, t.inicio_min, t.fin_min
      FROM reserva r JOIN turno t USING (id_turno) WHERE r.estado = 'Activa')
WINDOW dia AS (PARTITION BY fecha, nombre_sala, edificio ORDER BY inicio_min, id_reserva)"""
VIEWS["isla"] = """
SELECT *, CAST(sum(comienza_bloque) OVER (PARTITION BY fecha, nombre_sala, edificio ORDER BY inicio_min) AS BIGINT)
  AS bloque_id FROM isla_fila"""

# sweeps: state after finishing attended ones, then after unattended islands, then one by one
VIEWS["tras_sw1"] = f"""
SELECT r.* REPLACE (CASE WHEN r.estado = 'Activa' AND f.fin <= {NOW} AND r.id_reserva IN (FROM asistida)
                         THEN 'Finalizada' ELSE r.estado END AS estado)
FROM reserva r JOIN fin_de f USING (id_reserva)"""
VIEWS["isla2"] = """
SELECT *, sum(abre) OVER (PARTITION BY fecha, nombre_sala, edificio ORDER BY inicio_min) AS bloque_id
FROM (SELECT r.id_reserva, r.fecha, r.nombre_sala, r.edificio, t.inicio_min, t.fin_min,
             CASE WHEN lag(t.fin_min) OVER (PARTITION BY r.fecha, r.nombre_sala, r.edificio
                                            ORDER BY t.inicio_min, r.id_reserva) = t.inicio_min THEN 0 ELSE 1 END AS abre
      FROM tras_sw1 r JOIN turno t USING (id_turno) WHERE r.estado = 'Activa')"""
VIEWS["vacia"] = f"""
SELECT i.id_reserva FROM isla2 i JOIN (
  SELECT fecha, nombre_sala, edificio, bloque_id FROM isla2
  GROUP BY ALL HAVING count(*) FILTER (id_reserva IN (FROM asistida)) = 0
     AND max(fecha + to_minutes(fin_min)) <= {NOW} - INTERVAL 10 MINUTE) e
USING (fecha, nombre_sala, edificio, bloque_id)"""
VIEWS["tras_sw2"] = """
SELECT * REPLACE (CASE WHEN estado = 'Activa' AND id_reserva IN (FROM vacia) THEN 'Sin Asistencia' ELSE estado END AS estado)
FROM tras_sw1"""


def _overdue(source: str) -> str:
    return f"""
SELECT r.* REPLACE (CASE WHEN r.estado = 'Activa' AND f.fin < {NOW} - INTERVAL 10 MINUTE
                         THEN CASE WHEN r.id_reserva IN (FROM asistida) THEN 'Finalizada' ELSE 'Sin Asistencia' END
                         ELSE r.estado END AS estado)
FROM {source} r JOIN fin_de f USING (id_reserva)"""


VIEWS["tras_sw3"] = _overdue("tras_sw2")
VIEWS["solo_sw3"] = _overdue("reserva")

# effects of batches
VIEWS["cancelado"] = """
SELECT q.ci, q.id_reserva, p.ci_participante IS NOT NULL AS fila, coalesce(p.confirmado, false) AS confirmaba
FROM q_cancel q LEFT JOIN rp p ON p.ci_participante = q.ci AND p.id_reserva = q.id_reserva"""
VIEWS["tras_ch2"] = """
SELECT p.* REPLACE (p.confirmado AND c.ci IS NULL AS confirmado)
FROM rp p LEFT JOIN q_cancel c ON c.ci = p.ci_participante AND c.id_reserva = p.id_reserva"""
VIEWS["vaciada_ch2"] = """
SELECT DISTINCT id_reserva FROM cancelado c WHERE fila
AND NOT EXISTS (FROM tras_ch2 p WHERE p.id_reserva = c.id_reserva AND p.confirmado)"""
VIEWS["ch3"] = """
SELECT q.ci, q.id_reserva, CASE WHEN r.estado IS NULL THEN 'unknown_reservation'
                                WHEN r.estado <> 'Activa' THEN 'not_active' END AS reason
FROM q_cancel q LEFT JOIN reserva r USING (id_reserva)"""
VIEWS["tras_ch3"] = """
SELECT * FROM rp p WHERE NOT EXISTS (FROM ch3 c WHERE c.reason IS NULL AND c.ci = p.ci_participante AND c.id_reserva = p.id_reserva)"""
VIEWS["ch4_uno"] = f"""
SELECT q.*, r.nombre_sala, r.edificio, r.estado AS estado_previo, CASE lower(q.estado_nuevo) WHEN 'cancelada' THEN 'Cancelada'
         WHEN 'activa' THEN 'Activa' WHEN 'sin asistencia' THEN 'Sin Asistencia' END AS estado_final,
  CASE WHEN r.id_reserva IS NULL THEN 'unknown_reservation'
       WHEN q.fecha_nueva < {TODAY} THEN 'past_date'
       WHEN q.fecha_nueva = {TODAY} AND q.fecha_nueva + to_minutes(t.inicio_min) <= {NOW} THEN 'turno_started'
       WHEN EXISTS (FROM reserva o WHERE o.estado = 'Activa' AND o.nombre_sala = r.nombre_sala AND o.edificio = r.edificio
            AND o.fecha = q.fecha_nueva AND o.id_turno = q.id_turno_nuevo AND o.id_reserva <> q.id_reserva) THEN 'slot_taken'
       WHEN t.id_turno IS NULL THEN 'unknown_turno'
       WHEN lower(q.estado_nuevo) NOT IN ('activa', 'cancelada', 'sin asistencia', 'finalizada') THEN 'bad_state' END AS reason
FROM q_edit q LEFT JOIN reserva r ON r.id_reserva = q.id_reserva LEFT JOIN turno t ON t.id_turno = q.id_turno_nuevo"""
VIEWS["ch4"] = """
SELECT * REPLACE (CASE WHEN reason IS NULL AND estado_final = 'Activa' AND id_reserva >
    min(id_reserva) FILTER (reason IS NULL AND estado_final = 'Activa')
      OVER (PARTITION BY nombre_sala, edificio, fecha_nueva, id_turno_nuevo) THEN 'slot_taken' ELSE reason END AS reason)
FROM ch4_uno"""
# the same edits one after the other, in the order of the reservation; rooms do not touch one another, so
# each step looks at one edit per room: rows '#' say how far a room is, 'g' what was granted, the rest
# how many hold a slot
VIEWS["ch4_hecho"] = f"""
SELECT q.*, r.nombre_sala, r.edificio, r.estado AS estado_previo, CASE lower(q.estado_nuevo) WHEN 'cancelada' THEN 'Cancelada'
         WHEN 'activa' THEN 'Activa' WHEN 'sin asistencia' THEN 'Sin Asistencia' END AS estado_final,
  concat(r.nombre_sala, '|', r.edificio) AS sala_e,
  CASE WHEN r.estado = 'Activa' THEN concat(r.nombre_sala, '|', r.edificio, '|', r.fecha, '|', r.id_turno) END AS origen,
  concat(r.nombre_sala, '|', r.edificio, '|', q.fecha_nueva, '|', q.id_turno_nuevo) AS destino,
  CASE WHEN r.id_reserva IS NULL THEN 'unknown_reservation'
       WHEN q.fecha_nueva < {TODAY} THEN 'past_date'
       WHEN q.fecha_nueva = {TODAY} AND q.fecha_nueva + to_minutes(t.inicio_min) <= {NOW} THEN 'turno_started' END AS antes,
  CASE WHEN t.id_turno IS NULL THEN 'unknown_turno'
       WHEN lower(q.estado_nuevo) NOT IN ('activa', 'cancelada', 'sin asistencia', 'finalizada') THEN 'bad_state' END AS despues
FROM q_edit q LEFT JOIN reserva r ON r.id_reserva = q.id_reserva LEFT JOIN turno t ON t.id_turno = q.id_turno_nuevo"""
VIEWS["ch4_pedido"] = """
SELECT id_reserva, sala_e, origen, destino, estado_final = 'Activa' AS queda,
       row_number() OVER (PARTITION BY sala_e ORDER BY id_reserva) AS n
FROM ch4_hecho WHERE antes IS NULL AND despues IS NULL"""
VIEWS["ch4_inicio"] = """
SELECT origen AS k, count(*) AS n FROM (SELECT concat(nombre_sala, '|', edificio, '|', fecha, '|', id_turno) AS origen
  FROM reserva WHERE estado = 'Activa') GROUP BY ALL"""
VIEWS["ch4_turnos"] = """
SELECT DISTINCT concat('#', sala_e) AS k, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS paso FROM ch4_pedido
UNION
SELECT e.k, e.n, v.paso FROM (
  SELECT p.*, p.n AS paso, coalesce(d.n, di.n, 0) AS en_destino, coalesce(o.n, oi.n, 0) AS en_origen,
         p.origen IS NOT DISTINCT FROM p.destino AS ya_esta
  FROM ch4_turnos w JOIN ch4_pedido p ON w.k = concat('#', p.sala_e) AND p.n = w.paso + 1
  LEFT JOIN recurring.ch4_turnos d ON d.k = p.destino LEFT JOIN ch4_inicio di ON di.k = p.destino
  LEFT JOIN recurring.ch4_turnos o ON o.k = p.origen LEFT JOIN ch4_inicio oi ON oi.k = p.origen) v,
  unnest(list_filter(list_concat([{'k': concat('#', v.sala_e), 'n': CAST(0 AS BIGINT)}],
    CASE WHEN v.en_destino - CAST(v.ya_esta AS INTEGER) = 0 THEN [
      {'k': concat('g', v.id_reserva), 'n': CAST(1 AS BIGINT)},
      {'k': CASE WHEN v.origen IS NOT NULL AND NOT (v.ya_esta AND v.queda) THEN v.origen END, 'n': CAST(v.en_origen - 1 AS BIGINT)},
      {'k': CASE WHEN v.queda AND NOT v.ya_esta THEN v.destino END, 'n': CAST(v.en_destino + 1 AS BIGINT)}] END),
    lambda y: y.k IS NOT NULL)) AS s(e)"""
HEADS["ch4_turnos"] = "(k, n, paso) USING KEY (k)"
VIEWS["ch4_dado"] = "SELECT * FROM ch4_hecho WHERE concat('g', id_reserva) IN (SELECT k FROM ch4_turnos)"
# edits that fail anyway say so only if the slot was free at their turn
VIEWS["ch4_seguido"] = """
SELECT h.*, coalesce(h.antes, CASE WHEN h.despues IS NULL THEN CASE WHEN d.id_reserva IS NULL THEN 'slot_taken' END
  WHEN EXISTS (FROM ch4_hecho o WHERE o.origen = h.destino AND o.id_reserva <> h.id_reserva AND NOT EXISTS (FROM ch4_dado g
         WHERE g.id_reserva = o.id_reserva AND g.id_reserva < h.id_reserva AND NOT (g.destino = g.origen AND g.estado_final = 'Activa')))
    OR EXISTS (FROM ch4_dado g WHERE g.destino = h.destino AND g.estado_final = 'Activa' AND g.id_reserva < h.id_reserva)
    THEN 'slot_taken' ELSE h.despues END) AS reason
FROM ch4_hecho h LEFT JOIN ch4_dado d ON d.id_reserva = h.id_reserva"""
VIEWS["pr1_ch4"] = """
SELECT p.ci_participante AS ci, min(p.id_reserva) AS id_reserva FROM rp p JOIN ch4 c USING (id_reserva)
WHERE c.reason IS NULL AND c.estado_final = 'Sin Asistencia' AND c.estado_previo <> 'Sin Asistencia'
AND NOT EXISTS (FROM sancion s WHERE s.ci_participante = p.ci_participante AND s.activa) GROUP BY ALL"""
VIEWS["ch5"] = f"""
SELECT q.id_reserva, CASE WHEN r.estado IS NULL THEN 'unknown_reservation'
   WHEN r.estado <> 'Activa' OR {NOW} > f.fin + INTERVAL 10 MINUTE THEN 'not_editable' END AS reason
FROM (SELECT DISTINCT id_reserva FROM q_attendance) q LEFT JOIN reserva r USING (id_reserva) LEFT JOIN fin_de f USING (id_reserva)"""
VIEWS["ch6"] = """
SELECT q.ci, CASE WHEN p.ci IS NULL THEN 'unknown_participant' WHEN p.email = 'administrativo@ucu.edu.uy' THEN 'protected'
   WHEN q.ci IN (SELECT ci_participante FROM notificacion) THEN 'has_notifications' END AS reason
FROM (SELECT DISTINCT ci FROM q_leavers) q LEFT JOIN participantes p USING (ci)"""
VIEWS["fuera"] = "SELECT ci FROM ch6 WHERE reason IS NULL"


def _proper(c: str) -> str:
    return (
        f"array_to_string(list_transform(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''), "
        f"lambda w: array_to_string(list_transform(string_split(w, ''''), lambda s: upper(s[1:1]) || lower(s[2:])), '''')), ' ')"
    )


_NAME_RULES = f"""
   WHEN NOT regexp_full_match(nombre, '[A-Za-zÀ-ÿ'' ]+') THEN 'bad_name'
   WHEN NOT regexp_full_match(apellido, '[A-Za-zÀ-ÿ'' ]+') THEN 'bad_surname'
   WHEN length({_proper('nombre')}) > 50 THEN 'name_too_long'
   WHEN length({_proper('apellido')}) > 50 THEN 'surname_too_long'"""
_DOMAIN = "(CASE WHEN lower(rol) = 'estudiante' THEN email LIKE '%@correo.ucu.edu.uy' ELSE email LIKE '%@ucu.edu.uy' END)"
_DIGIT = (
    "((CAST(ci[1] AS INT) * 2 + CAST(ci[2] AS INT) * 9 + CAST(ci[3] AS INT) * 8 + CAST(ci[4] AS INT) * 7 "
    "+ CAST(ci[5] AS INT) * 6 + CAST(ci[6] AS INT) * 3 + CAST(ci[7] AS INT) * 4 + CAST(ci[8] AS INT)) % 10 = 0)"
)
VIEWS["ch7_previo"] = f"""
SELECT q.*, CASE {_NAME_RULES}
   WHEN NOT {_DOMAIN} THEN 'bad_email'
   WHEN email = 'administrativo@ucu.edu.uy' THEN 'protected'
   WHEN EXISTS (FROM participantes o WHERE lower(o.email) = lower(q.email) AND o.ci <> q.ci) THEN 'duplicate_email' END AS reason
FROM q_participant_edit q"""
VIEWS["ch7"] = """
SELECT * REPLACE (CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY lower(email), reason ORDER BY request_id) > 1
                       THEN 'duplicate_email' ELSE reason END AS reason) FROM ch7_previo"""
VIEWS["ch9_previo"] = f"""
SELECT q.*, CASE {_NAME_RULES}
   WHEN NOT {_DIGIT} THEN 'bad_ci'
   WHEN NOT {_DOMAIN} THEN 'bad_email'
   WHEN EXISTS (FROM participantes o WHERE o.ci = q.ci OR lower(o.email) = lower(q.email)) THEN 'duplicate' END AS reason
FROM q_participant q"""
# numbers are distinct within the batch, so only e-mails can collide in it
VIEWS["ch9"] = """
SELECT * REPLACE (CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY lower(email), reason ORDER BY request_id) > 1
                       THEN 'duplicate' ELSE reason END AS reason) FROM ch9_previo"""
VIEWS["ch10_previo"] = f"""
SELECT q.*, {_proper('nombre_sala')} AS propio, CASE
   WHEN length(nombre_sala) NOT BETWEEN 1 AND 50 THEN 'bad_length'
   WHEN NOT regexp_full_match(nombre_sala, '[A-Za-z0-9\\s"'']+') THEN 'bad_name'
   WHEN coalesce(TRY_CAST(capacidad AS INTEGER) NOT BETWEEN 1 AND 60, true) THEN 'bad_capacity'
   WHEN EXISTS (FROM sala s WHERE lower(s.nombre_sala) = lower({_proper('q.nombre_sala')}) AND s.edificio = q.edificio)
     THEN 'duplicate' END AS reason
FROM q_room q"""
VIEWS["ch10"] = """
SELECT * REPLACE (CASE WHEN reason IS NULL
     AND row_number() OVER (PARTITION BY lower(propio), edificio, reason ORDER BY request_id) > 1
                       THEN 'duplicate' ELSE reason END AS reason) FROM ch10_previo"""
VIEWS["sala_crecida"] = """
SELECT * FROM sala UNION ALL
SELECT propio, edificio, CAST(capacidad AS SMALLINT), tipo_sala FROM ch10 WHERE reason IS NULL"""
VIEWS["sn2"] = f"""
SELECT q.*, CASE WHEN fecha_fin < {TODAY} THEN 'ends_in_past'
   WHEN NOT regexp_full_match(ci, '[0-9]{{7,8}}') THEN 'bad_ci'
   WHEN ci NOT IN (SELECT ci FROM participantes) THEN 'unknown_participant'
   WHEN ci NOT IN (SELECT ci_participante FROM ppa) THEN 'no_programme' END AS reason
FROM q_sanction q"""
VIEWS["sn2_persona"] = """
SELECT ci, max(fecha_fin) AS fin, arg_min(fecha_fin, request_id) AS fin_primera FROM sn2 WHERE reason IS NULL GROUP BY ci"""


def _touches(end: str) -> str:
    return (
        f"s.activa AND ((s.fecha_inicio <= {end} AND s.fecha_fin >= {TODAY}) OR s.fecha_fin = {TODAY} - 1 "
        f"OR s.fecha_inicio = {end} + 1)"
    )


VIEWS["sn2_toca"] = f"""
SELECT s.*, n.fin, {_touches('n.fin_primera')} AS primera FROM sancion s JOIN sn2_persona n ON n.ci = s.ci_participante
WHERE {_touches('n.fin')}"""
VIEWS["sn2_nueva"] = f"""
SELECT n.ci, least({TODAY}, min(t.fecha_inicio)) AS ini, greatest(n.fin, max(t.fecha_fin)) AS fin,
       coalesce(bool_or(t.primera), false) AS fusion
FROM sn2_persona n LEFT JOIN sn2_toca t ON t.ci_participante = n.ci GROUP BY n.ci, n.fin"""
VIEWS["sn4"] = """
SELECT *, CASE WHEN fecha_fin < fecha_inicio THEN 'ends_before_start' END AS reason FROM q_sanction_edit"""
VIEWS["pr1"] = """
SELECT p.ci_participante AS ci, min(p.id_reserva) AS id_reserva FROM rp p JOIN c_state c USING (id_reserva)
WHERE c.estado_new = 'Sin Asistencia' AND c.estado_old <> 'Sin Asistencia'
AND NOT EXISTS (FROM sancion s WHERE s.ci_participante = p.ci_participante AND s.activa) GROUP BY ALL"""
VIEWS["tras_baja"] = """
SELECT p.* REPLACE (p.confirmado AND c.ci IS NULL AS confirmado)
FROM rp p LEFT JOIN c_withdrawal c ON c.ci = p.ci_participante AND c.id_reserva = p.id_reserva"""
VIEWS["vaciada_pr2"] = """
SELECT DISTINCT id_reserva FROM c_withdrawal c
WHERE NOT EXISTS (FROM tras_baja p WHERE p.id_reserva = c.id_reserva AND p.confirmado)"""
VIEWS["marcada"] = """
SELECT p.* REPLACE (CASE WHEN confirmado THEN id_reserva % 2 = 0 ELSE asistencia END AS asistencia),
       confirmado AND asistencia <> (id_reserva % 2 = 0) AS cambio FROM rp p"""
VIEWS["hueco"] = f"""
SELECT r.fecha, r.nombre_sala, r.edificio, max(r.id_turno) AS hasta
FROM reserva r WHERE r.id_reserva IN (SELECT id_reserva FROM marcada WHERE cambio)
AND NOT EXISTS (FROM reserva o JOIN marcada m USING (id_reserva) WHERE o.fecha = r.fecha AND o.nombre_sala = r.nombre_sala
     AND o.edificio = r.edificio AND o.id_turno <= r.id_turno AND m.asistencia)
AND (SELECT max(o.fecha + to_minutes(t.fin_min)) FROM reserva o JOIN turno t USING (id_turno) WHERE o.fecha = r.fecha
     AND o.nombre_sala = r.nombre_sala AND o.edificio = r.edificio AND o.id_turno <= r.id_turno) + INTERVAL 10 MINUTE <= {NOW}
GROUP BY ALL"""

_WORD = re.compile(r"[a-z_][a-z_0-9]*")


def statement(body: str) -> str:
    """``body`` with the views it names, and those they name, as leading CTEs."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for word in set(_WORD.findall(sql)):
            if word in VIEWS and word not in needed:
                needed.add(word)
                visit(VIEWS[word])

    visit(body)
    ctes = ",\n".join(f"{name}{HEADS.get(name, '')} AS ({sql.strip()})" for name, sql in VIEWS.items() if name in needed)
    return f"WITH {'RECURSIVE ' if needed & HEADS.keys() else ''}{ctes}\n{body.strip()}" if ctes else body.strip()


def _rank(column: str, total: str) -> str:
    # two decimals, half up, in integers
    return f"((20000 * {column} + {total}) // (2 * {total})) / 100.0"


_MEAN = "((200 * sum(n) + count(*)) // (2 * count(*))) / 100.0"
_ROOM = "nombre_sala, edificio"


def _reports(base: str, suffix: str, out: dict[str, str]) -> None:
    sized = f"{base} b JOIN (SELECT id_reserva, count(*) AS n FROM rp GROUP BY ALL) z USING (id_reserva)"
    person = "JOIN ppa m ON m.ci_participante = p.ci_participante JOIN programas_academicos g USING (nombre_programa)"
    out[f"rp01_top_rooms{suffix}"] = (
        f"SELECT {_ROOM}, count(*) AS cantidad_reservas FROM {base} GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 10"
    )
    out[f"rp02_turno_demand{suffix}"] = (
        f"SELECT inicio_min AS hora_inicio, fin_min AS hora_fin, count(*) AS reservas "
        f"FROM {base} JOIN turno USING (id_turno) GROUP BY ALL"
    )
    out[f"rp03_avg_participants{suffix}"] = f"SELECT {_ROOM}, {_MEAN} AS promedio_participantes FROM {sized} GROUP BY {_ROOM}"
    out[f"rp04_bookings_by_programme{suffix}"] = (
        f"SELECT nombre_programa, f.nombre AS facultad, count(DISTINCT b.id_reserva) AS reservas "
        f"FROM {base} b JOIN rp p USING (id_reserva) {person} JOIN facultad f USING (id_facultad) GROUP BY ALL"
    )
    out[f"rp05_building_occupancy{suffix}"] = (
        f"SELECT edificio, {_rank('sum(n)', 'sum(capacidad)')} AS porcentaje_ocupacion FROM {sized} GROUP BY edificio"
    )
    out[f"rp06_bookings_by_role{suffix}"] = (
        f"SELECT m.rol, g.tipo, count(DISTINCT b.id_reserva) AS reservas, count(*) FILTER (p.asistencia) AS asistencias "
        f"FROM {base} b JOIN rp p USING (id_reserva) {person} GROUP BY ALL"
    )
    out[f"rp08_state_share{suffix}"] = (
        f"SELECT estado, {_rank('count(*)', '(SELECT count(*) FROM reserva)')} AS porcentaje FROM {base} GROUP BY estado"
    )
    out[f"rp09_cancellation_rate{suffix}"] = (
        f"SELECT {_ROOM}, {_rank('count(*) FILTER (estado = ' + chr(39) + 'Cancelada' + chr(39) + ')', 'count(*)')} "
        f"AS tasa_cancelacion FROM {base} GROUP BY {_ROOM} ORDER BY 3 DESC, 1, 2 LIMIT 10"
    )
    out[f"rp10_top_participants{suffix}"] = (
        f"SELECT h.ci, h.nombre, h.apellido, count(DISTINCT p.id_reserva) AS reservas_confirmadas "
        f"FROM rp p JOIN participantes h ON h.ci = p.ci_participante JOIN {base} b USING (id_reserva) "
        f"WHERE p.asistencia GROUP BY ALL ORDER BY 4 DESC, 1 LIMIT 10"
    )
    out[f"rp11_mean_lead_days{suffix}"] = (
        f"SELECT sign(s) * ((200 * abs(s) + k) // (2 * k)) / 100.0 AS antelacion_promedio_dias FROM (SELECT "
        f"sum(b.fecha - p.fecha_solicitud_reserva) AS s, count(*) AS k FROM {base} b JOIN rp p USING (id_reserva))"
    )


def _build() -> dict[str, str]:
    o: dict[str, str] = {}
    reserva_all = "id_reserva, nombre_sala, edificio, fecha, id_turno, estado"
    rp_all = "ci_participante, id_reserva, fecha_solicitud_reserva, asistencia, confirmado"
    next_sancion = "(SELECT max(id_sancion) FROM sancion)"

    names = {"programas_academicos": "programas_academicos", "participantes_programa_academico": "ppa",
             "edificio": "edificio_v", "reserva_participante": "rp", "sancion_participante": "sancion"}
    model = ["participantes", "facultad", "programas_academicos", "participantes_programa_academico", "edificio", "sala",
             "turno", "reserva", "reserva_participante", "sancion_participante", "notificacion"]
    o["src1_snk1_snapshot_counts"] = " UNION ALL ".join(
        f"SELECT '{t}' AS tabla, count(*) AS filas FROM {names.get(t, t)}" for t in model
    )
    o["src2_projection_participation"] = "SELECT * FROM rp"
    o["src4_requests_json"] = o["src4_requests_parquet"] = "SELECT * FROM q_booking"
    o["src4_requests_csv"] = """
SELECT * REPLACE (nombre_sala || chr(10) || '"sala", 1' AS nombre_sala) FROM q_booking"""
    o["src4_rejected_requests"] = """
SELECT CASE WHEN request_id % 7 < 3 THEN 'bad_fecha' ELSE 'bad_id_turno' END AS reason, count(*) AS n
FROM q_booking WHERE request_id % 7 < 3 OR request_id % 11 = 0 GROUP BY ALL"""

    # filters
    cols = "id_reserva, nombre_sala, edificio, fecha, id_turno, estado, tipo_sala"
    o["flt1_report_filter"] = f"SELECT {cols} FROM base_f"
    o["flt1_report_filter_all_conditions"] = f"SELECT {cols} FROM base_f WHERE edificio = 'Edificio NATION_20'"
    o["flt2_sanctioned"] = "SELECT * FROM sancionado"
    o["flt3_occupied_slots"] = "SELECT DISTINCT nombre_sala, edificio, fecha, id_turno FROM reserva WHERE estado = 'Activa'"
    o["flt4_open_slots"] = """
SELECT s.nombre_sala, s.edificio, d.fecha, t.id_turno FROM sala s, turno t,
  (SELECT DATE '2025-02-01' + CAST(i AS INTEGER) AS fecha FROM range(7) AS g(i)) d
WHERE NOT EXISTS (FROM reserva r WHERE r.estado = 'Activa' AND r.nombre_sala = s.nombre_sala AND r.edificio = s.edificio
                  AND r.fecha = d.fecha AND r.id_turno = t.id_turno)"""
    o["flt5_buildings"] = "SELECT nombre_edificio FROM edificio_v"
    o["flt5_rooms"] = "SELECT nombre_sala, edificio FROM sala"
    o["flt5_slots"] = "SELECT * FROM turno"
    o["flt5_faculties"] = "SELECT * FROM facultad"
    o["flt6_people_and_rooms"] = """
SELECT request_id, ci IN (SELECT ci FROM participantes) AS existe, ci IN (SELECT ci_participante FROM ppa) AS en_programa,
       EXISTS (FROM sala s WHERE s.nombre_sala = q.nombre_sala AND s.edificio = q.edificio) AS sala_existe FROM q_booking q"""
    o["flt6_identity_taken"] = """
SELECT request_id, EXISTS (FROM participantes p WHERE p.ci = q.ci) AS ci_tomada,
       EXISTS (FROM participantes p WHERE lower(p.email) = lower(q.email)) AS email_tomado FROM q_participant_edit q"""
    o["flt6_in_reservation"] = """
SELECT request_id, EXISTS (FROM rp p WHERE p.ci_participante = q.ci AND p.id_reserva = q.id_reserva) AS ya_esta FROM q_join q"""
    o["flt7_confirmed"] = "SELECT ci_participante, id_reserva FROM rp WHERE confirmado"
    o["flt7_attended"] = "SELECT ci_participante, id_reserva FROM rp WHERE asistencia"
    o["flt7_active_reservations"] = "SELECT id_reserva, estado FROM reserva WHERE estado = 'Activa'"
    o["flt7_active_sanctions"] = "SELECT * FROM sancion WHERE activa"

    # listings
    for kind, grado, posgrado, other in (
        ("long", "Estudiante de grado", "Estudiante de posgrado", "'Administrativo'"),
        ("short", "Grado", "Posgrado", "'Desconocido'"),
        ("bare", "Grado", "Posgrado", "NULL"),
    ):
        o[f"vw01_profile_{kind}"] = f"""
SELECT p.ci, p.nombre, p.apellido, p.email, CASE WHEN h.rol = 'Docente' THEN 'Docente'
  WHEN h.rol = 'Estudiante' AND h.tipo = 'Grado' THEN '{grado}'
  WHEN h.rol = 'Estudiante' AND h.tipo = 'Posgrado' THEN '{posgrado}' ELSE {other} END AS tipo_persona
FROM participantes p LEFT JOIN persona h USING (ci)"""
    o["vw02_directory"] = """
SELECT p.ci, p.nombre, p.apellido, p.email, g.nombre_programa, g.id_facultad, f.nombre AS facultad, m.rol
FROM participantes p LEFT JOIN ppa m ON m.ci_participante = p.ci
LEFT JOIN programas_academicos g ON g.nombre_programa = m.nombre_programa LEFT JOIN facultad f ON f.id_facultad = g.id_facultad"""
    o["vw03_programmes_by_faculty"] = """
SELECT f.nombre AS facultad, 0 AS pagina, string_agg(nombre_programa, '|' ORDER BY nombre_programa) AS programas
FROM programas_academicos JOIN facultad f USING (id_facultad) GROUP BY ALL"""
    o["vw04_rooms_by_building"] = """
SELECT edificio, 0 AS pagina, string_agg(nombre_sala, '|' ORDER BY nombre_sala) AS salas FROM sala GROUP BY ALL"""
    o["vw03_programmes_by_faculty_short_pages"] = """
SELECT facultad, pagina, string_agg(nombre_programa, '|' ORDER BY nombre_programa) AS programas
FROM (SELECT f.nombre AS facultad, nombre_programa,
             CAST((row_number() OVER (PARTITION BY f.nombre ORDER BY nombre_programa) - 1) // 3 AS INTEGER) AS pagina
      FROM programas_academicos JOIN facultad f USING (id_facultad)) GROUP BY ALL"""
    o["vw04_rooms_by_building_short_pages"] = """
SELECT edificio, pagina, string_agg(nombre_sala, '|' ORDER BY nombre_sala) AS salas
FROM (SELECT *, CAST((row_number() OVER (PARTITION BY edificio ORDER BY nombre_sala) - 1) // 3 AS INTEGER) AS pagina FROM sala)
GROUP BY ALL"""
    o["vw04_rooms_json"] = """
SELECT edificio, 0 AS pagina, CAST(to_json(list(nombre_sala ORDER BY nombre_sala)) AS VARCHAR) AS salas FROM sala GROUP BY ALL"""
    o["vw05_room_list"] = "SELECT * FROM sala"
    o["vw06_my_reservations"] = """
SELECT p.ci_participante AS ci, b.id_reserva, b.nombre_sala, b.edificio, b.fecha, t.inicio_min, t.fin_min, b.estado,
       b.capacidad, c.n AS confirmados, CAST((c.n + 59) // 60 AS INTEGER) AS paginas,
       coalesce((SELECT string_agg(h.nombre || ' ' || h.apellido, '|' ORDER BY h.nombre || ' ' || h.apellido, h.ci)
        FROM rp x JOIN participantes h ON h.ci = x.ci_participante
        WHERE x.confirmado AND x.id_reserva = b.id_reserva AND x.ci_participante <> p.ci_participante), '') AS otros
FROM rp p JOIN base b USING (id_reserva) JOIN turno t USING (id_turno) JOIN confirmados c USING (id_reserva)
WHERE p.confirmado AND b.estado = 'Activa'"""
    for size, suffix in ((60, ""), (3, "_short_pages")):
        o[f"vw06_others_in_reservation{suffix}"] = f"""
WITH lista AS (SELECT p.id_reserva, p.ci_participante AS ci, h.nombre || ' ' || h.apellido AS nombre,
  CAST((row_number() OVER (PARTITION BY p.id_reserva ORDER BY h.nombre || ' ' || h.apellido NULLS LAST, h.ci NULLS LAST) - 1) // {size}
       AS INTEGER) AS pagina
  FROM rp p JOIN reserva r USING (id_reserva) LEFT JOIN participantes h ON h.ci = p.ci_participante
  WHERE p.confirmado AND r.estado = 'Activa')
SELECT m.ci, m.id_reserva, g.pagina, coalesce((SELECT string_agg(o.nombre, '|' ORDER BY o.nombre, o.ci) FROM lista o
       WHERE o.id_reserva = m.id_reserva AND o.pagina = g.pagina AND o.ci <> m.ci), '') AS otros
FROM lista m JOIN (SELECT DISTINCT id_reserva, pagina FROM lista) g USING (id_reserva)"""
    o["vw06_rosters"] = """
SELECT b.id_reserva, 0 AS pagina,
       coalesce(string_agg(h.nombre || ' ' || h.apellido, '|' ORDER BY h.nombre || ' ' || h.apellido, h.ci), '') AS personas,
       count(*) AS confirmados,
       coalesce(string_agg(h.ci, '|' ORDER BY h.nombre || ' ' || h.apellido, h.ci), '') AS cis
FROM base b JOIN rp p USING (id_reserva) LEFT JOIN participantes h ON h.ci = p.ci_participante
WHERE p.confirmado AND b.estado = 'Activa' GROUP BY b.id_reserva"""
    o["vw07_active_reservations"] = """
SELECT b.id_reserva, b.id_turno, b.fecha, t.inicio_min, t.fin_min, b.estado, b.nombre_sala, b.edificio, b.capacidad,
       count(p.ci_participante) AS ocupacion
FROM base b JOIN turno t USING (id_turno) LEFT JOIN rp p USING (id_reserva) WHERE b.estado = 'Activa' GROUP BY ALL"""
    o["vw08_reservation_detail"] = """
SELECT id_reserva, nombre_sala, edificio, fecha, inicio_min, fin_min, printf('%02d:%02d', inicio_min // 60, inicio_min % 60) AS hora_inicio,
       printf('%02d:%02d', fin_min // 60, fin_min % 60) AS hora_fin, capacidad, tipo_sala, estado
FROM base JOIN turno USING (id_turno)"""
    roster = "SELECT p.id_reserva, p.ci_participante, h.nombre, h.apellido{} FROM rp p JOIN participantes h ON h.ci = p.ci_participante{}"
    o["vw09_roster_all"] = roster.format("", "")
    o["vw09_roster_confirmed"] = roster.format("", " WHERE p.confirmado")
    o["vw09_roster_attendance"] = roster.format(", p.asistencia", "")
    o["vw10_sanction_history"] = f"""
SELECT ci_participante AS ci, id_sancion, fecha_inicio, fecha_fin,
       CASE WHEN activa AND fecha_fin >= {TODAY} THEN 'Activa' ELSE 'Expirada' END AS estado,
       CASE WHEN activa AND fecha_fin >= {TODAY} THEN CAST(fecha_fin - {TODAY} AS INTEGER) END AS dias_restantes FROM sancion"""
    o["vw11_current_sanctions"] = f"""
SELECT s.id_sancion, s.ci_participante, h.nombre, h.apellido, s.fecha_inicio, s.fecha_fin, s.activa,
       CASE WHEN s.fecha_inicio > {TODAY} THEN 'Pendiente' ELSE 'Activa' END AS estado
FROM sancion s JOIN participantes h ON h.ci = s.ci_participante WHERE s.activa AND s.fecha_fin >= {TODAY}"""
    o["vw12_notification_feed"] = "SELECT ci_participante AS ci, id_notificacion, mensaje, fecha, leida FROM notificacion"
    o["vw13_seats"] = """
SELECT b.id_reserva, b.fecha, b.id_turno, b.capacidad, b.tipo_sala, coalesce(c.n, 0) AS ocupados,
       b.capacidad - coalesce(c.n, 0) AS libres
FROM base b LEFT JOIN confirmados c USING (id_reserva) WHERE b.estado = 'Activa'"""
    o["vw14_attendance_editable"] = f"""
SELECT r.id_reserva, r.estado, r.estado = 'Activa' AND {NOW} <= f.fin + INTERVAL 10 MINUTE AS editable
FROM reserva r JOIN fin_de f USING (id_reserva)"""

    # reports
    _reports("base", "", o)
    _reports("base_f", "_filtered", o)
    o["rp07_sanctions_by_role"] = """
SELECT m.rol, g.tipo, count(*) AS sanciones FROM sancion s JOIN ppa m ON m.ci_participante = s.ci_participante
JOIN programas_academicos g USING (nombre_programa) GROUP BY ALL"""
    counts = {"turno_demand": "rp02", "avg_participants": "rp03", "bookings_by_programme": "rp04", "building_occupancy": "rp05",
              "bookings_by_role": "rp06", "state_share": "rp08", "cancellation_rate": "rp09", "top_participants": "rp10",
              "mean_lead_days": "rp11", "top_rooms": "rp01"}
    o["snk2_report_rows"] = " UNION ALL ".join(
        [f"SELECT '{n}' AS tabla, count(*) AS filas FROM ({o[f'{k}_{n}_filtered']})" for n, k in counts.items()]
        + [f"SELECT 'sanctions_by_role', count(*) FROM ({o['rp07_sanctions_by_role']})"]
    )

    # islands and intervals
    o["wn1_wn2_island_flags"] = """
SELECT id_reserva, fecha, nombre_sala, edificio, id_turno, inicio_min, fin_min, comienza_bloque, bloque_id FROM isla"""
    o["wn3_island_summary"] = """
SELECT fecha, nombre_sala, edificio, bloque_id, max(fecha + to_minutes(fin_min)) AS fin_bloque, count(*) AS reservas,
       count(*) FILTER (id_reserva IN (FROM asistida)) AS total_asistencias FROM isla GROUP BY ALL"""
    merged = """
SELECT ci_participante, min(fecha_inicio) AS fecha_inicio, max(fecha_fin) AS fecha_fin, count(*) AS n, min(id_sancion) AS id_sancion
FROM (SELECT *, sum(abre) OVER (PARTITION BY ci_participante ORDER BY fecha_inicio, id_sancion ROWS UNBOUNDED PRECEDING) AS tramo
      FROM (SELECT *, CASE WHEN fecha_inicio <= 1 + max(fecha_fin) OVER (PARTITION BY ci_participante
              ORDER BY fecha_inicio, id_sancion ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS abre
            FROM sancion{}))
GROUP BY ci_participante, tramo"""
    o["wn4_merge_intervals"] = f"SELECT ci_participante, fecha_inicio, fecha_fin, n FROM ({merged.format('')})"

    # admission
    o["ad1_bookings_self_snapshot"] = f"SELECT request_id, ci, {_VERDICT}, reason FROM ad1"
    o["ad2_bookings_admin_snapshot"] = f"SELECT request_id, ci, {_VERDICT}, reason FROM ad2"
    o["ad3_joins_snapshot"] = f"""SELECT request_id, ci, {_VERDICT}, reason,
       CASE WHEN reason IS NULL THEN CASE WHEN fila THEN 'reactivate' ELSE 'insert' END END AS action FROM ad3"""
    o["ad4_adds_admin_snapshot"] = f"SELECT request_id, ci, {_VERDICT}, reason FROM ad4"
    for n, name in enumerate(("bookings_self", "bookings_admin", "joins", "adds_admin"), start=1):
        extra = ", CASE WHEN reason IS NULL THEN CASE WHEN fila THEN 'reactivate' ELSE 'insert' END END AS action" if n == 3 else ""
        o[f"ad{n}_{name}_sequential"] = f"SELECT request_id, ci, {_VERDICT}, reason{extra} FROM ad{n}_seguido"
    o["ad5_quota_day"] = "SELECT ci, fecha, count(*) AS bloques FROM uso GROUP BY ALL"
    o["ad5_quota_day_confirmed"] = "SELECT ci, fecha, count(*) AS bloques FROM uso WHERE confirmado GROUP BY ALL"
    o["ad5_quota_week_monday"] = "SELECT ci, lunes AS semana_inicio, count(*) AS cantidad FROM uso WHERE confirmado GROUP BY ALL"
    o["ad5_quota_week_sunday"] = "SELECT ci, anio, semana, count(*) AS cantidad FROM uso GROUP BY ALL"

    # change application
    booked = "(SELECT *, (SELECT max(id_reserva) FROM reserva) + row_number() OVER (ORDER BY request_id) AS nuevo FROM ad2_dado)"
    own_booked = booked.replace("ad2_dado", "ad1_dado")
    o["ch01_apply_bookings_reserva"] = f"""
SELECT {reserva_all} FROM reserva UNION ALL SELECT nuevo, nombre_sala, edificio, fecha, id_turno, 'Activa' FROM {booked}"""
    o["ch01_apply_bookings_participation"] = f"""
SELECT {rp_all} FROM rp UNION ALL SELECT ci, nuevo, {TODAY}, false, true FROM {booked}"""
    o["ch01_apply_own_bookings_reserva"] = o["ch01_apply_bookings_reserva"].replace(booked, own_booked)
    o["ch01_slots_held_twice"] = """
SELECT nombre_sala, edificio, fecha, id_turno, count(*) AS veces, 'one_per_slot' AS regla FROM reserva WHERE estado = 'Activa'
GROUP BY ALL HAVING count(*) > 1"""
    o["ch01_apply_joins"] = f"""
SELECT p.* REPLACE (p.confirmado OR a.ci IS NOT NULL AS confirmado) FROM rp p
LEFT JOIN ad3_dado a ON a.ci = p.ci_participante AND a.id_reserva = p.id_reserva
UNION ALL SELECT ci, id_reserva, {TODAY}, false, true FROM ad3_dado WHERE NOT fila"""
    o["ch01_apply_adds"] = f"""
SELECT * FROM rp UNION ALL SELECT ci, id_reserva, {TODAY}, false, true FROM ad4_dado"""

    o["ch02_cancel_verdicts"] = """SELECT ci, id_reserva, CASE WHEN fila THEN 'accepted' ELSE 'rejected' END AS verdict,
       CASE WHEN NOT fila THEN 'not_in_reservation' END AS reason FROM cancelado"""
    o["ch02_cancel_reserva"] = """
SELECT id_reserva, CASE WHEN id_reserva IN (FROM vaciada_ch2) THEN 'Cancelada' ELSE estado END AS estado FROM reserva"""
    o["ch02_cancel_participation"] = "SELECT * FROM tras_ch2"
    o["ch02_cancel_notifications"] = f"""
SELECT * FROM notificacion UNION ALL
SELECT (SELECT max(id_notificacion) FROM notificacion) + row_number() OVER (ORDER BY id_reserva, ci), ci,
       CASE WHEN id_reserva IN (FROM vaciada_ch2) AND NOT EXISTS (FROM cancelado l WHERE l.id_reserva = c.id_reserva
                 AND l.confirmaba AND l.ci > c.ci)
            THEN 'Tu reserva #' || id_reserva || ' fue cancelada por falta de participantes.'
            ELSE 'Cancelaste tu participación en la reserva #' || id_reserva || '.' END, {NOW}, false
FROM cancelado c WHERE fila"""
    o["ch03_remove_verdicts"] = f"SELECT ci, id_reserva, {_VERDICT}, reason FROM ch3"
    o["ch03_remove_reserva"] = """
SELECT id_reserva, CASE WHEN id_reserva IN (SELECT id_reserva FROM ch3 WHERE reason IS NULL)
  AND id_reserva NOT IN (SELECT id_reserva FROM tras_ch3) THEN 'Cancelada' ELSE estado END AS estado FROM reserva"""
    o["ch03_remove_participation"] = "SELECT * FROM tras_ch3"
    o["ch04_modify_verdicts"] = f"SELECT id_reserva, fecha_nueva, id_turno_nuevo, estado_nuevo, {_VERDICT}, reason FROM ch4"
    o["ch04_modify_reserva"] = """
SELECT r.id_reserva, r.nombre_sala, r.edificio, coalesce(c.fecha_nueva, r.fecha) AS fecha,
       coalesce(c.id_turno_nuevo, r.id_turno) AS id_turno, coalesce(c.estado_final, r.estado) AS estado
FROM reserva r LEFT JOIN (FROM ch4 WHERE reason IS NULL) c USING (id_reserva)"""
    for what in ("verdicts", "reserva"):
        o[f"ch04_modify_sequential_{what}"] = o[f"ch04_modify_{what}"].replace("FROM ch4", "FROM ch4_seguido")
    o["ch04_slots_held_twice"] = f"""
SELECT nombre_sala, edificio, fecha, id_turno, count(*) AS veces, 'one_per_slot' AS regla
FROM ({o["ch04_modify_sequential_reserva"]}) WHERE estado = 'Activa' GROUP BY ALL HAVING count(*) > 1"""
    o["ch04_modify_participation"] = """
SELECT * FROM rp WHERE id_reserva NOT IN (SELECT id_reserva FROM ch4 WHERE reason IS NULL AND estado_final = 'Cancelada')"""
    o["ch04_modify_sanctions"] = f"""
SELECT * FROM sancion UNION ALL
SELECT {next_sancion} + row_number() OVER (ORDER BY ci), ci, {TODAY}, {TWO_MONTHS}, true FROM pr1_ch4"""
    o["ch12_notifications"] = f"""
WITH aviso AS (SELECT p.ci_participante AS ci, p.id_reserva FROM rp p JOIN ch4 c USING (id_reserva) WHERE c.reason IS NULL),
     tope AS (SELECT (SELECT max(id_notificacion) FROM notificacion) AS m, (SELECT count(*) FROM aviso) AS k)
SELECT * FROM notificacion UNION ALL
SELECT m + row_number() OVER (ORDER BY id_reserva, ci), ci,
       'La reserva #' || id_reserva || ' fue modificada por un administrador.', {NOW}, false FROM aviso, tope UNION ALL
SELECT m + k + row_number() OVER (ORDER BY id_reserva, ci), ci,
       'Has sido sancionado por inasistencia en la reserva #' || id_reserva, {NOW}, false FROM pr1_ch4, tope"""
    o["ch05_attendance_verdicts"] = f"SELECT id_reserva, {_VERDICT}, reason FROM ch5"
    o["ch05_attendance_participation"] = """
SELECT p.* REPLACE (CASE WHEN h.id_reserva IS NULL THEN p.asistencia
    ELSE coalesce((SELECT q.asistencia FROM q_attendance q WHERE q.ci = p.ci_participante AND q.id_reserva = p.id_reserva), false)
    END AS asistencia)
FROM rp p LEFT JOIN (SELECT id_reserva FROM ch5 WHERE reason IS NULL) h USING (id_reserva)"""
    o["ch06_delete_people_verdicts"] = f"SELECT ci, {_VERDICT}, reason FROM ch6"
    o["ch06_delete_people_reserva"] = """
SELECT id_reserva, CASE WHEN EXISTS (FROM rp p WHERE p.id_reserva = r.id_reserva AND p.confirmado AND p.ci_participante IN (FROM fuera))
  AND NOT EXISTS (FROM rp p WHERE p.id_reserva = r.id_reserva AND p.confirmado AND p.ci_participante NOT IN (FROM fuera))
  THEN 'Cancelada' ELSE estado END AS estado FROM reserva r"""
    for key, table, col in (
        ("participation", "rp", "ci_participante"),
        ("people", "participantes", "ci"),
        ("memberships", "ppa", "ci_participante"),
        ("sanctions", "sancion", "ci_participante"),
    ):
        o[f"ch06_delete_people_{key}"] = f"SELECT * FROM {table} WHERE {col} NOT IN (FROM fuera)"
    request = "request_id, ci, nombre, apellido, email, programa, rol"
    o["ch07_edit_people_verdicts"] = f"SELECT {request}, {_VERDICT}, reason FROM ch7"
    o["ch07_edit_people_people"] = f"""
SELECT p.ci, coalesce({_proper('e.nombre')}, p.nombre) AS nombre, coalesce({_proper('e.apellido')}, p.apellido) AS apellido,
       coalesce(e.email, p.email) AS email
FROM participantes p LEFT JOIN (FROM ch7 WHERE reason IS NULL) e USING (ci)"""
    o["ch07_edit_people_memberships"] = """
SELECT m.id_alumno_programa, m.ci_participante, coalesce(e.programa, m.nombre_programa) AS nombre_programa,
       coalesce(e.rol, m.rol) AS rol FROM ppa m LEFT JOIN (FROM ch7 WHERE reason IS NULL) e ON e.ci = m.ci_participante"""
    o["ch08_mark_read"] = """
SELECT * REPLACE (leida OR ci_participante IN (SELECT ci FROM participantes WHERE nombre = 'BUILDING') AS leida) FROM notificacion"""
    o["ch09_intake_people_verdicts"] = f"SELECT {request}, {_VERDICT}, reason FROM ch9"
    o["ch09_intake_people_people"] = f"""
SELECT * FROM participantes UNION ALL SELECT ci, {_proper('nombre')}, {_proper('apellido')}, email FROM ch9 WHERE reason IS NULL"""
    o["ch09_intake_people_memberships"] = """
SELECT * FROM ppa UNION ALL SELECT (SELECT max(id_alumno_programa) FROM ppa) + row_number() OVER (ORDER BY request_id),
       ci, programa, rol FROM ch9 WHERE reason IS NULL"""
    room_request = "request_id, nombre_sala, edificio, capacidad, tipo_sala"
    o["ch10_intake_rooms_verdicts"] = f"SELECT {room_request}, {_VERDICT}, reason FROM ch10"
    o["ch10_intake_rooms_rooms"] = "SELECT * FROM sala_crecida"
    bad = "CASE WHEN CAST(capacidad AS INTEGER) NOT BETWEEN 1 AND 60 THEN 'bad_capacity' END AS reason"
    o["ch11_edit_rooms_verdicts"] = f"SELECT *, {_VERDICT} FROM (SELECT *, {bad} FROM q_room_edit)"
    o["ch11_edit_rooms_rooms"] = """
SELECT nombre_sala, edificio, CASE WHEN ok THEN CAST(e.capacidad AS SMALLINT) ELSE s.capacidad END AS capacidad,
       CASE WHEN NOT ok THEN s.tipo_sala WHEN e.tipo_sala = 'libre' THEN 'Libre' ELSE 'Docente' END AS tipo_sala
FROM sala s JOIN (SELECT *, CAST(capacidad AS INTEGER) BETWEEN 1 AND 60 AS ok FROM q_room_edit) e USING (nombre_sala, edificio)"""
    used = "(nombre_sala, edificio) IN (SELECT (nombre_sala, edificio) FROM reserva)"
    o["ch11_delete_rooms_verdicts"] = f"""
SELECT nombre_sala, edificio, CASE WHEN {used} THEN 'rejected' ELSE 'accepted' END AS verdict,
       CASE WHEN {used} THEN 'has_reservations' END AS reason FROM sala_crecida"""
    o["ch11_delete_rooms_rooms"] = f"SELECT * FROM sala_crecida WHERE {used}"

    # sanctions
    o["sn1_expire"] = f"SELECT * REPLACE (activa AND fecha_fin >= {TODAY} AS activa) FROM sancion"
    o["sn2_add_verdicts"] = f"SELECT request_id, ci, fecha_fin, {_VERDICT}, reason FROM sn2"
    o["sn2_add_sanctions"] = f"""
SELECT * FROM sancion WHERE id_sancion NOT IN (SELECT id_sancion FROM sn2_toca) UNION ALL
SELECT {next_sancion} + row_number() OVER (ORDER BY ci), ci, ini, fin, true FROM sn2_nueva"""
    o["sn2_add_notifications"] = f"""
SELECT * FROM notificacion UNION ALL
SELECT (SELECT max(id_notificacion) FROM notificacion) + row_number() OVER (ORDER BY ci), ci,
       'Recibiste una sanción por inasistencia.', {NOW}, false FROM sn2_nueva WHERE NOT fusion"""
    o["sn3_coalesce"] = f"""
SELECT * FROM sancion WHERE NOT activa UNION ALL
SELECT id_sancion, ci_participante, fecha_inicio, fecha_fin, true FROM ({merged.format(' WHERE activa')})"""
    o["sn4_edit_verdicts"] = f"SELECT request_id, ci, fecha_inicio, fecha_fin, activa, {_VERDICT}, reason FROM sn4"
    o["sn4_edit_sanctions"] = """
SELECT s.id_sancion, s.ci_participante, s.fecha_inicio, coalesce(e.fecha_fin, s.fecha_fin) AS fecha_fin,
       coalesce(e.activa, s.activa) AS activa
FROM sancion s LEFT JOIN (SELECT ci, fecha_inicio, arg_max(fecha_fin, request_id) AS fecha_fin, arg_max(activa, request_id) AS activa
  FROM sn4 WHERE reason IS NULL GROUP BY ALL) e ON e.ci = s.ci_participante AND e.fecha_inicio = s.fecha_inicio"""

    # sweeps
    o["sw1_finalize_attended"] = "SELECT id_reserva, estado FROM tras_sw1"
    o["sw2_sweep_blocks"] = "SELECT id_reserva, estado FROM tras_sw2"
    o["sw3_sweep_reservations"] = "SELECT id_reserva, estado FROM solo_sw3"
    o["sw4_sanction_no_shows"] = f"""
SELECT * FROM sancion UNION ALL
SELECT {next_sancion} + row_number() OVER (ORDER BY ci), ci, {TODAY}, {TWO_MONTHS}, true FROM (
  SELECT DISTINCT p.ci_participante AS ci FROM rp p JOIN reserva r USING (id_reserva) WHERE r.estado = 'Sin Asistencia'
  AND NOT EXISTS (FROM sancion s WHERE s.ci_participante = p.ci_participante AND {TODAY} BETWEEN s.fecha_inicio AND s.fecha_fin))"""
    o["sw5_run_sweep_reserva"] = "SELECT id_reserva, estado FROM tras_sw3"
    o["sw5_run_sweep_sanctions"] = f"""
WITH viva AS (SELECT * REPLACE (activa AND fecha_fin >= {TODAY} AS activa) FROM sancion),
 n1 AS (SELECT DISTINCT p.ci_participante AS ci FROM rp p JOIN reserva a USING (id_reserva) JOIN tras_sw2 b USING (id_reserva)
   WHERE b.estado = 'Sin Asistencia' AND a.estado <> b.estado
   AND p.ci_participante NOT IN (SELECT ci_participante FROM viva WHERE activa)),
 n2 AS (SELECT DISTINCT p.ci_participante AS ci FROM rp p JOIN tras_sw2 a USING (id_reserva) JOIN tras_sw3 b USING (id_reserva)
   WHERE b.estado = 'Sin Asistencia' AND a.estado <> b.estado
   AND p.ci_participante NOT IN (SELECT ci_participante FROM viva WHERE activa) AND p.ci_participante NOT IN (FROM n1)),
 n3 AS (SELECT DISTINCT p.ci_participante AS ci FROM rp p JOIN tras_sw3 b USING (id_reserva) WHERE b.estado = 'Sin Asistencia'
   AND p.ci_participante NOT IN (FROM n1) AND p.ci_participante NOT IN (FROM n2)
   AND NOT EXISTS (FROM viva s WHERE s.ci_participante = p.ci_participante AND {TODAY} BETWEEN s.fecha_inicio AND s.fecha_fin)),
 nuevas AS (SELECT ci, 1 AS paso FROM n1 UNION ALL SELECT ci, 2 FROM n2 UNION ALL SELECT ci, 3 FROM n3)
SELECT * FROM viva UNION ALL
SELECT {next_sancion} + row_number() OVER (ORDER BY paso, ci), ci, {TODAY}, {TWO_MONTHS}, true FROM nuevas"""

    # propagation and streams
    o["pr1_sanctions"] = f"""
SELECT * FROM sancion UNION ALL
SELECT {next_sancion} + row_number() OVER (ORDER BY ci), ci, {TODAY}, {TWO_MONTHS}, true FROM pr1"""
    o["pr1_notifications"] = f"""
SELECT * FROM notificacion UNION ALL
SELECT (SELECT max(id_notificacion) FROM notificacion) + row_number() OVER (ORDER BY id_reserva, ci), ci,
       'Has sido sancionado por inasistencia en la reserva #' || id_reserva, {NOW}, false FROM pr1"""
    o["pr2_cancellations"] = """
SELECT id_reserva, CASE WHEN id_reserva IN (FROM vaciada_pr2) THEN 'Cancelada' ELSE estado END AS estado FROM reserva"""
    o["pr3_no_shows"] = """
SELECT r.id_reserva, CASE WHEN r.id_turno <= h.hasta THEN 'Sin Asistencia' ELSE r.estado END AS estado
FROM reserva r LEFT JOIN hueco h USING (fecha, nombre_sala, edificio)"""
    o["st1_no_show_stream"] = (
        f"SELECT ci AS ci_participante, {TODAY} AS fecha_inicio, {TWO_MONTHS} AS fecha_fin, true AS activa FROM pr1"
    )
    o["st2_withdrawal_stream"] = "SELECT id_reserva FROM vaciada_pr2"
    o["st3_attendance_stream"] = """
SELECT q.ci, q.id_reserva, q.asistencia, f.fin + to_minutes(CAST(q.ci AS INTEGER) % 21) AS marked_at,
       r.estado = 'Activa' AND CAST(q.ci AS INTEGER) % 21 <= 10 AS a_tiempo
FROM q_attendance q JOIN fin_de f USING (id_reserva) JOIN reserva r USING (id_reserva)"""

    # integrity
    o["dq1_duplicate_emails"] = """
SELECT min(email) AS email, count(*) AS veces, 'unique' AS regla FROM q_participant
GROUP BY lower(rtrim(email)) HAVING count(*) > 1"""
    o["dq2_unknown_people"] = """
SELECT ci, id_reserva, 'reference' AS regla FROM q_cancel WHERE ci NOT IN (SELECT ci FROM participantes)"""
    o["dq3_missing_room"] = "SELECT request_id, 'not_null' AS regla FROM q_booking WHERE nombre_sala IS NULL"
    o["dq4_capacity_range"] = """
SELECT request_id, CAST(capacidad AS INTEGER) AS capacidad, 'capacity_range' AS regla FROM q_room
WHERE CAST(capacidad AS INTEGER) < 1 OR CAST(capacidad AS INTEGER) > 60"""
    o["dq5_state_domain"] = """
SELECT id_reserva, estado_nuevo, 'domain' AS regla FROM q_edit
WHERE lower(trim(estado_nuevo)) NOT IN ('activa', 'cancelada', 'sin asistencia', 'finalizada')"""
    o["dq6_contested_slots"] = """
SELECT nombre_sala, edificio, fecha, id_turno, count(*) AS veces, 'one_per_slot' AS regla FROM q_booking
GROUP BY ALL HAVING count(*) > 1"""
    for key, condition in (("dq7_overfull", "true"), ("dq7_overfull_confirmed", "p.confirmado")):
        o[key] = f"""
SELECT b.id_reserva, b.capacidad, count(*) AS personas, 'seats' AS regla FROM base b JOIN rp p USING (id_reserva)
WHERE {condition} GROUP BY b.id_reserva, b.capacidad HAVING count(*) > b.capacidad"""
    o["dq_all_model_constraints"] = _constraints({t: names.get(t, t) for t in model})
    o["dq8_people"] = f"""
SELECT * FROM (SELECT ci, email, {_DIGIT} AS ci_valida, {_DOMAIN} AS email_valido, 'people' AS regla FROM q_participant)
WHERE NOT (ci_valida AND email_valido)"""
    return o


def _constraints(view: dict[str, str]) -> str:
    """One row per declared constraint with its number of violations."""

    def count(rule: str, source: str) -> str:
        return f"SELECT '{rule}' AS regla, count(*) AS violaciones FROM {source}"

    parts = []
    for table, keys in KEYS.items():
        for key in map(", ".join, keys):
            rule = f"unique:{table}({key.replace(' ', '')})"
            parts.append(count(rule, f"(SELECT {key} FROM {view[table]} GROUP BY {key} HAVING count(*) > 1)"))
    for r in REFERENCES:
        on = " AND ".join(f"p.{b} = c.{a}" for a, b in zip(r.child_cols, r.parent_cols))
        parts.append(
            count(
                f"reference:{r.child}({','.join(r.child_cols)})",
                f"{view[r.child]} c WHERE NOT EXISTS (FROM {view[r.parent]} p WHERE {on})",
            )
        )
    for table, schema in TABLES.items():
        missing = " OR ".join(f"{f.name} IS NULL" for f in schema.fields if not f.nullable)
        parts.append(count(f"not_null:{table}", f"{view[table]} WHERE {missing}"))
    for (table, col), values in DOMAINS.items():
        allowed = ", ".join(f"'{v}'" for v in values)
        parts.append(count(f"domain:{table}({col})", f"{view[table]} WHERE {col} NOT IN ({allowed})"))
    for (table, col), longest in LENGTHS.items():
        parts.append(count(f"length:{table}({col})", f"{view[table]} WHERE length({col}) > {longest}"))
    parts.append(count("check:sala(capacidad)", "sala WHERE capacidad < 1 OR capacidad > 60"))
    parts.append(count("check:turno(fin_min)", "turno WHERE fin_min <= inicio_min"))
    parts.append(count("check:sancion_participante(fecha_fin)", "sancion WHERE fecha_fin < fecha_inicio"))
    slot = "nombre_sala, edificio, fecha, id_turno"
    twice = f"(SELECT {slot} FROM reserva WHERE estado = 'Activa' GROUP BY {slot} HAVING count(*) > 1)"
    parts.append(count("rule:one_per_slot", twice))
    parts.append(count("rule:seats", "base b JOIN confirmados c USING (id_reserva) WHERE c.n > b.capacidad"))
    student = "EXISTS (FROM ppa m WHERE m.ci_participante = p.ci AND m.rol = 'Estudiante')"
    other = "(EXISTS (FROM ppa m WHERE m.ci_participante = p.ci AND m.rol = 'Docente') OR NOT EXISTS (FROM ppa m WHERE m.ci_participante = p.ci))"
    fits = f"(({student} AND email LIKE '%@correo.ucu.edu.uy') OR ({other} AND email LIKE '%@ucu.edu.uy'))"
    parts.append(count("rule:people", f"participantes p WHERE NOT ({_DIGIT} AND {fits})"))
    return " UNION ALL ".join(parts)


def _flatten(sql: str) -> str:
    """Prepend the views; a statement with CTEs of its own keeps them after the views."""
    body = sql.strip()
    if body.startswith("WITH "):
        full = statement(body[5:])
        head, own = full.split("\n" + body[5:].strip(), 1)[0], body[5:].strip()
        return f"{head},\n{own}"
    return statement(body)


ORACLES: dict[str, str] = {name: _flatten(sql) for name, sql in _build().items()}
