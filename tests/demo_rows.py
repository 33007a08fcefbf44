"""The demo scenario: two attended groups, a no-show, a no-show over two slots, a past sanction."""

from __future__ import annotations

import datetime as dt

from aulario.sources.model import Model
from aulario.sources.schema import TABLES

# The demo people, rooms and reservations.
_PEOPLE = [
    ("48562347", "Ana", "Pérez", "ana.perez@correo.ucu.edu.uy"),
    ("51238903", "Luis", "González", "luis.gonzalez@correo.ucu.edu.uy"),
    ("43782512", "María", "Rodríguez", "maria.rodriguez@correo.ucu.edu.uy"),
    ("40672157", "Tomás", "Silva", "tomas.silva@correo.ucu.edu.uy"),
    ("53910675", "Camila", "Duarte", "camila.duarte@correo.ucu.edu.uy"),
    ("29875645", "José", "Rodríguez", "jrodriguez@ucu.edu.uy"),
    ("10000014", "Admin", "UCU", "administrativo@ucu.edu.uy"),
]
_FACULTIES = [
    (1, "Facultad de Ingeniería y Tecnologías"),
    (2, "Facultad de Derecho y Artes Liberales"),
    (3, "Facultad de Ciencias Empresariales"),
    (4, "Facultad de Ciencias de Salud"),
    (5, "Facultad de Psicología y Bienestar Humano"),
]
_PROGRAMMES = [
    ("Ingeniería en Informática", 1, "Grado"),
    ("Dirección de Empresas", 3, "Grado"),
    ("Psicología", 5, "Grado"),
    ("Arquitectura", 2, "Grado"),
    ("Medicina", 4, "Grado"),
    ("Maestría en Ciencia de Datos", 1, "Posgrado"),
]
_MEMBERS = [
    (1, "48562347", "Ingeniería en Informática", "Estudiante"),
    (2, "51238903", "Dirección de Empresas", "Estudiante"),
    (3, "43782512", "Psicología", "Estudiante"),
    (4, "40672157", "Arquitectura", "Estudiante"),
    (5, "53910675", "Medicina", "Estudiante"),
    (6, "29875645", "Maestría en Ciencia de Datos", "Docente"),
]
_ROOMS = [
    ("Sala A1", "Edificio Sacré Cœur", 40, "Libre"),
    ("Sala A2", "Edificio Sacré Cœur", 30, "Libre"),
    ("Sala B1", "Edificio Semprún", 25, "Posgrado"),
    ("Sala B2", "Edificio Semprún", 20, "Posgrado"),
    ("Sala C1", "Edificio San José", 50, "Libre"),
    ("Sala C2", "Edificio San José", 45, "Libre"),
    ("Sala D1", "Edificio Mullin", 35, "Docente"),
]
_DAY, _ASKED = dt.date(2025, 11, 20), dt.date(2025, 11, 1)
_BOOKINGS = [
    (1, "Sala A1", "Edificio Sacré Cœur", _DAY, 1, "Activa"),
    (2, "Sala A2", "Edificio Sacré Cœur", _DAY, 2, "Activa"),
    (3, "Sala B1", "Edificio Semprún", _DAY, 1, "Activa"),
    (4, "Sala C1", "Edificio San José", _DAY, 1, "Activa"),
    (5, "Sala C1", "Edificio San José", _DAY, 2, "Activa"),
]
_PRESENT = {1: ["48562347", "51238903", "43782512"], 3: ["48562347", "51238903"]}
_ABSENT = {
    2: ["40672157", "53910675"],
    4: ["43782512", "40672157", "53910675"],
    5: ["43782512", "40672157", "53910675"],
}


def table(spark, name, rows):
    return spark.createDataFrame(rows, TABLES[name])


def demo_tables(spark) -> Model:
    taking_part = [(ci, r, _ASKED, True, True) for r, cis in _PRESENT.items() for ci in cis]
    taking_part += [(ci, r, _ASKED, False, True) for r, cis in _ABSENT.items() for ci in cis]
    buildings = sorted({r[1] for r in _ROOMS})
    rows = {
        "participantes": _PEOPLE,
        "facultad": _FACULTIES,
        "programas_academicos": _PROGRAMMES,
        "participantes_programa_academico": _MEMBERS,
        "edificio": [(b, "-", "-") for b in buildings],
        "sala": _ROOMS,
        "turno": [(i, (7 + i) * 60, (8 + i) * 60) for i in range(1, 16)],
        "reserva": _BOOKINGS,
        "reserva_participante": taking_part,
        "sancion_participante": [(1, "51238903", dt.date(2025, 10, 1), dt.date(2025, 11, 1), False)],
        "notificacion": [],
    }
    return Model(spark, {n: table(spark, n, r) for n, r in rows.items()})
