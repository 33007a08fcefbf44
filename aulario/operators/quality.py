"""Constraint checks as jobs: each returns the violating rows and the name of the rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aulario.functions.text import canonical, check_digit_ok, email_domain_ok, text_key
from aulario.operators.filters import SLOT
from aulario.sources import fixed
from aulario.sources.model import Model
from aulario.sources.schema import DOMAINS, KEYS, LENGTHS, REFERENCES, TABLES


def _rule(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("regla", F.lit(name))


def _compared(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Key columns as the database compares them: texts without case and accents, other types as they are."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return [(text_key(k) if k in texts else F.col(k)).alias(f"_{k}") for k in keys]


def check_unique(df: DataFrame, keys: Sequence[str], name: str = "unique") -> DataFrame:
    """Key values that occur more than once, with how often.

    Texts that differ in case, accents or trailing blanks are the same value to the database; of their
    spellings the smallest is shown.
    """
    shown = [F.min(k).alias(k) for k in keys]
    groups = df.groupBy(*_compared(df, keys)).agg(*shown, F.count("*").alias("veces"))
    return _rule(groups.filter(F.col("veces") > 1).select(*keys, "veces"), name)


def check_reference(child: DataFrame, cols: Sequence[str], parent: DataFrame, parent_cols: Sequence[str], name: str = "reference") -> DataFrame:
    """Child rows whose key is not in the parent; a key with a NULL part is not checked.

    Texts refer to a key of any case and accents, as in the database.
    """
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    asked = child.select("*", *[k.alias(f"_c{i}") for i, k in enumerate(_compared(child, cols))])
    keys = parent.select(*[k.alias(f"_c{i}") for i, k in enumerate(_compared(parent, parent_cols))])
    on = [f"_c{i}" for i in range(len(cols))]
    return _rule(asked.filter(whole).join(keys, on, "left_anti").select(*child.columns), name)


def check_not_null(df: DataFrame, cols: Sequence[str], name: str = "not_null") -> DataFrame:
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return _rule(df.filter(missing), name)


def check_holds(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """Rows for which a check is false (unknown passes, as in SQL)."""
    return _rule(df.filter(~condition), name)


def check_capacity_range(df: DataFrame) -> DataFrame:
    within = F.col("capacidad").between(fixed.MIN_CAPACIDAD, fixed.MAX_CAPACIDAD)
    return check_holds(df, within, "capacity_range")


def check_turno_order(df: DataFrame) -> DataFrame:
    return check_holds(df, F.col("fin_min") > F.col("inicio_min"), "turno_order")


def check_sanction_order(df: DataFrame) -> DataFrame:
    return check_holds(df, F.col("fecha_fin") >= F.col("fecha_inicio"), "sanction_order")


def check_domain(df: DataFrame, col: str, values: Sequence[str], name: str = "domain") -> DataFrame:
    """Values that are none of the closed set in any spelling the database takes (case, outer blanks)."""
    return check_holds(df, F.col(col).isNull() | canonical(col, tuple(values)).isNotNull(), name)


def check_length(df: DataFrame, col: str, longest: int, name: str = "length") -> DataFrame:
    return check_holds(df, F.length(col) <= longest, name)


def check_slots(df: DataFrame) -> DataFrame:
    """Room slots wanted or held more than once (give active reservations, or requests)."""
    return check_unique(df, SLOT, "one_per_slot")


def check_seats(t: Model, confirmed_only: bool = True) -> DataFrame:
    """Reservations with more people than their room seats."""
    rp = t.reserva_participante
    if confirmed_only:
        rp = rp.filter(F.col("confirmado") == F.lit(True))
    sizes = rp.groupBy("id_reserva").agg(F.count("*").alias("personas"))
    room = t.sala.select("nombre_sala", "edificio", "capacidad")
    over = t.reserva.join(sizes, "id_reserva").join(room, ["nombre_sala", "edificio"])
    return _rule(
        over.filter(F.col("personas") > F.col("capacidad")).select("id_reserva", "capacidad", "personas"),
        "seats",
    )


def check_people(people: DataFrame, memberships: DataFrame | None = None) -> DataFrame:
    """People whose identity number or e-mail domain is invalid.

    The role comes from ``people`` or from their memberships; without one, staff rules apply, and
    somebody with several roles passes if one of them fits the e-mail.
    """
    if memberships is not None:
        roles = memberships.groupBy(F.col("ci_participante").alias("ci")).agg(
            F.max(F.lower("rol") == "estudiante").alias("_est"), F.max(F.lower("rol") != "estudiante").alias("_otro")
        )
        rows = people.join(roles, "ci", "left")
        as_student = email_domain_ok("email", F.lit("Estudiante")) & F.coalesce("_est", F.lit(False))
        as_staff = email_domain_ok("email", F.lit("Docente")) & F.coalesce(F.col("_otro"), F.col("_est").isNull())
        fits = as_student | as_staff
    else:
        rows, fits = people, email_domain_ok("email", "rol")
    flagged = rows.select("ci", "email", check_digit_ok("ci").alias("ci_valida"), fits.alias("email_valido"))
    return _rule(flagged.filter(~(F.col("ci_valida") & F.col("email_valido"))), "people")


def row_rules() -> dict[str, dict[str, Column]]:
    """Per table, the constraints a row meets or breaks on its own: rule -> condition that must hold."""
    out: dict[str, dict[str, Column]] = {table: {} for table in TABLES}
    for table, schema in TABLES.items():
        required = [F.col(f.name).isNotNull() for f in schema.fields if not f.nullable]
        out[table][f"not_null:{table}"] = reduce(lambda a, b: a & b, required)
    for (table, col), values in DOMAINS.items():
        out[table][f"domain:{table}({col})"] = F.col(col).isin(*values)
    for (table, col), longest in LENGTHS.items():
        out[table][f"length:{table}({col})"] = F.length(col) <= longest
    out["sala"]["check:sala(capacidad)"] = F.col("capacidad").between(fixed.MIN_CAPACIDAD, fixed.MAX_CAPACIDAD)
    out["turno"]["check:turno(fin_min)"] = F.col("fin_min") > F.col("inicio_min")
    out["sancion_participante"]["check:sancion_participante(fecha_fin)"] = F.col("fecha_fin") >= F.col("fecha_inicio")
    return out


def _keyed_checks(t: Model) -> dict[str, DataFrame]:
    """Constraints that compare rows: keys, references, slots, seats, people."""
    out: dict[str, DataFrame] = {}
    for table, keys in KEYS.items():
        for key in keys:
            out[f"unique:{table}({','.join(key)})"] = check_unique(getattr(t, table), key)
    for r in REFERENCES:
        name = f"reference:{r.child}({','.join(r.child_cols)})"
        out[name] = check_reference(getattr(t, r.child), r.child_cols, getattr(t, r.parent), r.parent_cols)
    out["rule:one_per_slot"] = check_slots(t.reserva.filter(F.col("estado") == fixed.ACTIVA))
    out["rule:seats"] = check_seats(t)
    out["rule:people"] = check_people(t.participantes, t.participantes_programa_academico)
    return out


def model_checks(t: Model) -> Mapping[str, DataFrame]:
    """Every declared constraint of the model as name -> violating rows."""
    out = _keyed_checks(t)
    for table, rules in row_rules().items():
        for name, condition in rules.items():
            out[name] = check_holds(getattr(t, table), condition, name)
    return out


def violation_counts(t: Model) -> DataFrame:
    """Violations per constraint: ``regla``, ``violaciones``.

    All row-level constraints of a table are counted in one pass over it.
    """
    parts = [
        df.agg(F.count("*").alias("violaciones")).select(F.lit(name).alias("regla"), "violaciones")
        for name, df in _keyed_checks(t).items()
    ]
    for table, rules in row_rules().items():
        broken = [
            F.struct(F.lit(name).alias("regla"), F.count_if(~condition).alias("violaciones"))
            for name, condition in rules.items()
        ]
        parts.append(getattr(t, table).agg(F.array(*broken).alias("r")).select(F.inline("r")))
    return reduce(lambda a, b: a.unionByName(b), parts)
