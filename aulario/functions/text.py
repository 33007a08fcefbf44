"""Text checks and cleaning used when records are taken in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from aulario.sources import fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_person_name(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(fixed.NOMBRE_PERSONA), F.lit(False))


def is_room_name(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(fixed.NOMBRE_SALA), F.lit(False))


def is_ci_shape(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(fixed.CI_FORMATO), F.lit(False))


def _capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substring(word, 2, 2_000_000)))


def proper_name(c: Column | str) -> Column:
    """Collapse blanks and capitalise each word, and each part of a word around an apostrophe."""
    words = F.filter(F.split(_col(c), r"\s+"), lambda w: w != "")
    fixed_words = F.transform(words, lambda w: F.array_join(F.transform(F.split(w, "'"), _capitalised), "'"))
    return F.array_join(fixed_words, " ")


def check_digit_ok(ci: Column | str) -> Column:
    """Whether the last digit of an identity number matches the other seven."""
    digits = F.regexp_replace(_col(ci), r"\D", "")
    full = F.lpad(digits, 8, "0")

    def digit(i: int) -> Column:
        return F.substring(full, i, 1).try_cast("int")

    total = reduce(lambda a, b: a + b, [digit(i + 1) * w for i, w in enumerate(fixed.CI_PESOS)])
    return F.coalesce(F.length(digits).between(7, 8) & ((total + digit(8)) % 10 == 0), F.lit(False))


def email_domain_ok(email: Column | str, rol: Column | str) -> Column:
    """Students and staff write from different domains; the suffix is case-sensitive."""
    domain = F.when(F.lower(_col(rol)) == "estudiante", fixed.DOMINIO_ESTUDIANTE).otherwise(fixed.DOMINIO_PERSONAL)
    return F.coalesce(F.endswith(_col(email), domain), F.lit(False))


def canonical(c: Column | str, spellings: tuple[str, ...]) -> Column:
    """The stored spelling of a closed-set value whatever its case; NULL if it is none of them."""
    key = F.lower(F.trim(_col(c)))
    out = F.lit(None).cast("string")
    for s in reversed(spellings):
        out = F.when(key == s.lower(), s).otherwise(out)
    return out


#: Collation of the database's text columns: no case, no accents, ñ a letter of its own.
COLLATION = "es_CI_AI"


def text_key(c: Column | str) -> Column:
    """The text as the database compares it: equality, joins and grouping follow the Spanish collation.

    Trailing blanks do not count. The value keeps its spelling; keys are for comparing, not for output.
    """
    return F.collate(F.rtrim(_col(c)), COLLATION)


def contains_ci(c: Column | str, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(_col(c)), F.lit(needle.lower())), F.lit(False))


def fill(template: str, number: Column | str) -> Column:
    """A notification text with its ``{}`` replaced by a number."""
    before, after = template.split("{}")
    return F.concat(F.lit(before), _col(number).cast("string"), F.lit(after))
