"""From requests to state: requests are taken one after the other and what is granted changes the tables.

The verdicts are those of sequential admission, so two requests of one batch never get the same room
slot, seat or last unit of a quota. They are written to the shared folder once: both tables and the
gate see the same grants. The gate looks at what the grants touch and refuses to hand on a state in
which a slot is held twice or a room is overfull through them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulario.operators import admission
from aulario.operators.changes import accepted, apply_bookings, apply_joins
from aulario.operators.filters import SLOT
from aulario.operators.quality import check_seats, check_slots
from aulario.operators.verdicts import Mode, Outcome
from aulario.plans.staging import stage
from aulario.sources import fixed
from aulario.sources.model import Model

By = Literal["self", "admin"]
Admit = Callable[[Model, DataFrame, dt.datetime, Mode], DataFrame]

_BOOKINGS: Mapping[str, Admit] = {"self": admission.admit_bookings_self, "admin": admission.admit_bookings_admin}
_JOINS: Mapping[str, Admit] = {"self": admission.admit_joins, "admin": admission.admit_adds_admin}


class BrokenRule(RuntimeError):
    """A state that a batch must not lead to."""


def require_none(violations: DataFrame) -> None:
    """Fail with a few examples if a check of ``quality`` returns rows."""
    examples = violations.take(3)
    if examples:
        raise BrokenRule("; ".join(str(row.asDict()) for row in examples))


def gate_bookings(t: Model, granted: DataFrame) -> None:
    """No granted slot is granted twice or was held before."""
    wanted = granted.select(*SLOT)
    held = t.reserva.filter(F.col("estado") == fixed.ACTIVA).select(*SLOT).join(wanted.distinct(), SLOT, "left_semi")
    require_none(check_slots(held.unionByName(wanted)))


def gate_joins(after: Model, granted: DataFrame, confirmed_only: bool) -> None:
    """No reservation somebody was let into has more people than its room seats."""
    touched = granted.select("id_reserva").distinct()
    narrowed = after.replace(
        reserva=after.reserva.join(touched, "id_reserva", "left_semi"),
        reserva_participante=after.reserva_participante.join(touched, "id_reserva", "left_semi"),
    )
    require_none(check_seats(narrowed, confirmed_only))


def book(t: Model, requests: DataFrame, as_of: dt.datetime, by: By = "admin") -> Outcome:
    """Bookings in (``request_ts``, ``request_id``) order become active reservations with their requester."""
    verdicts = stage(_BOOKINGS[by](t, requests, as_of, "sequential"), "bookings")
    gate_bookings(t, accepted(verdicts))
    return Outcome(apply_bookings(t, verdicts, as_of), verdicts)


def join(t: Model, requests: DataFrame, as_of: dt.datetime, by: By = "self") -> Outcome:
    """People who ask for (or are given) a seat, in order; accepted ones are confirmed."""
    verdicts = stage(_JOINS[by](t, requests, as_of, "sequential"), "joins")
    after = apply_joins(t, verdicts, as_of)
    gate_joins(after, accepted(verdicts), confirmed_only=by == "self")
    return Outcome(after, verdicts)
