"""The bundle of booking tables that operators read and return."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aulario.sources.schema import TABLES

Builder = Callable[["Model"], DataFrame]
#: Rows of a stored table that can concern reservations between two days (either may be open).
Reader = Callable[[dt.date | None, dt.date | None], DataFrame]


class Model:
    """Booking tables by name; each DataFrame is built when first asked for.

    ``model.reserva`` gives the table, ``model.replace(reserva=df)`` gives a new bundle in which
    only that table differs. A table may be given as a function of the new bundle, which runs when
    the table is first asked for: state nobody reads costs nothing. Bundles never change in place.
    """

    def __init__(
        self, spark: SparkSession, tables: Mapping[str, DataFrame | Builder], readers: Mapping[str, Reader] | None = None
    ):
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise KeyError(f"not tables of the model: {sorted(unknown)}")
        self.spark = spark
        self._sources = dict(tables)
        self._built: dict[str, DataFrame] = {}
        self._readers = dict(readers or {})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._built:
            source = self._sources[name]
            self._built[name] = source if isinstance(source, DataFrame) else source(self)
        return self._built[name]

    def replace(self, **changed: DataFrame | Builder) -> Model:
        """A bundle with some tables replaced; the others stay those of this one."""
        kept = {n: (lambda _, n=n: getattr(self, n)) for n in self._sources if n not in changed}
        readers = {n: r for n, r in self._readers.items() if n not in changed}
        return Model(self.spark, {**kept, **changed}, readers)

    def between(self, first: dt.date | None, last: dt.date | None) -> Model:
        """The bundle for questions about reservations from ``first`` to ``last`` (both included, either open).

        ``reserva`` holds those days alone. Tables stored by month are read from the months in
        question, so their other rows are left out as well; state that differs from what is stored
        is not cut.
        """
        if first is None and last is None:
            return self

        def reserva(_: Model) -> DataFrame:
            rows = self._readers["reserva"](first, last) if "reserva" in self._readers else self.reserva
            rows = rows if first is None else rows.filter(F.col("fecha") >= F.lit(first))
            return rows if last is None else rows.filter(F.col("fecha") <= F.lit(last))

        # participations lie in the folder of their reservation, as long as no reservation has moved since
        pruned = "reserva" in self._readers and "reserva_participante" in self._readers
        rp = {"reserva_participante": lambda _: self._readers["reserva_participante"](first, last)} if pruned else {}
        return self.replace(reserva=reserva, **rp)

    def names(self) -> list[str]:
        return [n for n in TABLES if n in self._sources]

    def cached(self, *names: str) -> Model:
        """Persist the named tables (call :meth:`release` when done)."""
        for n in names:
            getattr(self, n).persist()
        return self

    def release(self, *names: str) -> None:
        for n in names:
            getattr(self, n).unpersist()
