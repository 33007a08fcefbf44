"""Room-booking analytics expressed as Spark jobs over whole tables."""

from aulario.session import AS_OF, build_session, tune
from aulario.sources.model import Model
from aulario.sources.projection import project_testdata
from aulario.sources.tables import load_tables

__all__ = ["AS_OF", "Model", "build_session", "load_tables", "project_testdata", "tune"]
