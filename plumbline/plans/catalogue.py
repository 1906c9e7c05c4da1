"""All registered queries and the SQL that states the same in DuckDB."""

from . import assign, audit, checks, fit, layout, resolve, streams  # noqa: F401
from .views import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
