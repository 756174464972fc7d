"""All queries of the library and their SQL."""

from . import content, history, models, more, runs  # noqa: F401  they register their queries
from .adapters import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
