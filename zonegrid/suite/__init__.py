"""All registered queries (``QUERIES``) and their DuckDB oracles (``ORACLE``)."""

from . import core, evaluate, forest, models, ops, prep, scoring  # noqa: F401  (registers)
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
