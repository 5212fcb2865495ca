"""What the modules of registered queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
KEY, ORDER = ["subject_id"], ["frame"]


def query(sql: str | None = None):
    """Register a function as a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c, n: int = 4):
    return F.round(c, n)


def up(c, n: int = 4):
    """Rounded with ties, and what binary fractions leave just under one, upwards; ``round(x + 1e-9, n)`` in SQL does the same."""
    return F.round(c + F.lit(1e-9), n)
