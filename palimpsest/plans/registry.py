"""All queries of the core and the SQL that gives the same rows."""

from __future__ import annotations

from . import queries as overlap
from . import skew


def queries() -> dict:
    return {**overlap.QUERIES, **skew.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**overlap.ORACLE, **skew.ORACLE}
