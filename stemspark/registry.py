"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import geometry as geo

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def rounded(column, digits: int = 6):
    return F.floor(geo.number(column) * F.lit(float(10**digits)) + 0.5).cast("double") / F.lit(float(10**digits))


def rounded_sql(expr: str, digits: int = 6) -> str:
    return f"floor(({expr}) * 1e{digits} + 0.5) / 1e{digits}"
