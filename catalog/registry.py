"""Name -> (query, SQL) registry and the rounding both engines share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Round; adding 0 turns a negative zero into zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def sig(c: Column | str) -> Column:
    """Ten significant digits, for values of any size."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.format_string("%.9e", c.cast("double"))).cast("double")


def r(x: str, digits: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def g(x: str) -> str:
    return f"CAST(CASE WHEN ({x}) IS NULL THEN NULL ELSE format('{{:.9e}}', CAST({x} AS DOUBLE)) END AS DOUBLE)"


def rounded(df, cols=None, digits: int = 6):
    """Round every double column (or those named)."""
    names = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    names = names if cols is None else names & set(cols)
    return df.select(*[rnd(F.col(f"`{c}`"), digits).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])
