"""Constant tables inside a plan."""

from __future__ import annotations

import math

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant_array(rows, fields: str) -> Column:
    """A constant array of structs; parsed once and folded into the plan."""
    pairs = [f.split() for f in fields.split(", ")]
    text = json.dumps([dict(zip([n for n, _ in pairs], r)) for r in rows])
    return F.from_json(F.lit(text), "array<struct<%s>>" % ",".join(f"{n}:{t}" for n, t in pairs))


def constant_doubles(values) -> Column:
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def sql_value(v) -> str:
    """A fitted value as SQL text, read back as the same value. Plans of many columns are built from
    text: one call to the JVM for an expression instead of one for each of its parts."""
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    v = float(v)
    return f"{v!r}D" if math.isfinite(v) else f"double('{v!r}')"
