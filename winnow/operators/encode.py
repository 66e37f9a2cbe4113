"""Categorical encoders. Fitted state is a (category -> code) table per column.

A column with few categories keeps its state on the driver and is applied by a broadcast
lookup; beyond ``STATE_ROWS`` categories the state stays a distributed table and the apply
is an ordinary join whose strategy Spark picks from sizes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.constants import sql_value
from winnow.functions.ranks import ordered_ordinal
from winnow.operators.profile import stacked
from winnow.roles import ROLES, Roles, col, ident
from winnow.session import bounded, small_table

STATE_ROWS = 20_000
ONEHOT_COLUMNS = 2_000

METHODS = ("onehot", "binary", "frequency", "label")


@dataclass
class CategoryState:
    """code/share per category; ``rows`` is set when the table is small."""

    size: int
    rows: list | None
    table: DataFrame | None

    def frame(self, spark, key: str, value: str) -> DataFrame:
        if self.rows is not None:
            return small_table(spark, [(k, v) for k, v in self.rows], f"`{key}` string, `{value}` double")
        return self.table.select(F.col("value").alias(key), F.col("code").cast("double").alias(value))


@dataclass
class Encoder:
    method: str
    states: dict[str, CategoryState] = field(default_factory=dict)
    digits: dict[str, int] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        for c in [c for c in self.states if c in df.columns]:
            df = getattr(self, "_" + self.method)(df, c)
        return df

    def _lookup(self, df: DataFrame, c: str) -> DataFrame:
        state = self.states[c].frame(df.sparkSession, "_k", "_code")
        return df.join(state, col(c).eqNullSafe(F.col("_k")), "left").drop("_k")

    def _replace(self, df: DataFrame, c: str, new: list) -> DataFrame:
        out = []
        for name in df.columns:
            if name == "_code":
                continue
            out += new if name == c else [col(name)]
        return df.select(*out)

    def _onehot(self, df: DataFrame, c: str) -> DataFrame:
        new = []
        named_null = any(value == "null" for value, _ in self.states[c].rows)
        for value, _ in self.states[c].rows:
            name = ("null_value" if named_null else "null") if value is None else value
            new.append(F.expr(f"cast({ident(c)} <=> {sql_value(value)} as double)").alias(f"{c}_{name}"))
        return self._replace(df, c, new)

    def _binary(self, df: DataFrame, c: str) -> DataFrame:
        n = self.digits[c]
        code = F.coalesce(F.col("_code"), F.lit(0.0)).cast("long")
        new = [
            F.shiftright(code, n - 1 - i).bitwiseAND(F.lit(1)).cast("double").alias(f"{c}_{i}")
            for i in range(n)
        ]
        return self._replace(self._lookup(df, c), c, new)

    def _frequency(self, df: DataFrame, c: str) -> DataFrame:
        share = F.when(col(c).isNotNull(), F.coalesce(F.col("_code"), F.lit(0.0)))
        return self._replace(self._lookup(df, c), c, [share.alias(c)])

    def _label(self, df: DataFrame, c: str) -> DataFrame:
        code = F.coalesce(F.col("_code"), F.lit(-1.0))
        return self._replace(self._lookup(df, c), c, [code.alias(c)])


def fit_encoder(
    df: DataFrame, method: str = "onehot", roles: Roles = ROLES, state_rows: int = STATE_ROWS
) -> Encoder:
    if method not in METHODS:
        raise ValueError(f"unknown encoding method: {method}")
    out = Encoder(method)
    cats = roles.categorical(df)
    if not cats:
        return out
    # one job counts the categories of every column
    first = [F.min(col(roles.row_id)).alias("first")] if method == "binary" else []
    long = stacked(df, cats, roles.ids(df) if first else [], "string")
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), *first)
    rows = bounded(counts, state_rows * len(cats))
    small: dict[str, list] = {c: [] for c in cats}
    for r in rows or ():
        small[r["feature"]].append(r)
    for c in cats:
        if rows is not None and len(small[c]) <= state_rows:
            state = _from_rows(small[c], method)
        elif method == "onehot":
            raise ValueError(f"{c}: more than {state_rows} categories; use frequency, label or binary")
        else:
            state = _from_table(counts.where(F.col("feature") == c), method)
        if method == "onehot" and state.size > ONEHOT_COLUMNS:
            raise ValueError(f"{c}: {state.size} categories; use frequency, label or binary")
        out.states[c] = state
        out.digits[c] = max(1, math.ceil(math.log2(state.size + 1))) if state.size > 0 else 1
    return out


def _from_rows(rows: list, method: str) -> CategoryState:
    if method == "frequency":
        total = sum(r["n"] for r in rows if r["value"] is not None)
        codes = [(r["value"], r["n"] / total) for r in rows if r["value"] is not None]
    elif method == "binary":
        ordered = sorted(rows, key=lambda r: r["first"])
        codes = [(r["value"], float(i + 1)) for i, r in enumerate(ordered)]
    else:
        ordered = sorted((r["value"] for r in rows), key=lambda v: (v is None, (v or "").encode()))
        codes = [(v, float(i)) for i, v in enumerate(ordered)]
    return CategoryState(len(codes), codes, None)


def _from_table(counts: DataFrame, method: str) -> CategoryState:
    if method == "frequency":
        known = counts.where("value is not null")
        total = known.agg(F.sum("n")).first()[0]
        return CategoryState(-1, None, known.select("value", (F.col("n") / F.lit(total)).alias("code")))
    order = [F.col("first")] if method == "binary" else [F.col("value").asc_nulls_last()]
    start = 1 if method == "binary" else 0
    table = ordered_ordinal(counts, order, "_i").select("value", (F.col("_i") + start).alias("code"))
    size = table.count() if method == "binary" else -1
    return CategoryState(size, None, table)
