"""Scaling of numeric columns. Fit gives a few numbers per column; apply is a projection."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.constants import constant_array, sql_value
from winnow.functions.quantiles import exact_quantiles, with_buckets
from winnow.operators.select import column_stats
from winnow.roles import ROLES, Roles, col, ident

METHODS = ("standard", "minmax", "maxabs", "power", "quantile", "normalizer", "robust", "kbins")
QUANTILES = 1000
BIN_COUNT = 5
# strictly increasing in every column: a column that varies still varies afterwards
MONOTONE = ("standard", "minmax", "maxabs", "robust", "power")


def yeo_johnson(x: Column, lam: float) -> Column:
    up, down = F.greatest(x, F.lit(0.0)), F.greatest(-x, F.lit(0.0))
    pos = F.log1p(up) if lam == 0 else (F.pow(up + 1.0, F.lit(lam)) - 1.0) / lam
    neg = F.log1p(down) if lam == 2 else (F.pow(down + 1.0, F.lit(2.0 - lam)) - 1.0) / (2.0 - lam)
    return F.when(x >= 0, pos).when(x < 0, -neg)


@dataclass
class Scaler:
    method: str
    columns: list[str] = field(default_factory=list)
    others: list[str] = field(default_factory=list)
    params: dict[str, tuple] = field(default_factory=dict)
    roles: Roles = ROLES

    def apply(self, df: DataFrame) -> DataFrame:
        """Scaled columns first, then the other features; a column missing from ``df`` is 0."""
        have = set(df.columns)
        for c in self.columns:
            if c not in have:
                df = df.withColumn(c, F.lit(0.0))
        tail = [c for c in self.others if c in have]
        if self.method == "quantile":
            return self._quantile(df, tail)
        if self.method == "normalizer":
            norm = F.sqrt(sum((col(c) * col(c) for c in self.columns[1:]), col(self.columns[0]) * col(self.columns[0])))
            new = [
                F.coalesce(col(c) / F.nullif(norm, F.lit(0.0)), col(c)).alias(c) for c in self.columns
            ]
        elif self.method in ("standard", "minmax", "maxabs", "robust"):
            cells = [f"({ident(c)} - {sql_value(m)}) / {sql_value(w)} AS {ident(c)}" for c, (m, w) in ((c, self.params[c]) for c in self.columns)]
            r = self.roles
            return df.selectExpr(*map(ident, r.ids(df)), *cells, *map(ident, tail), *map(ident, r.labels(df)))
        else:
            new = [self._cell(c).alias(c) for c in self.columns]
        return self._shape(df, new, tail)

    def _shape(self, df: DataFrame, new: list, tail: list[str]) -> DataFrame:
        r = self.roles
        return df.select(*r.ids(df), *new, *[col(c) for c in tail], *r.labels(df))

    def _cell(self, c: str) -> Column:
        x, p = col(c), self.params[c]
        if self.method == "kbins":
            hits = [(x >= e).cast("double") for e in p]
            return F.when(x.isNotNull(), sum(hits[1:], hits[0]) if hits else F.lit(0.0))
        if self.method == "power":
            lam, mean, std = p
            return (yeo_johnson(x, lam) - mean) / std
        raise ValueError(f"not a cell by cell method: {self.method}")

    def _quantile(self, df: DataFrame, tail: list[str]) -> DataFrame:
        names = {c: f"_x{i}" for i, c in enumerate(self.columns) if len(self.params[c][0]) > 1}
        df = df.select("*", *[col(c).alias(n) for c, n in names.items()])
        if names:
            df = with_buckets(df, {n: self.params[c][0] for c, n in names.items()})
        new = []
        for c in self.columns:
            xs, lo, hi = self.params[c]
            x = col(c)
            if len(xs) < 2:
                flat = F.when(x <= F.lit(xs[0]), 0.0).when(x > F.lit(xs[0]), 1.0) if xs else F.lit(None)
                new.append(flat.cast("double").alias(c))
                continue
            levels = constant_array(zip(xs, lo, hi), "x double, lo double, hi double")
            b = F.col(names[c] + "__b").cast("int")
            here, there = F.try_element_at(levels, F.greatest(b, F.lit(1))), F.try_element_at(levels, b + 1)
            left = here["x"]
            between = here["hi"] + (x - left) * (there["lo"] - here["hi"]) / F.nullif(there["x"] - left, F.lit(0.0))
            value = (
                F.when(x <= F.lit(xs[0]), 0.0)
                .when(x >= F.lit(xs[-1]), 1.0)
                .when(x == left, (here["lo"] + here["hi"]) / 2)
                .otherwise(between)
            )
            new.append(F.when(x.isNotNull(), value).alias(c))
        return self._shape(df, new, tail)


def fit_scaler(
    df: DataFrame, method: str = "standard", roles: Roles = ROLES, n_rows: int | None = None,
    stats: dict | None = None,
) -> Scaler:
    """``stats`` are column statistics already taken from ``df``, if any."""
    if method not in METHODS:
        raise ValueError(f"unknown scaling method: {method}")
    cols = roles.numeric(df)
    if not cols:
        raise ValueError("no numeric columns to scale")
    others = [c for c in roles.features(df) if c not in cols]
    out = Scaler(method, cols, others, roles=roles)
    if method in ("standard", "minmax", "maxabs"):
        stats = column_stats(df, roles) if stats is None else stats
        out.params = {c: _linear(method, *stats[c][:4]) for c in cols}
    elif method == "robust":
        q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], n_rows=n_rows)
        for c in cols:
            q1, q2, q3 = q[c]
            out.params[c] = (q2 or 0.0, (q3 - q1) or 1.0) if q1 is not None else (0.0, 1.0)
    elif method == "kbins":
        q = exact_quantiles(df, cols, [i / BIN_COUNT for i in range(BIN_COUNT + 1)], n_rows=n_rows)
        out.params = {c: tuple(_inner_edges(q[c])) for c in cols}
    elif method == "quantile":
        n = df.count() if n_rows is None else n_rows
        m = max(1, min(QUANTILES, n))
        refs = [i / (m - 1) for i in range(m)] if m > 1 else [0.0]
        q = exact_quantiles(df, cols, refs, n_rows=n)
        out.params = {c: _levels(q[c], refs) for c in cols}
    elif method == "power":
        out.params = _fit_power(df, cols)
    return out


def _linear(method, lo, hi, avg, std) -> tuple[float, float]:
    if lo is None:
        return (0.0, 1.0)
    if method == "standard":
        return (avg, std if hi > lo else 1.0) if hi > lo else (lo, 1.0)
    if method == "minmax":
        return (lo, (hi - lo) if hi > lo else 1.0)
    return (0.0, max(abs(lo), abs(hi)) or 1.0)


def _inner_edges(edges: list) -> list[float]:
    if edges[0] is None:
        return []
    kept = [edges[0]] + [e for prev, e in zip(edges, edges[1:]) if e - prev > 1e-8]
    return kept[1:-1]


def _levels(values: list, refs: list[float]) -> tuple[list, list, list]:
    """Distinct quantile values with the first and last level each one covers."""
    xs, lo, hi = [], [], []
    for v, r in zip(values, refs):
        if v is None:
            continue
        if xs and v <= xs[-1]:
            hi[-1] = r
        else:
            xs.append(v)
            lo.append(r)
            hi.append(r)
    return xs, lo, hi


def _fit_power(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    """Maximum-likelihood exponent per column. Each pass scores a grid of exponents for all
    columns in one aggregate and moves to the vertex of the parabola through the best three;
    the grid shrinks from pass to pass, or moves outward when its edge is best."""
    narrow = df.select(*[col(c) for c in cols]).persist()
    try:
        base = narrow.agg(
            *[
                F.struct(
                    F.count(col(c)).alias("n"),
                    F.avg(col(c)).alias("m"),
                    (F.max(col(c)) > F.min(col(c))).alias("varies"),
                    F.sum(F.signum(col(c)) * F.log1p(F.abs(col(c)))).alias("j"),
                ).alias(f"a{i}")
                for i, c in enumerate(cols)
            ]
        ).first()
        stats = {c: base[f"a{i}"] for i, c in enumerate(cols)}
        live = [c for c in cols if stats[c]["varies"]]
        out = {c: (1.0, stats[c]["m"] or 0.0, 1.0) for c in cols if c not in live}
        if not live:
            return out
        centre = dict.fromkeys(live, 0.0)
        width = dict.fromkeys(live, 2.0)
        for round_no in range(12):
            points = 9 if round_no == 0 else 5
            todo = [c for c in live if width[c] > 1e-3]
            if not todo:
                break
            grid = [
                (c, float(v))
                for c in todo
                for v in np.linspace(centre[c] - width[c], centre[c] + width[c], points)
            ]
            moments = _power_moments(narrow, grid, stats)
            for i, c in enumerate(todo):
                lams = [lam for _, lam in grid[i * points : (i + 1) * points]]
                ll = []
                for lam, (_, var) in zip(lams, moments[i * points : (i + 1) * points]):
                    good = np.isfinite(var) and var > 0
                    n, j = stats[c]["n"], stats[c]["j"]
                    ll.append(-n / 2 * np.log(var) + (lam - 1) * j if good else -np.inf)
                k = int(np.argmax(ll))
                if k in (0, points - 1):
                    centre[c] = lams[k]
                    continue
                step = lams[1] - lams[0]
                lo, mid, hi = ll[k - 1], ll[k], ll[k + 1]
                bend = lo - 2 * mid + hi
                shift = 0.5 * step * (lo - hi) / bend if np.isfinite(bend) and bend < 0 else 0.0
                centre[c] = lams[k] + shift
                width[c] = step / (2 if round_no == 0 else 5)
        best = [(c, float(centre[c])) for c in live]
        for (c, lam), (mean, var) in zip(best, _power_moments(narrow, best, stats)):
            out[c] = (lam, mean, float(np.sqrt(var)) or 1.0)
        return out
    finally:
        narrow.unpersist()


def _power_moments(df: DataFrame, grid: list, stats: dict) -> list[tuple[float, float]]:
    """(mean, variance) of the transformed column for every (column, exponent) of the grid,
    as one elementwise vector aggregate. Values are shifted by the transform of the column
    mean, so squares do not cancel; NULL contributes nothing."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    shifts = [_yj_number(stats[c]["m"], lam) for c, lam in grid]
    cells = []
    for (c, lam), s in zip(grid, shifts):
        x = ident(c)
        two = 2.0 - lam
        up = f"log1p({x})" if lam == 0 else f"(power({x} + 1D, {lam!r}D) - 1D) / {lam!r}D"
        down = f"-log1p(-{x})" if two == 0 else f"(1D - power(1D - {x}, {two!r}D)) / {two!r}D"
        cells.append(f"CASE WHEN {x} >= 0 THEN {up} - ({s!r}D) WHEN {x} < 0 THEN {down} - ({s!r}D) ELSE 0D END")
    vec = df.select(array_to_vector(F.expr("array(" + ", ".join(cells) + ")")).alias("v"))
    r = vec.select(Summarizer.metrics("sum", "normL2").summary(F.col("v")).alias("s")).first()["s"]
    total, norm = r["sum"].toArray(), r["normL2"].toArray()
    out = []
    for k, (c, _) in enumerate(grid):
        n = stats[c]["n"]
        m = total[k] / n
        out.append((float(shifts[k] + m), float(norm[k] ** 2 / n - m * m)))
    return out


def _yj_number(x: float, lam: float) -> float:
    if x >= 0:
        return float(np.log1p(x)) if lam == 0 else ((x + 1.0) ** lam - 1.0) / lam
    two = 2.0 - lam
    return -float(np.log1p(-x)) if two == 0 else -((1.0 - x) ** two - 1.0) / two
