"""Imputation. Fit reads train features only; apply is a projection of constants, except
for the neighbour method, which is a join."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.constants import sql_value
from winnow.functions.moments import gram
from winnow.functions.quantiles import exact_quantiles
from winnow.operators.profile import stacked
from winnow.roles import ROLES, Roles, col, ident


def modes(df: DataFrame, cols: list[str], as_type: str) -> dict:
    """Most frequent value per column, smallest on ties, by counts then an arg-max."""
    if not cols:
        return {}
    counts = stacked(df, cols, [], as_type).where("value is not null").groupBy("feature", "value").count()
    best = counts.groupBy("feature").agg(F.min(F.struct(-F.col("count"), F.col("value"))).alias("m"))
    return {r["feature"]: r["m"]["value"] for r in best.collect()}


@dataclass
class Imputer:
    strategy: str
    numeric: dict = field(default_factory=dict)
    categorical: dict = field(default_factory=dict)
    donors: DataFrame | None = None
    coefficients: list = field(default_factory=list)
    roles: Roles = ROLES

    def apply(self, df: DataFrame) -> DataFrame:
        if self.strategy == "knn" and self.donors is not None:
            df = self._from_neighbours(df)
        if self.strategy == "iterative" and self.coefficients:
            df = self._from_regressions(df)
        return self._constants(df)

    def _constants(self, df: DataFrame) -> DataFrame:
        fills = {**self.numeric, **self.categorical}
        cells = [
            f"coalesce({ident(c)}, {sql_value(fills[c])}) AS {ident(c)}" if fills.get(c) is not None else ident(c)
            for c in df.columns
        ]
        return df.selectExpr(*cells)

    def _from_neighbours(self, df: DataFrame) -> DataFrame:
        from winnow.operators.knn import neighbour_means

        dims = [c for c in self.numeric if c in df.columns]
        return neighbour_means(df, self.donors, dims, k=5, roles=self.roles)

    def _from_regressions(self, df: DataFrame) -> DataFrame:
        """Replays every round of the fit: later rounds start from what earlier ones filled in."""
        filled = self.swept(self.flagged(df), self.coefficients)
        return filled.drop(*["_na_" + c for c in self.numeric])

    def flagged(self, df: DataFrame) -> DataFrame:
        """The table with constants filled in and a flag for each hole."""
        for c in self.numeric:
            df = df.withColumn("_na_" + c, col(c).isNull())
        return self._constants(df)

    def swept(self, df: DataFrame, steps: list[tuple[str, list[float]]]) -> DataFrame:
        dims = list(self.numeric)
        for target, weights in steps:
            others = [c for c in dims if c != target]
            guess = F.lit(weights[0])
            for c, w in zip(others, weights[1:]):
                guess = guess + col(c) * F.lit(w)
            df = df.withColumn(target, F.when(F.col("_na_" + target), guess).otherwise(col(target)))
        return df


def fit_imputer(
    df: DataFrame,
    strategy: str = "mean",
    roles: Roles = ROLES,
    fill_value: float = 0.0,
    rounds: int = 10,
    n_rows: int | None = None,
) -> Imputer:
    """Strategies: mean, median, most_frequent, constant, knn, iterative. Categorical
    columns always take their most frequent value."""
    num, cat = roles.numeric(df), roles.categorical(df)
    out = Imputer(strategy, roles=roles)
    out.categorical = modes(df, cat, "string")
    if not num:
        return out
    if strategy == "median":
        q = exact_quantiles(df, num, [0.5], n_rows=n_rows)
        out.numeric = {c: q[c][0] for c in num}
    elif strategy == "most_frequent":
        found = modes(df, num, "double")
        out.numeric = {c: found.get(c) for c in num}
    elif strategy == "constant":
        out.numeric = {c: float(fill_value) for c in num}
    elif strategy in ("mean", "knn", "iterative"):
        r = df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(num)]).first()
        out.numeric = {c: r[f"m{i}"] for i, c in enumerate(num)}
    else:
        raise ValueError(f"unknown imputation strategy: {strategy}")
    if strategy == "knn":
        out.donors = df.select(*roles.ids(df), *[col(c) for c in num])
    if strategy == "iterative":
        _fit_rounds(df, out, num, rounds)
    return out


def _fit_rounds(df: DataFrame, out: Imputer, num: list[str], rounds: int) -> None:
    """Round-robin ridge regressions. Every step is one cross-product aggregate of the
    current state of the table; the solve is d x d on the driver."""
    live = [c for c in num if out.numeric[c] is not None]
    out.numeric = {c: out.numeric[c] for c in live}
    r = df.agg(*[F.count(F.when(col(c).isNull(), 1)).alias(f"m{i}") for i, c in enumerate(live)]).first()
    holes = [c for i, c in enumerate(live) if r[f"m{i}"] > 0]
    holes.sort(key=lambda c: r[f"m{live.index(c)}"])
    if not holes or len(live) < 2:
        return
    last: dict[str, np.ndarray] = {}
    state = Imputer("iterative", {c: out.numeric[c] for c in live})
    current = state.flagged(df.select(*[col(c) for c in live])).persist()
    for _ in range(rounds):
        change, earlier, steps = 0.0, current, []
        for target in holes:
            others = [c for c in live if c != target]
            n, s, g = gram(current.where(~F.col("_na_" + target)), [*others, target])
            mean = s / n
            cov = g / n - np.outer(mean, mean)
            a, b = cov[:-1, :-1], cov[:-1, -1]
            ridge = 1e-8 * max(np.trace(a) / max(len(others), 1), 1e-12)
            w = np.linalg.solve(a + ridge * np.eye(len(others)), b)
            full = np.concatenate([[mean[-1] - w @ mean[:-1]], w])
            scale = np.abs(full).max() or 1.0
            change = max(change, np.abs(full - last.get(target, np.full_like(full, np.inf))).max() / scale)
            last[target] = full
            steps.append((target, [float(x) for x in full]))
            current = state.swept(current, steps[-1:])
        out.coefficients += steps
        current = current.persist()  # the table as this round leaves it
        if change < 1e-6:
            break
        current.count()
        earlier.unpersist()
    earlier.unpersist()
    current.unpersist()
