"""Outlier masking by spread or by quartiles, and re-imputation of what was masked."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions import moments as M
from winnow.functions.constants import sql_value
from winnow.functions.quantiles import exact_quantiles
from winnow.operators.impute import Imputer
from winnow.roles import ROLES, Roles, col, ident


@dataclass
class OutlierMask:
    method: str
    threshold: float = 3.0
    params: dict = field(default_factory=dict)
    imputer: Imputer | None = None

    def mask(self, df: DataFrame) -> DataFrame:
        return df.selectExpr(*[self._cell(c) if c in self.params else ident(c) for c in df.columns])

    def _cell(self, c: str) -> str:
        a, b = map(sql_value, self.params[c])
        x = ident(c)
        if self.method == "zscore":
            out = f"abs(({x} - {a}) / {b}) > {sql_value(self.threshold)}"
        else:
            out = f"{x} < {a} OR {x} > {b}"
        return f"CASE WHEN NOT ({out}) THEN {x} END AS {x}"

    def apply(self, df: DataFrame) -> DataFrame:
        masked = self.mask(df)
        return self.imputer.apply(masked) if self.imputer is not None else masked


def fit_outliers(
    df: DataFrame,
    method: str = "zscore",
    threshold: float = 3.0,
    imputer: Imputer | None = None,
    roles: Roles = ROLES,
    n_rows: int | None = None,
) -> OutlierMask:
    """Limits come from the train rows and are reused on any other table."""
    cols = roles.numeric(df)
    out = OutlierMask(method, threshold, imputer=imputer)
    if not cols:
        return out
    if method == "zscore":
        aggs = [
            F.struct(F.avg(col(c)), M.sample_std(col(c)), F.max(col(c)) > F.min(col(c))).alias(f"a{i}")
            for i, c in enumerate(cols)
        ]
        r = df.agg(*aggs).first()
        out.params = {c: (r[f"a{i}"][0], r[f"a{i}"][1]) for i, c in enumerate(cols) if r[f"a{i}"][2]}
    elif method == "iqr":
        q = exact_quantiles(df, cols, [0.25, 0.75], n_rows=n_rows)
        for c in cols:
            q1, q3 = q[c]
            if q1 is not None:
                out.params[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    else:
        raise ValueError(f"unknown outlier method: {method}")
    return out
