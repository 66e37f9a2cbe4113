"""Column expressions for moments with the sample corrections data profiles use."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.roles import col

WIDE_LIMIT = 40


def corrected_skew(c: Column) -> Column:
    n = F.count(c).cast("double")
    flat = F.min(c) == F.max(c)
    scale = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n < 3, None).when(flat, 0.0).otherwise(F.skewness(c) * scale)


def corrected_kurtosis(c: Column) -> Column:
    """Excess kurtosis, unbiased form; Spark's own is the population excess."""
    n = F.count(c).cast("double")
    flat = F.min(c) == F.max(c)
    scaled = ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n < 4, None).when(flat, 0.0).otherwise(scaled)


def when_varies(c: Column, value: Column) -> Column:
    """``value`` where the column varies, else 0: merging partial means of a constant may
    leave a spread of rounding size, while its range is exactly 0."""
    return F.when(F.min(c) == F.max(c), 0.0).otherwise(value)


def sample_variance(c: Column) -> Column:
    return F.when(F.count(c) < 2, None).otherwise(when_varies(c, F.var_samp(c)))


def sample_std(c: Column) -> Column:
    return F.when(F.count(c) < 2, None).otherwise(when_varies(c, F.stddev_samp(c)))


def pair_correlation(a: Column, b: Column) -> Column:
    """Pearson over rows where both sides are present; NULL when either is constant.

    Written with covariance because ``corr`` raises on a constant column in ANSI mode.
    Constancy is tested on the range, which is exact, rather than on a rounded variance.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    varies = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(varies, F.covar_pop(x, y) / F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0)))


def abs_correlation(a: Column, b: Column) -> Column:
    """|Pearson| over rows where both sides are present, NULL when either is constant there."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    varies = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(varies, F.sqrt(F.regr_r2(a, b)))


def mean_defined(values: list[Column]) -> Column:
    """Mean of the non-NULL entries of a list of scalar columns."""
    if not values:
        return F.lit(None).cast("double")
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values[1:]), F.coalesce(values[0], F.lit(0.0)))
    n = sum((v.isNotNull().cast("int") for v in values[1:]), values[0].isNotNull().cast("int"))
    return total / F.nullif(n.cast("double"), F.lit(0.0))


def pairs(cols: list[str]) -> list[tuple[str, str]]:
    return list(combinations(cols, 2))


def gram(df: DataFrame, cols: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, column sums, X'X) over the rows given; the driver receives d + d*d numbers.

    Up to ``WIDE_LIMIT`` columns it is one aggregate of generated sums with map-side
    partials; wider tables use RowMatrix, which tree-aggregates packed matrices. A null counts
    as 0 either way, which is the mean where the values were centred first.
    """
    d = len(cols)
    if d <= WIDE_LIMIT:
        aggs = [F.count(F.lit(1)).alias("n")]
        aggs += [F.sum(col(c)).alias(f"s{i}") for i, c in enumerate(cols)]
        aggs += [
            F.sum(col(cols[i]) * col(cols[j])).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)
        ]
        r = df.agg(*aggs).first()
        n = float(r["n"])
        s = np.array([r[f"s{i}"] or 0.0 for i in range(d)])
        g = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                g[i, j] = g[j, i] = r[f"g{i}_{j}"] or 0.0
        return n, s, g
    filled = F.array(*[F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in cols])
    return gram_of_array(df.select(filled.alias("_a")), "_a")


def gram_of_array(df: DataFrame, name: str) -> tuple[float, np.ndarray, np.ndarray]:
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    # a leading one makes the same matrix carry n and the column sums
    vec = df.select(array_to_vector(F.concat(F.array(F.lit(1.0)), F.col(name))).alias("_v"))
    m = RowMatrix(MLUtils.convertVectorColumnsFromML(vec, "_v")).computeGramianMatrix().toArray()
    return float(m[0, 0]), m[0, 1:].copy(), m[1:, 1:].copy()


def covariance(n: float, s: np.ndarray, g: np.ndarray) -> np.ndarray:
    return (g - np.outer(s, s) / n) / max(n - 1.0, 1.0)


def centred_gram(df: DataFrame, cols: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, means, covariance): moments are taken after subtracting a first-pass mean, so
    large offsets do not cancel away the signal."""
    first = df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    m0 = np.array([first[f"m{i}"] or 0.0 for i in range(len(cols))])
    moved = df.select(*[(col(c) - float(m0[i])).alias(c) for i, c in enumerate(cols)])
    n, s, g = gram(moved, cols)
    return n, m0 + s / max(n, 1.0), covariance(n, s, g)
