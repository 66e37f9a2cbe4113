"""Feature construction: projections, products, tree leaves. Numeric columns are replaced;
categorical columns and the label are kept. Output columns are named "0", "1", ..."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions import moments as M
from winnow.functions.constants import sql_value
from winnow.operators import forest, landmarks, linear
from winnow.roles import ROLES, Roles, col, ident

# Spellings accepted for the kernel projection.
ALIASES = {"kernalPCA": "kernelPCA", "kernel_pca": "kernelPCA"}
METHODS = (
    "pca", "IncrementalPCA", "TruncatedSVD", "kernelPCA", "lda",
    "polynomial", "InteractionFeatures", "RandomTrees",
)
TREES = 100
TREE_DEPTH = 5
# Rows of a task of the forest.
FOREST_ROWS = 200_000


@dataclass
class FeatureMap:
    method: str
    columns: list[str]
    roles: Roles = ROLES
    centre: np.ndarray | None = None
    weights: np.ndarray | None = None
    land: landmarks.Landmarks | None = None
    terms: list[tuple[str, ...]] = field(default_factory=list)
    trees: forest.Forest | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        df = df.selectExpr(
            *[ident(c) for c in df.columns if c not in self.columns],
            *[ident(c) if c in have else f"0D AS {ident(c)}" for c in self.columns],
        )
        if self.method == "RandomTrees":
            return self._leaves(df)
        if self.method in ("polynomial", "InteractionFeatures"):
            new = [F.expr(" * ".join(map(ident, t))).alias(str(i)) for i, t in enumerate(self.terms)]
            return self._shape(df, new)
        if self.land is not None:
            turned = self.land.linear(number_array(self.columns), self.weights, -(self.centre @ self.weights))
            return self._shape(df, [F.get(turned, F.lit(k)).alias(str(k)) for k in range(self.weights.shape[1])])
        new = []
        for k in range(self.weights.shape[1]):
            parts = [
                f"({ident(c)} - {sql_value(self.centre[i])}) * {sql_value(self.weights[i, k])}"
                for i, c in enumerate(self.columns)
            ]
            new.append(F.expr(" + ".join(["0D", *parts])).alias(str(k)))
        return self._shape(df, new)

    def _shape(self, df: DataFrame, new: list[Column]) -> DataFrame:
        r = self.roles
        kept = [c for c in r.features(df) if c not in self.columns]
        return df.select(*r.ids(df), *new, *[col(c) for c in kept], *r.labels(df))

    def _leaves(self, df: DataFrame) -> DataFrame:
        r = self.roles
        kept = [c for c in r.features(df) if c not in self.columns]
        onehot = self.trees.onehot(df, number_array(self.columns)).alias("0")
        return df.select(*r.ids(df), onehot, *[col(c) for c in kept], *r.labels(df))


def number_array(cols: list[str]) -> Column:
    return F.array(*[col(c).cast("double") for c in cols])


def assembled(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error").transform(df)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)


def fix_signs(v: np.ndarray) -> np.ndarray:
    """Make the entry of largest size in each column positive."""
    top = v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]
    return v * np.where(top < 0, -1.0, 1.0)


def top_eigen(a: np.ndarray, k: int) -> np.ndarray:
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    order = np.argsort(values)[::-1][:k]
    return fix_signs(vectors[:, order])


@dataclass
class CentredState:
    """Rows, means and the sums of products of deviations from them. Merging works on differences of
    means, so an offset that all rows share costs no digits, and batches may come in any order."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray

    def merge(self, other: CentredState) -> CentredState:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n)
        return CentredState(n, self.mean + gap * (other.n / n), scatter)

    def projection(self, cols: list[str], k: int, roles: Roles = ROLES) -> FeatureMap:
        out = FeatureMap("IncrementalPCA", cols, roles, centre=self.mean)
        out.weights = top_eigen(self.scatter / max(self.n - 1.0, 1.0), min(k, len(cols)))
        return out


def centred_state(df: DataFrame, cols: list[str]) -> CentredState:
    """The state of one batch: two aggregates with map-side partials, d * d numbers to the driver."""
    n, mean, cov = M.centred_gram(df, cols)
    return CentredState(n, mean, cov * max(n - 1.0, 1.0))


def moment_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, n, si, sj, sij): additive over batches, so a later batch is a groupBy-sum."""
    n, s, g = M.gram(df, cols)
    rows = [
        (cols[i], cols[j], int(n), float(s[i]), float(s[j]), float(g[i, j]))
        for i in range(len(cols))
        for j in range(i, len(cols))
    ]
    return df.sparkSession.createDataFrame(rows, "a string, b string, n long, sa double, sb double, sab double")


def merge_moments(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "sab")])


def pca_from_moments(table: DataFrame, cols: list[str], k: int, roles: Roles = ROLES) -> FeatureMap:
    at = {c: i for i, c in enumerate(cols)}
    s, g, n = np.zeros(len(cols)), np.zeros((len(cols), len(cols))), 0.0
    for r in table.collect():
        i, j = at[r["a"]], at[r["b"]]
        g[i, j] = g[j, i] = r["sab"]
        s[i], s[j], n = r["sa"], r["sb"], float(r["n"])
    out = FeatureMap("IncrementalPCA", cols, roles, centre=s / n)
    out.weights = top_eigen(M.covariance(n, s, g), min(k, len(cols)))
    return out


def class_scatter(df: DataFrame, cols: list[str], roles: Roles = ROLES) -> DataFrame:
    """Per-class count, means and centred cross products, one row per (label, a, b)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(cols)]
    ps = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    aggs += [
        (F.covar_pop(col(cols[i]), col(cols[j])) * F.count(F.lit(1))).alias(f"c{i}_{j}") for i, j in ps
    ]
    wide = df.where(col(roles.label).isNotNull()).groupBy(col(roles.label).alias("label")).agg(*aggs)
    cells = [
        F.struct(
            F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), F.col(f"m{i}").alias("mean_a"),
            F.col(f"m{j}").alias("mean_b"), F.col(f"c{i}_{j}").alias("scatter"),
        )
        for i, j in ps
    ]
    return wide.select("label", "n", F.explode(F.array(*cells)).alias("e")).select("label", "n", "e.*")


def _discriminant(df: DataFrame, cols: list[str], k: int, roles: Roles) -> tuple[np.ndarray, np.ndarray]:
    d, at = len(cols), {c: i for i, c in enumerate(cols)}
    within, means, sizes = np.zeros((d, d)), {}, {}
    for r in class_scatter(df, cols, roles).collect():
        i, j = at[r["a"]], at[r["b"]]
        within[i, j] += r["scatter"]
        within[j, i] = within[i, j]
        m = means.setdefault(r["label"], np.zeros(d))
        m[i], m[j] = r["mean_a"], r["mean_b"]
        sizes[r["label"]] = r["n"]
    n = sum(sizes.values())
    grand = sum(sizes[c] * means[c] for c in sizes) / n
    between = sum(sizes[c] * np.outer(means[c] - grand, means[c] - grand) for c in sizes)
    k = min(k, len(sizes) - 1, d)
    if k < 1:
        raise ValueError("the discriminant projection needs at least two classes")
    values, vectors = np.linalg.eigh(within / max(n - len(sizes), 1))
    keep = values > 1e-10 * max(values.max(), 1e-300)
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    turned = top_eigen(whiten.T @ (between / n) @ whiten, k)
    return grand, fix_signs(whiten @ turned)


def fit_features(
    df: DataFrame, method: str = "pca", n_components: int = 2, roles: Roles = ROLES, seed: int = 0,
    kernel_error: float = landmarks.ERROR, kernel_features: int = landmarks.LIMIT,
) -> FeatureMap:
    """The kernel projection uses landmark rows, as many as leave out at most ``kernel_error`` of
    k(x, x) on average, ``kernel_features`` at most; ``land.error`` is the part measured."""
    method = ALIASES.get(method, method)
    cols = roles.numeric(df)
    if not cols:
        raise ValueError("no numeric columns to transform")
    if method not in METHODS:
        raise ValueError(f"unknown feature transform: {method}")
    d = len(cols)
    out = FeatureMap(method, cols, roles)
    if method in ("pca", "IncrementalPCA"):
        _, mean, cov = M.centred_gram(df, cols)
        out.centre, out.weights = mean, top_eigen(cov, min(n_components, d))
    elif method == "TruncatedSVD":
        _, _, g = M.gram(df, cols)
        out.centre, out.weights = np.zeros(d), top_eigen(g, min(n_components, d))
    elif method == "kernelPCA":
        _kernel_projection(df, out, n_components, kernel_error, kernel_features, seed)
    elif method == "lda":
        out.centre, out.weights = _discriminant(df, cols, n_components, roles)
    elif method in ("polynomial", "InteractionFeatures"):
        start = 0 if method == "polynomial" else 1
        out.terms = [(c,) for c in cols]
        out.terms += [(cols[i], cols[j]) for i in range(d) for j in range(i + start, d)]
    else:
        _fit_trees(df, out, seed)
    return out


def _kernel_projection(df: DataFrame, out: FeatureMap, k: int, error: float, size: int, seed: int) -> None:
    """Principal directions of the centred landmark features: those of the centred kernel matrix
    restricted to the landmarks' span."""
    rows = df.select(number_array(out.columns).alias("_x"), F.lit(0).alias("_y")).persist()
    try:
        out.land = landmarks.choose(rows, "_x", 1.0 / len(out.columns), error, size, seed)
        blocks = linear.pack(rows, "_x", "_y")
        m = linear.second_moments(blocks, len(out.columns), out.land.basis)
    finally:
        rows.unpersist()
    n, s = m[-1, -1], m[-1, :-1]
    out.centre = s / n
    out.weights = top_eigen(M.covariance(n, s, m[:-1, :-1]), min(k, out.land.size))


def in_parts(data: DataFrame, rows: int) -> DataFrame:
    """A table of more than ``rows`` rows dealt over tasks that get about so many each at most."""
    n = data.count()
    if n <= rows:
        return data
    return data.repartition(max(math.ceil(n / rows), data.sparkSession.sparkContext.defaultParallelism))


def _fit_trees(df: DataFrame, out: FeatureMap, seed: int) -> None:
    """Totally random trees; each row becomes the sparse one-hot vector of the leaves it falls in."""
    rows = in_parts(df.select(number_array(out.columns).alias("_x")), FOREST_ROWS)
    out.trees = forest.fit_forest(rows, F.col("_x"), len(out.columns), TREES, TREE_DEPTH, seed)
