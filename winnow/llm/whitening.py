"""Whitening of embeddings by shifted CholeskyQR.

The centred rows A (n x d, never gathered) are made orthogonal by passes over the table: a pass
sums the Gram matrix of Q = A / R, R being the product of the factors so far (a triangular solve
per batch of rows); its Cholesky factor is the next factor. The first Gram matrix is shifted, so
the factor exists however ill-conditioned A is; every pass then brings Q closer to
orthogonal, and passes repeat until it is so to rounding. R is d x d and small: its
singular values and right vectors are those of A, so the components have the accuracy of an SVD
of A itself, not of its covariance.

Centring is exact: with n and the integer sums S, n x - S is an integer, and (n x - S) / n the
only rounding. Every sum of a pass is one d x d matrix per task, added up by rows on the
executors; d rows reach the driver.

Defined cases: a vector that is null or holds a null or non-finite entry takes no part; missing
entries of a shorter (or empty) vector count as 0; every other row is kept, with null and
repeated ids; constant or dependent dimensions give no component, so fewer than ``k`` may come
back (none if all rows are equal); the sign of a component makes its largest entry positive; a
deviation beyond 63 bits or an entry beyond 2^42 raises. Other columns are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 8
SCALE, OFFSET = 1024, 100_000
#: Passes end once Q'Q is this close to a projection; more than PASSES of them raise.
ORTHOGONAL, PASSES = 1e-12, 8
#: Singular values below this share of the largest are those of dependent dimensions.
DEPENDENT = 1e-12
#: Rows whose dense form is held at once; merging tasks of the matrices.
ROWS, MERGE = 4096, 16
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part; v may hold any number of finite entries."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(v.isNotNull() & ~bad).select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * c) + OFFSET of a list column, missing entries as c = 0."""
    out = np.zeros((len(column), dim))
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dim).all():
        out = flat.reshape(len(lengths), dim)
    elif len(flat):
        row = np.repeat(np.arange(len(lengths)), lengths)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    out = np.floor(out * SCALE)
    if len(out) and out.size and np.abs(out).max() >= 1 << 52:
        raise OverflowError("an entry is too large for exact integers")
    return out.astype(np.int64) + OFFSET


@dataclass(frozen=True)
class Centre:
    """Number of rows and sums by dimension, exact; ``reach`` bounds |n x - S| over all rows."""

    n: int
    sums: tuple[int, ...]
    reach: int

    @property
    def dim(self) -> int:
        return len(self.sums)

    def moved(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact; Python integers where 64 bits are too few."""
        kind = np.int64 if self.reach < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.moved(x).astype(float) / self.n

    def deviation(self, x: np.ndarray) -> np.ndarray:
        moved = self.moved(x)
        if self.reach**2 * self.dim >= 1 << 63:
            moved = moved.astype(object)
        total = (moved * moved).sum(axis=1)
        if total.dtype == object and len(total) and max(total) >= 1 << 63:
            raise OverflowError("a deviation does not fit a long")
        return total.astype(np.int64)


def batches_of(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def centre(vectors: DataFrame) -> Centre | None:
    """Counts, sums and ranges of all dimensions in one pass; None without rows."""
    width = vectors.agg(F.max(F.size("v")).alias("d")).first()["d"]
    if width is None:
        return None

    def run(batches):
        n, sums, low, high = 0, np.zeros(width, np.int64), np.full(width, 1 << 62), np.full(width, -(1 << 62))
        for batch in batches_of(batches):
            x = integers(batch.column(1), width)
            n += len(x)
            sums += x.sum(axis=0)
            low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if n:
            columns = [np.arange(width, dtype=np.int32), np.full(width, n), sums, low, high]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "n", "s", "low", "high"])

    parts = vectors.mapInArrow(run, "i int, n long, s long, low long, high long")
    sums = F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), sums, F.min("low").alias("low"), F.max("high").alias("high"))
    rows = sorted(rows.collect(), key=lambda r: r["i"])  # one row per dimension
    if not rows:
        return Centre(vectors.count(), (), 0)
    n = rows[0]["n"]
    reach = max(max(abs(n * r["low"] - int(r["s"])), abs(n * r["high"] - int(r["s"])), n * max(abs(r["low"]), abs(r["high"]))) for r in rows)
    return Centre(n, tuple(int(r["s"]) for r in rows), reach)


def summed(vectors: DataFrame, size: int, product) -> np.ndarray:
    """The sum over all rows of ``product(x)``, a (size, size) matrix for each batch of integer
    rows: one matrix per task, added up by matrix row on at most ``MERGE`` tasks."""

    def part(batches):
        total = None
        for batch in batches_of(batches):
            one = product(batch.column(1))
            total = one if total is None else total + one
        if total is not None:
            rows = pa.array([r.tobytes() for r in total], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), rows], names=["i", "row"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[i] = held[i] + np.frombuffer(row) if i in held else np.frombuffer(row)
        rows = pa.array([r.tobytes() for r in held.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), rows], names=["i", "row"])

    schema = "i int, row binary"
    whole = vectors.mapInArrow(part, schema).repartition(MERGE, "i").mapInArrow(merge, schema)
    out = np.zeros((size, size))
    for r in whole.collect():
        out[r["i"]] = np.frombuffer(r["row"])
    return out


def solve_right(a: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """a / (R_k ... R_1) by one triangular solve for each factor."""
    for r in factors:
        a = np.linalg.solve(r.T, a.T).T
    return a


def orthogonal_factor(vectors: DataFrame, mid: Centre) -> np.ndarray:
    """B (d x d) with B'B = A'A to rounding relative to each singular value: the product of the
    factors of all passes."""
    d, factors, last = mid.dim, [], None
    for number in range(PASSES):
        done = list(factors)

        def product(column, done=done):
            q = solve_right(mid.rows(integers(column, d)), done)
            return q.T @ q

        gram = summed(vectors, d, product)
        gram = (gram + gram.T) / 2
        if number and np.abs(gram @ gram - gram).max() < ORTHOGONAL * d:
            last = gram
            break
        if not np.abs(gram).max():
            return np.zeros((d, d))
        # the shift keeps the factor real where rounding makes the smallest eigenvalue negative
        shift = 11 * (mid.n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(gram, 2)
        try:
            if not number:
                raise np.linalg.LinAlgError
            factor = np.linalg.cholesky(gram)
        except np.linalg.LinAlgError:
            factor = np.linalg.cholesky(gram + max(shift, np.finfo(float).tiny) * np.eye(d))
        factors.append(factor.T)
    if last is None:
        raise ArithmeticError(f"not orthogonal after {PASSES} passes")
    # the last Gram matrix is the identity, or a projection where dimensions depend on each other
    values, axes = np.linalg.eigh(last)
    out = np.sqrt(np.maximum(values, 0.0))[:, None] * axes.T
    for factor in reversed(factors):
        out = out @ factor
    return out


@dataclass(frozen=True)
class Whitening:
    """``axes`` (components, d) are unit eigenvectors of the covariance, ``values`` its eigenvalues."""

    centre: Centre
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.rows(x) @ (self.axes / np.sqrt(self.values)[:, None]).T


def fit(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K) -> Whitening | None:
    vectors = usable(df, key, vector)
    mid = centre(vectors)
    if mid is None:
        return None
    if not mid.dim:
        return Whitening(mid, np.zeros((0, 0)), np.zeros(0), 0.0)
    _, sigma, axes = np.linalg.svd(orthogonal_factor(vectors, mid))
    keep = min(k, int((sigma > DEPENDENT * sigma[0]).sum()) if sigma[0] > 0 else 0)
    axes = axes[:keep]
    signs = np.sign(axes[np.arange(keep), np.abs(axes).argmax(axis=1)]) if keep else np.ones(0)
    return Whitening(mid, axes * signs[:, None], sigma[:keep] ** 2 / mid.n, float((sigma**2).sum() / mid.n))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of (covariance of the whitened rows - identity), measured on the table."""
    k, d, n = len(model.values), model.centre.dim, model.centre.n
    if not k:
        return 0.0

    def product(column):
        # a column of ones beside them, so that the means come out of the same pass
        w = model.apply(integers(column, d))
        w = np.hstack([w, np.ones((len(w), 1))])
        return w.T @ w

    gram = summed(vectors, k + 1, product)
    means = gram[:k, k] / n
    return float(np.abs(gram[:k, :k] / n - np.outer(means, means) - np.eye(k)).max())


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each
    vector and component: x = floor(1024 c) + 100000, whitened against all vectors of ``df``."""
    spark = df.sparkSession
    model = fit(df, key, vector, k)
    if model is None or not len(model.values):
        return spark.createDataFrame([], OUT)
    vectors = usable(df, key, vector)
    error = identity_error(vectors, model)
    n, d, parts = model.centre.n, model.centre.dim, len(model.values)
    share = model.values / model.trace

    def run(batches):
        for batch in batches_of(batches):
            x = integers(batch.column(1), d)
            rows = np.repeat(np.arange(len(x)), parts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, parts + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), n)), pa.array(model.centre.deviation(x)[rows]), pa.array(model.apply(x).reshape(-1)),
                    pa.array(np.tile(share, len(x))), pa.array(np.full(len(rows), error)),
                ],
                names=[f.split()[0] for f in OUT.split(", ")],
            )

    return vectors.mapInArrow(run, OUT)
