"""Radial kernel features from landmark rows, as many as a stated error needs."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.operators.linear import Basis, arrays_of

log = logging.getLogger(__name__)

FIRST = 64
ERROR = 0.001
LIMIT = 1024
ROWS = 512


@dataclass
class Landmarks:
    """``points`` (m x d) and ``root`` (m x r) with features k(x, points) @ root, whose inner products
    are the kernel restricted to the span of the landmarks. ``error`` is the mean of k(x, x) minus
    that restriction's k(x, x) over all rows, measured and not estimated."""

    points: np.ndarray
    root: np.ndarray
    gamma: float
    error: float = 1.0

    @property
    def size(self) -> int:
        return self.root.shape[1]

    def kernel(self, x: np.ndarray) -> np.ndarray:
        mid = self.points.mean(axis=0)  # an offset that all rows share would cost digits
        x, p = x - mid, self.points - mid
        # -gamma times the squared distance as one product of matrices
        left = np.hstack([x, (x * x).sum(axis=1)[:, None], np.ones((len(x), 1))])
        right = -self.gamma * np.vstack([-2.0 * p.T, np.ones((1, len(p))), (p * p).sum(axis=1)])
        out = np.empty((len(x), len(p)))
        for lo in range(0, len(x), ROWS):  # a part at a time stays in the processor's cache
            far = left[lo : lo + ROWS] @ right
            np.minimum(far, 0.0, out=far)
            np.exp(far, out=out[lo : lo + ROWS])
        return out

    def features(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.root

    @property
    def basis(self) -> Basis:
        return Basis(self.kernel, self.root)

    def linear(self, x: Column, weights: np.ndarray, offsets: np.ndarray, after: Callable | None = None) -> Column:
        """features(x) @ weights + offsets as an array, then ``after`` on the matrix of a batch; lazy
        and row-wise, so it runs on a stream."""
        fixed = Landmarks(self.points, self.root @ weights, self.gamma)

        @F.pandas_udf("array<double>")
        def mapped(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            got = fixed.features(np.vstack(rows.to_numpy())) + offsets
            return pd.Series(list(after(got) if after else got))

        return mapped(x)


def _spanned(points: np.ndarray, gamma: float) -> Landmarks:
    """Directions whose share of the landmarks' kernel is below rounding are left out."""
    out = Landmarks(points, np.eye(len(points)), gamma)
    values, vectors = np.linalg.eigh(out.kernel(points))
    keep = values > 1e-10 * values.max()
    out.root = vectors[:, keep] / np.sqrt(values[keep])
    return out


def choose(df: DataFrame, x: str, gamma: float, error: float = ERROR, limit: int = LIMIT, seed: int = 0) -> Landmarks:
    """Landmarks drawn from the rows of the array column ``x`` until the mean part of k(x, x) that they
    miss is at most ``error``, or ``limit`` of them are drawn (then a warning tells the error left).

    Draws are without replacement with chances in proportion to the missed part of each row, which
    is its leverage given the landmarks so far: rows already spanned are never drawn. A round doubles
    the landmarks and is one pass over all rows. A task sends its first rows of the draw, at most
    as many as the round adds. The draw hangs on the row's values and the seed, not on its place.
    Equal rows are one candidate in the end, so a table of few distinct rows is spanned exactly.
    """
    named = df.select(F.col(x).alias("x"), F.xxhash64(F.lit(seed), F.col(x)).alias("h"))
    now, take = None, min(FIRST, limit)
    while True:
        total, missed, drawn = _pass(named, now, take, gamma)
        if not total:
            raise ValueError("no rows to draw landmarks from")
        if now is not None:
            now.error = missed / total
            full = len(now.points) >= limit
            if now.error <= error or full or not len(drawn):
                if now.error > error:
                    log.warning("%d landmarks leave a kernel error of %g", len(now.points), now.error)
                return now
        points = np.unique(drawn if now is None else np.vstack([now.points, drawn]), axis=0)
        if now is not None and len(points) == len(now.points):
            return now
        now = _spanned(points, gamma)
        take = max(1, min(len(now.points), limit - len(now.points)))


def _pass(named: DataFrame, now: Landmarks | None, take: int, gamma: float) -> tuple[int, float, np.ndarray]:
    """(rows, missed part of the kernel's diagonal, the ``take`` rows drawn first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, missed, keys, kept = 0, 0.0, np.zeros(0), None
        for batch in batches:
            step = max(1, (1 << 20) // max(1, 0 if now is None else len(now.points)))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                m = arrays_of(part.column(0))
                h = part.column(1).to_numpy(zero_copy_only=False)
                lost = np.ones(len(m))
                if now is not None:
                    lost = np.maximum(1.0 - (now.features(m) ** 2).sum(axis=1), 0.0)
                n, missed = n + len(m), missed + float(lost.sum())
                even = ((h.astype(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
                open_ = lost > 1e-9
                race = -np.log(even[open_]) / lost[open_]
                rows = m[open_] if kept is None else np.vstack([kept, m[open_]])
                keys, first = np.unique(np.concatenate([keys, race]), return_index=True)
                keys, kept = keys[:take], rows[first[:take]]
        if n:
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([n], pa.int64()), "missed": pa.array([missed]), "key": pa.array([None], pa.float64()),
                "x": pa.array([None], pa.list_(pa.float64())),
            })
            if len(keys):
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([0] * len(keys), pa.int64()), "missed": pa.array([0.0] * len(keys)),
                    "key": pa.array(keys), "x": pa.array(list(kept), pa.list_(pa.float64())),
                })

    out = named.mapInArrow(run, "n long, missed double, key double, x array<double>").persist()
    try:
        s = out.agg(F.sum("n").alias("n"), F.sum("missed").alias("missed")).first()
        drawn = out.where("key IS NOT NULL").groupBy("key").agg(F.first("x").alias("x")).orderBy("key").limit(take).collect()
    finally:
        out.unpersist()
    return int(s["n"] or 0), float(s["missed"] or 0.0), np.array([r["x"] for r in drawn])
