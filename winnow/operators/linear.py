"""Many two-class linear problems over one set of rows, fitted together.

Rows are packed once into matrix blocks. Every round is one pass in which each task adds up the
loss and the gradient of all problems at once, and the tasks' vectors, dealt out by problem, are
added up as bytes, so the number of passes does not grow with the number of classes. What reaches the driver is one
vector per problem; rows never do.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.session import shuffle_width

log = logging.getLogger(__name__)

CELLS = 1 << 18  # numbers in a block: 2 MB
TASK_CELLS = 1 << 20  # numbers from which a task is cut in two
DENSE_LIMIT = 1024  # inputs up to which the curvature of all of them is used together
CURVED = 1 << 22  # second derivatives that a task may hold: 32 MB
MEMORY = 12  # steps remembered by a problem
LENGTHS = tuple(2.0**-i for i in range(-3, 13))  # parts of a step that a pass tries at once
WINDOW = 2.0  # margins around the corner that bend at first: all of them
NARROWER = 0.6
BLOCK = "n long, sparse boolean, at binary, x binary, y binary"


# ---------------------------------------------------------------- rows as matrix blocks


def arrays_of(column: pa.Array) -> np.ndarray:
    """A batch of equally long lists as a matrix. A missing list or entry is an error."""
    if column.null_count or column.flatten().null_count:
        raise ValueError("a model input is missing; impute before fitting")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not np.isfinite(flat).all():
        raise ValueError("a model input is not a finite number")
    return flat.reshape(len(column), -1)


def dealt(df: DataFrame, x: str) -> DataFrame:
    """The rows of a cached table in one task per core, or more where a task would get more than
    ``TASK_CELLS`` numbers of the array column ``x``. A fit makes many passes, and in each every task
    costs its start, however few rows it has."""
    cells = df.select(F.sum(F.size(x).cast("long")).alias("n")).first()["n"] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks, have = max(cores, math.ceil(cells / TASK_CELLS)), df.rdd.getNumPartitions()
    if have > tasks:
        return df.coalesce(tasks)
    return df.repartition(tasks) if have < cores else df


def pack(df: DataFrame, x: str, y: str) -> DataFrame:
    """Blocks of at most ``CELLS`` numbers (one row at least) of the array column ``x`` and the class
    number ``y``. A block that is mostly zeros keeps its other entries only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            step = max(1, CELLS // max(len(batch.column(0)[0].as_py()), 1))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                m = arrays_of(part.column(0))
                codes = part.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
                at = np.flatnonzero(m)
                sparse = at.size * 2 < m.size
                if sparse:
                    cells, places = m.ravel()[at].tobytes(), at.tobytes()
                else:
                    cells, places = m.tobytes(), b""
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([len(m)], pa.int64()), "sparse": pa.array([sparse], pa.bool_()),
                    "at": pa.array([places], pa.binary()), "x": pa.array([cells], pa.binary()),
                    "y": pa.array([codes.tobytes()], pa.binary()),
                })

    return df.select(F.col(x), F.col(y).cast("int")).mapInArrow(run, BLOCK)


def unpack(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows x inputs, class numbers) of each block, one block in memory at a time."""
    for i in range(batch.num_rows):
        n, sparse, at, x, y = (batch.column(k)[i].as_py() for k in range(5))
        if sparse:
            m = np.zeros(n * width)
            m[np.frombuffer(at, np.int64)] = np.frombuffer(x)
        else:
            m = np.frombuffer(x)
        yield m.reshape(n, width), np.frombuffer(y, np.int32)


def summed(blocks: DataFrame, width: int, part: Callable, keys: int) -> dict[int, np.ndarray]:
    """``part(rows, codes)`` gives a (keys x any) matrix for a block; its sum over all blocks.

    A task sends one row per key, its numbers as bytes; they are dealt out by key and added up there
    one at a time. As lists each number would be an object in the JVM and again on the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for m, codes in unpack(batch, width):
                got = part(m, codes)
                total = got if total is None else total + got
        if total is not None:
            for k in range(keys):
                yield _sent(k, total[k])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                k, v = batch.column(0)[i].as_py(), np.frombuffer(batch.column(1)[i].as_buffer())
                if k in totals:
                    totals[k] += v
                else:
                    totals[k] = v.copy()
        for k, v in totals.items():
            yield _sent(k, v)

    parts = blocks.mapInArrow(run, "k int, v binary")
    rows = parts.repartition(min(keys, shuffle_width(blocks.sparkSession)), "k").mapInArrow(add, "k int, v binary").collect()
    return {r["k"]: np.frombuffer(r["v"]) for r in rows}


def _sent(k: int, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "k": pa.array([k], pa.int32()), "v": pa.array([np.ascontiguousarray(v, dtype=np.float64).tobytes()], pa.binary()),
    })


@dataclass
class Basis:
    """Inputs made of a block's rows on the fly: ``turn(rows) @ root``. Tasks only ever hold
    ``turn(rows)``; ``root`` is applied to the few vectors that the driver has."""

    turn: Callable
    root: np.ndarray

    @property
    def lift(self) -> np.ndarray:
        r, c = self.root.shape
        return np.block([[self.root, np.zeros((r, 1))], [np.zeros((1, c)), np.ones((1, 1))]])


def second_moments(blocks: DataFrame, width: int, basis: Basis | None = None) -> np.ndarray:
    """Sum of the outer products of (inputs, 1), one row of it per key."""
    turn = basis.turn if basis else None
    size = (len(basis.root) if basis else width) + 1

    def part(m, _):
        m = turn(m) if turn else m
        a = np.hstack([m, np.ones((len(m), 1))])
        return a.T @ a

    got = summed(blocks, width, part, size)
    if not got:
        raise ValueError("no rows to learn from")
    out = np.array([got[i] for i in range(size)])
    return basis.lift.T @ out @ basis.lift if basis else out


# ---------------------------------------------------------------- losses on the margin


def logistic_loss(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.exp(-np.abs(m))
    return np.log1p(e) + np.maximum(-m, 0.0), -np.where(m > 0, e, 1.0) / (1.0 + e)


def hinge_loss(width: float) -> Callable:
    """The hinge with its corner rounded over ``width``; never more than width / 2 below it. Its second
    derivative is that of a corner rounded over ``window`` (one for each column), where that is wider."""

    def loss(m: np.ndarray, window: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gap = np.clip(1.0 - m, 0.0, None)
        inside, window = np.minimum(gap, width), np.maximum(window, width)
        bend = np.where(window > width, 2 * np.abs(1.0 - width / 2 - m) <= window, (gap > 0) & (gap <= width))
        return inside * inside / (2 * width) + (gap - inside), -inside / width, bend / window

    return loss


# ---------------------------------------------------------------- one problem's steps


class Search:
    """Limited-memory quasi-Newton steps of one problem. ``point`` is where the next pass evaluates;
    ``tell`` takes loss and gradient there, and either moves on or shortens the step."""

    def __init__(self, start: np.ndarray, ridge: np.ndarray, scale: Callable, tol: float):
        self.ridge, self.scale, self.tol = ridge, scale, tol
        self.point, self.done = start.copy(), False
        self.at = self.value = self.slope = self.step = None
        self.length, self.pairs = 1.0, []

    def tell(self, loss: float, grad: np.ndarray) -> None:
        value = loss + 0.5 * float(self.ridge @ (self.point * self.point))
        slope = grad + self.ridge * self.point
        if self.at is not None:
            drop = self.length * float(self.slope @ self.step)
            if value > self.value + 1e-4 * drop + 1e-13 * abs(self.value):
                bend = 2.0 * (value - self.value - drop)
                self.length *= float(np.clip(-drop / bend, 0.1, 0.5))
                if self.length < 1e-10:
                    self.point, self.done = self.at, True
                else:
                    self.point = self.at + self.length * self.step
                return
            s, g = self.point - self.at, slope - self.slope
            if s @ g > 1e-14 * (s @ s):
                self.pairs = [*self.pairs[-(MEMORY - 1):], (s, g)]
        first = self.at is None
        self.at, self.value, self.slope = self.point, value, slope
        if first:
            self.size = max(float(np.linalg.norm(slope)), 1e-12)
        if np.linalg.norm(slope) <= self.tol * self.size:
            self.done = True
            return
        self.step, self.length = -self._turned(slope), 1.0
        self.point = self.at + self.step

    def _turned(self, g: np.ndarray) -> np.ndarray:
        q, kept = g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        r = self.scale(q)
        if self.pairs:
            s, y = self.pairs[-1]
            r *= (s @ y) / (y @ self.scale(y))
        for (s, y), a in zip(self.pairs, reversed(kept)):
            r += s * (a - (y @ r) / (s @ y))
        return r


class Newton:
    """Newton's steps of one problem, from zero. Second derivatives come from a wide ``window`` around
    the corner at first, which narrows with each step: a step changes many margins by more than the
    corner's width, and what bends at its start tells little of what it meets. A step that does not
    lower the objective, and the first, whose size is unknown, get a pass that gives the losses at
    ``LENGTHS`` of it (``line``); the best of them is taken."""

    def __init__(self, inputs: int, ridge: np.ndarray, tol: float):
        self.ridge, self.tol, self.window = ridge, tol, WINDOW
        self.point, self.step, self.at, self.done, self.line = np.zeros(inputs), None, None, False, False
        self.sure = self.tiny = False

    def tell(self, loss: float, grad: np.ndarray, scale: Callable) -> None:
        """Loss and gradient at ``point``, and the inverse of the curvature there."""
        value = loss + 0.5 * float(self.ridge @ (self.point * self.point))
        if self.at is not None and not self.sure:
            drop = float(self.slope @ self.step)
            if value > self.value + 1e-4 * drop + 1e-13 * abs(self.value):
                self.line = True
                return
        first = self.at is None
        self.at, self.value, self.slope = self.point, value, grad + self.ridge * self.point
        if first:
            self.size = max(float(np.linalg.norm(self.slope)), 1e-12)
        if np.linalg.norm(self.slope) <= self.tol * self.size:
            self.done = True
            return
        self.step, self.window = -scale(self.slope), self.window * NARROWER
        self.point, self.line, self.sure, self.tiny = self.at + self.step, first, False, False

    def tell_line(self, losses: np.ndarray) -> None:
        """The losses at ``LENGTHS`` of the step."""
        values = [v + 0.5 * float(self.ridge @ (p * p)) for v, p in zip(losses, (self.at + t * self.step for t in LENGTHS))]
        best = int(np.argmin(values))
        if values[best] < self.value:
            self.point, self.line, self.sure = self.at + LENGTHS[best] * self.step, False, True
        elif self.tiny:
            self.point, self.done = self.at, True
        else:
            self.step, self.tiny = self.step * LENGTHS[-1], True


@dataclass
class Solved:
    weights: np.ndarray  # problems x inputs
    offsets: np.ndarray
    rounds: int
    converged: bool


def solve(
    blocks: DataFrame, width: int, signs: np.ndarray, loss: Callable, curvature: float, cost: float = 1.0,
    offset_ridge: float = 1.0, basis: Basis | None = None, moments: np.ndarray | None = None,
    tol: float = 1e-7, max_rounds: int = 200,
) -> Solved:
    """Minimise 0.5 |w|^2 + 0.5 offset_ridge b^2 + cost * sum loss(sign * (w.x + b)) for every problem.

    ``signs`` (classes x problems) holds 1, -1 or 0, where 0 leaves a class out of a problem. ``loss``
    gives value and slope at the margins, and may give the second derivative too (for a window, see
    ``Newton``), whose bound is ``curvature``. With second derivatives as many problems share a pass as
    fit ``CURVED`` numbers. A problem ends when its gradient has fallen to ``tol`` times its first; those
    left after ``max_rounds`` passes are told of by ``converged`` and a warning.
    """
    problems = signs.shape[1]
    moments = second_moments(blocks, width, basis) if moments is None else moments
    inputs, turn = len(moments) - 1, basis.turn if basis else None
    ridge = np.append(np.ones(inputs), offset_ridge)
    bound = moments * (cost * curvature)
    curved = len(loss(np.zeros(1))) == 3
    if curved:
        searches = [Newton(inputs + 1, ridge, tol) for _ in range(problems)]
    else:
        scale = _scaling(bound, ridge)
        searches = [Search(np.zeros(inputs + 1), ridge, scale, tol) for _ in range(problems)]
    size = (len(basis.root) if basis else width) + 1
    share = max(1, CURVED // (size * size)) if curved else problems
    rounds = 0
    while rounds < max_rounds and not all(s.done for s in searches):
        open_ = [k for k in range(problems) if not searches[k].done][:share]
        lines = [k for k in open_ if curved and searches[k].line]
        full = [k for k in open_ if k not in lines]
        w, side = _lifted([searches[k].point for k in full], basis), signs[:, full].astype(np.float64)
        a, b = (_lifted([v(searches[k]) for k in lines], basis) for v in (lambda s: s.at, lambda s: s.step))
        along = signs[:, lines].astype(np.float64)
        window = (np.array([searches[k].window for k in full]),) if curved else ()
        asked = signs[:, open_].any(axis=1)

        def part(m, codes, w=w, side=side, window=window, a=a, b=b, along=along, asked=asked):
            if not asked.all():  # rows of classes that no open problem has
                m, codes = m[asked[codes]], codes[asked[codes]]
            m = turn(m) if turn else m
            out = []
            if len(w):
                t = side[codes]
                value, slope, *bend = loss(t * (m @ w[:, :-1].T + w[:, -1]), *window)
                value, slope = value * (t != 0), slope * t
                out = [slope.T @ m, slope.sum(axis=0)[:, None], value.sum(axis=0)[:, None]]
                if bend:
                    out.append(np.array([_curved(m, (bend[0] * (t != 0))[:, k]) for k in range(len(w))]))
                out = [np.hstack(out) * cost]
            if len(a):
                out.append(_along(m, along[codes], a, b, loss) * cost)
            wide = max(p.shape[1] for p in out)
            return np.vstack([np.pad(p, ((0, 0), (0, wide - p.shape[1]))) for p in out])

        got = summed(blocks, width, part, len(open_))
        for i, k in enumerate(full):
            grad, value = got[i][:size], got[i][size]
            grad = basis.lift.T @ grad if basis else grad
            if not curved:
                searches[k].tell(value, grad)
                continue
            h = np.zeros((size, size))
            h[np.triu_indices(size)] = got[i][size + 1 : size + 1 + size * (size + 1) // 2]
            h = np.triu(h, 1) + h.T
            h = basis.lift.T @ h @ basis.lift if basis else h
            if not h[-1, -1]:  # where no row bends, the offset has no curvature of its own
                h[-1, -1] = 1e-4 * bound[-1, -1]
            searches[k].tell(value, grad, _scaling(h, ridge, dense=True))
        for i, k in enumerate(lines, len(full)):
            searches[k].tell_line(got[i][: len(LENGTHS)])
        rounds += 1
    ok = all(s.done for s in searches)
    if not ok:
        log.warning("%d of %d problems had not converged after %d passes", sum(not s.done for s in searches), problems, rounds)
    best = np.array([s.point if s.at is None else s.at for s in searches])
    return Solved(best[:, :-1], best[:, -1], rounds, ok)


def _lifted(vectors: list[np.ndarray], basis: Basis | None) -> np.ndarray:
    """Weights as the tasks use them, a row for each vector."""
    w = np.array(vectors)
    return w @ basis.lift.T if basis and len(w) else w


def _along(m: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray, loss: Callable) -> np.ndarray:
    """Each problem's loss at ``LENGTHS`` of the step ``b`` from ``a``; problems x lengths."""
    out = np.zeros((len(a), len(LENGTHS)))
    for k in range(len(a)):
        rows = np.flatnonzero(t[:, k])
        start, step = (t[rows, k] * (m[rows] @ v[k, :-1] + v[k, -1]) for v in (a, b))
        out[k] = [loss(start + length * step)[0].sum() for length in LENGTHS]
    return out


def _curved(m: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """Second derivatives of one problem, from the rows that have any; the upper triangle, by rows."""
    at = np.flatnonzero(bend)
    a = np.hstack([m[at], np.ones((len(at), 1))]) * np.sqrt(bend[at])[:, None]
    return (a.T @ a)[np.triu_indices(a.shape[1])]


def _scaling(bound: np.ndarray, ridge: np.ndarray, dense: bool = False) -> Callable:
    """Inverse of a curvature of the objective; beyond ``DENSE_LIMIT`` inputs of its diagonal only
    unless ``dense``. It changes the number of passes, not the solution."""
    if len(ridge) - 1 > DENSE_LIMIT and not dense:
        d = np.diag(bound) + ridge + 1e-12
        return lambda v: v / d
    h = bound + np.diag(ridge)
    h[np.diag_indices_from(h)] += 1e-10 * max(np.trace(h) / len(h), 1e-300)
    inverse = np.linalg.inv(h)
    return lambda v: inverse @ v


def one_against_rest(classes: int) -> np.ndarray:
    """Signs of one problem per class; with two classes one problem, for the second class."""
    signs = 2 * np.eye(classes, dtype=np.int8) - 1
    return signs[:, 1:] if classes == 2 else signs


def one_against_one(classes: int) -> np.ndarray:
    """Signs of one problem per pair of classes (i < j), positive for i."""
    out = [[(k == i) - (k == j) for k in range(classes)] for i in range(classes) for j in range(i + 1, classes)]
    return np.array(out, dtype=np.int8).T
