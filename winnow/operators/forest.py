"""Totally random trees over all rows, and the leaves that rows fall in.

A node takes one input at random among those that vary in it and a threshold at random between the
smallest and the largest value there, until ``depth`` levels are reached or all its rows are equal.
The random target of the usual description decides nothing but the end at equal targets, which has
no chance as long as rows differ, so none is drawn. All that growing asks of the rows are extremes
by (node, input): one pass over all rows gives those of every open node of every tree.

Where a row lies in all trees is found at once: each input's value has a row of bit sets, one per
tree, of the leaves that its thresholds leave open; the sets of all inputs have one leaf in common.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.operators.linear import CELLS
from winnow.session import shuffle_width

DEPTH_LIMIT = 5  # a set of leaves has 32 bits
ASKED = 16  # inputs that a pass tries for a node
STRIDE = 128  # rows whose sets are joined before any is looked at
BLOCK = "n long, x binary"


@dataclass
class Forest:
    """By input that has thresholds: these in order, and the leaves open to each interval between them
    (intervals x trees). ``starts`` is the number of the first leaf of each tree, and of all leaves."""

    cuts: dict[int, np.ndarray]
    open_: dict[int, np.ndarray]
    starts: np.ndarray

    @property
    def trees(self) -> int:
        return len(self.starts) - 1

    def masks(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree as a set of one; ``x`` is inputs x rows."""
        out = None
        for c, cuts in self.cuts.items():
            got = self.open_[c].take(np.searchsorted(cuts, x[c], side="left"), axis=0)
            out = got if out is None else np.bitwise_and(out, got, out=out)
        return np.ones((x.shape[1], self.trees), dtype=np.uint32) if out is None else out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The number of the leaf of every row in every tree, counted over all trees."""
        # the exponent of a power of two
        bits = (self.masks(x).astype(np.float32).view(np.int32) >> 23) - 127
        return bits + self.starts[:-1].astype(np.int32)

    def onehot(self, df: DataFrame, x: Column) -> Column:
        """The sparse vector of the leaves of each row of ``df``; ``x`` is its array of inputs."""
        from pyspark.ml.linalg import VectorUDT

        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf(VectorUDT())
        def placed(rows: pa.Array) -> pa.Array:
            forest = shared.value
            n, step = len(rows), max(1, CELLS // forest.trees)
            found = [forest.leaves(inputs(rows.slice(lo, step)).T) for lo in range(0, n, step)]
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * forest.trees)
            flat = np.concatenate([f.ravel() for f in found]) if n else np.zeros(0, np.int32)
            parts = [
                pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, forest.starts[-1], np.int32)),
                pa.ListArray.from_arrays(ends, pa.array(flat)), pa.ListArray.from_arrays(ends, pa.array(np.ones(len(flat)))),
            ]
            return pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])

        return placed(x)


def inputs(column: pa.Array) -> np.ndarray:
    """A batch of equally long lists as a matrix. A missing list or entry is an error."""
    if column.null_count or column.flatten().null_count:
        raise ValueError("a model input is missing; impute before fitting")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if np.isnan(flat).any():
        raise ValueError("a model input is not a number")
    return flat.reshape(len(column), -1)


# ---------------------------------------------------------------- growing


class _Tree:
    """Nodes as lists; those of a split are ``left`` and ``left + 1``. ``path`` numbers a node by its
    place (root 1, below k: 2 k and 2 k + 1), so its draws do not hang on when it is grown."""

    def __init__(self):
        self.feature, self.cut, self.left, self.path = [-1], [0.0], [0], [1]

    def split(self, node: int, feature: int, cut: float) -> list[int]:
        kid = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, kid
        for side in (0, 1):
            for part, new in ((self.feature, -1), (self.cut, 0.0), (self.left, 0), (self.path, 2 * self.path[node] + side)):
                part.append(new)
        return [kid, kid + 1]

    def spans(self) -> tuple[list[int], list[tuple]]:
        """Leaves from left to right, and (feature, cut, first, middle, end) of each split by places among them."""
        leaves, splits = [], []

        def visit(k: int) -> None:
            if self.feature[k] < 0:
                leaves.append(k)
                return
            first = len(leaves)
            visit(self.left[k])
            middle = len(leaves)
            visit(self.left[k] + 1)
            splits.append((self.feature[k], self.cut[k], first, middle, len(leaves)))

        visit(0)
        return leaves, splits


def _forest(trees: list[_Tree]) -> tuple[Forest, list[dict[int, int]]]:
    """What places rows in ``trees`` as they are, and the place of each leaf among its tree's."""
    places, found = [], []
    for t, tree in enumerate(trees):
        leaves, splits = tree.spans()
        places.append({k: i for i, k in enumerate(leaves)})
        found += [(t, *s) for s in splits]
    whole = np.array([(1 << len(p)) - 1 for p in places], dtype=np.uint32)
    cuts = {c: np.unique([s[2] for s in found if s[1] == c]) for c in sorted({s[1] for s in found})}
    open_ = {c: np.tile(whole, (len(v) + 1, 1)) for c, v in cuts.items()}
    for t, c, cut, first, middle, end in found:
        at = int(np.searchsorted(cuts[c], cut)) + 1
        open_[c][:at, t] &= np.uint32(~((1 << end) - (1 << middle)) & 0xFFFFFFFF)
        open_[c][at:, t] &= np.uint32(~((1 << middle) - (1 << first)) & 0xFFFFFFFF)
    return Forest(cuts, open_, np.cumsum([0, *map(len, places)])), places


def grown(ask: Callable, width: int, trees: int, depth: int, seed: int) -> Forest:
    """``ask(forest, asked)`` gives the smallest and largest value by question, where ``asked`` has
    (trees, places of leaves, question numbers) by input; infinity where a node has no rows."""
    if not 0 < depth <= DEPTH_LIMIT:
        raise ValueError(f"trees of 1 to {DEPTH_LIMIT} levels only")
    made = [_Tree() for _ in range(trees)]

    def fresh(t: int, k: int) -> tuple:
        rng = np.random.default_rng([seed, t, made[t].path[k]])
        return t, k, rng.permutation(width), rng.random(), 0

    live = [fresh(t, 0) for t in range(trees)]
    while live:
        forest, places = _forest(made)
        asked: dict[int, list] = {}
        wanted = [(i, j, c) for i, (_, _, order, _, start) in enumerate(live) for j, c in enumerate(order[start : start + ASKED])]
        for q, (i, _, c) in enumerate(wanted):
            asked.setdefault(int(c), []).append((live[i][0], places[live[i][0]][live[i][1]], q))
        lo, hi = ask(forest, {c: tuple(np.array(v).T) for c, v in sorted(asked.items())}, len(wanted))
        chosen: dict[int, tuple] = {}
        for q, (i, _, c) in enumerate(wanted):
            if lo[q] < hi[q]:
                chosen.setdefault(i, (int(c), _between(lo[q], hi[q], live[i][3])))
        if not np.isfinite(lo).any() and not np.isfinite(hi).any() and (lo > hi).all():
            raise ValueError("no rows to learn from")
        onward = []
        for i, (t, k, order, u, start) in enumerate(live):
            if i in chosen:
                kids = made[t].split(k, *chosen[i])
                if made[t].path[kids[0]] < 1 << depth:
                    onward += [fresh(t, kid) for kid in kids]
            elif start + ASKED < width:
                onward.append((t, k, order, u, start + ASKED))
        live = onward
    return _forest(made)[0]


def _between(lo: float, hi: float, u: float) -> float:
    """A threshold that keeps ``lo`` left and ``hi`` right."""
    a, b = np.nan_to_num([lo, hi])
    cut = float(a * (1.0 - u) + b * u)
    return cut if lo <= cut < hi else float(lo)


def extremes(x: np.ndarray, forest: Forest, asked: dict, lo: np.ndarray, hi: np.ndarray) -> None:
    """Move ``lo`` and ``hi`` to the extremes of ``x`` (inputs x rows) by question.

    The rows' sets are put in the order of an input's values and joined over strides of rows; the first
    and the last stride that has a leaf, and there the first and the last row, have the extremes.
    """
    n = x.shape[1]
    if not n:
        return
    masks, strides = forest.masks(x), -(-n // STRIDE)
    for c, (tree, place, question) in asked.items():
        order = np.argsort(x[c])
        v, (columns, at) = x[c][order], np.unique(tree, return_inverse=True)
        sets = np.zeros((strides * STRIDE, len(columns)), dtype=np.uint32)
        sets[:n] = masks.take(order, axis=0) if len(columns) == forest.trees else masks[order[:, None], columns]
        sets = sets.reshape(strides, STRIDE, len(columns))
        bit = np.uint32(1) << place.astype(np.uint32)
        has = (np.bitwise_or.reduce(sets, axis=1)[:, at] & bit) > 0
        first, last = has.argmax(axis=0), strides - 1 - has[::-1].argmax(axis=0)
        some = has.any(axis=0)
        low = np.flatnonzero(some & (v[first * STRIDE] < lo[question]))
        high = np.flatnonzero(some & (v[np.minimum((last + 1) * STRIDE, n) - 1] > hi[question]))
        for which, stride, out, back in ((low, first, lo, False), (high, last, hi, True)):
            if len(which):
                rows = (sets[stride[which], :, at[which]] & bit[which, None]) > 0
                row = STRIDE - 1 - rows[:, ::-1].argmax(axis=1) if back else rows.argmax(axis=1)
                got, q = v[stride[which] * STRIDE + row], question[which]
                out[q] = np.maximum(out[q], got) if back else np.minimum(out[q], got)


# ---------------------------------------------------------------- the fit


def fit_forest(df: DataFrame, x: Column, width: int, trees: int = 100, depth: int = 5, seed: int = 0) -> Forest:
    """A forest over all rows of ``df``, whose array of ``width`` inputs is ``x``. It hangs on the rows'
    values and the seed, not on their places, keys or number of copies."""
    blocks = _packed(df.select(x.alias("x")), width).persist()
    try:
        n = blocks.agg(F.sum("n").alias("n")).first()["n"] or 0
        if n * width <= CELLS:
            return _in_one_task(blocks, width, trees, depth, seed)
        return grown(lambda *q: _pass(blocks, width, *q), width, trees, depth, seed)
    finally:
        blocks.unpersist()


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of rows, an input after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // width)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                m = inputs(batch.column(0).slice(lo, step))
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([len(m)], pa.int64()), "x": pa.array([np.ascontiguousarray(m.T).tobytes()], pa.binary()),
                })

    return rows.mapInArrow(run, BLOCK)


def _unpacked(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    for x in batch.column(1):
        yield np.frombuffer(x.as_buffer()).reshape(width, -1)


def _in_one_task(blocks: DataFrame, width: int, trees: int, depth: int, seed: int) -> Forest:
    """The same where all rows fit a block: one task that asks itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [m for batch in batches for m in _unpacked(batch, width)]
        whole = np.hstack(parts) if parts else np.zeros((width, 0))

        def ask(forest, asked, questions):
            lo, hi = np.full(questions, np.inf), np.full(questions, -np.inf)
            extremes(whole, forest, asked, lo, hi)
            return lo, hi

        made = grown(ask, width, trees, depth, seed)
        yield pa.RecordBatch.from_pydict({"parts": pa.array([pickle.dumps((made.cuts, made.open_, made.starts))], pa.binary())})

    return Forest(*pickle.loads(blocks.coalesce(1).mapInArrow(run, "parts binary").first()["parts"]))


def _pass(blocks: DataFrame, width: int, forest: Forest, asked: dict, questions: int) -> tuple[np.ndarray, np.ndarray]:
    """The extremes over all rows: each task sends its own, a few tasks join them."""
    shared = blocks.sparkSession.sparkContext.broadcast((forest, asked))

    def joined(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full(questions, np.inf), np.full(questions, -np.inf)
        for a, b in found:
            np.minimum(lo, a, out=lo)
            np.maximum(hi, b, out=hi)
        yield pa.RecordBatch.from_pydict({"lo": pa.array([lo.tobytes()], pa.binary()), "hi": pa.array([hi.tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, asked = shared.value
        lo, hi = np.full(questions, np.inf), np.full(questions, -np.inf)
        for batch in batches:
            for x in _unpacked(batch, width):
                extremes(x, forest, asked, lo, hi)
        yield from joined(iter([(lo, hi)]))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from joined(
            (np.frombuffer(a.as_buffer()), np.frombuffer(b.as_buffer())) for batch in batches for a, b in zip(batch.column(0), batch.column(1))
        )

    parts = blocks.mapInArrow(run, "lo binary, hi binary")
    try:
        got = parts.repartition(min(8, shuffle_width(blocks.sparkSession))).mapInArrow(join, "lo binary, hi binary").collect()
    finally:
        shared.unpersist()
    return (np.min([np.frombuffer(r["lo"]) for r in got], axis=0), np.max([np.frombuffer(r["hi"]) for r in got], axis=0))
