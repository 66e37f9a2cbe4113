"""Exact k nearest neighbours as a partitioned join.

Points are packed into cells, each with a bounding box and one pattern of present columns,
and cells into blocks of bounded size. A query is sent first to its closest cell(s), which gives an upper bound
on its k-th distance, and then only to the other cells whose box comes within that bound.
Work inside a block is numpy on one (block, query chunk) pair; both sides are bounded, so a
crowded region becomes more blocks and more chunks rather than a larger task. Equal points
keep only their k smallest keys (no more of them can ever be used) and equal queries are
asked once, so repeated rows cost nothing extra. The answer is exact: the bound only skips
cells that cannot hold a neighbour. Ties go to the smaller key.

A query that lacks columns cannot tell points apart that differ in these only. So points of one
pattern are also kept by the columns they share with such queries, again with their k smallest
keys for equal values, and the query is sent to these cells instead. A large block is searched by a
tree of halves, so the work of a query grows with the logarithm of the block.

Distances skip columns missing on either side and scale up by (columns / shared columns).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.quantiles import value_splits
from winnow.roles import ROLES, Roles, col
from winnow.session import cut_lineage, shuffle_width, small_table

BLOCK_ROWS = 1_000
MAX_BLOCKS = 8_192
MAX_PATTERNS = 64
CHUNK_ROWS = 4_000
GRID_COLUMNS = 6
TREE_ROWS = 50_000  # points of a block that is searched by a tree
TREE_COLUMNS = 4  # varying columns up to which a tree is used; in more, most leaves are visited
BRUTE_ROWS = 2_000  # points up to which a block is searched whole
LEAF_ROWS = 32
COPIES = 8  # times that the points may be kept by some of their columns, on average
CELLS = 1 << 19  # numbers of a matrix in a task: 4 MB


def nearest(
    points: DataFrame,
    queries: DataFrame,
    dims: list[str],
    k: int,
    point_id: str,
    query_id: str,
    need: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, need, point_id, distance): the k nearest points of each query.

    ``need`` names a query column with the position (as text) of the point column that must
    be present in a neighbour, as imputation asks; without it any point will do.
    """
    spark = points.sparkSession
    d = len(dims)
    pts = points.select(
        col(point_id).alias("pid"), *[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(dims)]
    )
    xs = [f"x{i}" for i in range(d)]
    twin = Window.partitionBy(*xs).orderBy("pid")
    pts = cut_lineage(pts.withColumn("_t", F.row_number().over(twin)).where(F.col("_t") <= k).drop("_t"))
    qs = queries.select(
        col(query_id).alias("qid"),
        (col(need) if need else F.lit("")).alias("need"),
        *[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(dims)],
    )
    qs = cut_lineage(qs)
    types = (qs.schema["qid"].dataType.simpleString(), pts.schema["pid"].dataType.simpleString())
    cells, boxes, views = _pack(pts, qs, xs, k, block_rows, bool(need))
    if boxes.empty:
        return spark.createDataFrame([], _found_schema(types))
    nsub = dict(zip(boxes["cell"], boxes["nsub"]))
    shared = spark.sparkContext.broadcast(_index(boxes, xs, bool(need), views))

    route_schema = f"qid {types[0]}, need string, cell string, " + ", ".join(f"{x} double" for x in xs) + ", r double"
    width = shuffle_width(spark)
    home = qs.repartition(width, "qid").mapInPandas(lambda it: _route(it, shared.value, k, xs, None), route_schema)
    first = cut_lineage(_best(_probe(home, cells, nsub, xs, k, types), k))
    reach = first.groupBy("qid", "need").agg(
        F.max("distance").alias("r"), F.count(F.lit(1)).alias("got")
    )
    bound = F.when(F.col("got") >= k, F.col("r")).otherwise(F.lit(float("inf")))
    again = qs.join(reach, ["qid", "need"], "left").select(
        *qs.columns, F.coalesce(bound, F.lit(float("inf"))).alias("_r")
    )
    rest = again.repartition(width, "qid").mapInPandas(lambda it: _route(it, shared.value, k, xs, "_r"), route_schema)
    return _best(first.unionByName(_probe(rest, cells, nsub, xs, k, types)), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid", "need").orderBy("distance", "pid")
    return found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def _pattern(xs: list[str]):
    return F.concat(*[F.when(F.col(x).isNull(), "0").otherwise("1") for x in xs])


def _common(a: str, b: str) -> str:
    return "".join("1" if "1" == i == j else "0" for i, j in zip(a, b))


def _views(seen: list, asked: list | None, typed: bool) -> dict[str, list[str]]:
    """Sets of columns by which the points of each pattern are kept. ``asked`` has the queries'
    patterns, the commonest first, or is None where they are too many: then, and beyond ``COPIES``,
    a pattern is kept whole too, for queries that have no view of it."""
    views: dict[str, list[str]] = {p["pat"]: [] for p in seen}
    if asked is None or len(asked[0]["pat"] if asked else "") >= 62:
        return {p: [p] for p in views}
    left = COPIES * sum(p["n"] for p in seen)
    for q in asked:
        for p in seen:
            pat = p["pat"]
            part = _common(q["pat"], pat)
            # a pattern with no column that the query lacks has nothing to give where one is needed
            if "1" not in part or part in views[pat] or (typed and part == pat):
                continue
            if part != pat:
                left -= p["n"]
                part = part if left >= 0 else pat
            if part not in views[pat]:
                views[pat].append(part)
    return views


def _pack(
    pts: DataFrame, qs: DataFrame, xs: list[str], k: int, block_rows: int, typed: bool
) -> tuple[DataFrame, pd.DataFrame, dict]:
    """Assign every point to a cell of each view of its pattern; return the points, the (bounded) box
    table, whose ``nsub`` says into how many blocks of bounded size a cell is cut, and the views."""
    tagged = pts.withColumn("pat", _pattern(xs))
    n = tagged.count()
    if n == 0:
        return tagged, pd.DataFrame(), {}
    seen = (
        tagged.groupBy("pat")
        .agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.min(x), F.max(x)).alias(x) for x in xs])
        .orderBy(F.desc("n"), "pat")
        .limit(MAX_PATTERNS)
        .collect()
    )
    asked = qs.groupBy(_pattern(xs).alias("pat")).count().orderBy(F.desc("count"), "pat").limit(MAX_PATTERNS + 1).collect()
    views = _views(seen, asked if len(asked) <= MAX_PATTERNS else None, typed)
    per_block = max(block_rows, math.ceil(n / (MAX_BLOCKS / 4)))
    # points with a rare pattern share blocks that every query visits
    lists = F.create_map(*[F.lit(v) for p, own in views.items() for v in (p, ",".join(own))])
    parts = F.when(F.col("pat").isin(list(views)), F.split(F.element_at(lists, F.col("pat")), ",")).otherwise(F.array(F.lit("*")))
    tagged = tagged.withColumn("view", F.explode(parts)).where("view <> ''")
    tagged = tagged.withColumn("pat", F.when(F.col("view") == "*", "*").otherwise(F.col("pat")))
    masked = lambda i, x: F.when((F.col("view") == "*") | (F.substring("view", i + 1, 1) == "1"), F.col(x)).alias(x)
    tagged = tagged.select("pid", "pat", "view", *[masked(i, x) for i, x in enumerate(xs)])
    if any(v != p for p, own in views.items() for v in own):
        twin = Window.partitionBy("pat", "view", *xs).orderBy("pid")
        tagged = tagged.withColumn("_t", F.row_number().over(twin)).where(F.col("_t") <= k).drop("_t")
        tagged = cut_lineage(tagged)
    varies = lambda x: any(p[x][0] is not None and p[x][0] < p[x][1] for p in seen)
    moving = [x for x in xs if varies(x)]
    # a cell budget per view keeps the total number of cells under MAX_BLOCKS / 2
    count = sum(map(len, views.values()))
    target = min(math.ceil(n / per_block), MAX_BLOCKS // (2 * (count + 1)))
    grids: dict[tuple[str, ...], int] = {}
    by_view = {}
    for view in sorted({v for own in views.values() for v in own} | {"*"}):
        use = [x for i, x in enumerate(xs) if x in moving and (view == "*" or view[i] == "1")][:GRID_COLUMNS]
        side = max(1, int(target ** (1 / len(use)))) if use else 1
        if side < 2:
            use, side = use[: int(math.log2(max(target, 1)))], 2
        by_view[view] = (use, side)
        if use:
            grids[side] = sorted({*grids.get(side, ()), *use})
    splits = {side: value_splits(tagged.select(*use), use, side) for side, use in grids.items()}
    place = F.lit("")
    for view, (use, side) in by_view.items():
        parts = []
        for x in use:
            cuts = [(F.col(x) >= F.lit(c)).cast("int") for c in splits[side][x][1]]
            index = sum(cuts[1:], cuts[0]) if cuts else F.lit(0)
            parts.append(F.coalesce(index.cast("string"), F.lit("n")))
        place = F.when(F.col("view") == view, F.concat_ws(",", *parts)).otherwise(place)
    tagged = tagged.withColumn("cell", F.concat_ws(",", "pat", "view", place))
    boxes = (
        tagged.groupBy("cell", "pat", "view")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.min(x).alias("lo_" + x) for x in xs],
            *[F.max(x).alias("hi_" + x) for x in xs],
        )
        .toPandas()
        .sort_values("cell", ignore_index=True)
    )
    few = {v: sum(x in moving and f == "1" for x, f in zip(xs, v)) <= TREE_COLUMNS for v in by_view if v != "*"}
    whole = np.array([max(per_block, TREE_ROWS) if few.get(v) else per_block for v in boxes["view"]])
    boxes["nsub"] = np.ceil(boxes["n"] / whole).astype(int)
    return tagged.select("pid", "cell", *xs), boxes, views


def _index(boxes: pd.DataFrame, xs: list[str], typed: bool, views: dict) -> dict:
    """Box table as plain arrays; at most MAX_BLOCKS rows by construction."""
    lo = boxes[["lo_" + x for x in xs]].to_numpy(dtype=float)
    mixed = (boxes["pat"] == "*").to_numpy()
    flags = lambda c: np.array([[f == "1" for f in v] if v != "*" else [False] * len(xs) for v in boxes[c]])
    return {
        "cell": boxes["cell"].to_numpy(dtype=object),
        "n": boxes["n"].to_numpy(),
        "lo": lo,
        "hi": boxes[["hi_" + x for x in xs]].to_numpy(dtype=float),
        "mixed": mixed,
        "has": ~np.isnan(lo) & ~mixed[:, None],
        "maybe": ~np.isnan(lo),
        "gives": np.where(mixed[:, None], ~np.isnan(lo), flags("pat")),
        "pat": boxes["pat"].to_numpy(dtype=object),
        "view": boxes["view"].to_numpy(dtype=object),
        "views": views,
        "typed": typed,
    }


def _fitting(index: dict, name: str, need: str) -> dict:
    """The part of the index that a query of the pattern ``name`` is sent to: of every pattern of
    points the view that both share, or the whole pattern where there is no such view."""
    want = {p: (c if (c := _common(name, p)) in own else p) for p, own in index["views"].items()}
    fits = np.array([p == "*" or want[p] == v for p, v in zip(index["pat"], index["view"])], dtype=bool)
    if index["typed"]:
        fits &= index["gives"][:, int(need)]
    return {name: part[fits] if isinstance(part, np.ndarray) else part for name, part in index.items()}


def _kinds(index: dict, q: np.ndarray, need: np.ndarray, known: dict):
    """(rows, part of the index) of the queries of each pattern and need; all of them together with
    the whole index where every pattern of points is kept whole."""
    if all(own == [p] for p, own in index["views"].items()):
        yield np.arange(len(q)), index
        return
    shapes, place = np.unique(~np.isnan(q), axis=0, return_inverse=True)
    kind = pd.Series(list(zip(place.ravel(), need)))
    for (shape, wants), rows in kind.groupby(kind).indices.items():
        name = "".join("1" if f else "0" for f in shapes[shape])
        if (name, wants) not in known:
            known[name, wants] = _fitting(index, name, wants)
        yield rows, known[name, wants]


def _lower(index: dict, q: np.ndarray) -> np.ndarray:
    """Lower bound of the distance from each query to any point of each cell; nan where
    no column is shared, so that there is no distance at all."""
    d = q.shape[1]
    total = np.zeros((len(q), len(index["cell"])))
    shared = np.zeros_like(total)
    touch = np.zeros_like(total, dtype=bool)
    for i in range(d):
        x = q[:, i][:, None]
        there = ~np.isnan(x)
        if not there.any():
            continue
        both = there & index["has"][None, :, i]
        gap = np.maximum(np.maximum(index["lo"][None, :, i] - x, x - index["hi"][None, :, i]), 0.0)
        total += np.where(both, gap * gap, 0.0)
        shared += both
        touch |= there & index["maybe"][None, :, i]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.sqrt(total * d / shared) * (1 - 1e-9)
    return np.where(touch, np.where(shared > 0, out, 0.0), np.nan)


def _allowed(index: dict, need: np.ndarray) -> np.ndarray:
    if not index["typed"]:
        return np.ones((len(need), len(index["cell"])), dtype=bool)
    return index["gives"][:, np.array([int(c) for c in need], dtype=int)].T


def _home(lower: np.ndarray, ok: np.ndarray, index: dict, k: int) -> np.ndarray:
    """Closest cells that together hold k points which surely count as neighbours."""
    order = np.argsort(np.where(ok, lower, np.inf), axis=1, kind="stable")
    sure = np.where(ok & ~index["mixed"][None, :], index["n"][None, :], 0)
    sorted_n = np.take_along_axis(sure, order, axis=1)
    before = np.cumsum(sorted_n, axis=1) - sorted_n
    take = np.zeros_like(ok)
    np.put_along_axis(take, order, (before < k) & np.take_along_axis(ok, order, axis=1), axis=1)
    return take


def _route(batches, index: dict, k: int, xs: list[str], radius: str | None):
    known: dict = {}
    for pdf in batches:
        every, need = pdf[xs].to_numpy(dtype=float), pdf["need"].to_numpy()
        for members, own in _kinds(index, every, need, known):
            step = max(1, CELLS // max(1, len(own["cell"])))
            for start in range(0, len(members), step):
                at = members[start : start + step]
                part = pdf.iloc[at]
                lower = _lower(own, every[at])
                ok = ~np.isnan(lower) & _allowed(own, need[at])
                home = _home(np.nan_to_num(lower), ok, own, k)
                if radius is None:
                    take = home
                else:
                    take = ok & ~home & (np.nan_to_num(lower) <= part[radius].to_numpy()[:, None])
                rows, blocks = np.nonzero(take)
                for lo in range(0, len(rows), CELLS // 8):
                    some = rows[lo : lo + CELLS // 8]
                    out = part.iloc[some][["qid", "need", *xs]].reset_index(drop=True)
                    out.insert(2, "cell", own["cell"][blocks[lo : lo + CELLS // 8]])
                    out["r"] = np.inf if radius is None else part[radius].to_numpy()[some]
                    yield out


def _probe(
    routed: DataFrame, cells: DataFrame, nsub: dict, xs: list[str], k: int, types: tuple[str, str]
) -> DataFrame:
    """Top k of each (query, block), computed per (block, chunk of queries).

    A cell is cut into ``nsub`` blocks by a hash of the point and its queries into chunks by
    a hash of the query, the numbers following the row counts; a query meets every block of
    its cell and a block is repeated once per chunk, so both sides of a task stay bounded.
    The load table has one row per cell.
    """
    spark = routed.sparkSession
    routed = cut_lineage(routed)
    per = routed.groupBy("cell").count().collect()
    rows = [(r["cell"], int(nsub[r["cell"]]), math.ceil(r["count"] / CHUNK_ROWS)) for r in per]
    load = small_table(spark, rows, "cell string, nsub int, nch int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (
        routed.join(load, "cell")
        .withColumn("ch", F.pmod(F.xxhash64("qid", "need"), F.col("nch")).cast("int"))
        .withColumn("sub", each("nsub"))
        .drop("nsub", "nch")
    )
    right = (
        cells.join(load, "cell")
        .withColumn("sub", F.pmod(F.xxhash64("pid"), F.col("nsub")).cast("int"))
        .withColumn("ch", each("nch"))
        .drop("nsub", "nch")
    )
    d = len(xs)

    def solve(key, q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if q.empty or p.empty:
            return pd.DataFrame({"qid": [], "need": [], "pid": [], "distance": []})
        p = p.sort_values("pid")
        return _topk(
            q["qid"].to_numpy(), q["need"].to_numpy(), q[xs].to_numpy(dtype=float),
            p["pid"].to_numpy(), p[xs].to_numpy(dtype=float), k, d, q["r"].to_numpy(), key[0].startswith("*"),
        )

    width = shuffle_width(spark)
    keys = ("cell", "sub", "ch")
    return (
        left.repartition(width, *keys)
        .groupBy(*keys)
        .cogroup(right.repartition(width, *keys).groupBy(*keys))
        .applyInPandas(solve, _found_schema(types))
    )


def _found_schema(types: tuple[str, str]) -> str:
    return f"qid {types[0]}, need string, pid {types[1]}, distance double"


def _topk(qid, need, q, pid, p, k, d, r, mixed) -> pd.DataFrame:
    """Top k of one block for each query, none beyond its distance ``r``, rows of ``p`` in key order.

    Where every point has the same columns, queries are taken by their own pattern: a
    matrix product gives all squared distances up to rounding, whatever could be among the
    k nearest within that rounding is measured again term by term, and only those are
    ranked. Mixed blocks are measured term by term throughout.
    """
    have = ~np.isnan(p)
    some = have.any(axis=0)
    pure = bool((some == have.all(axis=0)).all())
    codes = np.isnan(q) @ (1 << np.arange(d, dtype=np.int64)) if d < 62 else np.arange(len(q))
    if mixed and len(need) and need[0] != "":
        wanted = np.array([int(f) for f in need])
        able = some[wanted] if pure else np.ones(len(q), dtype=bool)
    else:  # a query is sent to cells of one pattern only where that has what it needs
        wanted, able = None, np.ones(len(q), dtype=bool)
    halved = pure and len(p) > BRUTE_ROWS and (np.nanmin(p[:, some], axis=0) < np.nanmax(p[:, some], axis=0)).sum() <= TREE_COLUMNS
    step = max(1, CHUNK_ROWS if halved else CELLS // max(1, len(pid)))
    outs, trees = [], {}
    for code in np.unique(codes[able]):
        members = np.flatnonzero((codes == code) & able)
        for s in range(0, len(members), step):
            rows = members[s : s + step]
            a = q[rows]
            if pure:
                dims = np.flatnonzero(some & ~np.isnan(a[0]))
                if len(dims) == 0:
                    continue
                if halved:
                    name = tuple(dims)
                    trees[name] = trees[name] if name in trees else _halved(p[:, dims], k)
                    i, j, dist = _near_halved(a[:, dims], trees[name], k, d, r[rows])
                else:
                    i, j, dist = _near_pure(a[:, dims], p[:, dims], k, d)
            else:
                i, j, dist = _near_mixed(a, p, None if wanted is None else wanted[rows], have, d)
            close = dist <= r[rows][i]
            i, j, dist = i[close], j[close], dist[close]
            order = np.lexsort((j, dist, i))
            i, j, dist = i[order], j[order], dist[order]
            ok = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
            i, j, dist = i[ok], j[ok], dist[ok]
            outs.append(
                pd.DataFrame({"qid": qid[rows][i], "need": need[rows][i], "pid": pid[j], "distance": dist})
            )
    if not outs:
        return pd.DataFrame({"qid": [], "need": [], "pid": [], "distance": []})
    return pd.concat(outs, ignore_index=True)


def _near_pure(a, p, k, d):
    centre = p.mean(axis=0)
    x, y = a - centre, p - centre
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    rough = xx[:, None] + yy[None, :] - 2.0 * (x @ y.T)
    slack = 1e-10 * (xx + yy.max())
    m = min(k, len(p))
    cut = np.partition(rough, m - 1, axis=1)[:, m - 1] + 2 * slack
    i, j = np.nonzero(rough <= cut[:, None])
    total = np.zeros(len(i))
    for c in range(a.shape[1]):
        diff = a[i, c] - p[j, c]
        total += diff * diff
    return i, j, np.sqrt(total * d / a.shape[1])


def _halved(p: np.ndarray, k: int):
    """Points cut at the median of their widest column, again and again, to leaves of some
    ``LEAF_ROWS``: (their order, the starts of the leaves, the boxes of each level)."""
    n, order, depth = len(p), np.arange(len(p)), 0
    while n >> (depth + 1) >= max(k, LEAF_ROWS // 2):
        depth += 1
    for level in range(depth):
        edges = (n * np.arange((1 << level) + 1)) >> level
        mids = (n * np.arange(1, 2 << level, 2)) >> (level + 1)
        for lo, mid, hi in zip(edges[:-1], mids, edges[1:]):
            at = order[lo:hi]
            rows = p[at]
            c = np.argmax(rows.max(axis=0) - rows.min(axis=0))
            order[lo:hi] = at[np.argpartition(rows[:, c], mid - lo)]
    rows, boxes = p[order], []
    for level in range(depth + 1):
        starts = (n * np.arange(1 << level)) >> level
        boxes.append((np.minimum.reduceat(rows, starts), np.maximum.reduceat(rows, starts)))
    return rows, order, np.append(starts, n), boxes


def _gap(a, box, i, node):
    """Squared distance from each query ``a[i]`` to a box."""
    total = np.zeros(len(i))
    for c in range(a.shape[1]):
        x = a[i, c]
        gap = np.maximum(np.maximum(box[0][node, c] - x, x - box[1][node, c]), 0.0)
        total += gap * gap
    return total


def _near_halved(a, tree, k, d, r):
    """Points within ``r`` and within the k-th distance in the query's closest leaf, which are all
    that can be among its k nearest; the distances are those of ``_near_pure``."""
    p, order, starts, boxes = tree
    every = np.arange(len(a))

    def measured(i, at):
        total = np.zeros(at.shape)
        for c in range(a.shape[1]):
            diff = a[i, c][:, None] - p[at, c]
            total += diff * diff
        return np.sqrt(total * d / a.shape[1])

    node = np.zeros(len(a), dtype=np.int64)
    for box in boxes[1:]:
        node = 2 * node + (_gap(a, box, every, 2 * node + 1) < _gap(a, box, every, 2 * node))
    least = int(np.diff(starts).min())
    limit = r.astype(float)
    if least >= k:
        step = max(1, CELLS // least)
        for lo in range(0, len(a), step):
            i = every[lo : lo + step]
            dist = measured(i, starts[node[i]][:, None] + np.arange(least))
            limit[i] = np.minimum(limit[i], np.partition(dist, k - 1, axis=1)[:, k - 1])
    i, node = every, np.zeros(len(a), dtype=np.int64)
    for box in boxes[1:]:
        i, node = np.repeat(i, 2), np.repeat(2 * node, 2)
        node[1::2] += 1
        near = np.sqrt(_gap(a, box, i, node) * d / a.shape[1]) * (1 - 1e-9) <= limit[i]
        i, node = i[near], node[near]
    most, outs = int(np.diff(starts).max()), []
    step = max(1, CELLS // most)
    for lo in range(0, len(i), step):
        part, leaf = i[lo : lo + step], node[lo : lo + step]
        at = starts[leaf][:, None] + np.arange(most)
        dist = measured(part, np.minimum(at, len(p) - 1))
        row, col_ = np.nonzero((dist <= limit[part][:, None]) & (at < starts[leaf + 1][:, None]))
        outs.append((part[row], order[at[row, col_]], dist[row, col_]))
    if not outs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*outs))


def _near_mixed(a, p, wanted, have, d):
    total, shared = np.zeros((len(a), len(p))), np.zeros((len(a), len(p)))
    for c in range(d):
        diff = a[:, c][:, None] - p[:, c][None, :]
        present = ~np.isnan(diff)
        total += np.where(present, diff * diff, 0.0)
        shared += present
    ok = shared > 0
    if wanted is not None:
        ok &= have[:, wanted].T
    i, j = np.nonzero(ok)
    return i, j, np.sqrt(total[i, j] * d / shared[i, j])


# ---------------------------------------------------------------- uses


def neighbour_means(
    df: DataFrame, donors: DataFrame, dims: list[str], k: int = 5, roles: Roles = ROLES
) -> DataFrame:
    """Fill each missing number with the mean of that column over its k nearest donors that
    have it. Cells without any donor are left for the column mean."""
    key = roles.row_id
    holes = [F.when(col(c).isNull(), F.lit(str(i))) for i, c in enumerate(dims)]
    asked = df.where(_any_null(dims))
    # equal incomplete rows have equal answers: ask once per distinct vector
    distinct = asked.groupBy(*[col(c) for c in dims]).agg(F.min(col(key)).alias("_q"))
    typed = distinct.withColumn("_need", F.explode(F.array_compact(F.array(*holes))))
    found = nearest(donors, typed, dims, k, key, "_q", need="_need")
    values = donors.select(
        col(key).alias("pid"),
        F.array(*[col(c) for c in dims]).alias("_vals"),
    )
    cell = F.element_at("_vals", F.col("need").cast("int") + 1)
    means = found.join(values, "pid").groupBy("qid", "need").agg(F.avg(cell).alias("m"))
    wide = means.groupBy(F.col("qid").alias("_pq")).agg(
        *[F.max(F.when(F.col("need") == str(i), F.col("m"))).alias(f"_m{i}") for i in range(len(dims))]
    )
    answers = distinct.join(wide, F.col("_q") == F.col("_pq")).select(
        *[col(c).alias(f"_a{i}") for i, c in enumerate(dims)],
        *[f"_m{i}" for i in range(len(dims))],
    )
    same = None
    for i, c in enumerate(dims):
        test = col(c).eqNullSafe(F.col(f"_a{i}"))
        same = test if same is None else same & test
    # complete rows bypass the join
    filled = df.where(_any_null(dims)).join(answers, same, "left")
    filled = filled.select(
        *[
            F.coalesce(col(c), F.col(f"_m{dims.index(c)}")).alias(c) if c in dims else col(c)
            for c in df.columns
        ]
    )
    return df.where(~_any_null(dims)).unionByName(filled)


def _any_null(dims: list[str]):
    out = col(dims[0]).isNull()
    for c in dims[1:]:
        out = out | col(c).isNull()
    return out


def classify(
    train: DataFrame, test: DataFrame, dims: list[str], k: int = 5, roles: Roles = ROLES
) -> DataFrame:
    """Majority vote of the k nearest train rows; equal votes go to the smallest label.
    A test row without any value has no neighbours and takes the most frequent train label.
    Returns (row_id, label, prediction), one row for each test row."""
    key, lab = roles.row_id, roles.label
    pts = train.select(col(key), *[col(c) for c in dims])
    distinct = test.groupBy(*[col(c) for c in dims]).agg(F.min(col(key)).alias("_q"))
    found = nearest(pts, distinct, dims, k, key, "_q")
    votes = found.join(train.select(col(key).alias("pid"), col(lab).alias("_l")), "pid")
    tally = votes.groupBy("qid", "_l").agg(F.count(F.lit(1)).alias("v"))
    picked = tally.groupBy(F.col("qid").alias("_pq")).agg(
        F.min(F.struct(-F.col("v"), F.col("_l"))).alias("_pick")
    )
    answers = distinct.join(picked, F.col("_q") == F.col("_pq")).select(
        *[col(c).alias(f"_a{i}") for i, c in enumerate(dims)], F.col("_pick._l").alias("prediction")
    )
    same = None
    for i, c in enumerate(dims):
        t = col(c).eqNullSafe(F.col(f"_a{i}"))
        same = t if same is None else same & t
    most = train.groupBy(col(lab).alias("_l")).count().orderBy(F.desc("count"), "_l").select("_l").first()
    usual = F.lit(most["_l"] if most else None).cast(train.schema[lab].dataType)
    told = F.coalesce("prediction", usual).alias("prediction")
    return test.join(answers, same, "left").select(col(key), col(lab), told)
