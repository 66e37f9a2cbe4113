"""Hard negatives by Hilbert-ordered Parquet blocks with zone maps.

Candidate rows are put on a Hilbert curve (over the axes of largest variance) and written in its
order as Parquet, ``BLOCK`` rows to a block: ids, labels and the matrix of the block in columns
of their own, beside a zone map that holds the smallest and largest value of every dimension and
the labels that occur. A search reads the zone columns first; interval arithmetic gives the
least and the greatest inner product that any row of a block can have with an anchor, and only
blocks that can hold a row of a window (a range of scores, with or without the anchor's own
label) have their matrix read and scored.

The windows of an anchor are found in two searches: first its positives, the best rows of its
label; then, for each positive, the rows of other labels whose score lies between ``low`` and
``high`` percent of the positive's. A search has two steps: the ``HOME`` blocks with the highest
bounds give each window its k-th score so far, and with this as the lower end of the window all
blocks that can still matter are read. A window keeps k rows per task, so what is sent grows
with windows and tasks, not with scores.

Anchors come in slices of ``SLICE``, which bounds what rides along with the tasks. Of equal
vectors with one label only the smallest ids (as many as an answer can name) are candidates.

Defined cases: a row without id, label or vector, or with a null or non-finite component, takes
no part; rows that share an id are one (the smallest label, then vector); missing components of a
shorter (or empty) vector count as 0; ties go to the smaller id; scores are exact while they fit
53 bits, and raise beyond. Other columns are never looked at.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import cut, shared_folder
from winnow.llm.topk import matrix

SCALE = 256
POSITIVES = NEGATIVES = 5
LOW, HIGH = 80, 100
#: Rows of a block; blocks a window looks at first; anchors of one pass.
BLOCK, HOME, SLICE = 128, 2, 1024
#: Dimensions of the curve and bits of each.
AXES, BITS = 8, 7
#: Rows that a task orders and cuts into blocks (128 MB of 64 dimensions).
ROWS_PER_TASK = 250_000
#: Zone rows whose bounds are held at once; rows of the requests (one per block) that are broadcast.
ZONES, REQUESTS = 128, 20_000
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
BLOCKS = "block long, n int, low array<int>, high array<int>, labels array<int>, ids binary, row_labels binary, rows binary"


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of (n, dims) whole numbers below 2^bits (dims * bits < 64).

    A cell's place is found by going down the levels: at each, the octant is read through the
    reflections and exchanges of axes that the octants above have left (the transform that undoes
    them from the highest bit), and the bits are Gray-decoded across axes and levels.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(dims):
            on = (x[i] & bit) != 0
            other = (x[0] ^ x[i]) & below
            x[0] ^= np.where(on, below, other)
            x[i] ^= np.where(on, 0, other)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    out = np.zeros(x.shape[1], dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def quantised(df: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, label, v): floor(SCALE * x) of each component; one row per id."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = df.where(F.col(key).isNotNull() & v.isNotNull() & ~bad)
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    rows = usable.select(F.col(key).cast("long").alias("id"), label.cast("int").alias("label"), whole.alias("v"))
    least = F.min(F.struct("label", "v")).alias("r")
    return rows.where("label IS NOT NULL").groupBy("id").agg(least).select("id", "r.label", "r.v")


def smallest(rows: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` smallest ids of rows with one label and vector."""
    # the rank limit is applied before the shuffle too, so a very common vector stays small
    order = Window.partitionBy("label", "v").orderBy("id")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")


def curve_axes(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(axes, low, high): the directions of largest variance and the range of each; from sums
    over all rows, one (dim, dim) matrix per task."""

    def moments(batches):
        n, s, g = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            v = matrix(batch.column(0), dim).astype(float)
            n, s, g = n + len(v), s + v.sum(axis=0), g + v.T @ v
        columns = [pa.array([x], pa.binary()) for x in (s.tobytes(), g.tobytes())]
        yield pa.RecordBatch.from_arrays([pa.array([n]), *columns], names=["n", "s", "g"])

    def merge(batches):
        n, s, g = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            for one in batch.to_pylist():
                n, s, g = n + one["n"], s + np.frombuffer(one["s"]), g + np.frombuffer(one["g"]).reshape(dim, dim)
        columns = [pa.array([x], pa.binary()) for x in (s.tobytes(), g.tobytes())]
        yield pa.RecordBatch.from_arrays([pa.array([n]), *columns], names=["n", "s", "g"])

    schema = "n long, s binary, g binary"
    parts = rows.select("v").mapInArrow(moments, schema).repartition(16).mapInArrow(merge, schema).collect()
    n = sum(r["n"] for r in parts)
    s = sum(np.frombuffer(r["s"]) for r in parts)
    g = sum(np.frombuffer(r["g"]).reshape(dim, dim) for r in parts)
    values, vectors = np.linalg.eigh(g / n - np.outer(s / n, s / n))
    axes = vectors[:, ::-1][:, : min(AXES, dim)]
    middle, spread = (s / n) @ axes, np.sqrt(np.maximum(values[::-1][: axes.shape[1]], 0)) * 3 + 1e-9
    return axes, middle - spread, middle + spread


def write_blocks(rows: DataFrame, folder: str, size: int = BLOCK) -> tuple[DataFrame, int]:
    """The blocks of (id, label, v) as Parquet below ``folder``, and the number of dimensions."""
    rows = cut(rows)
    found = rows.agg(F.max(F.size("v")).alias("d"), F.count("*").alias("n")).first()
    dim = max(found["d"] or 0, 1)
    axes, low, high = curve_axes(rows, dim)

    def place(batches):
        for batch in batches:
            p = (matrix(batch.column(2), dim) @ axes - low) / (high - low)
            at = hilbert(np.clip(np.floor(p * (1 << BITS)), 0, (1 << BITS) - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["id", "label", "v", "place"])

    placed = rows.mapInArrow(place, "id long, label int, v array<int>, place long")
    # equal places are split by id, so a crowded cell spreads over tasks
    tasks = max(1, -(-found["n"] // ROWS_PER_TASK), rows.sparkSession.sparkContext.defaultParallelism)
    ordered = placed.repartitionByRange(tasks, "place", "id").sortWithinPartitions("place", "id")

    def to_blocks(batches):
        number, rest = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            whole = rest.num_rows // size * size
            for a in range(0, whole, size):
                yield one_block(number, rest.slice(a, size), dim)
                number += 1
            rest = rest.slice(whole)
        if rest is not None and rest.num_rows:
            yield one_block(number, rest, dim)

    ordered.mapInArrow(to_blocks, BLOCKS).write.parquet(folder)
    return rows.sparkSession.read.parquet(folder), dim


def one_block(number: int, batch: pa.RecordBatch, dim: int) -> pa.RecordBatch:
    order = np.argsort(batch.column(0).to_numpy())  # by id, for ties
    ids, labels = batch.column(0).to_numpy()[order], batch.column(1).to_numpy()[order]
    v = matrix(batch.column(2), dim)[order].astype("<i4")
    columns = [
        pa.array([number]), pa.array([len(ids)], pa.int32()),
        pa.array([v.min(axis=0)], pa.list_(pa.int32())), pa.array([v.max(axis=0)], pa.list_(pa.int32())),
        pa.array([np.unique(labels)], pa.list_(pa.int32())),
        pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([labels.astype("<i4").tobytes()], pa.binary()),
        pa.array([v.tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in BLOCKS.split(", ")])


class Windows:
    """Ranges of scores to fill: for anchor ``at`` the k best rows with low <= score <= high, of
    the anchor's label (``same``) or of the others, never the anchor itself."""

    def __init__(self, ids, labels, vectors, at, low, high, same: bool, k: int):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.at, self.low, self.high, self.same, self.k = at, low, high, same, k

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(blocks, anchors): least and greatest inner product by interval arithmetic."""
        up, down = np.maximum(self.vectors, 0).T, np.minimum(self.vectors, 0).T
        return low @ up + high @ down, high @ up + low @ down

    def possible(self, batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """(blocks, windows) of zone rows: whether a row can be in the window, and the greatest score."""
        least, most = self.bounds(matrix(batch.column(1), dim), matrix(batch.column(2), dim))
        has, mixed = np.zeros((batch.num_rows, len(self.ids)), bool), np.zeros(batch.num_rows, bool)
        for i, found in enumerate(batch.column(3).to_pylist()):
            has[i], mixed[i] = np.isin(self.labels, found), len(found) > 1
        fits = has if self.same else ~has | mixed[:, None]
        most_w = most[:, self.at]
        return fits[:, self.at] & (most_w >= self.low) & (least[:, self.at] <= self.high), np.minimum(most_w, self.high)

    def fill(self, batches, dim: int):
        """The k best rows of each window over the (ids, row_labels, rows, windows) of blocks."""
        held: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                packed, row_labels, rows, wanted = (batch.column(c)[i].as_py() for c in range(4))
                ids, labels = np.frombuffer(packed, "<i8"), np.frombuffer(row_labels, "<i4")
                v = np.frombuffer(rows, "<i4").reshape(len(ids), dim).astype(float)
                windows = np.flatnonzero(np.unpackbits(np.frombuffer(wanted, np.uint8), count=len(self.at)))
                anchors, inverse = np.unique(self.at[windows], return_inverse=True)
                scores = (v @ self.vectors[anchors].T)[:, inverse]
                own = labels[:, None] == self.labels[self.at[windows]]
                ok = (own if self.same else ~own) & (scores >= self.low[windows]) & (scores <= self.high[windows])
                ok &= ids[:, None] != self.ids[self.at[windows]]
                for c in np.flatnonzero(ok.any(axis=0)):
                    w, hits = int(windows[c]), np.flatnonzero(ok[:, c])
                    best = held.get(w, [])
                    if len(best) == self.k:
                        hits = hits[scores[hits, c] >= -best[-1][0]]
                    if len(hits) > self.k:  # rows of a block are in order of their ids
                        hits = hits[np.argsort(-scores[hits, c], kind="stable")[: self.k]]
                    held[w] = sorted(best + [(-int(scores[h, c]), int(ids[h])) for h in hits])[: self.k]
        found = [(w, -s, i) for w, best in held.items() for s, i in best]
        columns = list(zip(*found)) or [(), (), ()]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["window", "score", "id"])

    def home(self, batches, dim: int):
        """(block, window, most): the HOME blocks with the greatest bounds for each window."""
        most = np.full((HOME, len(self.at)), -np.inf)
        block = np.full((HOME, len(self.at)), -1)
        for batch in zone_slices(batches):
            fits, bound = self.possible(batch, dim)
            most = np.vstack([most, np.where(fits, bound, -np.inf)])
            block = np.vstack([block, np.repeat(batch.column(0).to_numpy()[:, None], len(self.at), axis=1)])
            first = np.argsort(-most, axis=0, kind="stable")[:HOME]
            most, block = np.take_along_axis(most, first, axis=0), np.take_along_axis(block, first, axis=0)
        _, w = np.nonzero(np.isfinite(most))
        some = np.isfinite(most)
        columns = [pa.array(block[some]), pa.array(w.astype(np.int32)), pa.array(most[some])]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "window", "most"])

    def needed(self, batches, dim: int):
        """(block, windows): the blocks that can hold a row of a window, with a bit for each."""
        for batch in zone_slices(batches):
            fits, _ = self.possible(batch, dim)
            bits = pa.array([row.tobytes() for row in np.packbits(fits, axis=1)], pa.binary())
            both = pa.RecordBatch.from_arrays([batch.column(0), bits], names=["block", "windows"])
            yield both.filter(pa.array(fits.any(axis=1)))

    def bitmaps(self, batches):
        for batch in batches:
            fits = np.zeros((batch.num_rows, len(self.at)), bool)
            for i, windows in enumerate(batch.column(1).to_pylist()):
                fits[i, windows] = True
            bits = pa.array([row.tobytes() for row in np.packbits(fits, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), bits], names=["block", "windows"])


def zone_slices(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, ZONES):
            yield batch.slice(a, ZONES)


def read_windows(blocks: DataFrame, requests: DataFrame, windows: Windows, dim: int) -> DataFrame:
    """(window, score, id, rank): the k best rows of each window over the blocks it asked for.
    ``requests`` (block, windows) has one row for each block."""
    few = requests.select("block").limit(REQUESTS + 1).count() <= REQUESTS
    wanted = F.broadcast(requests) if few else requests
    joined = blocks.select("block", "ids", "row_labels", "rows").join(wanted, "block").select("ids", "row_labels", "rows", "windows")
    best = joined.mapInArrow(lambda batches: windows.fill(batches, dim), "window int, score long, id long")
    order = Window.partitionBy("window").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= windows.k)


def requests_of(blocks: DataFrame, windows: Windows, dim: int) -> DataFrame:
    """(block, windows) to read for the windows; reads the zone columns only."""
    zones = blocks.select("block", "low", "high", "labels")
    return cut(zones.mapInArrow(lambda batches: windows.needed(batches, dim), "block long, windows binary"))


def search(blocks: DataFrame, windows: Windows, dim: int) -> DataFrame:
    """(window, score, id, rank): at most k rows for each window."""
    zones = blocks.select("block", "low", "high", "labels")
    firsts = zones.mapInArrow(lambda batches: windows.home(batches, dim), "block long, window int, most double")
    order = Window.partitionBy("window").orderBy(F.desc("most"), "block")
    firsts = firsts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= HOME)
    firsts = firsts.groupBy("block").agg(F.collect_list("window").alias("w")).mapInArrow(windows.bitmaps, "block long, windows binary")
    kth = read_windows(blocks, cut(firsts), windows, dim).where(F.col("rank") == windows.k)
    low = windows.low.copy()
    for r in kth.collect():  # one number for each window of the slice
        low[r["window"]] = max(low[r["window"]], r["score"])
    closer = Windows(windows.ids, windows.labels, windows.vectors, windows.at, low, windows.high, windows.same, windows.k)
    return read_windows(blocks, requests_of(blocks, closer, dim), closer, dim)


def mine(
    df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | None = None,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row
    that ``is_anchor`` (over the column ``id``) holds for and each of its best ``positives``, the
    first ``negatives`` rows with low * positive <= 100 * score <= high * positive."""
    spark = df.sparkSession
    rows = cut(quantised(df, key, vector, F.col("label") if label is None else label))
    asked = rows.where(is_anchor)
    if asked.limit(1).count() == 0:
        return spark.createDataFrame([], OUT)
    folder = f"{shared_folder(spark)}/hard-negatives-{uuid.uuid4().hex}"
    blocks, dim = write_blocks(smallest(rows, max(positives + 1, negatives)), f"{folder}/blocks", block)
    last = None
    while True:
        ahead = asked if last is None else asked.where(F.col("id") > last)
        anchors = ahead.orderBy("id").limit(SLICE).collect()
        if not anchors:
            break
        last = anchors[-1]["id"]
        found = mine_slice(blocks, anchors, dim, positives, negatives, low, high)
        found.write.mode("append").parquet(f"{folder}/found")
    return spark.read.schema(OUT).parquet(f"{folder}/found")


def mine_slice(blocks, anchors, dim, positives, negatives, low, high) -> DataFrame:
    """Rows of ``OUT`` for one slice of anchors."""
    spark = blocks.sparkSession
    ids, labels = np.array([r["id"] for r in anchors], np.int64), np.array([r["label"] for r in anchors], np.int32)
    vectors = np.zeros((len(anchors), dim))
    for i, r in enumerate(anchors):
        vectors[i, : len(r["v"])] = r["v"]
    if not fits_exactly(blocks, vectors):
        raise OverflowError("inner products beyond 53 bits")
    n, whole = len(anchors), float(1 << 53)
    first = Windows(ids, labels, vectors, np.arange(n), np.full(n, -whole), np.full(n, whole), True, positives)
    best = search(blocks, first, dim).collect()  # at most ``positives`` for each anchor
    if not best:
        return spark.createDataFrame([], OUT)
    at = np.array([r["window"] for r in best])
    scores = np.array([r["score"] for r in best])
    # whole scores between the two ends: ceil(low * p / 100) .. floor(high * p / 100)
    ends = (-(-low * scores // 100)).astype(float), (high * scores // 100).astype(float)
    second = Windows(ids, labels, vectors, at, *ends, False, negatives)
    named = [(i, int(ids[a]), r["id"], r["score"]) for i, (a, r) in enumerate(zip(at, best))]
    names = spark.createDataFrame(named, "window int, anchor_id long, positive_id long, positive_score long")
    return search(blocks, second, dim).join(F.broadcast(names), "window").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def fits_exactly(blocks: DataFrame, vectors: np.ndarray) -> bool:
    most = blocks.select(F.greatest(F.abs(F.array_min("low")), F.abs(F.array_max("high"))).alias("m")).agg(F.max("m").alias("m")).first()["m"]
    return vectors.shape[1] * float(np.abs(vectors).max()) * float(most or 0) < 1 << 53
