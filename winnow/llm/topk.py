"""Exact top-k by inner product with a three-phase uniform threshold.

A vector's components are cut into M lists by dimension; a row's local score in a list is the
inner product over that list's dimensions, its score the sum of its local scores.

1. Gather: every partition gives its k best entries of every list for each query; the entries
   so found are scored in full, and the k-th best full score is the cutoff of the query.
2. Broadcast cutoff / M. A row whose score reaches the cutoff has a local score of at least
   cutoff / M in some list (the largest of M numbers is at least their mean), so collecting the
   entries that reach it loses nothing. An entry is dropped at once where its local score plus
   the most its other lists can give (the product of the norms) stays below the cutoff.
3. Resolve: the rows collected are scored in full, and the k best are kept.

Queries come in blocks of ``BLOCK`` rows, which bounds what is broadcast; vectors are not
shuffled. Equal vectors are one entry of the lists, kept with the k + 1 smallest ids, which are
the only ones that any answer can name.

Defined cases: a vector that is null, empty or holds a null or non-finite component takes no
part; rows that share an id are one (the smallest vector); a row without id takes no part;
missing components of a shorter vector count as 0; ties go to the smaller id; scores are exact
while they fit 53 bits. Other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import cut

K = 10
#: Lists (groups of dimensions) a vector is cut into.
LISTS = 2
#: Queries of one pass; what is broadcast is BLOCK vectors and cutoffs.
BLOCK = 1024
#: Rows whose local scores are held at once.
ROWS = 2048


def quantised(df: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """(id, v): floor(scale * x) of each component as doubles; one row per id."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = df.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return usable.select(F.col(key).cast("long").alias("id"), whole.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def classes(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (cid, v) and their k + 1 smallest ids (cid, id); cid is the smallest id."""
    order = Window.partitionBy("v").orderBy("id")
    # the rank limit is applied before the shuffle too, so a very common vector stays small
    few = vectors.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    few = cut(few.withColumn("cid", F.min("id").over(Window.partitionBy("v"))))
    return few.where("id = cid").select("cid", "v"), few.select("cid", "id")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``dim`` columns."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def best_of(local: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k largest values in each column of (rows, queries)."""
    if len(local) <= k:
        return np.repeat(np.arange(len(local))[:, None], local.shape[1], axis=1)
    return np.argpartition(-local, k - 1, axis=0)[:k]


def search_block(entries: DataFrame, block: list, k: int, dim: int, lists: int) -> DataFrame:
    """(query_id, cid, score) of all entries that can be among the k + 1 best of a query in ``block``."""
    ids = np.array([r["id"] for r in block], dtype=np.int64)
    q = np.zeros((len(block), dim))
    for i, r in enumerate(block):
        q[i, : len(r["v"])] = r["v"]
    spans = [(dim * j // lists, dim * (j + 1) // lists) for j in range(lists)]
    take = k + 1  # the query's own entry may be among them

    def batches_of(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                yield part.column(0).to_numpy(), matrix(part.column(1), dim)

    def gather(batches):
        held: dict[int, tuple] = {}
        for cid, v in batches_of(batches):
            for j, (a, b) in enumerate(spans):
                local = v[:, a:b] @ q[:, a:b].T
                at = best_of(local, take)
                score = np.take_along_axis(local, at, axis=0)
                who = cid[at]
                if j in held:
                    who, score = np.vstack([held[j][0], who]), np.vstack([held[j][1], score])
                    at = best_of(score, take)
                    who, score = np.take_along_axis(who, at, axis=0), np.take_along_axis(score, at, axis=0)
                held[j] = (who, score)
        for j, (who, score) in held.items():
            n, m = who.shape
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(ids, n)), pa.array(np.full(n * m, j, np.int32)), pa.array(who.reshape(-1)), pa.array(score.reshape(-1))],
                names=["query_id", "list", "cid", "local"],
            )

    local_best = entries.mapInArrow(gather, "query_id long, list int, cid long, local double")
    order = Window.partitionBy("query_id", "list").orderBy(F.desc("local"), "cid")
    firsts = local_best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= take).select("query_id", "cid").distinct()
    row_of = {int(x): i for i, x in enumerate(ids)}

    def full(batches):
        for batch in batches:
            rows = np.array([row_of[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            v = matrix(batch.column(2), dim)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.einsum("ij,ij->i", v, q[rows]).astype(np.int64))],
                names=["query_id", "cid", "score"],
            )

    def resolve(asked):
        joined = asked.join(entries, "cid").select("query_id", "cid", "v")
        return joined.mapInArrow(full, "query_id long, cid long, score long")

    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "cid")
    kth = resolve(firsts).withColumn("n", F.row_number().over(by_score)).where(F.col("n") == take).select("query_id", "score")
    cutoff = np.full(len(ids), -np.inf)  # fewer than k + 1 entries in all: everything is collected
    for r in kth.collect():  # one number for each query of the block
        cutoff[row_of[r["query_id"]]] = r["score"]
    norms = [np.sqrt((q[:, a:b] ** 2).sum(axis=1)) for a, b in spans]

    def collect(batches):
        for cid, v in batches_of(batches):
            found = np.zeros((len(cid), len(ids)), dtype=bool)
            own = [np.sqrt((v[:, a:b] ** 2).sum(axis=1)) for a, b in spans]
            for j, (a, b) in enumerate(spans):
                local = v[:, a:b] @ q[:, a:b].T
                rest = sum(np.outer(own[i], norms[i]) for i in range(lists) if i != j)
                found |= (local >= cutoff / lists) & (local + rest * (1 + 1e-9) + 1e-6 >= cutoff)
            row, col = np.nonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids[col]), pa.array(cid[row])], names=["query_id", "cid"])

    sufficient = entries.mapInArrow(collect, "query_id long, cid long")
    scored = resolve(sufficient)
    return scored.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= take).select("query_id", "cid", "score")


def top_k(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of ``df`` for each row of ``queries``
    (rows of the same form), by integer inner product of floor(1024 * x)."""
    spark = df.sparkSession
    vectors = quantised(df, key, vector)
    entries, members = classes(vectors, k)
    entries, asked = cut(entries), cut(quantised(queries, key, vector))
    width = entries.agg(F.max(F.size("v")).alias("n")).first()["n"]
    wider = asked.agg(F.max(F.size("v")).alias("n")).first()["n"]
    dim = max(width or 1, wider or 1)
    found, last = None, None
    while True:
        ahead = asked if last is None else asked.where(F.col("id") > last)
        block = ahead.orderBy("id").limit(BLOCK).collect()
        if not block:
            break
        last = block[-1]["id"]
        part = cut(search_block(entries, block, k, dim, min(lists, dim)))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    named = found.join(members, "cid").where("id <> query_id").withColumn("rank", F.row_number().over(order))
    return named.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), F.col("id").alias("vec_id"), "score")
