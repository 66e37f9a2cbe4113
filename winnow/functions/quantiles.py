"""Exact linear-interpolation quantiles, with a plan that stays bounded on large tables.

The built-in ``percentile`` keeps every distinct value of a column in one aggregation
buffer. That is right for small tables and fatal for large ones, so above a row limit the
columns are cut into value buckets by a sketch, buckets are counted exactly, and only the
buckets that hold a wanted rank are sorted. Both routes return the same numbers.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.constants import constant_doubles
from winnow.roles import col
from winnow.session import cut_lineage

SMALL_ROWS = 2_000_000
BUCKET_ROWS = 1_000_000
MAX_BUCKETS = 10_000
# the built-in aggregate walks all values once per probability
FEW_PROBS = 64


def exact_quantiles(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    n_rows: int | None = None,
    small_rows: int = SMALL_ROWS,
    bucket_rows: int = BUCKET_ROWS,
) -> dict[str, list[float | None]]:
    """{column: [quantile per prob]}, NULLs ignored; all-NULL columns give None."""
    if not cols:
        return {}
    if n_rows is None:
        n_rows = df.count()
    if n_rows <= small_rows and len(probs) <= FEW_PROBS:
        p = constant_doubles(probs)
        r = df.agg(*[F.percentile(col(c), p).alias(f"q{i}") for i, c in enumerate(cols)]).first()
        return {
            c: list(r[f"q{i}"]) if r[f"q{i}"] is not None else [None] * len(probs)
            for i, c in enumerate(cols)
        }
    return _bucketed(df, cols, probs, n_rows, bucket_rows)


def value_splits(df: DataFrame, cols: list[str], buckets: int) -> dict[str, tuple[int, list[float]]]:
    """{column: (non-null count, ascending distinct inner cut points)} from one sketch pass."""
    grid = constant_doubles([i / buckets for i in range(1, buckets)] or [0.5])
    accuracy = max(10_000, 10 * buckets)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [
            F.count(col(c)).alias(f"n{i}"),
            F.percentile_approx(col(c), grid, accuracy).alias(f"s{i}"),
        ]
    r = df.agg(*aggs).first()
    return {c: (r[f"n{i}"], sorted(set(r[f"s{i}"] or []))) for i, c in enumerate(cols)}


def with_buckets(df: DataFrame, splits: dict[str, list[float]], suffix: str = "__b") -> DataFrame:
    """Add one integer bucket column per entry; values equal to a cut go to its right."""
    names = list(splits)
    edges = [[-math.inf, *splits[c], math.inf] for c in names]
    step = Bucketizer(
        splitsArray=edges,
        inputCols=names,
        outputCols=[c + suffix for c in names],
        handleInvalid="keep",
    )
    return step.transform(df)


def _bucketed(df, cols, probs, n_rows, bucket_rows):
    cores = df.sparkSession.sparkContext.defaultParallelism
    buckets = int(min(MAX_BUCKETS, max(2, cores, math.ceil(n_rows / bucket_rows))))
    cut = value_splits(df.select(*[col(c) for c in cols]), cols, buckets)
    live = [c for c in cols if cut[c][0] > 0]
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    if not live:
        return out
    alias = {c: f"x{i}" for i, c in enumerate(live)}
    narrow = df.select(*[col(c).alias(alias[c]) for c in live])
    tagged = with_buckets(narrow, {alias[c]: cut[c][1] for c in live})
    long = tagged.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("f"),
                        F.col(alias[c] + "__b").cast("int").alias("b"),
                        F.col(alias[c]).alias("v"),
                    )
                    for i, c in enumerate(live)
                ]
            )
        ).alias("e")
    ).select("e.*").where("v is not null")
    counts: dict[int, dict[int, int]] = {}
    for r in long.groupBy("f", "b").count().collect():
        counts.setdefault(r["f"], {})[r["b"]] = r["count"]

    wanted, spec = [], {}
    for i, c in enumerate(live):
        n = sum(counts[i].values())
        order = sorted(counts[i])
        first = [0, *accumulate(counts[i][b] for b in order)]
        for p in probs:
            pos = p * (n - 1)
            lo, hi = math.floor(pos), math.ceil(pos)
            spec[(i, p)] = (lo, hi, pos - lo)
            for k in {lo, hi}:
                at = bisect_right(first, k) - 1
                wanted.append((i, order[at], k - first[at], k))
    spark = df.sparkSession
    ranks = F.broadcast(spark.createDataFrame(sorted(set(wanted)), "f int, b int, k long, g long"))
    hit = long.join(ranks.select("f", "b").distinct(), ["f", "b"], "left_semi")
    per_value = hit.groupBy("f", "b", "v").count()
    w = Window.partitionBy("f", "b").orderBy("v")
    starts_at = per_value.select(
        "f", "b", (F.sum("count").over(w) - F.col("count")).alias("k"), "v", F.lit(None).cast("long").alias("g")
    )
    # a rank belongs to the last value that starts at or before it
    both = starts_at.unionByName(ranks.select("f", "b", "k", F.lit(None).cast("double").alias("v"), "g"))
    upto = Window.partitionBy("f", "b").orderBy("k", F.col("g").asc_nulls_first())
    carried = both.withColumn("v", F.last("v", ignorenulls=True).over(upto)).where("g is not null")
    found = carried.select("f", "g", "v").collect()
    at = {(r["f"], r["g"]): r["v"] for r in found}
    for i, c in enumerate(live):
        vals = []
        for p in probs:
            lo, hi, frac = spec[(i, p)]
            a, b = at[(i, lo)], at[(i, hi)]
            vals.append(a if a == b else (1 - frac) * a + frac * b)
        out[c] = vals
    return out


def grouped_quantiles(
    long: DataFrame, keys: list[str], probs: list[float], small_rows: int = SMALL_ROWS, buckets: int = 256
) -> DataFrame:
    """(keys..., q array): exact quantiles of ``value`` per group of a long table.

    Groups up to ``small_rows`` use the built-in aggregate. A larger group is cut into value
    buckets by its own sketch; bucket totals place every wanted rank, and only the buckets
    that hold one are sorted, each on its own.
    """
    known = long.where("value is not null").select(*keys, "value")
    largest = known.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= small_rows:
        return known.groupBy(*keys).agg(F.percentile("value", constant_doubles(probs)).alias("q"))
    grid = constant_doubles([i / buckets for i in range(1, buckets)])
    # a sketch may differ between runs, so it is taken once
    cuts = cut_lineage(
        known.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("value", grid, 10 * buckets)).alias("_c"))
    )
    tagged = known.join(cuts, keys).select(
        *keys, "value", F.size(F.filter("_c", lambda c: c <= F.col("value"))).alias("_b")
    )
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        tagged.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    )
    spots = F.transform(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]),
        lambda s: F.struct(s["i"].alias("i"), (s["p"] * (F.col("_all") - 1)).alias("at")),
    )
    ranks = totals.withColumn("_s", F.explode(spots)).withColumn(
        "_k", F.explode(F.array_distinct(F.array(F.floor("_s.at"), F.ceil("_s.at"))))
    )
    wanted = ranks.where("_k >= _first and _k < _first + _n").select(
        *keys, "_b", (F.col("_k") - F.col("_first")).alias("_pos"), F.col("_s.i").alias("_i"),
        (F.lit(1.0) - F.abs(F.col("_s.at") - F.col("_k"))).alias("_w"),
    )
    hit = tagged.join(wanted.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi")
    w = Window.partitionBy(*keys, "_b").orderBy("value")
    starts = hit.groupBy(*keys, "_b", "value").count().select(
        *keys, "_b", (F.sum("count").over(w) - F.col("count")).alias("_pos"), "value"
    )
    both = starts.unionByName(wanted, allowMissingColumns=True)
    upto = Window.partitionBy(*keys, "_b").orderBy("_pos", F.col("_i").asc_nulls_first())
    found = both.withColumn("value", F.last("value", ignorenulls=True).over(upto)).where("_i is not null")
    # equal neighbours are taken as they are, so that no rounding enters
    one = found.groupBy(*keys, "_i").agg(
        F.when(F.min("value") == F.max("value"), F.min("value"))
        .otherwise(F.sum(F.col("value") * F.col("_w"))).alias("_q")
    )
    return one.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias("q")
    )
