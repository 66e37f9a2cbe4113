"""Nearest-neighbour mutual information between each numeric column and the label.

For one column the neighbours of a value are its neighbours in sorted order, so the k-th
distance inside a class comes from lag/lead and the neighbour count from a running count.
Sorting is cut into value buckets: a bucket sees the k nearest same-class values on either
side as extra rows, and running counts start from the totals of earlier buckets, so no
window covers a whole class or column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.quantiles import value_splits, with_buckets
from winnow.roles import ROLES, Roles, col
from winnow.session import cut_lineage, small_table

BUCKET_ROWS = 1_000_000
EULER = 0.57721566490153286061


def digamma(n: Column) -> Column:
    """psi(n) for a positive integer: harmonic numbers below 10, the series above."""
    small = F.array(*[F.lit(sum(1.0 / j for j in range(1, i)) - EULER) for i in range(1, 11)])
    x = n.cast("double")
    x2 = x * x
    series = F.log(x) - 0.5 / x - 1 / (12 * x2) + 1 / (120 * x2 * x2) - 1 / (252 * x2 * x2 * x2)
    return F.when(n <= 10, F.element_at(small, F.least(n, F.lit(10)).cast("int"))).otherwise(series)


def noise(roles: Roles, i: int, seed: int) -> Column:
    """Standard normal draw keyed by the row, so reruns and retries agree."""
    span = F.lit(1 << 52)
    u = lambda s: (F.pmod(F.xxhash64(col(roles.row_id), F.lit(i), F.lit(s)), span) + 0.5) / span
    return F.sqrt(F.lit(-2.0) * F.log(u(seed))) * F.cos(F.lit(2 * math.pi) * u(seed + 7919))


def mutual_information(
    df: DataFrame, roles: Roles = ROLES, k: int = 3, seed: int = 0, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(feature, mutual_info) in nats, never below 0. NULL counts as 0; columns are scaled to
    unit spread and get a tiny keyed noise that breaks ties."""
    cols = roles.numeric(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "feature string, mutual_info double")
    base = df.where(col(roles.label).isNotNull())
    classes = {r[0]: r[1] for r in base.groupBy(col(roles.label)).count().collect()}
    sizes = {c: n for c, n in classes.items() if n > 1}
    total = sum(sizes.values())
    if total == 0:
        return spark.createDataFrame([(c, 0.0) for c in cols], "feature string, mutual_info double")
    filled = {c: F.coalesce(col(c), F.lit(0.0)) for c in cols}
    s = base.agg(
        *[F.struct(F.stddev_pop(v), F.avg(F.abs(v))).alias(f"a{i}") for i, v in enumerate(filled.values())]
    ).first()
    values = []
    for i, c in enumerate(cols):
        std = s[f"a{i}"][0] or 1.0
        jitter = 1e-10 * max(1.0, s[f"a{i}"][1] / std)
        values.append((filled[c] / F.lit(std) + noise(roles, i, seed) * F.lit(jitter)).alias(f"x{i}"))
    names = [f"x{i}" for i in range(len(cols))]
    wide = cut_lineage(
        base.where(col(roles.label).isin(*sizes)).select(
            col(roles.row_id).alias("id"), col(roles.label).alias("l"), *values
        )
    )
    buckets = max(1, min(10_000, math.ceil(total / bucket_rows)))
    found = value_splits(wide, names, buckets) if buckets > 1 else {}
    cuts = {n: found[n][1] if n in found else [] for n in names}
    points = _long(wide, names, cuts, ["id", "l"])
    reach = _class_radius(points, sizes, k)
    counted = _count_within(points, reach, names, cuts)
    per = small_table(spark, [(c, n, min(k, n - 1)) for c, n in sizes.items()], "l string, nl long, kl int")
    scored = counted.join(per, "l").groupBy("f").agg(
        (
            F.avg(digamma(F.col("kl"))) - F.avg(digamma(F.col("nl"))) - F.avg(digamma(F.col("m")))
        ).alias("part")
    )
    label = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("f") + 1)
    psi_n = digamma(F.lit(total))
    return scored.select(label.alias("feature"), F.greatest(F.col("part") + psi_n, F.lit(0.0)).alias("mutual_info"))


def _long(wide: DataFrame, names, cuts, keep) -> DataFrame:
    tagged = with_buckets(wide, {n: cuts[n] for n in names}) if any(cuts.values()) else wide
    bucket = lambda n: (F.col(n + "__b").cast("int") if any(cuts.values()) else F.lit(0))
    cells = [
        F.struct(F.lit(i).alias("f"), bucket(n).alias("b"), F.col(n).alias("x")) for i, n in enumerate(names)
    ]
    return tagged.select(*keep, F.explode(F.array(*cells)).alias("e")).select(*keep, "e.*")


def _class_radius(points: DataFrame, sizes: dict, k: int) -> DataFrame:
    """Points with the k-th nearest value ``v`` of their own class and its distance ``r``."""
    group = ["f", "l", "b"]
    up = Window.partitionBy(*group).orderBy("x", "id")
    down = Window.partitionBy(*group).orderBy(F.desc("x"), F.desc("id"))
    low = points.withColumn("_r", F.row_number().over(up)).where(F.col("_r") <= k).drop("_r")
    high = points.withColumn("_r", F.row_number().over(down)).where(F.col("_r") <= k).drop("_r")
    # buckets of one (column, class) numbered without gaps; k per side always suffice
    # because every numbered bucket holds at least one value
    seats = (
        points.select(*group).distinct()
        .withColumn("_j", F.dense_rank().over(Window.partitionBy("f", "l").orderBy("b")))
    )
    shift = F.explode(F.sequence(F.lit(1), F.lit(k)))

    def halo(rows, sign):
        sent = rows.join(seats, group).withColumn("_s", shift)
        sent = sent.select("f", "l", "x", "id", (F.col("_j") + sign * F.col("_s")).alias("_j"))
        return sent.join(seats, ["f", "l", "_j"]).select("f", "l", "b", "x", "id", F.lit(True).alias("extra"))

    own = points.select("f", "l", "b", "x", "id", F.lit(False).alias("extra"))
    near = own.unionAll(halo(high, 1)).unionAll(halo(low, -1))
    w = Window.partitionBy(*group).orderBy("x", "id")
    step = lambda other: F.when(
        other.isNotNull(), F.struct(F.abs(other - F.col("x")).alias("r"), other.alias("v"))
    )
    gaps = F.array_compact(
        F.array(
            *[step(F.lag("x", i).over(w)) for i in range(1, k + 1)],
            *[step(F.lead("x", i).over(w)) for i in range(1, k + 1)],
        )
    )
    kth = F.element_at(F.array_sort("_g"), F.least(F.lit(k), F.size("_g")))
    return near.withColumn("_g", gaps).where("not extra").withColumn("_k", kth).select(
        "f", "l", "b", "x", "id", F.col("_k.r").alias("r"), F.col("_k.v").alias("v")
    )


def _count_within(points: DataFrame, reach: DataFrame, names, cuts) -> DataFrame:
    """(f, l, id, m): values of the column, any class, strictly closer than the k-th of the
    own class. That neighbour's value is itself one end of the interval, so rounding cannot
    let it in."""
    right = F.when(F.col("v") > F.col("x"), F.col("v")).otherwise(F.col("x") + F.col("r"))
    left = F.when(F.col("v") > F.col("x"), F.col("x") - F.col("r")).otherwise(F.col("v"))
    # at equal values: right end, then points, then left end
    ends = reach.select(
        "f", "l", "id",
        F.explode(
            F.array(
                F.struct(right.alias("x"), F.lit(0).alias("t")), F.struct(left.alias("x"), F.lit(2).alias("t"))
            )
        ).alias("e"),
    ).select("f", "l", "id", "e.x", "e.t")
    if any(cuts.values()):
        tagged = ends
        for i, n in enumerate(names):
            tagged = with_buckets(tagged.withColumn(n, F.when(F.col("f") == i, F.col("x"))), {n: cuts[n]})
        b = F.coalesce(*[F.when(F.col("f") == i, F.col(n + "__b")) for i, n in enumerate(names)]).cast("int")
        ends = tagged.select("f", b.alias("b"), "x", "t", "l", "id")
    else:
        ends = ends.select("f", F.lit(0).alias("b"), "x", "t", "l", "id")
    events = points.select("f", "b", "x", F.lit(1).alias("t"), "l", "id").unionAll(ends)
    one = F.when(F.col("t") == 1, 1).otherwise(0)
    totals = points.groupBy("f", "b").agg(F.count(F.lit(1)).alias("_n"))
    seats = events.select("f", "b").distinct().join(totals, ["f", "b"], "left")
    before = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = seats.select("f", "b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    run = Window.partitionBy("f", "b").orderBy("x", "t").rowsBetween(Window.unboundedPreceding, 0)
    counted = events.join(offsets, ["f", "b"]).withColumn("c", F.sum(one).over(run) + F.col("_off"))
    inside = F.max(F.when(F.col("t") == 0, F.col("c"))) - F.max(F.when(F.col("t") == 2, F.col("c")))
    return counted.where("t <> 1").groupBy("f", "l", "id").agg(F.greatest(inside, F.lit(1)).alias("m"))
