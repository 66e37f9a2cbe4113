"""Row numbers and running aggregates whose groups are split into bounded buckets.

A plain window sorts each whole group in one task. Here the ordering key is cut into
buckets, bucket totals give offsets through a small table, and the window only sorts
inside (group, bucket); the result is the same number a plain window would give.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.session import cut_lineage, shuffle_width


def hash_key(key: str, seed: int | None = None) -> Column:
    text = F.col(key).cast("string")
    return F.md5(text if seed is None else F.concat(text, F.lit(f"#{seed}")))


def hash_ordinal(
    df: DataFrame, key: str, group: list[str], out: str, seed: int | None = None, digits: int | None = None
) -> DataFrame:
    """1-based position of each row in its group, in md5(key) order.

    md5 digits are uniform, so the 16**digits buckets of a group are even whatever the groups
    are. By default there are at least 64 buckets per shuffle partition.
    """
    if digits is None:
        digits = math.ceil(math.log(64 * max(4, shuffle_width(df.sparkSession)), 16))
    h = df.withColumn("_h", hash_key(key, seed)).withColumn("_b", F.substring("_h", 1, digits))
    return bucket_ordinal(h, group, "_b", ["_h", key], out).drop("_h", "_b")


def join_null_safe(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with null equal to null; the keys of ``other`` are dropped."""
    named = other.select(*[F.col(c).alias(f"_ns_{c}") if c in keys else F.col(c) for c in other.columns])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_ns_{c}")) for c in keys])
    return df.join(named, same, how).drop(*[f"_ns_{c}" for c in keys])


def bucket_ordinal(
    df: DataFrame, group: list[str], bucket: str, order: list, out: str
) -> DataFrame:
    """Row number within ``group`` where ``bucket`` is monotone in ``order``."""
    keys = [*group, bucket]
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    joined = join_null_safe(df, offsets, keys)
    return joined.withColumn(out, F.row_number().over(inside) + F.col("_off")).drop("_off").select(
        *df.columns, out
    )


def running_max_before(
    df: DataFrame, group: list[str], order: str, value: Column, out: str, width: int = 50_000
) -> DataFrame:
    """Largest ``value`` over earlier rows of the group (NULL on the first row).

    ``order`` must be an integer unique in the group; ``width`` is the bucket span.
    """
    tagged = df.withColumn("_rm_v", value).withColumn("_rm_b", F.floor(F.col(order) / F.lit(width)))
    keys = [*group, "_rm_b"]
    before = Window.partitionBy(*group).orderBy("_rm_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        tagged.groupBy(*keys)
        .agg(F.max("_rm_v").alias("_rm_m"))
        .withColumn("_rm_c", F.max("_rm_m").over(before))
        .drop("_rm_m")
    )
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    here = F.max("_rm_v").over(inside)
    carry = F.col("_rm_c")
    # either side may be an empty prefix
    latest = F.when(carry.isNull() | (here > carry), F.coalesce(here, carry)).otherwise(carry)
    return join_null_safe(tagged, carried, keys).withColumn(out, latest).select(*df.columns, out)


def ordered_ordinal(df: DataFrame, order: list, out: str) -> DataFrame:
    """0-based position of each row in a global sort, without a one-task window.

    The sorted rows are written once so that both uses see the same partition bounds.
    """
    tagged = cut_lineage(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_m"), 33)
    sizes = tagged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        tagged.withColumn("_p", part)
        .join(F.broadcast(offsets), "_p")
        .withColumn(out, F.col("_off") + local)
        .drop("_m", "_p", "_off")
    )
