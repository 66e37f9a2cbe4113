"""Deterministic samples, hold-outs and folds in md5 order of the row key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.ranks import hash_key, hash_ordinal
from winnow.roles import ROLES, Roles, col


def sample_fixed(df: DataFrame, n: int, seed: int = 0, roles: Roles = ROLES) -> DataFrame:
    """Exactly n rows: the n smallest keyed hashes, taken per task before they are merged."""
    h = hash_key(roles.row_id, seed)
    return df.withColumn("_h", h).orderBy("_h", roles.row_id).limit(n).drop("_h")


def stratified_split(df: DataFrame, every: int = 5, seed: int | None = None, roles: Roles = ROLES) -> DataFrame:
    """Adds ``is_test``: each ``every``-th row of every class. A single class gives a plain
    split of the same shape. Rows without a label are left out."""
    ranked = hash_ordinal(
        df.where(col(roles.label).isNotNull()), roles.row_id, [roles.label], "_rn", seed
    )
    return ranked.withColumn("is_test", (F.col("_rn") - 1) % every == 0).drop("_rn")


def holdout_split(df: DataFrame, every: int = 4, seed: int | None = None, roles: Roles = ROLES) -> DataFrame:
    """Adds ``is_test`` for each ``every``-th row of the whole table."""
    one = df.withColumn("_all", F.lit(1))
    ranked = hash_ordinal(one, roles.row_id, ["_all"], "_rn", seed)
    return ranked.withColumn("is_test", (F.col("_rn") - 1) % every == 0).drop("_rn", "_all")


def stratified_folds(df: DataFrame, k: int = 4, seed: int | None = None, roles: Roles = ROLES) -> DataFrame:
    """Adds ``fold`` in 0..k-1, level within each class."""
    ranked = hash_ordinal(
        df.where(col(roles.label).isNotNull()), roles.row_id, [roles.label], "_rn", seed
    )
    return ranked.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_rn")


def divide(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("not is_test").drop("is_test"), df.where("is_test").drop("is_test")
