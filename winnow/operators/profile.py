"""Table measures (one row per table) and column profiles (one row per column)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions import moments as M
from winnow.functions.quantiles import exact_quantiles, grouped_quantiles
from winnow.functions.ranks import join_null_safe
from winnow.roles import ROLES, Roles, col
from winnow.session import cut_lineage, shuffle_width

PAIRWISE_LIMIT = 40
BINS = 10
BROADCAST_CELLS = 1_000_000


# ---------------------------------------------------------------- table measures


def shape(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    num, cat = roles.numeric(df), roles.categorical(df)
    return df.agg(
        F.count(F.lit(1)).alias("n_instances"),
        F.lit(len(num) + len(cat)).cast("long").alias("n_features"),
        F.lit(len(num)).cast("long").alias("n_num_features"),
        F.lit(len(cat)).cast("long").alias("n_cat_features"),
    )


def missing_share(df: DataFrame, roles: Roles = ROLES) -> Column:
    feats = roles.features(df)
    nulls = [F.count(F.lit(1)) - F.count(col(c)) for c in feats]
    cells = F.count(F.lit(1)).cast("double") * F.lit(float(len(feats)))
    return sum(nulls[1:], nulls[0]).cast("double") / F.nullif(cells, F.lit(0.0))


def _table_aggs(df: DataFrame, roles: Roles, with_correlation: bool) -> list[Column]:
    num = [col(c) for c in roles.numeric(df)]
    cat = roles.categorical(df)
    aggs = [
        F.count(F.lit(1)).alias("n_instances"),
        F.lit(len(num) + len(cat)).cast("long").alias("n_features"),
        F.lit(len(num)).cast("long").alias("n_num_features"),
        F.lit(len(cat)).cast("long").alias("n_cat_features"),
        missing_share(df, roles).alias("missing_ratio"),
        M.mean_defined([M.corrected_skew(c) for c in num]).alias("feature_mean_skew"),
        M.mean_defined([M.corrected_kurtosis(c) for c in num]).alias("feature_mean_kurtosis"),
        M.mean_defined([M.sample_variance(c) for c in num]).alias("mean_feature_variance"),
    ]
    if with_correlation:
        aggs.append(mean_abs_correlation(roles.numeric(df)).alias("mean_feature_correlation"))
    return aggs


def mean_abs_correlation(cols: list[str]) -> Column:
    return M.mean_defined([M.abs_correlation(col(a), col(b)) for a, b in M.pairs(cols)])


def mean_abs_correlation_wide(df: DataFrame, cols: list[str], block: int = 400) -> float | None:
    """The same measure for very many columns."""
    return grouped_correlation(df.withColumn("_t", F.lit(0)), ["_t"], cols, block).first()["mean_feature_correlation"]


def _pair_sums(x: np.ndarray, left: slice, right: slice) -> list[np.ndarray]:
    """Matrices over (left, right) column pairs, of the rows where both are present: count, sums,
    squares and products, and the range of either side. ``x`` holds NaN for a missing value."""
    here = ~np.isnan(x)
    z = np.where(here, x, 0.0)
    a, b, pa, pb = z[:, left], z[:, right], here[:, left].astype(float), here[:, right].astype(float)

    def limits(values: slice, partner: slice) -> tuple[np.ndarray, np.ndarray]:
        # columns that miss the same rows share one range
        masks, which = np.unique(here[:, partner], axis=1, return_inverse=True)
        held = [np.where(m[:, None] & here[:, values], x[:, values], np.nan) for m in masks.T]
        low = np.stack([np.fmin.reduce(h, axis=0) for h in held])
        high = np.stack([np.fmax.reduce(h, axis=0) for h in held])
        return low[which.ravel()].T, high[which.ravel()].T

    (lo, hi), (lo2, hi2) = limits(left, right), limits(right, left)
    return [pa.T @ pb, a.T @ pb, pa.T @ b, (a * a).T @ pb, pa.T @ (b * b), a.T @ b, lo, hi, lo2.T, hi2.T]


def grouped_correlation(df: DataFrame, by: list[str], cols: list[str], block: int = 400) -> DataFrame:
    """(by..., mean_feature_correlation): ``mean_abs_correlation`` of every table of a grouping, for
    any number of columns.

    Values are moved by the means of their table, so that large offsets do not cancel. Each batch
    of rows adds up the products of two column blocks at a time; the rows that leave a task are one
    for each table of a batch and column pair, summed on the map side before the shuffle. Rows are
    sorted by table inside a partition, which moves nothing and keeps the tables of a batch few.
    A pair counts where both columns vary over the rows that have both, judged on the range.
    """
    key = F.to_json(F.struct(*[col(c) for c in by]), {"ignoreNullFields": "false"})
    tables = cut_lineage(df.groupBy(*by).agg(F.array(*[F.avg(col(c)) for c in cols]).alias("_m")).withColumn("_k", key))
    values = F.array(*[col(c).cast("double") for c in cols])
    moved = _with_limits(df.select(*by, values.alias("_x")), tables, by, len(cols)).select(
        "_k", F.zip_with("_x", "_m", lambda v, m: v - m).alias("_x")
    )
    names = ["n", "sx", "sy", "sxx", "syy", "sxy", "lx", "hx", "ly", "hy"]
    d = len(cols)
    blocks = [slice(i, min(i + block, d)) for i in range(0, d, block)]

    def sums(batches):
        for batch in batches:
            for table, rows in batch.groupby("_k", sort=False):
                x = np.array(rows["_x"].tolist(), dtype=float)
                for at, left in enumerate(blocks):
                    for right in blocks[at:]:
                        i, j = np.meshgrid(np.arange(left.start, left.stop), np.arange(right.start, right.stop), indexing="ij")
                        pick = (i < j).ravel()
                        parts = {c: m.ravel()[pick] for c, m in zip(names, _pair_sums(x, left, right))}
                        yield pd.DataFrame({"_k": table, "i": i.ravel()[pick], "j": j.ravel()[pick], **parts})

    schema = "_k string, i int, j int, " + ", ".join(f"{c} double" for c in names)
    partial = moved.sortWithinPartitions("_k").mapInPandas(sums, schema)
    least = [F.min(F.nanvl(c, F.lit(None))).alias(c) for c in ("lx", "ly")]
    most = [F.max(F.nanvl(c, F.lit(None))).alias(c) for c in ("hx", "hy")]
    pair = partial.groupBy("_k", "i", "j").agg(*[F.sum(c).alias(c) for c in names[:6]], *least, *most)
    cov = F.expr("sxy - sx * sy / nullif(n, 0)")
    spread = F.expr("sqrt((sxx - sx * sx / nullif(n, 0)) * (syy - sy * sy / nullif(n, 0)))")
    r = F.when(F.expr("hx > lx AND hy > ly"), F.abs(cov) / F.nullif(spread, F.lit(0.0)))
    mean = pair.select("_k", r.alias("r")).groupBy("_k").agg(F.avg("r").alias("mean_feature_correlation"))
    return tables.select(*by, "_k").join(mean, "_k", "left").drop("_k")


def class_counts(df: DataFrame, by: list[str], roles: Roles = ROLES) -> DataFrame:
    return df.where(col(roles.label).isNotNull()).groupBy(*by, col(roles.label).alias("_l")).count()


def target_measures(df: DataFrame, by: list[str] | None = None, roles: Roles = ROLES) -> DataFrame:
    """Number of classes and -sum p*log2(p + 1e-9). The class table is small, so the share
    needs only its total per group."""
    if not by:
        return target_measures(df.withColumn("_t", F.lit(0)), ["_t"], roles).drop("_t")
    cc = class_counts(df, by, roles)
    total = cc.groupBy(*by).agg(F.sum("count").alias("_n"))
    p = F.col("count") / F.col("_n")
    return (
        cc.join(total, by)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("target_num_classes"),
            (-F.sum(p * F.log2(p + F.lit(1e-9)))).alias("target_entropy"),
        )
    )


def table_measures(
    df: DataFrame, by: list[str] | None = None, roles: Roles = ROLES, mutual_info: bool = True
) -> DataFrame:
    """All measures, for the table or for every table of a ``by`` grouping.

    The moments are one pass with map-side partial sums; a group of any size costs one buffer
    per task. ``mutual_info`` adds the mean and maximum of the binned mutual information.
    """
    if not by:
        return table_measures(df.withColumn("_t", F.lit(0)), ["_t"], roles, mutual_info).drop("_t")
    feats = df.drop(*by)
    num = roles.numeric(feats)
    wide = len(num) > PAIRWISE_LIMIT
    base = df.groupBy(*by).agg(*_table_aggs(feats, roles, with_correlation=not wide))
    if wide:
        base = join_null_safe(base, grouped_correlation(df, by, num), by, "left")
    out = join_null_safe(base, target_measures(df, by, roles), by, "left")
    if not mutual_info:
        return out
    names = ["mean_mutual_info", "max_mutual_info"]
    if num:
        each = grouped_mutual_information(df, by, roles).groupBy(*by).agg(
            F.avg("mutual_info").alias(names[0]), F.max("mutual_info").alias(names[1])
        )
        out = join_null_safe(out, each, by, "left")
    # 0 for a table without numeric columns or labels
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) if num else F.lit(0.0) for c in names})


def need_flags(df: DataFrame, roles: Roles = ROLES, outlier_rule: bool = False) -> DataFrame:
    """Which steps the table needs. The outlier rule is off unless asked for."""
    num = [col(c) for c in roles.numeric(df)]
    if outlier_rule:
        skew = M.mean_defined([M.corrected_skew(c) for c in num])
        kurt = M.mean_defined([M.corrected_kurtosis(c) for c in num])
        need_o = F.coalesce((F.abs(skew) > 2) | (kurt > 2), F.lit(False))
    else:
        need_o = F.lit(False)
    return df.agg(
        (missing_share(df, roles) > 0).alias("need_i"),
        need_o.alias("need_o"),
        F.lit(len(roles.categorical(df)) > 0).alias("need_e"),
    )


def stacked(df: DataFrame, cols: list[str], keep: list[str], as_type: str) -> DataFrame:
    """Long form (keep..., feature, value) by one projection, no join."""
    items = [F.struct(F.lit(c).alias("feature"), col(c).cast(as_type).alias("value")) for c in cols]
    if not items:
        raise ValueError("no columns to stack")
    return df.select(*keep, F.explode(F.array(*items)).alias("_e")).select(*keep, "_e.feature", "_e.value")


def binned_mutual_information(df: DataFrame, roles: Roles = ROLES, bins: int = BINS) -> DataFrame:
    """Mutual information (nats) of each numeric column, cut into equal-width bins, with the
    label. NULL counts as 0. Works on counts only: (feature, bin, label) is small."""
    num = roles.numeric(df)
    filled = [F.coalesce(col(c), F.lit(0.0)) for c in num]
    r = df.agg(*[F.struct(F.min(v), F.max(v)).alias(f"r{i}") for i, v in enumerate(filled)]).first()
    cells = []
    for i, (c, v) in enumerate(zip(num, filled)):
        lo, hi = r[f"r{i}"][0], r[f"r{i}"][1]
        if lo is None or hi <= lo:
            b = F.lit(0)
        else:
            b = F.least(F.floor((v - lo) / (hi - lo) * bins).cast("int"), F.lit(bins - 1))
        cells.append(F.struct(F.lit(c).alias("feature"), b.cast("int").alias("bin")))
    long = (
        df.where(col(roles.label).isNotNull())
        .select(col(roles.label).alias("label"), F.explode(F.array(*cells)).alias("e"))
        .select("label", "e.feature", "e.bin")
    )
    joint = long.groupBy("feature", "bin", "label").agg(F.count(F.lit(1)).alias("nxy"))
    px = Window.partitionBy("feature", "bin")
    py = Window.partitionBy("feature", "label")
    pa = Window.partitionBy("feature")
    shares = joint.select(
        "feature",
        F.col("nxy").cast("double").alias("nxy"),
        F.sum("nxy").over(px).cast("double").alias("nx"),
        F.sum("nxy").over(py).cast("double").alias("ny"),
        F.sum("nxy").over(pa).cast("double").alias("n"),
    )
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return shares.groupBy("feature").agg(F.sum(term).alias("mutual_info"))


def _with_limits(df: DataFrame, limits: DataFrame, by: list[str], n_cols: int) -> DataFrame:
    """Every row with the limits of its table. Up to ``BROADCAST_CELLS`` limits are broadcast;
    beyond that the rows of a table are dealt over salts, so that a large one is many tasks."""
    if limits.count() * n_cols <= BROADCAST_CELLS:
        return join_null_safe(df, F.broadcast(limits), by)
    salts = shuffle_width(df.sparkSession)
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(salts)).cast("int"))
    copies = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return join_null_safe(dealt, copies, [*by, "_salt"]).drop("_salt")


def grouped_mutual_information(df: DataFrame, by: list[str], roles: Roles = ROLES, bins: int = BINS) -> DataFrame:
    """(by..., feature, mutual_info): ``binned_mutual_information`` of every table of a grouping."""
    num = roles.numeric(df.drop(*by))
    filled = [F.coalesce(col(c), F.lit(0.0)).cast("double") for c in num]
    limits = df.groupBy(*by).agg(
        F.array(*[F.min(v) for v in filled]).alias("_lo"), F.array(*[F.max(v) for v in filled]).alias("_hi")
    )
    cells = []
    for i, (c, v) in enumerate(zip(num, filled)):
        lo, hi = F.col("_lo")[i], F.col("_hi")[i]
        b = F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * bins).cast("int"), F.lit(bins - 1))).otherwise(0)
        cells.append(F.struct(F.lit(c).alias("feature"), b.alias("bin")))
    labelled = df.where(col(roles.label).isNotNull())
    long = _with_limits(labelled, cut_lineage(limits), by, len(num)).select(
        *by, col(roles.label).alias("_l"), F.explode(F.array(*cells)).alias("_e")
    ).select(*by, "_l", "_e.feature", "_e.bin")
    joint = long.groupBy(*by, "feature", "bin", "_l").agg(F.count(F.lit(1)).cast("double").alias("nxy"))
    over = lambda *keys: F.sum("nxy").over(Window.partitionBy(*by, "feature", *keys))
    shares = joint.select(*by, "feature", "nxy", over("bin").alias("nx"), over("_l").alias("ny"), over().alias("n"))
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return shares.groupBy(*by, "feature").agg(F.sum(term).alias("mutual_info"))


# ---------------------------------------------------------------- column profiles


def profile_common(df: DataFrame, roles: Roles = ROLES, approximate: bool = False) -> DataFrame:
    """One row per feature: type, counts, distinct values and the flags that follow.

    Distinct counts come from (feature, value) groups, so a frequent value costs one row
    per task; ``approximate`` swaps in a sketch.
    """
    num = set(roles.numeric(df))
    # adding 0 makes the two signs of zero one value
    feats = [(col(c) + F.lit(0.0)).alias(c) if c in num else col(c) for c in roles.features(df)]
    long = stacked(df.select(*feats), roles.features(df), [], "string")
    if approximate:
        out = long.groupBy("feature").agg(
            F.count(F.lit(1)).alias("nums"),
            F.count(F.when(F.col("value").isNull(), 1)).alias("n_missing"),
            F.approx_count_distinct("value").alias("n_unique"),
        )
    else:
        out = (
            long.groupBy("feature", "value")
            .count()
            .groupBy("feature")
            .agg(
                F.sum("count").alias("nums"),
                F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("n_missing"),
                F.count("value").alias("n_unique"),
            )
        )
    return out.select(
        "feature",
        F.when(F.col("feature").isin(*num), "double").otherwise("string").alias("dtype")
        if num
        else F.lit("string").alias("dtype"),
        "nums",
        "n_missing",
        (F.col("n_missing") / F.col("nums")).alias("missing_ratio"),
        "n_unique",
        (F.col("n_unique") == 1).alias("is_constant"),
        (F.col("n_unique") == 2).cast("int").alias("is_binary"),
    )


def numeric_profile(df: DataFrame, cols: list[str] | None = None, roles: Roles = ROLES) -> DataFrame:
    """mean .. iqr, outlier share, sign and sparsity per numeric column.

    Moments are one wide aggregate; the outlier share needs the mean and spread first, so
    it is a second aggregate over the same columns.
    """
    cols = roles.numeric(df) if cols is None else cols
    spark = df.sparkSession
    schema = (
        "feature string, mean double, std double, skew double, kurtosis double, min double, max double,"
        " range double, q1 double, q2 double, q3 double, iqr double, zscore_outlier_ratio double,"
        " has_negative boolean, sparsity double"
    )
    if not cols:
        return spark.createDataFrame([], schema)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(cols):
        x = col(c)
        aggs.append(
            F.struct(
                F.count(x).alias("n"),
                F.avg(x).alias("mean"),
                M.sample_std(x).alias("std"),
                M.corrected_skew(x).alias("skew"),
                M.corrected_kurtosis(x).alias("kurtosis"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                F.coalesce(F.max(x < 0), F.lit(False)).alias("neg"),
                F.count(F.when(x == 0, 1)).alias("zeros"),
            ).alias(f"a{i}")
        )
    first = df.agg(*aggs).first()
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], n_rows=first["n_rows"])
    far = []
    for i, c in enumerate(cols):
        a = first[f"a{i}"]
        spread = a["std"] if a["std"] and a["max"] > a["min"] else None
        hit = F.lit(None) if spread is None else F.when(F.abs((col(c) - a["mean"]) / spread) > 3, 1)
        far.append(F.count(hit).alias(f"z{i}"))
    second = df.agg(*far).first()
    rows = []
    for i, c in enumerate(cols):
        a, (q1, q2, q3) = first[f"a{i}"], q[c]
        n = a["n"]
        rows.append(
            (
                c, a["mean"], a["std"], a["skew"], a["kurtosis"], a["min"], a["max"],
                None if n == 0 else a["max"] - a["min"], q1, q2, q3, None if q1 is None else q3 - q1,
                second[f"z{i}"] / n if n else 0.0, a["neg"], a["zeros"] / n if n else None,
            )
        )
    return spark.createDataFrame(rows, schema)


def categorical_profile(df: DataFrame, cols: list[str] | None = None, roles: Roles = ROLES) -> DataFrame:
    cols = roles.categorical(df) if cols is None else cols
    vc = stacked(df, cols, [], "string").where("value is not null").groupBy("feature", "value").count()
    total = vc.groupBy("feature").agg(F.sum("count").alias("_n"))
    p = F.col("count") / F.col("_n")
    return vc.join(total, "feature").groupBy("feature").agg(
        F.max(p).alias("mode_freq_ratio"),
        (-F.sum(p * F.log2(p + F.lit(1e-8)))).alias("value_counts_entropy"),
        (F.count(F.lit(1)) == 2).alias("is_binary"),
    )


def profile_table(df: DataFrame, roles: Roles = ROLES, missing_only: bool = False) -> DataFrame:
    """Profiles of all numeric columns, or of those with missing values; may be empty."""
    cols = roles.numeric(df)
    if missing_only and cols:
        r = df.agg(*[F.count(F.when(col(c).isNull(), 1)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        cols = [c for i, c in enumerate(cols) if r[f"m{i}"] > 0]
    numbers = numeric_profile(df, cols, roles)
    if not cols:
        common = profile_common(df, roles).limit(0)
    else:
        common = profile_common(df.select(*[col(c) for c in cols]), roles)
    return common.join(F.broadcast(numbers), "feature").withColumn(
        "feature", F.concat(F.lit("col_"), F.col("feature"))
    )


def profile_tables(df: DataFrame, by: list[str], cols: list[str] | None = None, roles: Roles = ROLES) -> DataFrame:
    """Profiles of the numeric columns of many tables at once, one row per (by..., feature).

    Everything is grouped by table and column with map-side partials; distinct values are
    counted from (table, column, value) groups, so a table that holds most rows is no
    heavier for any one task.
    """
    cols = [c for c in roles.numeric(df) if c not in by] if cols is None else cols
    keys = [*by, "feature"]
    long = stacked(df, cols, by, "double")
    x = F.col("value")
    base = long.groupBy(*keys).agg(
        F.lit("double").alias("dtype"),
        F.count(F.lit(1)).alias("nums"),
        (F.count(F.lit(1)) - F.count(x)).alias("n_missing"),
        F.count(x).alias("_n"),
        F.avg(x).alias("mean"),
        M.sample_std(x).alias("std"),
        M.corrected_skew(x).alias("skew"),
        M.corrected_kurtosis(x).alias("kurtosis"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.coalesce(F.max(x < 0), F.lit(False)).alias("has_negative"),
        (F.count(F.when(x == 0, 1)) / F.nullif(F.count(x).cast("double"), F.lit(0.0))).alias("sparsity"),
    )
    unique = long.where("value is not null").select(*keys, "value").distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_unique")
    )
    quartiles = grouped_quantiles(long, keys, [0.25, 0.5, 0.75])
    limits = base.where("max > min").select(*keys, F.col("mean").alias("_m"), F.col("std").alias("_s"))
    far = long.join(limits, keys).groupBy(*keys).agg(
        F.count(F.when(F.abs((x - F.col("_m")) / F.col("_s")) > 3, 1)).alias("_far")
    )
    all_ = base.join(unique, keys, "left").join(quartiles, keys, "left").join(far, keys, "left")
    n_unique = F.coalesce("n_unique", F.lit(0))
    q = lambda i: F.get("q", F.lit(i))
    return all_.select(
        *keys, "dtype", "nums", "n_missing", (F.col("n_missing") / F.col("nums")).alias("missing_ratio"),
        n_unique.alias("n_unique"), (n_unique == 1).alias("is_constant"), (n_unique == 2).cast("int").alias("is_binary"),
        "mean", "std", "skew", "kurtosis", "min", "max", (F.col("max") - F.col("min")).alias("range"),
        q(0).alias("q1"), q(1).alias("q2"), q(2).alias("q3"), (q(2) - q(0)).alias("iqr"),
        F.coalesce(F.col("_far") / F.nullif(F.col("_n").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("zscore_outlier_ratio"),
        "has_negative", "sparsity",
    )
