"""Scans, splits, table measures and column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import view, with_views
from catalog.registry import g, query, r, rnd, rounded, sig
from winnow.operators import mutual_info, profile, split
from winnow.plans import trials as TR
from winnow.sources import tables

NUM = ("f_price", "f_acctbal", "f_month", "f_tier", "f_const")
CAT = ("c_segment", "c_status")

# long form of the numeric and of all feature columns
LONG = "num AS (" + " UNION ALL ".join(
    f"SELECT row_id, label, '{c}' AS feature, {c} AS value FROM ds" for c in NUM
) + ")"
WORDS = "words AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM ds" for c in NUM + CAT
) + ")"
# counts, mean and centred power sums per column
CENTRED = """
mid AS (SELECT feature, avg(value) AS m FROM num GROUP BY feature),
pow AS (
  SELECT n.feature, CAST(count(n.value) AS DOUBLE) AS n, any_value(m.m) AS m,
         sum((n.value - m.m) * (n.value - m.m)) AS s2,
         sum((n.value - m.m) * (n.value - m.m) * (n.value - m.m)) AS s3,
         sum((n.value - m.m) * (n.value - m.m) * (n.value - m.m) * (n.value - m.m)) AS s4,
         min(n.value) AS lo, max(n.value) AS hi
  FROM num n JOIN mid m ON n.feature = m.feature GROUP BY n.feature),
mom AS (
  SELECT feature, n, m, s2 / (n - 1) AS v, lo, hi,
         CASE WHEN lo = hi THEN 0.0
              ELSE (s3 / n) / ((s2 / n) * sqrt(s2 / n)) * sqrt(n * (n - 1)) / (n - 2) END AS skew,
         CASE WHEN lo = hi THEN 0.0
              ELSE ((n + 1) * ((s4 / n) / ((s2 / n) * (s2 / n)) - 3) + 6) * (n - 1) / ((n - 2) * (n - 3)) END AS kurt
  FROM pow)
"""
MOMENTS = LONG + "," + CENTRED


def corr_sql(source: str, by: str = "") -> str:
    """Mean absolute correlation over column pairs, written with centred sums."""
    key = f"{by}, " if by else ""
    one = []
    for i, a in enumerate(NUM):
        for b in NUM[i + 1 :]:
            one.append(
                f"SELECT {key}CASE WHEN min({a}) FILTER ({b} IS NOT NULL) < max({a}) FILTER ({b} IS NOT NULL)"
                f" AND min({b}) FILTER ({a} IS NOT NULL) < max({b}) FILTER ({a} IS NOT NULL)"
                f" THEN abs(corr({a}, {b})) END AS r FROM {source}" + (f" GROUP BY {by}" if by else "")
            )
    return " UNION ALL ".join(one)


def mutual_sql(source: str, by: str, tag: str) -> str:
    """Views that end in <tag>_mi: mean and largest binned mutual information of each data set."""
    long = " UNION ALL ".join(
        f"SELECT {by} AS dataset, label, '{c}' AS feature, coalesce({c}, 0.0) AS v FROM {source}" for c in NUM
    )
    return f"""{tag}_mv AS ({long}),
{tag}_ml AS (SELECT dataset, feature, min(v) AS lo, max(v) AS hi FROM {tag}_mv GROUP BY dataset, feature),
{tag}_mj AS (SELECT dataset, feature, bin, label, CAST(count(*) AS DOUBLE) AS nxy FROM (
  SELECT f.dataset, f.feature, f.label, CASE WHEN l.hi > l.lo
    THEN least(CAST(floor((f.v - l.lo) / (l.hi - l.lo) * 10) AS INT), 9) ELSE 0 END AS bin
  FROM {tag}_mv f JOIN {tag}_ml l ON f.dataset = l.dataset AND f.feature = l.feature
  WHERE f.label IS NOT NULL) b GROUP BY dataset, feature, bin, label),
{tag}_mp AS (SELECT dataset, feature, nxy, sum(nxy) OVER (PARTITION BY dataset, feature, bin) AS nx,
  sum(nxy) OVER (PARTITION BY dataset, feature, label) AS ny, sum(nxy) OVER (PARTITION BY dataset, feature) AS n FROM {tag}_mj),
{tag}_mi AS (SELECT dataset, avg(mi) AS mean_mutual_info, max(mi) AS max_mutual_info FROM (
  SELECT dataset, feature, sum(nxy / n * ln(nxy * n / (nx * ny))) AS mi FROM {tag}_mp GROUP BY dataset, feature) m
  GROUP BY dataset)"""


MUTUAL_OUT = f"{r('i.mean_mutual_info')} AS mean_mutual_info, {r('i.max_mutual_info')} AS max_mutual_info"
SHARES = (
    "missing_ratio", "feature_mean_skew", "feature_mean_kurtosis", "mean_feature_correlation", "target_entropy",
    "mean_mutual_info", "max_mutual_info",
)


@query(
    "scan_dataset",
    with_views(["ds"], f"""SELECT row_id, {g('f_price')} AS f_price, {g('f_acctbal')} AS f_acctbal, f_month, f_tier,
      f_const, c_segment, c_status, label FROM ds"""),
)
def scan_dataset(spark, sf):
    df, _ = tables.as_labelled(view(spark, sf, "ds"), target="label", row_id="row_id")
    return df.withColumn("f_price", sig("f_price")).withColumn("f_acctbal", sig("f_acctbal"))


@query("mf_shape", with_views(["ds"], """SELECT count(*) AS n_instances, CAST(7 AS BIGINT) AS n_features,
  CAST(5 AS BIGINT) AS n_num_features, CAST(2 AS BIGINT) AS n_cat_features FROM ds"""))
def mf_shape(spark, sf):
    return profile.shape(view(spark, sf, "ds"))


MISSING = "(" + " + ".join(f"(count(*) - count({c}))" for c in NUM + CAT) + ") / (CAST(count(*) AS DOUBLE) * 7)"


@query("mf_missing_ratio", with_views(["ds"], f"SELECT {r(MISSING, 9)} AS missing_ratio FROM ds"))
def mf_missing_ratio(spark, sf):
    df = view(spark, sf, "ds")
    return df.agg(rnd(profile.missing_share(df), 9).alias("missing_ratio"))


@query("mf_target_classes", with_views(["ds"], "SELECT count(DISTINCT label) AS target_num_classes FROM ds"))
def mf_target_classes(spark, sf):
    return profile.target_measures(view(spark, sf, "ds")).select("target_num_classes")


@query("mf_mean_skew", with_views(["ds"], f"SELECT {r('avg(skew)')} AS feature_mean_skew FROM mom", MOMENTS))
def mf_mean_skew(spark, sf):
    return profile.table_measures(view(spark, sf, "ds"), mutual_info=False).select(rnd("feature_mean_skew").alias("feature_mean_skew"))


@query("mf_mean_kurtosis", with_views(["ds"], f"SELECT {r('avg(kurt)')} AS feature_mean_kurtosis FROM mom", MOMENTS))
def mf_mean_kurtosis(spark, sf):
    return profile.table_measures(view(spark, sf, "ds"), mutual_info=False).select(
        rnd("feature_mean_kurtosis").alias("feature_mean_kurtosis")
    )


@query("mf_mean_variance", with_views(["ds"], f"SELECT {g('avg(v)')} AS mean_feature_variance FROM mom", MOMENTS))
def mf_mean_variance(spark, sf):
    return profile.table_measures(view(spark, sf, "ds"), mutual_info=False).select(
        sig("mean_feature_variance").alias("mean_feature_variance")
    )


@query(
    "mf_mean_abs_corr",
    with_views(["ds"], f"SELECT {r('avg(r)')} AS mean_feature_correlation FROM cors", f"cors AS ({corr_sql('ds')})"),
)
def mf_mean_abs_corr(spark, sf):
    return profile.table_measures(view(spark, sf, "ds"), mutual_info=False).select(
        rnd("mean_feature_correlation").alias("mean_feature_correlation")
    )


ENTROPY = "-sum(p * log2(p + 1e-9))"


@query(
    "mf_target_entropy",
    with_views(["ds"], f"SELECT {r(ENTROPY)} AS target_entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM ds GROUP BY label)"),
)
def mf_target_entropy(spark, sf):
    return profile.target_measures(view(spark, sf, "ds")).select(rnd("target_entropy").alias("target_entropy"))


@query(
    "mf_all",
    with_views(["ds"], f"""SELECT s.*, {r('m.sk')} AS feature_mean_skew, {r('m.ku')} AS feature_mean_kurtosis,
      {g('m.va')} AS mean_feature_variance, {r('c.co')} AS mean_feature_correlation, e.target_num_classes,
      {r('e.te')} AS target_entropy, {MUTUAL_OUT}
    FROM (SELECT count(*) AS n_instances, CAST(7 AS BIGINT) AS n_features, CAST(5 AS BIGINT) AS n_num_features,
                 CAST(2 AS BIGINT) AS n_cat_features, {r(MISSING)} AS missing_ratio FROM ds) s,
         (SELECT avg(skew) AS sk, avg(kurt) AS ku, avg(v) AS va FROM mom) m,
         (SELECT avg(r) AS co FROM cors) c,
         (SELECT count(*) AS target_num_classes, {ENTROPY} AS te
          FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM ds GROUP BY label)) e, all_mi i""",
    MOMENTS + f", cors AS ({corr_sql('ds')}), " + mutual_sql("ds", "'all'", "all")),
)
def mf_all(spark, sf):
    out = profile.table_measures(view(spark, sf, "ds"))
    return rounded(out.withColumn("mean_feature_variance", sig("mean_feature_variance")),
                   list(SHARES))


BY_MOMENTS = "num AS (" + " UNION ALL ".join(
    f"SELECT dataset || '|{c}' AS feature, {c} AS value FROM kb" for c in NUM
) + ")," + CENTRED


@query(
    "mf_by_dataset",
    with_views(["kb"], f"""SELECT s.dataset, s.n_instances, s.n_features, s.n_num_features, s.n_cat_features, s.missing_ratio,
      {r('m.sk')} AS feature_mean_skew, {r('m.ku')} AS feature_mean_kurtosis, {g('m.va')} AS mean_feature_variance,
      {r('c.co')} AS mean_feature_correlation, e.target_num_classes, {r('e.te')} AS target_entropy, {MUTUAL_OUT}
    FROM (SELECT dataset, count(*) AS n_instances, CAST(7 AS BIGINT) AS n_features, CAST(5 AS BIGINT) AS n_num_features,
                 CAST(2 AS BIGINT) AS n_cat_features, {r(MISSING)} AS missing_ratio FROM kb GROUP BY dataset) s
    JOIN (SELECT split_part(feature, '|', 1) AS dataset, avg(skew) AS sk, avg(kurt) AS ku, avg(v) AS va FROM mom GROUP BY 1) m
      ON s.dataset = m.dataset
    JOIN (SELECT dataset, avg(r) AS co FROM cors GROUP BY dataset) c ON s.dataset = c.dataset
    JOIN (SELECT dataset, count(*) AS target_num_classes, {ENTROPY} AS te FROM (
            SELECT dataset, count(*) / sum(count(*)) OVER (PARTITION BY dataset) AS p FROM kb GROUP BY dataset, label)
          GROUP BY dataset) e ON s.dataset = e.dataset JOIN kb_mi i ON s.dataset = i.dataset""",
    BY_MOMENTS + f", cors AS ({corr_sql('kb', 'dataset')}), " + mutual_sql("kb", "dataset", "kb")),
)
def mf_by_dataset(spark, sf):
    out = profile.table_measures(view(spark, sf, "kb"), ["dataset"])
    return rounded(out.withColumn("mean_feature_variance", sig("mean_feature_variance")),
                   list(SHARES))


# 44 numeric columns, more than are compared by an aggregate for each pair
WIDE = [f"w{k}" for k in range(42)]
WIDE_KB = "SELECT row_id, dataset, label, f_price, f_acctbal, " + ", ".join(
    f"CASE WHEN row_id % {50 + k} <> 0 THEN CAST((row_id * {k + 3}) % {97 + k} AS DOUBLE) END AS {c}" for k, c in enumerate(WIDE)
) + " FROM kb"


WIDE_LONG = f"wide AS MATERIALIZED ({WIDE_KB}), cells AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT row_id, dataset, {k} AS k, {c} AS v FROM wide WHERE {c} IS NOT NULL" for k, c in enumerate(["f_price", "f_acctbal", *WIDE])
) + """), paired AS (
  SELECT a.dataset, CASE WHEN min(a.v) < max(a.v) AND min(b.v) < max(b.v) THEN abs(corr(a.v, b.v)) END AS r
  FROM cells a JOIN cells b ON a.row_id = b.row_id AND a.k < b.k GROUP BY a.dataset, a.k, b.k)"""


@query(
    "mf_wide_by_dataset",
    with_views(["kb"], f"""SELECT s.dataset, s.n_instances, CAST(44 AS BIGINT) AS n_num_features, {r('c.co')} AS mean_feature_correlation
    FROM (SELECT dataset, count(*) AS n_instances FROM wide GROUP BY dataset) s
    JOIN (SELECT dataset, avg(r) AS co FROM paired GROUP BY dataset) c ON s.dataset = c.dataset""", WIDE_LONG),
)
def mf_wide_by_dataset(spark, sf):
    view(spark, sf, "kb").createOrReplaceTempView("kb")
    out = profile.table_measures(spark.sql(WIDE_KB), ["dataset"], mutual_info=False)
    return rounded(out.select("dataset", "n_instances", "n_num_features", "mean_feature_correlation"))


BINNED = LONG + """,
filled AS (SELECT feature, label, coalesce(value, 0.0) AS v FROM num),
lim AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM filled GROUP BY feature),
binned AS (SELECT f.feature, f.label, CASE WHEN l.hi > l.lo
             THEN least(CAST(floor((f.v - l.lo) / (l.hi - l.lo) * 10) AS INT), 9) ELSE 0 END AS bin
           FROM filled f JOIN lim l ON f.feature = l.feature),
joint AS (SELECT feature, bin, label, CAST(count(*) AS DOUBLE) AS nxy FROM binned GROUP BY feature, bin, label),
parts AS (SELECT feature, nxy, sum(nxy) OVER (PARTITION BY feature, bin) AS nx,
                 sum(nxy) OVER (PARTITION BY feature, label) AS ny, sum(nxy) OVER (PARTITION BY feature) AS n FROM joint)
"""


@query(
    "mf_mutual_info_binned",
    with_views(["ds"], f"SELECT feature, {r('sum(nxy / n * ln(nxy * n / (nx * ny)))')} AS mutual_info FROM parts GROUP BY feature", BINNED),
)
def mf_mutual_info_binned(spark, sf):
    return rounded(profile.binned_mutual_information(view(spark, sf, "ds")))


@query("mf_mutual_info_knn")
def mf_mutual_info_knn(spark, sf):
    return mutual_info.mutual_information(view(spark, sf, "ds"))


@query("need_flags", with_views(["ds"], f"SELECT {MISSING} > 0 AS need_i, false AS need_o, true AS need_e FROM ds"))
def need_flags(spark, sf):
    return profile.need_flags(view(spark, sf, "ds"))


# ---------------------------------------------------------------- column profiles

COMMON = """SELECT feature, CASE WHEN feature LIKE 'c_%' THEN 'string' ELSE 'double' END AS dtype, count(*) AS nums,
  count(*) - count(value) AS n_missing, (count(*) - count(value)) / CAST(count(*) AS DOUBLE) AS miss,
  count(DISTINCT value) AS n_unique FROM words GROUP BY feature"""
COMMON_OUT = f"""feature, dtype, nums, n_missing, {r('miss', 9)} AS missing_ratio, n_unique, n_unique = 1 AS is_constant,
  CAST(n_unique = 2 AS INT) AS is_binary"""
NUMBERS = LONG + """,
stats AS (SELECT feature, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi,
       quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3,
       bool_or(value < 0) AS neg, count(*) FILTER (value = 0) / CAST(count(value) AS DOUBLE) AS zero
  FROM num GROUP BY feature),
far AS (SELECT n.feature, count(*) FILTER (s.hi > s.lo AND abs((n.value - s.mean) / s.sd) > 3) / CAST(count(n.value) AS DOUBLE) AS ratio
  FROM num n JOIN stats s ON n.feature = s.feature GROUP BY n.feature)
"""
NUMERIC_OUT = f"""{g('s.mean')} AS mean, {g('s.sd')} AS std, {r('m.skew')} AS skew, {r('m.kurt')} AS kurtosis,
  s.lo AS "min", s.hi AS "max", {g('s.hi - s.lo')} AS range, {g('s.q1')} AS q1, {g('s.q2')} AS q2, {g('s.q3')} AS q3,
  {g('s.q3 - s.q1')} AS iqr, {r('f.ratio', 9)} AS zscore_outlier_ratio, s.neg AS has_negative, {r('s.zero', 9)} AS sparsity"""
NUMERIC_FROM = "FROM stats s JOIN mom m ON s.feature = m.feature JOIN far f ON s.feature = f.feature"
SIG_COLS = ("mean", "std", "range", "q1", "q2", "q3", "iqr")


def polished(df):
    for c in SIG_COLS:
        df = df.withColumn(c, sig(c))
    return df.withColumn("skew", rnd("skew")).withColumn("kurtosis", rnd("kurtosis")).withColumn(
        "zscore_outlier_ratio", rnd("zscore_outlier_ratio", 9)).withColumn("sparsity", rnd("sparsity", 9))


@query("profile_common", with_views(["ds"], f"SELECT {COMMON_OUT} FROM ({COMMON}) x", WORDS))
def profile_common(spark, sf):
    return profile.profile_common(view(spark, sf, "ds")).withColumn("missing_ratio", rnd("missing_ratio", 9))


@query("profile_numeric", with_views(["ds"], f"SELECT s.feature, {NUMERIC_OUT} {NUMERIC_FROM}", NUMBERS + "," + CENTRED))
def profile_numeric(spark, sf):
    return polished(profile.numeric_profile(view(spark, sf, "ds")))


EV_NUMBERS = (NUMBERS + "," + CENTRED).replace(LONG, "num AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS value FROM ev" for c in ("f_value", "f_hour", "f_bucket")) + ")")


@query(
    "profile_outlier_ratio",
    with_views(["ev"], f"""SELECT s.feature, {r('f.ratio', 9)} AS zscore_outlier_ratio, s.neg AS has_negative,
      {r('s.zero', 9)} AS sparsity {NUMERIC_FROM}""", EV_NUMBERS),
)
def profile_outlier_ratio(spark, sf):
    out = profile.numeric_profile(view(spark, sf, "ev"))
    return rounded(out.select("feature", "zscore_outlier_ratio", "has_negative", "sparsity"), digits=9)


CATS = "cats AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM ds" for c in CAT) + """),
vc AS (SELECT feature, value, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS p FROM cats WHERE value IS NOT NULL
       GROUP BY feature, value)"""


@query(
    "profile_categorical",
    with_views(["ds"], f"""SELECT feature, {r('max(p)', 9)} AS mode_freq_ratio,
      {r('-sum(p * log2(p + 1e-8))')} AS value_counts_entropy, count(*) = 2 AS is_binary FROM vc GROUP BY feature""", CATS),
)
def profile_categorical(spark, sf):
    out = profile.categorical_profile(view(spark, sf, "ds"))
    return out.withColumn("mode_freq_ratio", rnd("mode_freq_ratio", 9)).withColumn(
        "value_counts_entropy", rnd("value_counts_entropy"))


TABLE_SQL = f"""SELECT 'col_' || x.feature AS feature, x.dtype, x.nums, x.n_missing, {r('x.miss', 9)} AS missing_ratio,
  x.n_unique, x.n_unique = 1 AS is_constant, CAST(x.n_unique = 2 AS INT) AS is_binary, {NUMERIC_OUT}
  FROM ({COMMON}) x JOIN stats s ON x.feature = s.feature JOIN mom m ON s.feature = m.feature
  JOIN far f ON s.feature = f.feature"""


@query("profile_table", with_views(["ds"], TABLE_SQL, WORDS + "," + NUMBERS + "," + CENTRED))
def profile_table(spark, sf):
    return polished(profile.profile_table(view(spark, sf, "ds"))).withColumn("missing_ratio", rnd("missing_ratio", 9))


@query("profile_missing_only", with_views(["ds"], TABLE_SQL + " WHERE x.n_missing > 0", WORDS + "," + NUMBERS + "," + CENTRED))
def profile_missing_only(spark, sf):
    out = profile.profile_table(view(spark, sf, "ds"), missing_only=True)
    return polished(out).withColumn("missing_ratio", rnd("missing_ratio", 9))


# ---------------------------------------------------------------- splits


@query(
    "sample_fixed",
    with_views(["ds"], "SELECT row_id, label FROM ds ORDER BY md5(CAST(row_id AS VARCHAR) || '#0'), row_id LIMIT 500"),
)
def sample_fixed(spark, sf):
    return split.sample_fixed(view(spark, sf, "ds"), 500).select("row_id", "label")


H = "md5(CAST(row_id AS VARCHAR)), row_id"


@query(
    "split_stratified",
    with_views(["ds"], f"SELECT row_id, label, (row_number() OVER (PARTITION BY label ORDER BY {H}) - 1) % 5 = 0 AS is_test FROM ds"),
)
def split_stratified(spark, sf):
    return split.stratified_split(view(spark, sf, "ds")).select("row_id", "label", "is_test")


@query("split_holdout", with_views(["ds"], f"SELECT row_id, (row_number() OVER (ORDER BY {H}) - 1) % 4 = 0 AS is_test FROM ds"))
def split_holdout(spark, sf):
    return split.holdout_split(view(spark, sf, "ds")).select("row_id", "is_test")


@query(
    "split_kfold",
    with_views(["ds"], f"SELECT row_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {H}) - 1) % 4 AS INT) AS fold FROM ds"),
)
def split_kfold(spark, sf):
    return split.stratified_folds(view(spark, sf, "ds")).select("row_id", "label", "fold")


# ---------------------------------------------------------------- profiles with strategies

METHODS = TR.SCALING_METHODS
STRATEGY = """top AS (SELECT * FROM colstrat ORDER BY accuracy DESC, trial_id LIMIT 100),
wts AS (SELECT *, accuracy * exp(-CAST(1 AS DOUBLE) * (row_number() OVER (ORDER BY accuracy DESC, trial_id) - 1)) AS w0,
        exp(-CAST(1 AS DOUBLE) * (row_number() OVER (ORDER BY accuracy DESC, trial_id) - 1)) AS e FROM top),
tot AS (SELECT sum(e) AS te FROM wts),
lf AS (SELECT 'f_price' AS feature, coalesce(f_price, 'none') AS method, w0 / te AS w FROM wts, tot
       UNION ALL SELECT 'f_acctbal', coalesce(f_acctbal, 'none'), w0 / te FROM wts, tot),
sp AS (SELECT feature, """ + ", ".join(
    f"coalesce(sum(w) FILTER (method = '{m}'), 0) AS {m}" for m in METHODS
) + """ FROM lf GROUP BY feature),
nm AS (SELECT *, CASE WHEN """ + " + ".join(METHODS) + " = 0 THEN 1e-9 ELSE " + " + ".join(METHODS) + " END AS t FROM sp)"
STRAT_COLS = ", ".join(f"{r(f'z.{m} / z.t')} AS strategy_{m}" for m in METHODS)
JOINED = f"""SELECT x.nums, x.n_missing, {r('x.miss', 9)} AS missing_ratio, x.n_unique, x.n_unique = 1 AS is_constant,
  CAST(x.n_unique = 2 AS INT) AS is_binary, {NUMERIC_OUT}, {STRAT_COLS}
  FROM ({COMMON}) x JOIN stats s ON x.feature = s.feature JOIN mom m ON s.feature = m.feature
  JOIN far f ON s.feature = f.feature JOIN nm z ON z.feature = x.feature"""


def _joined(spark, sf):
    freq = TR.strategy_frequency_ranked(view(spark, sf, "colstrat"), ["f_price", "f_acctbal"])
    out = TR.with_strategies(profile.profile_table(view(spark, sf, "ds")), freq)
    out = polished(out).withColumn("missing_ratio", rnd("missing_ratio", 9))
    return rounded(out, ["strategy_" + m for m in METHODS])


@query("profile_strategy_join", with_views(["ds", "colstrat"], JOINED, ",".join([WORDS, NUMBERS, CENTRED, STRATEGY])))
def profile_strategy_join(spark, sf):
    return _joined(spark, sf)


GROUPED = "num AS (" + " UNION ALL ".join(
    f"SELECT dataset || '|{c}' AS feature, {c} AS value FROM kb" for c in NUM
) + ")," + (NUMBERS + "," + CENTRED)[len(LONG) + 1 :]
MERGED = f"""SELECT split_part(s.feature, '|', 1) AS dataset, x.nums, x.n_missing, {r('x.miss', 9)} AS missing_ratio, x.n_unique,
  CAST(x.n_unique = 2 AS INT) AS is_binary, {NUMERIC_OUT}, {STRAT_COLS}
  FROM (SELECT feature, count(*) AS nums, count(*) - count(value) AS n_missing,
               (count(*) - count(value)) / CAST(count(*) AS DOUBLE) AS miss, count(DISTINCT value) AS n_unique FROM num GROUP BY feature) x
  JOIN stats s ON x.feature = s.feature JOIN mom m ON s.feature = m.feature JOIN far f ON s.feature = f.feature
  JOIN nm z ON z.feature = split_part(x.feature, '|', 2)"""


@query("merge_profiles", with_views(["kb", "colstrat"], MERGED, ",".join([GROUPED, STRATEGY])))
def merge_profiles(spark, sf):
    """Profiles of all 25 tables joined with the method frequencies, in one grouped job."""
    freq = TR.strategy_frequency_ranked(view(spark, sf, "colstrat"), ["f_price", "f_acctbal"])
    parts = TR.with_strategies(profile.profile_tables(view(spark, sf, "kb"), ["dataset"], list(NUM)), freq)
    out = polished(TR.merge_tables([parts])).withColumn("missing_ratio", rnd("missing_ratio", 9))
    return rounded(out, ["strategy_" + m for m in METHODS])
