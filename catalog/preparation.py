"""Imputation, outliers, encoding, scaling, feature construction and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import view, with_views
from catalog.registry import g, query, r, rnd, rounded, sig
from winnow.operators import encode, features, impute, outlier, scale, select, split
from winnow.plans import chain

NUM = ("f_price", "f_acctbal", "f_month", "f_tier", "f_const")
CAT = ("c_segment", "c_status")
H = "md5(CAST(row_id AS VARCHAR)), row_id"
SPLIT = f"""sp AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {H}) - 1) % 5 = 0 AS is_test FROM ds),
tr AS (SELECT * FROM sp WHERE NOT is_test), te AS (SELECT * FROM sp WHERE is_test)"""


def mode_sql(c: str, source: str = "ds") -> str:
    return f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def mean_sql(c: str, source: str = "ds") -> str:
    return f"(SELECT avg({c}) FROM {source})"


def filled_sql(source: str, fit: str, fill=mean_sql) -> str:
    nums = ", ".join(f"coalesce({c}, {fill(c, fit)}) AS {c}" for c in NUM)
    cats = ", ".join(f"coalesce({c}, {mode_sql(c, fit)}) AS {c}" for c in CAT)
    return f"SELECT row_id, {nums}, {cats}, label FROM {source}"


FULL = f"fu AS ({filled_sql('ds', 'ds')})"
NUM_OUT = ", ".join(f"{r(c)} AS {c}" for c in NUM)


def split_tables(spark, sf):
    return split.divide(split.stratified_split(view(spark, sf, "ds")))


def complete(spark, sf):
    df = view(spark, sf, "ds")
    return impute.fit_imputer(df, "mean").apply(df)


# ---------------------------------------------------------------- imputation


def _imputed(strategy):
    def run(spark, sf):
        df = view(spark, sf, "ds")
        return rounded(impute.fit_imputer(df, strategy).apply(df).select("row_id", *NUM))

    return run


query("impute_mean", with_views(["ds"], f"SELECT row_id, {NUM_OUT} FROM fu", FULL))(_imputed("mean"))
query(
    "impute_median",
    with_views(["ds"], f"SELECT row_id, {NUM_OUT} FROM fu", f"""fu AS ({filled_sql('ds', 'ds',
        lambda c, t: f'(SELECT quantile_cont({c}, 0.5) FROM {t})')})"""),
)(_imputed("median"))
query(
    "impute_mode",
    with_views(["ds"], f"SELECT row_id, {NUM_OUT} FROM fu", f"fu AS ({filled_sql('ds', 'ds', mode_sql)})"),
)(_imputed("most_frequent"))
query(
    "impute_constant",
    with_views(["ds"], f"SELECT row_id, {NUM_OUT} FROM fu", f"fu AS ({filled_sql('ds', 'ds', lambda c, t: '0.0')})"),
)(_imputed("constant"))


@query("impute_categorical", with_views(["ds"], "SELECT row_id, c_segment, c_status FROM fu", FULL))
def impute_categorical(spark, sf):
    return complete(spark, sf).select("row_id", *CAT)


def _knn_sql() -> str:
    shared = " + ".join(f"(CASE WHEN q.{c} IS NULL OR p.{c} IS NULL THEN 0 ELSE 1 END)" for c in NUM)
    square = " + ".join(f"coalesce((q.{c} - p.{c}) * (q.{c} - p.{c}), 0.0)" for c in NUM)
    dist = f"sqrt(({square}) * 5.0 / ({shared}))"
    blocks = []
    for c in ("f_price", "f_acctbal"):
        blocks.append(f"""n_{c} AS (SELECT q.row_id, arg_min(p.{c}, {{'d': {dist}, 'i': p.row_id}}, 5) AS v
          FROM ds q JOIN ds p ON q.{c} IS NULL AND p.{c} IS NOT NULL GROUP BY q.row_id)""")
    out = f"""SELECT d.row_id, {r('coalesce(d.f_price, list_avg(a.v))')} AS f_price,
      {r('coalesce(d.f_acctbal, list_avg(b.v))')} AS f_acctbal
      FROM ds d LEFT JOIN n_f_price a ON d.row_id = a.row_id LEFT JOIN n_f_acctbal b ON d.row_id = b.row_id"""
    return with_views(["ds"], out, ",".join(blocks))


@query("impute_knn", _knn_sql())
def impute_knn(spark, sf):
    df = view(spark, sf, "ds")
    return rounded(impute.fit_imputer(df, "knn").apply(df).select("row_id", "f_price", "f_acctbal"))


@query("impute_iterative")
def impute_iterative(spark, sf):
    df = view(spark, sf, "ds")
    return impute.fit_imputer(df, "iterative").apply(df).select("row_id", *NUM)


@query(
    "impute_apply_test",
    with_views(["ds"], f"SELECT row_id, {NUM_OUT}, c_segment, c_status, label FROM ft", SPLIT + f", ft AS ({filled_sql('te', 'tr')})"),
)
def impute_apply_test(spark, sf):
    train, test = split_tables(spark, sf)
    return rounded(impute.fit_imputer(train, "mean").apply(test))


# ---------------------------------------------------------------- outliers

EVN = ("f_value", "f_hour", "f_bucket")


def _z_sql(c, fill="NULL"):
    return (f"CASE WHEN {c} IS NULL THEN {fill} WHEN hi_{c} > lo_{c} AND abs(({c} - m_{c}) / s_{c}) > 3 THEN {fill}"
            f" ELSE {c} END AS {c}")


ZFIT = "zf AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in EVN
) + " FROM ev)"


@query("outlier_zscore", with_views(["ev"], f"SELECT row_id, {', '.join(_z_sql(c) for c in EVN)} FROM ev, zf", ZFIT))
def outlier_zscore(spark, sf):
    df = view(spark, sf, "ev")
    return outlier.fit_outliers(df, "zscore").mask(df).select("row_id", *EVN)


QFIT = "qf AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in EVN
) + " FROM ev)"


@query(
    "outlier_iqr",
    with_views(["ev"], "SELECT row_id, " + ", ".join(
        f"CASE WHEN {c} < a_{c} - 1.5 * (b_{c} - a_{c}) OR {c} > b_{c} + 1.5 * (b_{c} - a_{c}) THEN NULL ELSE {c} END AS {c}"
        for c in EVN) + " FROM ev, qf", QFIT),
)
def outlier_iqr(spark, sf):
    df = view(spark, sf, "ev")
    return outlier.fit_outliers(df, "iqr").mask(df).select("row_id", *EVN)


@query(
    "outlier_reimpute",
    with_views(["ev"], "SELECT row_id, " + ", ".join(f"{r(c)} AS {c}" for c in EVN) + " FROM (SELECT row_id, "
               + ", ".join(_z_sql(c, f"m_{c}") for c in EVN) + " FROM ev, zf) x", ZFIT),
)
def outlier_reimpute(spark, sf):
    df = view(spark, sf, "ev")
    refill = impute.fit_imputer(df, "mean")
    return rounded(outlier.fit_outliers(df, "zscore", imputer=refill).apply(df).select("row_id", *EVN))


# ---------------------------------------------------------------- encoding

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
STATUSES = ("F", "O", "P")


def onehot_sql(source: str) -> str:
    cols = [f"CAST(c_segment = '{v}' AND c_segment IS NOT NULL AS DOUBLE) AS \"c_segment_{v}\"" for v in SEGMENTS]
    cols += ["CAST(c_segment IS NULL AS DOUBLE) AS c_segment_null"]
    cols += [f"CAST(c_status = '{v}' AS DOUBLE) AS \"c_status_{v}\"" for v in STATUSES]
    body = ", ".join(cols).replace(
        "CAST(c_segment = '", "CAST(coalesce(c_segment, '') = '").replace(" AND c_segment IS NOT NULL", "")
    return f"SELECT row_id, {body} FROM {source}"


@query("encode_onehot", with_views(["ds"], onehot_sql("ds")))
def encode_onehot(spark, sf):
    df = view(spark, sf, "ds").select("row_id", *CAT, "label")
    return encode.fit_encoder(df, "onehot").apply(df).drop("label")


def code_view(c: str, rank: str) -> str:
    return f"k_{c} AS (SELECT v, {rank} AS code FROM (SELECT {c} AS v, min(row_id) AS f, count(*) AS n FROM {{src}} GROUP BY {c}) x)"


def lookup_sql(source: str, rank: str, out, fit: str = "ds") -> str:
    blocks = ", ".join(code_view(c, rank).replace("{src}", fit) for c in CAT)
    cols = ", ".join(out(c, f"(SELECT code FROM k_{c} k WHERE k.v IS NOT DISTINCT FROM d.{c})") for c in CAT)
    return blocks, f"SELECT d.row_id, {cols} FROM {source} d"


def _bits(c, code):
    n = 3 if c == "c_segment" else 2
    return ", ".join(f"CAST((coalesce({code}, 0) >> {n - 1 - i}) & 1 AS DOUBLE) AS {c}_{i}" for i in range(n))


_b, _q = lookup_sql("ds", "row_number() OVER (ORDER BY f)", _bits)


@query("encode_binary", with_views(["ds"], _q, _b))
def encode_binary(spark, sf):
    df = view(spark, sf, "ds").select("row_id", *CAT, "label")
    return encode.fit_encoder(df, "binary").apply(df).drop("label")


_b, _q = lookup_sql(
    "ds", "CASE WHEN v IS NOT NULL THEN n / sum(CASE WHEN v IS NOT NULL THEN n ELSE 0 END) OVER () END",
    lambda c, code: f"{r(code, 9)} AS {c}",
)


@query("encode_frequency", with_views(["ds"], _q, _b))
def encode_frequency(spark, sf):
    df = view(spark, sf, "ds").select("row_id", *CAT, "label")
    return rounded(encode.fit_encoder(df, "frequency").apply(df).drop("label"), digits=9)


LABEL_RANK = "row_number() OVER (ORDER BY v NULLS LAST) - 1"
_b, _q = lookup_sql("ds", LABEL_RANK, lambda c, code: f"CAST(coalesce({code}, -1) AS DOUBLE) AS {c}")


@query("encode_label", with_views(["ds"], _q, _b))
def encode_label(spark, sf):
    df = view(spark, sf, "ds").select("row_id", *CAT, "label")
    return encode.fit_encoder(df, "label").apply(df).drop("label")


# fitted on closed orders only, so that other values are unseen
_known = "known AS (SELECT * FROM ds WHERE c_status <> 'P' AND c_segment IS NOT NULL)"
_b, _q = lookup_sql("ds", LABEL_RANK, lambda c, code: f"CAST(coalesce({code}, -1) AS DOUBLE) AS {c}", "known")


@query("encode_apply_test", with_views(["ds"], _q, _known + ", " + _b))
def encode_apply_test(spark, sf):
    df = view(spark, sf, "ds").select("row_id", *CAT, "label")
    seen = df.where("c_status <> 'P' and c_segment is not null")
    return encode.fit_encoder(seen, "label").apply(df).drop("label")


# ---------------------------------------------------------------- scaling


def _scaled(method):
    def run(spark, sf):
        df = complete(spark, sf).select("row_id", *NUM, "label")
        return rounded(scale.fit_scaler(df, method).apply(df).drop("label"))

    return run


def scale_sql(expr, fit) -> str:
    stats = ", ".join(fit(c) for c in NUM)
    cols = ", ".join(f"{r(expr(c))} AS {c}" for c in NUM)
    return with_views(["ds"], f"SELECT row_id, {cols} FROM fu, st", FULL + f", st AS (SELECT {stats} FROM fu)")


query("norm_standard", scale_sql(
    lambda c: f"CASE WHEN h_{c} > l_{c} THEN ({c} - a_{c}) / s_{c} ELSE 0 END",
    lambda c: f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}, min({c}) AS l_{c}, max({c}) AS h_{c}",
))(_scaled("standard"))
query("norm_minmax", scale_sql(
    lambda c: f"CASE WHEN h_{c} > l_{c} THEN ({c} - l_{c}) / (h_{c} - l_{c}) ELSE 0 END",
    lambda c: f"min({c}) AS l_{c}, max({c}) AS h_{c}",
))(_scaled("minmax"))
query("norm_maxabs", scale_sql(
    lambda c: f"{c} / CASE WHEN h_{c} = 0 THEN 1 ELSE h_{c} END", lambda c: f"max(abs({c})) AS h_{c}",
))(_scaled("maxabs"))
query("norm_robust", scale_sql(
    lambda c: f"({c} - m_{c}) / CASE WHEN b_{c} = a_{c} THEN 1 ELSE b_{c} - a_{c} END",
    lambda c: f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) AS b_{c}",
))(_scaled("robust"))


def _bin_sql(c: str) -> str:
    # an inner edge counts when it is apart from the edge before it and is not the last kept
    edge = [f"e_{c}[{i}]" for i in range(1, 7)]
    kept = "[" + ", ".join([f"struct_pack(e := {edge[0]}, k := true)"] + [
        f"struct_pack(e := {edge[i]}, k := {edge[i]} - {edge[i - 1]} > 1e-8)" for i in range(1, 6)]) + "]"
    inner = f"list_transform(list_filter({kept}, lambda z: z.k), lambda z: z.e)"
    return f"len(list_filter(({inner})[2:len({inner}) - 1], lambda z: z <= {c}))"


query("norm_kbins", scale_sql(
    _bin_sql, lambda c: f"quantile_cont({c}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e_{c}",
))(_scaled("kbins"))
query("norm_row_l2", with_views(
    ["ds"], "SELECT row_id, " + ", ".join(f"{r(f'coalesce({c} / nullif(nn, 0), {c})', 9)} AS {c}" for c in NUM)
    + " FROM (SELECT *, sqrt(" + " + ".join(f"{c} * {c}" for c in NUM) + ") AS nn FROM fu) x", FULL,
))(lambda spark, sf: rounded(
    (lambda df: scale.fit_scaler(df, "normalizer").apply(df).drop("label"))(
        complete(spark, sf).select("row_id", *NUM, "label")), digits=9))


def _quantile_sql() -> str:
    """Levels 0..999 of each column; a value on a level takes the mean of the first and last
    level it covers, others are interpolated between neighbouring distinct levels."""
    blocks, joins, outs = [FULL], [], []
    refs = "list_transform(range(0, 1000), lambda i: i / 999.0)"
    for c in NUM:
        blocks.append(f"q_{c} AS (SELECT unnest(quantile_cont({c}, {refs})) AS x, unnest({refs}) AS p FROM fu)")
        blocks.append(f"""l_{c} AS (SELECT x, lo, hi, lead(x) OVER (ORDER BY x) AS nx, lead(lo) OVER (ORDER BY x) AS nlo,
          min(x) OVER () AS first, max(x) OVER () AS last FROM (SELECT x, min(p) AS lo, max(p) AS hi FROM q_{c} GROUP BY x) y)""")
        joins.append(f"ASOF JOIN l_{c} ON fu.{c} >= l_{c}.x")
        a = f"l_{c}"
        outs.append(r(f"""CASE WHEN fu.{c} <= {a}.first THEN 0 WHEN fu.{c} >= {a}.last THEN 1 WHEN fu.{c} = {a}.x
          THEN ({a}.lo + {a}.hi) / 2 ELSE {a}.hi + (fu.{c} - {a}.x) * ({a}.nlo - {a}.hi) / ({a}.nx - {a}.x) END""") + f" AS {c}")
    return with_views(["ds"], f"SELECT fu.row_id, {', '.join(outs)} FROM fu {' '.join(joins)}", ", ".join(blocks))


query("norm_quantile", _quantile_sql())(_scaled("quantile"))


@query("norm_power")
def norm_power(spark, sf):
    return _scaled("power")(spark, sf)


FIXED = {"f_price": 0.5, "f_acctbal": 2.0, "f_month": 0.0, "f_tier": -1.5, "f_const": 1.0}


def _yj_sql(c: str) -> str:
    lam = FIXED[c]
    up = f"ln(1 + {c})" if lam == 0 else f"(pow({c} + 1, {lam}) - 1) / {lam}"
    down = f"-ln(1 - {c})" if lam == 2 else f"-(pow(1 - {c}, {2 - lam}) - 1) / {2 - lam}"
    return f"CASE WHEN {c} >= 0 THEN {up} ELSE {down} END"


@query(
    "norm_power_fixed_lambda",
    with_views(["ds"], "SELECT row_id, " + ", ".join(f"{r(_yj_sql(c))} AS {c}" for c in NUM) + " FROM fu", FULL),
)
def norm_power_fixed_lambda(spark, sf):
    df = complete(spark, sf)
    return df.select("row_id", *[rnd(scale.yeo_johnson(F.col(c), FIXED[c])).alias(c) for c in NUM])


_dropped = [c for c in NUM if c != "f_tier"]


@query(
    "norm_apply_test",
    with_views(["ds"], "SELECT row_id, " + ", ".join(
        r(f"CASE WHEN h_{c} > l_{c} THEN ({c if c in _dropped else 0} - a_{c}) / s_{c} ELSE 0 END") + f" AS {c}" for c in NUM)
        + ", c_segment, c_status, label FROM ft, st", SPLIT + f", fr AS ({filled_sql('tr', 'tr')}), ft AS ({filled_sql('te', 'tr')}), st AS (SELECT "
        + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}, min({c}) AS l_{c}, max({c}) AS h_{c}" for c in NUM) + " FROM fr)"),
)
def norm_apply_test(spark, sf):
    train, test = split_tables(spark, sf)
    fill = impute.fit_imputer(train, "mean")
    scaler = scale.fit_scaler(fill.apply(train), "standard")
    # a column missing from the new table counts as 0
    return rounded(scaler.apply(fill.apply(test).drop("f_tier")))


# ---------------------------------------------------------------- feature construction

SMALL = ("f_price", "f_acctbal", "f_month", "f_tier")
STD = f"""st AS (SELECT {', '.join(f'avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}' for c in SMALL)} FROM fu),
sd AS (SELECT row_id, label, {', '.join(f'({c} - a_{c}) / s_{c} AS {c}' for c in SMALL)} FROM fu, st)"""


def standardised(spark, sf):
    df = complete(spark, sf).select("row_id", *SMALL, "label")
    return scale.fit_scaler(df, "standard").apply(df)


def _terms(start: int) -> str:
    single = [c for c in SMALL]
    both = [f"{a} * {b}" for i, a in enumerate(SMALL) for b in SMALL[i + start :]]
    return ", ".join(f"{r(t, 5)} AS \"{i}\"" for i, t in enumerate(single + both))


def _built(method):
    def run(spark, sf):
        df = standardised(spark, sf)
        return rounded(features.fit_features(df, method).apply(df).drop("label"), digits=5)

    return run


query("ft_polynomial", with_views(["ds"], f"SELECT row_id, {_terms(0)} FROM sd", FULL + "," + STD))(_built("polynomial"))
query("ft_interactions", with_views(["ds"], f"SELECT row_id, {_terms(1)} FROM sd", FULL + "," + STD))(
    _built("InteractionFeatures"))
query("ft_pca")(_built("pca"))
query("ft_incremental_pca")(_built("IncrementalPCA"))
query("ft_truncated_svd")(_built("TruncatedSVD"))
query("ft_kernel_pca")(_built("kernelPCA"))
query("ft_discriminant")(_built("lda"))


@query("ft_random_trees")
def ft_random_trees(spark, sf):
    """For each row the number of leaves that it falls in and the first of their columns, from the
    columns kept by the sparse one-hot vector."""
    df = standardised(spark, sf)
    out = features.fit_features(df, "RandomTrees").apply(df)
    hot = F.unwrap_udt("0")["indices"]
    return out.select("row_id", F.size(hot).alias("n_leaves"), F.array_min(hot).alias("first_leaf"))


@query(
    "ft_moments",
    with_views(["ds"], " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {r(f'sum({a})')} AS sa, {r(f'sum({b})')} AS sb, {r(f'sum({a} * {b})')} AS sab FROM sd"
        for i, a in enumerate(SMALL) for b in SMALL[i:]), FULL + "," + STD),
)
def ft_moments(spark, sf):
    """Moments of five batches, each computed alone, then merged."""
    df = standardised(spark, sf)
    folds = split.stratified_folds(df, 5)
    parts = [features.moment_table(folds.where(F.col("fold") == i).drop("fold"), list(SMALL)) for i in range(5)]
    return rounded(features.merge_moments(parts))


@query(
    "ft_class_scatter",
    with_views(["ds"], " UNION ALL ".join(
        f"SELECT label, count(*) AS n, '{a}' AS a, '{b}' AS b, {r(f'avg({a})')} AS mean_a, {r(f'avg({b})')} AS mean_b,"
        f" {r(f'covar_pop({a}, {b}) * count(*)')} AS scatter FROM sd GROUP BY label"
        for i, a in enumerate(SMALL) for b in SMALL[i:]), FULL + "," + STD),
)
def ft_class_scatter(spark, sf):
    return rounded(features.class_scatter(standardised(spark, sf), list(SMALL)))


@query(
    "ft_apply_test",
    with_views(["ds"], f"SELECT row_id, {_terms(0)}, label FROM sdt", SPLIT
               + f", fr AS ({filled_sql('tr', 'tr')}), ft AS ({filled_sql('te', 'tr')}), st AS (SELECT "
               + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in SMALL) + " FROM fr), sdt AS (SELECT row_id, label, "
               + ", ".join(f"({c} - a_{c}) / s_{c} AS {c}" for c in SMALL) + " FROM ft, st)"),
)
def ft_apply_test(spark, sf):
    train, test = split_tables(spark, sf)
    fill = impute.fit_imputer(train, "mean")
    train, test = (fill.apply(d).select("row_id", *SMALL, "label") for d in (train, test))
    scaler = scale.fit_scaler(train, "standard")
    built = features.fit_features(scaler.apply(train), "polynomial")
    return rounded(built.apply(scaler.apply(test)), digits=5)


# ---------------------------------------------------------------- selection


@query(
    "fs_variance",
    with_views(["ds"], " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {g(f'var_pop({c})')} AS variance, max({c}) > min({c}) AS kept FROM fu" for c in NUM), FULL),
)
def fs_variance(spark, sf):
    df = complete(spark, sf)
    stats = select.column_stats(df)
    kept = select.by_variance(df, stats=stats)
    out = spark.createDataFrame([(c, stats[c]["var"], c in kept) for c in NUM], "feature string, variance double, kept boolean")
    return out.withColumn("variance", sig("variance"))


_per = " UNION ALL ".join(f"SELECT '{c}' AS feature, label, {c} AS v FROM fu" for c in SMALL)
ANOVA = f"""lf AS ({_per}), gm AS (SELECT feature, avg(v) AS m, count(*) AS n, count(DISTINCT label) AS k FROM lf GROUP BY feature),
cm AS (SELECT feature, label, avg(v) AS mc, count(*) AS nc, var_pop(v) * count(*) AS w FROM lf GROUP BY feature, label),
fs AS (SELECT c.feature, any_value(g.n) AS n, any_value(g.k) AS k, sum(c.nc * (c.mc - g.m) * (c.mc - g.m)) AS b, sum(c.w) AS w
       FROM cm c JOIN gm g ON c.feature = g.feature GROUP BY c.feature),
sc AS (SELECT feature, (b / (k - 1)) / (w / (n - k)) AS f FROM fs)"""


@query(
    "fs_anova_f",
    with_views(["ds"], f"SELECT feature, {r('f')} AS f_score, row_number() OVER (ORDER BY f DESC) <= 3 AS kept FROM sc", FULL + "," + ANOVA),
)
def fs_anova_f(spark, sf):
    df = complete(spark, sf)
    kept = select.by_anova(df)
    scores = select.anova_scores(df.select("row_id", *SMALL, "label"))
    return scores.select("feature", rnd("f_score").alias("f_score"), F.col("feature").isin(*kept).alias("kept"))


Y = "CAST(left(label, 1) AS DOUBLE)"


@query(
    "fs_pearson",
    with_views(["ds"], " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'corr({c}, {Y})')} AS correlation, abs(corr({c}, {Y})) > 0.005 AS kept FROM fu" for c in SMALL)
        + " UNION ALL SELECT 'f_const', NULL, false", FULL),
)
def fs_pearson(spark, sf):
    df = complete(spark, sf).withColumn("label", F.substring("label", 1, 1))
    kept = select.by_pearson(df, 0.005)
    out = select.label_correlations(df)
    return out.select("feature", rnd("correlation").alias("correlation"), F.col("feature").isin(*kept).alias("kept"))


@query(
    "fs_apply_to_test",
    with_views(["ds"], "SELECT row_id, " + ", ".join(f"{r(c)} AS {c}" for c in SMALL) + ", c_segment, c_status, label FROM ft",
               SPLIT + f", ft AS ({filled_sql('te', 'tr')})"),
)
def fs_apply_to_test(spark, sf):
    train, test = split_tables(spark, sf)
    fill = impute.fit_imputer(train, "mean")
    kept = select.select_features(fill.apply(train))
    return rounded(select.keep_columns(fill.apply(test), kept))


# ---------------------------------------------------------------- fit and apply a chain

CHAIN = SPLIT + f""", fr0 AS ({filled_sql('tr', 'tr')}), ft0 AS ({filled_sql('te', 'tr')}),
k1 AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT c_segment AS v FROM fr0) x),
k2 AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT c_status AS v FROM fr0) x),
fr AS (SELECT f.* EXCLUDE (c_segment, c_status), CAST(k1.code AS DOUBLE) AS c_segment, CAST(k2.code AS DOUBLE) AS c_status
       FROM fr0 f JOIN k1 ON f.c_segment = k1.v JOIN k2 ON f.c_status = k2.v),
ft AS (SELECT f.* EXCLUDE (c_segment, c_status), CAST(coalesce(k1.code, -1) AS DOUBLE) AS c_segment, CAST(coalesce(k2.code, -1) AS DOUBLE) AS c_status
       FROM ft0 f LEFT JOIN k1 ON f.c_segment = k1.v LEFT JOIN k2 ON f.c_status = k2.v)"""
READY = SMALL + CAT
CHAIN_STATS = ", st AS (SELECT " + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in READY) + " FROM fr)"


def fitted_chain(train):
    return chain.fit_chain(train, chain.steps_of(["I", "E", "N"], ["mean", "label", "standard"]))


@query(
    "chain_fit_apply",
    with_views(["ds"], "SELECT row_id, " + ", ".join(r(f"({c} - a_{c}) / s_{c}") + f" AS {c}" for c in READY) + ", label FROM ft, st",
               CHAIN + CHAIN_STATS),
)
def chain_fit_apply(spark, sf):
    train, test = split_tables(spark, sf)
    return rounded(fitted_chain(train).apply(test))
