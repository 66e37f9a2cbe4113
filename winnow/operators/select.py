"""Feature selection. Each rule is one aggregate and returns the numeric columns to keep;
categorical (and vector) columns always stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions import moments as M
from winnow.operators.profile import stacked
from winnow.roles import ROLES, Roles, col, ident

METHODS = ("variance", "univariate", "pearson")


def keep_columns(df: DataFrame, kept: list[str], roles: Roles = ROLES) -> DataFrame:
    """Project to the kept features that exist here, in this table's column order."""
    wanted = set(kept)
    kept = [*roles.ids(df), *[c for c in roles.features(df) if c in wanted], *roles.labels(df)]
    return df.selectExpr(*[ident(c) for c in kept])


def column_stats(df: DataFrame, roles: Roles = ROLES) -> dict:
    """{numeric column: row of lo, hi, avg, std (population), var} from one aggregate."""
    cols = roles.numeric(df)
    if not cols:
        return {}
    # one expression as text: a chain takes these statistics many times, and building them
    # column by column costs more than a small table's job
    spread = "CASE WHEN min({x}) = max({x}) THEN 0D ELSE {f}({x}) END"
    cells = ", ".join(
        "named_struct('lo', min({x}), 'hi', max({x}), 'avg', avg({x}), 'std', {std}, 'var', {var})".format(
            x=x, std=spread.format(x=x, f="stddev_pop"), var=spread.format(x=x, f="var_pop")
        )
        for x in (f"cast({ident(c)} as double)" for c in cols)
    )
    return dict(zip(cols, df.agg(F.expr(f"array({cells})").alias("cells")).first()["cells"]))


def by_variance(
    df: DataFrame, threshold: float = 0.0, roles: Roles = ROLES, stats: dict | None = None
) -> list[str]:
    """Columns whose population variance exceeds the threshold; all of them if none does."""
    cols = roles.numeric(df)
    stats = column_stats(df, roles) if stats is None else stats

    # at threshold 0 the range decides: it is exact where a variance may round above 0
    def passes(s):
        if s["lo"] is None:
            return False
        return s["hi"] > s["lo"] if threshold == 0 else s["var"] > threshold

    return [c for c in cols if passes(stats[c])] or cols


def anova_scores(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """One-way F statistic per numeric column. Class means are centred on the column mean so
    that the two sums of squares do not cancel."""
    cols = roles.numeric(df)
    long = stacked(df.where(col(roles.label).isNotNull()), cols, [roles.label], "double").where("value is not null")
    per = long.groupBy("feature", roles.label).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    total = per.groupBy("feature").agg(
        F.sum("n").alias("nt"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mt"),
        F.count(F.lit(1)).alias("k"),
    )
    parts = per.join(total, "feature").groupBy("feature").agg(
        F.first("nt").alias("nt"),
        F.first("k").alias("k"),
        F.sum(F.col("n") * (F.col("m") - F.col("mt")) * (F.col("m") - F.col("mt"))).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
    )
    msb = F.col("between") / F.nullif((F.col("k") - 1).cast("double"), F.lit(0.0))
    msw = F.col("within") / F.nullif((F.col("nt") - F.col("k")).cast("double"), F.lit(0.0))
    return parts.select("feature", (msb / F.nullif(msw, F.lit(0.0))).alias("f_score"))


def by_anova(df: DataFrame, share: float = 0.8, roles: Roles = ROLES) -> list[str]:
    """Drop constant columns, then keep the best ``share`` of the rest (at least one)."""
    cols = by_variance(df, 0.0, roles)
    if not cols:
        return []
    slim = df.select(*[col(c) for c in cols], col(roles.label))
    scores = {r["feature"]: r["f_score"] for r in anova_scores(slim, roles).collect()}
    k = max(1, int(len(cols) * share))
    # a score that cannot be computed ranks last; ties keep the later column
    ranked = sorted(
        range(len(cols)),
        key=lambda i: (scores.get(cols[i]) is not None, scores.get(cols[i]) or 0.0, i),
        reverse=True,
    )
    best = {cols[i] for i in ranked[:k]}
    return [c for c in cols if c in best]


def label_correlations(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """Correlation of each numeric column with a numeric label; a text label is refused."""
    y = F.expr(f"try_cast(`{roles.label}` as double)")
    cols = roles.numeric(df)
    bad = F.count(F.when(col(roles.label).isNotNull() & y.isNull(), 1)).alias("bad")
    r = df.agg(bad, *[M.pair_correlation(col(c), y).alias(f"r{i}") for i, c in enumerate(cols)]).first()
    if r["bad"]:
        raise ValueError("the correlation rule needs a numeric label")
    rows = [(c, r[f"r{i}"]) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "feature string, correlation double")


def by_pearson(df: DataFrame, threshold: float = 0.1, roles: Roles = ROLES) -> list[str]:
    return [
        r["feature"]
        for r in label_correlations(df, roles).collect()
        if r["correlation"] is not None and abs(r["correlation"]) > threshold
    ]


def select_features(
    df: DataFrame,
    method: str = "variance",
    var_threshold: float = 0.0,
    pearson_threshold: float = 0.1,
    k: float = 0.8,
    roles: Roles = ROLES,
) -> list[str]:
    """Names of the features to keep, in data order: numeric ones that pass, then the rest."""
    if method == "variance":
        kept = by_variance(df, var_threshold, roles)
    elif method == "univariate":
        kept = by_anova(df, k, roles)
    elif method == "pearson":
        kept = by_pearson(df, pearson_threshold, roles)
    else:
        raise ValueError(f"unknown selection method: {method}")
    num = set(roles.numeric(df))
    return [c for c in roles.features(df) if c not in num or c in set(kept)]
