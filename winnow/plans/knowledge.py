"""Past results as tables: similar data sets, their recorded step sequences, and the
candidate sequences made from them.

Recorded sequences have (dataset, pos, score, step_order, ops): ``step_order`` leaves out
the imputer, ``ops`` starts with it, and a NULL operator skips its step.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.session import cut_lineage, small_table

NOT_MEASURES = ("dataset",)
QUERY_LIMIT = 512
QUERIES_PER_PASS = 32

# Allowed operators per step ("none" skips the step), for each kind of model.
OPERATORS = {
    "I": ("mean", "median", "most_frequent", "knn"),
    "O": ("none", "zscore", "iqr"),
    "E": ("onehot", "label", "binary", "frequency"),
    "N": ("none", "standard", "minmax", "maxabs", "robust", "normalizer", "power", "quantile", "kbins"),
    "FT": (
        "none", "pca", "kernalPCA", "polynomial", "InteractionFeatures", "IncrementalPCA",
        "TruncatedSVD", "RandomTrees",
    ),
    "FS": ("none", "variance", "univariate", "pearson"),
}
NARROWED = {
    "DecisionTree": {"O": ("none",), "N": ("none",), "FT": ("none", "pca", "polynomial")},
    "KNN": {"E": ("onehot", "binary"), "FT": ("none", "pca", "kernel_pca")},
    "SVM": {"E": ("onehot", "binary"), "FT": ("none", "pca", "kernel_pca")},
    "LogisticRegression": {
        "I": ("mean",), "O": ("zscore", "iqr"), "E": ("onehot", "label"), "FS": ("variance",),
    },
}
# Benchmark data set names and ids.
DATASET_IDS = {
    "obesity": 40966,
    "eeg": 1471,
    "ada_prior": 715,
    "pbcseq": 826,
    "jungle_chess_2pcs_raw_endgame_complete": 182,
    "wall-robot-navigation": 1504,
    "USCensus": 4534,
    "house_prices": 42165,
    "page-blocks": 30,
    "microaggregation2": 41156,
    "Run_or_walk_information": 41161,
    "connect-4": 40668,
    "shuttle": 40685,
    "mozilla4": 1045,
    "avila": 40701,
    "google": 41162,
    "pol": 722,
    "abalone": 183,
}


def allowed(model: str) -> dict[str, tuple[str, ...]]:
    return {**OPERATORS, **NARROWED.get(model, {})}


def operator_space(spark: SparkSession, models: list[str] | None = None) -> DataFrame:
    """(model, step, op, ord): what a search may choose from."""
    rows = [
        (m, step, op, i)
        for m in (models or sorted(NARROWED))
        for step, ops in allowed(m).items()
        for i, op in enumerate(ops)
    ]
    return small_table(spark, rows, "model string, step string, op string, ord int")


def space_sizes(space: DataFrame) -> DataFrame:
    """Number of operator combinations per model: the product of the step list lengths."""
    per = space.groupBy("model", "step").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("model").agg(F.round(F.exp(F.sum(F.log(F.col("n"))))).cast("long").alias("combinations"))


def dataset_lookup(df: DataFrame, id_col: str) -> DataFrame:
    names = small_table(df.sparkSession, [(v, k) for k, v in DATASET_IDS.items()], "_id long, dataset_name string")
    return df.join(names, F.col(id_col) == F.col("_id"), "left").drop("_id")


def resolve_metric(recorded: DataFrame, model: str, metric: str, fallback: str = "accuracy") -> DataFrame:
    """Rows of (model, metric) or, where that has none, of (model, fallback). The partition
    filter reads only the two folders; the choice is a max over metric flags."""
    rows = recorded.where((F.col("model") == model) & F.col("metric").isin(metric, fallback))
    found = rows.groupBy("model").agg(F.max((F.col("metric") == metric).cast("int")).alias("_has"))
    chosen = F.when(F.col("_has") == 1, F.lit(metric)).otherwise(F.lit(fallback))
    return rows.join(found, "model").where(F.col("metric") == chosen).drop("_has")


# ---------------------------------------------------------------- similar data sets


def nearest_datasets(
    kb: DataFrame, queries: DataFrame, n: int = 5, with_history: DataFrame | None = None
) -> DataFrame:
    """(query, dataset, similarity, place): the n most similar rows of ``kb`` by cosine of
    standardised measures, missing measures as -1.

    A query that is itself in ``kb`` is left out of both its candidates and the means and
    spreads it is standardised with. Queries are few (one table is prepared at a time), so
    each pass reads ``kb`` once and scores every row against up to 32 of them.
    """
    measures = [c for c in kb.columns if c not in NOT_MEASURES]
    lacking = [c for c in measures if c not in queries.columns]
    if lacking:
        raise ValueError(f"the queries lack measures of the knowledge base: {lacking}")
    # measures may still be a plan over raw tables: compute them once
    flat = cut_lineage(
        kb.select(
            F.col("dataset").cast("string").alias("dataset"),
            *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in measures],
        )
    )
    asked = queries.select(
        F.col("dataset").cast("string").alias("dataset"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in measures],
    ).limit(QUERY_LIMIT + 1).collect()
    if len(asked) > QUERY_LIMIT:
        raise ValueError(f"more than {QUERY_LIMIT} queries; split the query table")
    names = [r["dataset"] for r in asked if r["dataset"] is not None]
    mid = flat.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in measures]).first()
    sums = flat.agg(
        *[F.sum(F.col(c) - mid[c]).alias("s_" + c) for c in measures],
        *[F.sum((F.col(c) - mid[c]) * (F.col(c) - mid[c])).alias("q_" + c) for c in measures],
    ).first()
    own = {r["dataset"]: r for r in flat.where(F.col("dataset").isin(*names)).collect()} if names else {}
    pool = flat if with_history is None else flat.join(
        with_history.select(F.col("dataset").cast("string").alias("dataset")).distinct(), "dataset", "left_semi"
    )
    out = None
    for start in range(0, len(asked), QUERIES_PER_PASS):
        cells = []
        for r in asked[start : start + QUERIES_PER_PASS]:
            cells.append(_score(r, own.get(r["dataset"]), mid, sums, measures))
        part = pool.select("dataset", F.explode(F.array(*cells)).alias("e")).select("e.query", "dataset", "e.similarity")
        out = part if out is None else out.unionAll(part)
    out = out.where(~F.col("query").eqNullSafe(F.col("dataset")))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "dataset")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def _score(query, own, mid, sums, measures):
    rows = mid["n"] - (1 if own is not None else 0)
    weights = []
    for c in measures:
        s, q = sums["s_" + c], sums["q_" + c]
        if own is not None:
            d = own[c] - mid[c]
            s, q = s - d, q - d * d
        m = s / max(rows, 1)
        var = q / max(rows, 1) - m * m
        flat = var <= 1e-20 * max(mid[c] * mid[c], 1.0)
        weights.append((c, mid[c] + m, 1.0 if flat else math.sqrt(var)))
    z = [(query[c] - m) / s for c, m, s in weights]
    length = math.sqrt(sum(v * v for v in z))
    x = [(F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in weights]
    dot = sum((a * F.lit(b) for a, b in zip(x[1:], z[1:])), x[0] * F.lit(z[0]))
    norm = F.sqrt(sum((a * a for a in x[1:]), x[0] * x[0]))
    cosine = F.coalesce(dot / F.nullif(norm * F.lit(length), F.lit(0.0)), F.lit(0.0))
    return F.struct(F.lit(query["dataset"]).cast("string").alias("query"), cosine.alias("similarity"))


# ---------------------------------------------------------------- recorded sequences


def recommend(near: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded sequences of the similar data sets, imputer first in the order; data sets
    without any are kept with a NULL sequence."""
    r = recorded.select("dataset", "pos", "score", "step_order", "ops")
    full = F.when(F.col("ops").isNotNull(), F.concat(F.array(F.lit("I")), F.col("step_order")))
    return near.join(r, "dataset", "left").select(
        "query", "place", "dataset", "pos", "score", full.alias("step_order"), "ops"
    )


def clean_sequences(recorded: DataFrame, need_i: bool, need_o: bool, need_e: bool) -> DataFrame:
    """Drop the steps the table does not need, always drop selection; keep or drop the
    leading imputer."""
    unneeded = ["FS"] + [s for s, need in (("I", need_i), ("O", need_o), ("E", need_e)) if not need]
    tail = F.zip_with(
        "step_order", F.slice("ops", F.lit(2), F.size("ops")),
        lambda s, o: F.struct(s.alias("s"), o.alias("o")),
    )
    kept = F.filter(tail, lambda p: ~p["s"].isin(*unneeded))
    if need_i:
        first = F.array(F.struct(F.lit("I").alias("s"), F.get("ops", F.lit(0)).alias("o")))
        kept = F.concat(first, kept)
    return recorded.where("ops is not null").withColumn("_k", kept).select(
        "dataset", "pos", "score", F.col("_k.s").alias("step_order"), F.col("_k.o").alias("ops")
    )


def distinct_sequences(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("step_order", "ops").agg(
        F.min(F.struct("dataset", "pos")).alias("first"), F.count(F.lit(1)).alias("n")
    ).select("step_order", "ops", F.col("first.dataset").alias("dataset"), F.col("first.pos").alias("pos"), "n")


def order_sources(cleaned: DataFrame) -> DataFrame:
    """Each step order with the sorted set of data sets it came from. Pairs are made
    distinct first, so the collected list is one entry per data set."""
    pairs = cleaned.select("step_order", "dataset").distinct()
    return pairs.groupBy("step_order").agg(F.sort_array(F.collect_list("dataset")).alias("sources"))


def default_operators(sequences: DataFrame) -> DataFrame:
    """Most used operator per step over distinct sequences; ties go to the smaller ``pos``,
    then to the name."""
    pairs = F.arrays_zip(F.col("step_order").alias("s"), F.col("ops").alias("o"))
    long = sequences.select("pos", F.explode(pairs).alias("e")).select("pos", F.col("e.s").alias("step"), F.col("e.o").alias("op"))
    used = long.where("op is not null").groupBy("step", "op").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos")
    )
    top = used.groupBy("step").agg(F.min(F.struct((-F.col("n")).alias("n"), "pos", "op")).alias("t"))
    return top.select("step", F.col("t.op").alias("op"), (-F.col("t.n")).alias("n"))


def candidates(sequences: DataFrame) -> DataFrame:
    """One candidate per distinct order, every step with its default operator; a step that
    has none is left out. The defaults are at most one row per step, so they ride along as
    a map."""
    defaults = default_operators(sequences).groupBy(F.lit(0).alias("_t")).agg(
        F.map_from_entries(F.collect_list(F.struct("step", "op"))).alias("_d")
    )
    orders = sequences.groupBy("step_order").agg(F.count(F.lit(1)).alias("n")).withColumn("_t", F.lit(0))
    joined = orders.join(F.broadcast(defaults), "_t")
    known = joined.withColumn("step_order", F.filter("step_order", lambda s: F.map_contains_key("_d", s)))
    return (
        known.withColumn("ops", F.transform("step_order", lambda s: F.element_at("_d", s)))
        .groupBy("step_order", "ops")
        .agg(F.sum("n").alias("n"))
    )


def sequence_config(sequences: DataFrame) -> DataFrame:
    """Order and operators as an array of (step, method, params)."""
    # Parameters that go with a step.
    none = F.create_map().cast("map<string,string>")
    extra = lambda s: (
        F.when(s == "O", F.create_map(F.lit("threshold"), F.lit("3")))
        .when(s == "FT", F.create_map(F.lit("n_components"), F.lit("2")))
        .when(s == "FS", F.create_map(F.lit("var_threshold"), F.lit("0"), F.lit("pearson_threshold"), F.lit("0.1")))
        .otherwise(none)
    )
    config = F.zip_with(
        "step_order", "ops",
        lambda s, o: F.struct(s.alias("step"), o.alias("method"), extra(s).alias("params")),
    )
    return sequences.withColumn("config", config)
