"""Views of the search log: (run_id, iteration, step_order, ops, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.ranks import bucket_ordinal, running_max_before

BUCKET = 50_000


def _text(ops: Column) -> Column:
    return F.concat_ws(">", F.transform(ops, lambda o: F.coalesce(o, F.lit("none"))))


def prefix_scores(ledger: DataFrame, c: float = 2.0) -> DataFrame:
    """Visits, best score and upper confidence value of every operator prefix per run."""
    depth = F.sequence(F.lit(0), F.size("ops"))
    rows = ledger.select(
        "run_id", "score", F.explode(F.transform(depth, lambda i: F.slice(F.col("ops"), F.lit(1), i))).alias("p")
    )
    stats = rows.groupBy("run_id", _text(F.col("p")).alias("prefix"), F.size("p").alias("depth")).agg(
        F.count(F.lit(1)).alias("visits"), F.greatest(F.max("score"), F.lit(0.0)).alias("best_score")
    )
    parent = stats.select(
        "run_id", F.col("prefix").alias("_p"), (F.col("depth") + 1).alias("depth"), F.col("visits").alias("parent_visits")
    )
    up = F.when(F.col("depth") <= 1, F.lit("")).otherwise(
        F.regexp_replace("prefix", ">[^>]*$", "")
    )
    child = stats.where("depth > 0").withColumn("_p", up)
    ucb = F.col("best_score") + F.lit(c) * F.sqrt(F.log("parent_visits") / F.col("visits"))
    return child.join(parent, ["run_id", "_p", "depth"]).select(
        "run_id", "prefix", "depth", "visits", "best_score", "parent_visits", ucb.alias("ucb")
    )


def running_best(ledger: DataFrame) -> DataFrame:
    """Best score so far and the number of rounds since it last rose, per run and round."""
    seen = running_max_before(ledger, ["run_id"], "iteration", F.col("score"), "_before")
    up = F.col("_before").isNull() | (F.col("score") > F.col("_before"))
    numbered = bucket_ordinal(
        seen.withColumn("_up", up).withColumn("_b", F.floor(F.col("iteration") / F.lit(BUCKET))),
        ["run_id"], "_b", ["iteration"], "_n",
    )
    last = running_max_before(
        numbered.drop("_b"), ["run_id"], "iteration", F.when(F.col("_up"), F.col("_n")), "_last"
    )
    at = F.when(F.col("_up"), F.col("_n")).otherwise(F.col("_last"))
    return last.select(
        "run_id", "iteration", "step_order", "ops", "score",
        F.greatest(F.col("_before"), F.col("score")).alias("best_score"),
        F.col("_up").alias("improved"),
        (F.col("_n") - at).alias("no_improve"),
    )


def global_curve(ledger: DataFrame) -> DataFrame:
    """Per round, the run with the best score so far (lowest run on ties) and the sequence
    that gave it. Best-so-far carries its sequence along, as one ordered struct."""
    best = running_best_sequences(ledger)
    top = best.groupBy("iteration").agg(
        F.min(F.struct((-F.col("best_score")).alias("s"), "run_id", "best_order", "best_ops")).alias("t")
    )
    return top.select(
        "iteration", (-F.col("t.s")).alias("global_best_score"), F.col("t.run_id").alias("run_id"),
        F.col("t.best_order").alias("best_order"), F.col("t.best_ops").alias("best_ops"),
    )


def running_best_sequences(ledger: DataFrame) -> DataFrame:
    mark = F.struct(F.col("score"), (-F.col("iteration")).alias("i"), F.col("step_order"), F.col("ops"))
    # the struct orders by score, then by earlier round, so the maximum is the first best
    seen = running_max_before(
        ledger.withColumn("_m", mark), ["run_id"], "iteration", F.col("_m"), "_b"
    )
    now = F.when(F.col("_b").isNull() | (F.col("_m") > F.col("_b")), F.col("_m")).otherwise(F.col("_b"))
    return seen.withColumn("_x", now).select(
        "run_id", "iteration", F.col("_x.score").alias("best_score"),
        F.col("_x.step_order").alias("best_order"), F.col("_x.ops").alias("best_ops"),
    )


def finalists(ledger: DataFrame, top: int = 5, margin: float = 0.01) -> DataFrame:
    """Sequences that were best in their run at some point, one row each, the ``top`` by
    score, kept when within ``margin`` of the best. Order and operators both tell apart."""
    improved = running_best(ledger).where("improved")
    best = (
        improved.groupBy("step_order", "ops")
        .agg(F.max("score").alias("best_score"))
        .orderBy(F.desc("best_score"), "step_order", "ops")
        .limit(top)
        .withColumn("_t", F.lit(0))
    )
    peak = best.groupBy("_t").agg(F.max("best_score").alias("_m"))
    return best.join(peak, "_t").where(F.col("best_score") >= F.col("_m") - margin).select("step_order", "ops", "best_score")


def untried(ledger: DataFrame, space: DataFrame) -> DataFrame:
    """Allowed next operators not yet tried under each visited prefix. ``space`` has
    (step, op); step_order is '_'-joined text."""
    nodes = ledger.select(
        "step_order", "ops", F.explode(F.sequence(F.lit(0), F.size("ops") - 1)).alias("depth")
    ).select(
        "step_order",
        _text(F.slice("ops", F.lit(1), F.col("depth"))).alias("prefix"),
        F.get(F.split("step_order", "_"), F.col("depth")).alias("step"),
        F.coalesce(F.get("ops", F.col("depth")), F.lit("none")).alias("op"),
    )
    tried = nodes.distinct()
    places = tried.select("step_order", "prefix", "step").distinct()
    return (
        places.join(F.broadcast(space.select("step", "op")), "step")
        .join(tried, ["step_order", "prefix", "step", "op"], "left_anti")
        .select("step_order", "prefix", "step", "op")
    )
