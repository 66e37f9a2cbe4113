"""What to try next, from the search log alone.

One query per round ranks every untried operator list of every run. A list is ranked by a key for
each depth, the first deciding:

* where every choice of a slot has been tried under the list's prefix, the upper confidence value
  of the choice;
* where some have not, those come first, by weight (or, in a share of rounds, evenly);
* beyond, by weight.

A choice by weight is a draw: the key is score / temperature plus Gumbel noise hashed from (seed,
round, run, prefix), so the greatest key is a draw in proportion to exp(score / temperature), the
k greatest are k draws without replacement, and a rerun draws the same. Scores of transitions
come from past results and are moved by every trial of the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.plans import ledger as L
from winnow.plans import trials as TR

EXPLORE = 0.2
PATIENCE = 50
TEMPERATURE = 0.5
SPREAD = 2.0
_UNIT = 1 << 40


def operator_lists(spark: SparkSession, orders: list[list[str]], space: dict) -> DataFrame:
    """(run_id, step_order, ops, sizes): every operator list of each order, and the slot sizes.
    Bounded by the product of the slots of ``space``."""
    rows = [(i, "_".join(order), [list(space[s]) for s in order]) for i, order in enumerate(orders)]
    df = spark.createDataFrame(rows, "run_id long, step_order string, slots array<array<string>>")
    df = df.withColumn("ops", F.array().cast("array<string>"))
    for depth in range(max((len(o) for o in orders), default=0)):
        slot = F.coalesce(F.get("slots", F.lit(depth)), F.array(F.lit(None).cast("string")))
        df = df.withColumn("op", F.explode(slot)).withColumn(
            "ops", F.when(F.lit(depth) < F.size("slots"), F.concat("ops", F.array("op"))).otherwise(F.col("ops"))
        ).drop("op")
    return df.select("run_id", "step_order", "ops", F.transform("slots", F.size).alias("sizes"))


def uniform(*key: Column) -> Column:
    """A number in (0, 1) hashed from the key."""
    return (F.pmod(F.xxhash64(*key), F.lit(_UNIT)) + 0.5) / float(_UNIT)


def next_lists(
    ledger: DataFrame, lists: DataFrame, edges: DataFrame, round_no: int, batch: int, max_iter: int, seed: int = 0,
    explore: float = EXPLORE,
) -> DataFrame:
    """(run_id, step_order, ops, place): up to ``batch`` untried lists of each open run. A run is open
    while it has fewer than ``max_iter`` trials, the last PATIENCE of them not all in vain.
    ``ledger`` (run_id, iteration, ops, score), ``edges`` (run_id, prev, next, score)."""
    state = ledger.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("done"),
        # the earliest of the best trials; those after it brought nothing
        (F.max("iteration") - F.min_by("iteration", F.struct(-F.col("score"), F.col("iteration")))).alias("stale"),
    )
    room = state.where((F.col("done") < max_iter) & (F.col("stale") < PATIENCE)).select(
        "run_id", F.least(F.lit(batch), F.lit(max_iter) - F.col("done")).alias("room")
    )
    untried = lists.join(F.broadcast(room), "run_id").join(F.broadcast(ledger.select("run_id", "ops")), ["run_id", "ops"], "left_anti")

    stats = L.prefix_scores(ledger, SPREAD).select("run_id", "prefix", "depth", "ucb")
    parent = F.when(F.col("depth") <= 1, F.lit("")).otherwise(F.regexp_replace("prefix", ">[^>]*$", ""))
    # choices that the slot does not offer (a recorded default) leave it as open as before
    slots = lists.select("run_id", F.posexplode("ops").alias("pos", "op")).distinct().select("run_id", (F.col("pos") + 1).alias("depth"), "op")
    offered = stats.withColumn("op", F.element_at(F.split("prefix", ">"), -1)).join(F.broadcast(slots), ["run_id", "depth", "op"], "left_semi")
    tried_below = offered.groupBy("run_id", parent.alias("above"), "depth").agg(F.count(F.lit(1)).alias("tried"))
    moved = TR.transition_update(edges, ledger, by=("run_id",))

    at = F.sequence(F.lit(1), F.size("ops"))
    path = F.concat(F.array(F.lit(TR.START)), "ops")
    steps = untried.select(
        "run_id", "step_order", "ops", "room",
        F.explode(F.transform(at, lambda d: F.struct(
            d.alias("depth"), F.get("sizes", d - 1).alias("size"),
            F.get(path, d - 1).alias("prev"), F.get("ops", d - 1).alias("next"),
            F.array_join(F.slice("ops", F.lit(1), d - 1), ">").alias("above"),
            F.array_join(F.slice("ops", F.lit(1), d), ">").alias("prefix"),
        ))).alias("s"),
    ).select("run_id", "step_order", "ops", "room", "s.*")
    known = (
        steps.join(F.broadcast(tried_below), ["run_id", "above", "depth"], "left")
        .join(F.broadcast(stats), ["run_id", "prefix", "depth"], "left")
        .join(F.broadcast(moved), ["run_id", "prev", "next"], "left")
    )
    where = (F.lit(seed), F.lit(round_no), F.col("run_id"), F.col("step_order"))
    noise = -F.log(-F.log(uniform(*where, F.col("prefix"))))
    drawn = F.coalesce("score", F.lit(0.0)) / TEMPERATURE + noise
    whole = F.coalesce("tried", F.lit(0)) == F.col("size")
    leaving = F.col("tried").isNotNull() & ~whole
    even = leaving & (uniform(*where, F.lit("explore")) < explore)
    # an untried choice before any tried one, where some are untried
    key = F.when(whole, F.col("ucb")).when(F.col("ucb").isNotNull(), F.lit(float("-inf"))).when(even, noise).otherwise(drawn)
    ranked = known.groupBy("run_id", "step_order", "ops").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("depth", key.alias("key")))), lambda s: s["key"]).alias("keys"),
        F.first("room").alias("room"),
    )
    order = Window.partitionBy("run_id").orderBy(F.desc("keys"), "ops")
    return ranked.withColumn("place", F.row_number().over(order)).where("place <= room").select("run_id", "step_order", "ops", "place")
