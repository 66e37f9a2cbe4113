"""Evidence tables from evaluated step sequences: (dataset, trial_id, logic_pipe, phy_pipe,
accuracy), where the two sequence columns are arrays or '_'-joined text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.functions.ranks import running_max_before
from winnow.operators.profile import stacked

# The scaling methods a frequency row reports, in order.
SCALING_METHODS = (
    "none", "standard", "minmax", "maxabs", "robust", "normalizer", "power", "quantile", "kbins",
)
START = "__START__"


def for_datasets(trials: DataFrame, names: list[str]) -> DataFrame:
    """History of the named data sets; a name without history simply adds nothing."""
    return trials.where(F.col("dataset").isin(*names)) if names else trials.limit(0)


def top_trials(trials: DataFrame, k: int, score: str = "accuracy", key: str = "trial_id") -> DataFrame:
    return trials.orderBy(F.desc(score), key).limit(k)


def strategy_frequency(
    trials: DataFrame, columns: list[str], score: str = "accuracy"
) -> DataFrame:
    """Score-weighted use of each method per column; NULL counts as 'none'."""
    long = stacked(trials, columns, [score], "string").select(
        F.col("feature"), F.coalesce("value", F.lit("none")).alias("method"), F.col(score).alias("_w")
    )
    return _spread(long)


def strategy_frequency_ranked(
    trials: DataFrame, columns: list[str], k: int = 100, beta: float = 1.0, score: str = "accuracy"
) -> DataFrame:
    """The same over the k best trials, each weighted by score * exp(-beta*rank)/sum, with
    rows scaled to sum 1 (a row of zeros stays zero). Ranks run over k rows only."""
    top = top_trials(trials, k, score)
    order = Window.orderBy(F.desc(score), "trial_id")
    ranked = top.withColumn("_e", F.exp(-F.lit(beta) * (F.row_number().over(order) - 1)))
    weighted = ranked.withColumn("_w", F.col(score) * F.col("_e") / F.sum("_e").over(Window.partitionBy()))
    long = stacked(weighted, columns, ["_w"], "string").select(
        "feature", F.coalesce("value", F.lit("none")).alias("method"), "_w"
    )
    out = _spread(long)
    total = sum((F.col(m) for m in SCALING_METHODS[1:]), F.col(SCALING_METHODS[0]))
    safe = F.when(total == 0, F.lit(1e-9)).otherwise(total)
    return out.select("feature", *[(F.col(m) / safe).alias(m) for m in SCALING_METHODS])


def _spread(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("method") == m, F.col("_w"))), F.lit(0.0)).alias(m)
            for m in SCALING_METHODS
        ]
    )


def with_strategies(profile: DataFrame, frequency: DataFrame, prefix: str = "strategy_") -> DataFrame:
    """Column profiles joined with the method frequencies of the same column."""
    named = frequency.select(
        F.concat(F.lit("col_"), F.col("feature")).alias("_f"),
        *[F.col(m).alias(prefix + m) for m in SCALING_METHODS],
    )
    same = F.when(F.col("feature").startswith("col_"), F.col("feature")).otherwise(
        F.concat(F.lit("col_"), F.col("feature"))
    )
    return profile.join(named, same == F.col("_f")).drop("_f", "feature", "dtype")


def merge_tables(tables: list[DataFrame], drop: tuple[str, ...] = ("is_constant",)) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.drop(*drop)


def _steps(trials: DataFrame, name: str) -> Column:
    if isinstance(trials.schema[name].dataType, T.ArrayType):
        return F.col(name)
    return F.split(F.col(name), "_")


def project_on(trials: DataFrame, target: list[str]) -> DataFrame:
    """Cut every trial down to the steps of ``target``. Trials that share no step, or have
    the shared ones in another order, are left out; a step without an operator of its own
    takes the last one."""
    want = F.array(*[F.lit(s) for s in target])
    logic, phy = _steps(trials, "logic_pipe"), _steps(trials, "phy_pipe")
    base = trials.withColumn("_l", logic).withColumn("_p", phy).withColumn("logic", F.array_intersect("_l", want))
    ordered = base.where(
        (F.size("logic") > 0) & (F.col("logic") == F.array_intersect(want, F.col("_l")))
    )
    pick = F.transform(
        "logic",
        lambda s: F.element_at(
            F.col("_p"), F.least(F.array_position(F.col("_l"), s).cast("int"), F.size("_p"))
        ),
    )
    keep = [c for c in ("dataset", "trial_id", "accuracy") if c in trials.columns]
    return ordered.withColumn("phy", pick).where("accuracy is not null").select(*keep, "logic", "phy")


def edges(ops: Column) -> Column:
    """[(START, first), (first, second), ...] of an operator array."""
    path = F.concat(F.array(F.lit(START)), ops)
    n = F.size(ops)
    return F.zip_with(
        F.slice(path, F.lit(1), n), F.slice(path, F.lit(2), n),
        lambda a, b: F.struct(a.alias("prev"), b.alias("next")),
    )


def transition_table(
    trials: DataFrame, datasets: list[str] | None, target: list[str], top_k: int = 50
) -> DataFrame:
    """Best accuracy seen on each step from one operator to the next, over the top trials.
    No history gives an empty table."""
    if datasets is not None:
        trials = for_datasets(trials, datasets)
    best = top_trials(project_on(trials, target), top_k)
    return (
        best.select("accuracy", F.explode(edges(F.col("phy"))).alias("e"))
        .groupBy("e.prev", "e.next")
        .agg(F.max("accuracy").alias("score"))
    )


def transition_update(
    base: DataFrame,
    ledger: DataFrame,
    alpha: float = 1.0,
    allow_start_negative: bool = False,
    allow_negative: bool = True,
    by: tuple = (),
) -> DataFrame:
    """Add alpha * (score - best earlier score of the run) to every edge a trial used. The
    first trial of a run has nothing to compare with and adds nothing. ``by`` names columns of
    both tables (the run) that keep tables of their own."""
    seen = running_max_before(ledger, ["run_id"], "iteration", F.col("score"), "_best")
    gains = seen.where("_best is not null").select((F.col("score") - F.col("_best")).alias("d"), "ops", *by)
    used = gains.select("d", *by, F.explode(edges(F.col("ops"))).alias("e")).select("d", *by, "e.prev", "e.next")
    start_ok = F.lit(True) if allow_start_negative else F.col("d") > 0
    rest_ok = F.lit(True) if allow_negative else F.col("d") > 0
    counted = used.where(F.when(F.col("prev") == START, start_ok).otherwise(rest_ok))
    added = counted.groupBy(*by, "prev", "next").agg((F.lit(alpha) * F.sum("d")).alias("score"))
    both = base.select(*by, "prev", "next", "score").unionAll(added)
    return both.groupBy(*by, "prev", "next").agg(F.sum("score").alias("score"))


def choice_weights(scores: DataFrame, temperature: float | None = 0.5) -> DataFrame:
    """Choice probability of each ``next`` under its ``prev``. One group is the operator
    list of one step, so the windows are small."""
    w = Window.partitionBy("prev")
    s = F.col("score")
    even = F.lit(1.0) / F.count(F.lit(1)).over(w)
    if temperature is not None:
        e = F.exp((s - F.max(s).over(w)) / F.lit(temperature))
        p = e / F.sum(e).over(w)
    else:
        c = F.greatest(s, F.lit(0.0))
        p = F.coalesce(c / F.nullif(F.sum(c).over(w), F.lit(0.0)), even)
    same = F.min(s).over(w) == F.max(s).over(w)
    return scores.select("prev", "next", F.when(same, even).otherwise(p).alias("weight"))


def draw_choice(weights: DataFrame, seed: int, round_no: int) -> DataFrame:
    """One ``next`` per ``prev``: the first whose running weight passes a keyed uniform."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(round_no), F.col("prev")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    w = Window.partitionBy("prev").orderBy("next")
    run = weights.withColumn("_hi", F.sum("weight").over(w)).withColumn("_u", u)
    hit = run.where((F.col("_hi") > F.col("_u")))
    return hit.groupBy("prev").agg(F.min_by("next", "_hi").alias("next"))
