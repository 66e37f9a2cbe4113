"""Choose a step sequence for a table from past results and a bounded number of trials.

Similar data sets give candidate orders with default operators; all are scored once and the
best few are searched further. The search log is a table in the shared folder: each round one
query over it proposes untried operator lists for every order (``plans.proposals``), they are
scored as concurrent Spark jobs over shared prefixes, and their rows are appended. Finalists
close to the best are compared by cross-validation. Random choices are hashes of (seed, round,
order, prefix), so a rerun repeats the same trials.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.operators import profile, split
from winnow.operators.metrics import classification_metrics
from winnow.operators.models import fit_model, known_model
from winnow.plans import knowledge as K
from winnow.plans import ledger as L
from winnow.plans import proposals
from winnow.plans import trials as TR
from winnow.plans.chain import fit_chain, steps_of
from winnow.plans.evaluate import HoldOut, Trial, cross_validate, ledger_frame
from winnow.roles import ROLES, Roles
from winnow.session import cut_lineage, shared_folder
from winnow.sources import sinks
from winnow.sources.tables import read_labelled_csv

SAMPLE_ABOVE = 10_000


@dataclass
class Choice:
    order: list[str]
    ops: list[str]
    score: float
    ledger: DataFrame
    details: dict = field(default_factory=dict)


class SearchLog:
    """The rows (run_id, iteration, step_order, ops, score, reason) of a search, as Parquet."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"

    def add(self, trials: list[tuple[int, int, Trial]]) -> DataFrame:
        """Append (run_id, iteration, trial) rows; returns the whole log."""
        rows = [(run, i, "_".join(t.order), [o or "none" for o in t.ops], t.score, t.reason) for run, i, t in trials]
        ledger_frame(self.spark, rows).coalesce(1).write.mode("append").parquet(self.path)
        return self.table()

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def candidate_orders(
    train: DataFrame, kb: DataFrame, recorded: DataFrame, roles: Roles = ROLES,
    dataset: str | None = None, similar: int = 5,
) -> tuple[list[tuple[list[str], list[str]]], dict]:
    """Candidates from the most similar data sets that have recorded sequences."""
    flags = profile.need_flags(train, roles).first()
    me = profile.table_measures(train, roles=roles).withColumn("dataset", F.lit(dataset).cast("string"))
    near = K.nearest_datasets(kb, me, similar, with_history=recorded)
    names = [r["dataset"] for r in near.orderBy("place").collect()]
    cleaned = K.clean_sequences(
        recorded.where(F.col("dataset").isin(*names)), flags["need_i"], flags["need_o"], flags["need_e"]
    )
    found = K.candidates(K.distinct_sequences(cleaned)).orderBy(F.desc("n"), "step_order").collect()
    sources = {tuple(r["step_order"]): list(r["sources"]) for r in K.order_sources(cleaned).collect()}
    pairs = [(list(r["step_order"]), list(r["ops"])) for r in found]
    return pairs, {"similar": names, "flags": flags.asDict(), "sources": sources}


def select_sequence(
    train: DataFrame, kb: DataFrame, recorded: DataFrame, model: str = "LogisticRegression",
    metric: str = "accuracy", max_iter: int = 30, batch: int = 4, sample_rows: int = 5000,
    orders: int = 3, folds: int = 4, history: DataFrame | None = None, dataset: str | None = None,
    roles: Roles = ROLES, seed: int = 0, workers: int = 8, sample_above: int = SAMPLE_ABOVE,
) -> Choice:
    """A table of more than ``sample_above`` rows is tried (and its finalists cross-validated) on
    ``sample_rows`` of them, drawn by hash."""
    spark = train.sparkSession
    known_model(model)
    pairs, details = candidate_orders(train, kb, recorded, roles, dataset)
    if not pairs:
        raise ValueError("no recorded sequence fits this table")
    if train.count() > sample_above:
        train = split.sample_fixed(train, sample_rows, seed, roles)
    # at most ``sample_above`` rows: one task each for the many small jobs of the trials
    data = cut_lineage(train.coalesce(1)).persist()
    log = SearchLog(spark)
    try:
        with HoldOut(data, model, metric, roles, seed, bounded=True) as holdout:
            first = holdout.run_many(pairs, workers)
            best = sorted(first, key=lambda t: -t.score)[:orders]
            ledger = log.add([(i, 1, t) for i, t in enumerate(best)])
            lists = proposals.operator_lists(spark, [t.order for t in best], K.allowed(model)).persist()
            edges = starting_edges(spark, history, [t.order for t in best], details["sources"])
            done, round_no = {i: 1 for i in range(len(best))}, 0
            while True:
                round_no += 1
                planned = proposals.next_lists(ledger, lists, edges, round_no, batch, max_iter, seed).orderBy("run_id", "place").collect()
                if not planned:
                    break
                scored = holdout.run_many([(r["step_order"].split("_"), list(r["ops"])) for r in planned], workers)
                rows = []
                for r, trial in zip(planned, scored):
                    done[r["run_id"]] += 1
                    rows.append((r["run_id"], done[r["run_id"]], trial))
                ledger = log.add(rows)
            lists.unpersist()
        finalists = L.finalists(ledger).orderBy(F.desc("best_score"), "step_order", "ops").collect()
        final = [(r["step_order"].split("_"), list(r["ops"])) for r in finalists]
        checked = cross_validate(data, final, model, folds, metric, roles, seed, workers, bounded=True)
        best = max(checked, key=lambda t: t.score)
    finally:
        data.unpersist()
    details["candidates"] = pairs
    details["finalists"] = [(t.order, t.ops, t.score) for t in checked]
    return Choice(best.order, best.ops, best.score, ledger, details)


def starting_edges(spark: SparkSession, history: DataFrame | None, orders: list[list[str]], sources: dict) -> DataFrame:
    """(run_id, prev, next, score): transitions of past trials for each order; none without history."""
    schema = "run_id long, prev string, next string, score double"
    out = spark.createDataFrame([], schema)
    for i, order in enumerate(orders if history is not None else []):
        table = TR.transition_table(history, sources.get(tuple(order), []), order, top_k=500)
        out = out.unionByName(table.select(F.lit(i).cast("long").alias("run_id"), "prev", "next", F.col("score").cast("double").alias("score")))
    return cut_lineage(out) if history is not None else out


def run_report(
    df: DataFrame, kb: DataFrame, recorded: DataFrame, out_dir: str | None = None,
    model: str = "LogisticRegression", metric: str = "accuracy", roles: Roles = ROLES, fmt: str = "csv",
    name: str = "dataset", test_part: int = 5, split_seed: int | None = None, log_dir: str | None = None, **search,
) -> tuple[Choice, DataFrame]:
    """Split (one part in ``test_part`` is held out), choose, refit on all train rows, predict the
    test rows, write and score. Without ``out_dir`` nothing is written; the tables that runs share
    (search log, global curve, records) go to ``log_dir``, or else to ``out_dir``."""
    begin = time.time()
    spark = df.sparkSession
    data = split.stratified_split(df, test_part, split_seed, roles=roles).persist()
    try:
        train, test = split.divide(data)
        choice = select_sequence(train, kb, recorded, model, metric, roles=roles, **search)
        chain = fit_chain(train, steps_of(choice.order, choice.ops), roles)
        ready_train, ready_test = chain.apply(train), chain.apply(test)
        predictions = fit_model(ready_train, model, roles).predict(ready_test)
        row = classification_metrics(predictions, roles.label).first().asDict()
        metrics = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row))
        if out_dir is not None:
            paths = sinks.write_prepared(ready_train, ready_test, out_dir, fmt)
            best = {"order": choice.order, "ops": choice.ops}
            sinks.write_record(spark, best, f"{out_dir}/best_sequence")
            key, shared = {"dataset": name, "model": model}, log_dir or out_dir
            sinks.write_batch_result(
                metrics, f"{shared}/metrics", key, metric=metric, seconds=time.time() - begin,
                best_sequence="_".join(choice.order) + ":" + ">".join(o or "none" for o in choice.ops), best_score=choice.score,
            )
            sinks.write_keyed(choice.ledger, f"{shared}/search_log", key)
            sinks.write_keyed(L.global_curve(choice.ledger), f"{shared}/global_curve", key)
            report = {
                "dataset": name, "model": model, "metric": metric, "best": best, "search_score": choice.score,
                "test_metrics": row, "similar": choice.details["similar"], "flags": choice.details["flags"],
                "finalists": choice.details["finalists"], "outputs": paths,
            }
            sinks.write_record(spark, report, f"{out_dir}/run_report")
        return choice, metrics
    finally:
        data.unpersist()


def run_batch(
    spark: SparkSession, files: dict[str, str], kb: DataFrame, recorded: DataFrame, out_dir: str, target: str | None = None, **options
) -> DataFrame:
    """One run for each labelled CSV file ({name: path}); the records of all runs. The search logs,
    curves and records of all files share tables below ``out_dir``, one partition for each data
    set and model, so a rerun replaces its rows; prepared tables and reports go to ``out_dir``/name."""
    for name, path in files.items():
        df, roles = read_labelled_csv(spark, path, target=target)
        run_report(df, kb, recorded, f"{out_dir}/{name}", roles=roles, name=name, log_dir=out_dir, **options)
    return spark.read.parquet(f"{out_dir}/metrics")
