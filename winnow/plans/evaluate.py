"""Score step sequences by hold-out or k-fold runs.

Trials are independent Spark jobs started from a small thread pool over one cached input,
like a cross-validator; chains that start alike fit and apply their common start once.
"""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators.metrics import METRICS, classification_metrics
from winnow.operators.models import fit_model
from winnow.operators.split import divide, holdout_split, sample_fixed, stratified_folds
from winnow.plans.chain import SharedPrefixes, fit_chain, steps_of
from winnow.roles import ROLES, Roles

log = logging.getLogger(__name__)
FAILED = -1.0


@dataclass
class Trial:
    order: list[str]
    ops: list[str | None]
    score: float
    reason: str | None = None


def score_once(
    train: DataFrame, test: DataFrame, order, ops, model: str, metric: str = "accuracy",
    roles: Roles = ROLES, shared: SharedPrefixes | None = None,
) -> float:
    """Fit the chain and the model on ``train``, score the predictions on ``test``; ``shared``
    holds both where many chains are scored."""
    chain = fit_chain(train, steps_of(order, ops), roles, shared=shared, keep_cached=False)
    ready_train, ready_test = chain.ready or (chain.apply(train), chain.apply(test))
    return score_ready(ready_train, ready_test, model, metric, roles)


def score_prepared(
    data: DataFrame, model: str, metric: str = "accuracy", roles: Roles = ROLES, rows: int | None = None, seed: int = 0
) -> float:
    """Train and score a model on a table that is prepared already: split 3:1, optionally on a
    sample of ``rows`` rows drawn by hash."""
    if rows is not None:
        data = sample_fixed(data, rows, seed, roles)
    data = holdout_split(data, 4, seed, roles).persist()
    try:
        return score_ready(*divide(data), model, metric, roles)
    finally:
        data.unpersist()


def score_ready(train: DataFrame, test: DataFrame, model: str, metric: str, roles: Roles = ROLES) -> float:
    predictions = fit_model(train, model, roles).predict(test)
    if metric == "accuracy":
        hit = F.avg((F.col(roles.label) == F.col("prediction")).cast("double"))
        return float(predictions.agg(hit).first()[0] or 0.0)
    return float(classification_metrics(predictions, roles.label).first()[metric])


def guarded(run, order, ops) -> Trial:
    """A failing trial scores -1 and keeps its reason."""
    try:
        return Trial(list(order), list(ops), run())
    except Exception as e:  # noqa: BLE001 - any failure of a trial is a result
        log.warning("trial %s %s failed: %s", order, ops, str(e).split("\n")[0])
        return Trial(list(order), list(ops), FAILED, str(e).split("\n")[0][:500])


class HoldOut:
    """A cached 3:1 split that many trials share. ``bounded`` says that the table is a sample of
    bounded size, whose prepared forms may be cached too."""

    def __init__(
        self, df: DataFrame, model: str, metric: str = "accuracy", roles: Roles = ROLES, seed: int = 0, bounded: bool = False
    ):
        if metric not in METRICS:
            raise ValueError(f"unknown metric: {metric}")
        self.model, self.metric, self.roles = model, metric, roles
        self.data = holdout_split(df, 4, seed, roles).persist()
        self.train, self.test = divide(self.data)
        self.shared = SharedPrefixes(self.train, self.test, roles, bounded)

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self.shared.close()
        self.data.unpersist()

    def run(self, order, ops) -> Trial:
        return guarded(
            lambda: score_once(
                self.train, self.test, order, ops, self.model, self.metric, self.roles, self.shared
            ),
            order, ops,
        )

    def run_many(self, configs: list[tuple], workers: int = 4) -> list[Trial]:
        return in_parallel([lambda c=c: self.run(*c) for c in configs], workers)


def in_parallel(calls: list, workers: int) -> list:
    """Run calls on threads that carry the caller's Spark properties."""
    if len(calls) <= 1 or workers <= 1:
        return [c() for c in calls]
    results: list = [None] * len(calls)

    def one(i):
        def body():
            results[i] = calls[i]()

        t = InheritableThread(target=body)
        t.start()
        t.join()

    with ThreadPoolExecutor(max_workers=workers) as pool:
        list(pool.map(one, range(len(calls))))
    return results


def evaluate_holdout(
    df: DataFrame, order, ops, model: str, metric: str = "accuracy", roles: Roles = ROLES, seed: int = 0
) -> Trial:
    with HoldOut(df, model, metric, roles, seed) as split:
        return split.run(order, ops)


def evaluate_candidates(
    df: DataFrame, configs: list[tuple], model: str, metric: str = "accuracy", roles: Roles = ROLES,
    seed: int = 0, workers: int = 4,
) -> list[Trial]:
    with HoldOut(df, model, metric, roles, seed) as split:
        return split.run_many(configs, workers)


def evaluate_cv(
    df: DataFrame, order, ops, model: str, k: int = 4, metric: str = "accuracy", roles: Roles = ROLES,
    seed: int = 0, workers: int = 4,
) -> Trial:
    """Mean score over the folds that did not fail."""
    return cross_validate(df, [(order, ops)], model, k, metric, roles, seed, workers)[0]


def cross_validate(
    df: DataFrame, configs: list[tuple], model: str, k: int = 4, metric: str = "accuracy", roles: Roles = ROLES,
    seed: int = 0, workers: int = 4, bounded: bool = False,
) -> list[Trial]:
    """One trial for each (order, ops): its mean score over the folds that did not fail. The folds
    are drawn once; in each, chains that start alike share that start."""
    data = stratified_folds(df, k, seed, roles).persist()
    try:
        folds = [
            SharedPrefixes(data.where(F.col("fold") != i).drop("fold"), data.where(F.col("fold") == i).drop("fold"), roles, bounded)
            for i in range(k)
        ]

        def run(fold, order, ops):
            return guarded(lambda: score_once(fold.train, fold.test, order, ops, model, metric, roles, fold), order, ops)

        calls = [lambda f=f, c=c: run(f, *c) for c in configs for f in folds]
        parts = in_parallel(calls, workers)
        for f in folds:
            f.close()
    finally:
        data.unpersist()
    return [mean_trial(*c, parts[i * k : i * k + k]) for i, c in enumerate(configs)]


def mean_trial(order, ops, parts: list[Trial]) -> Trial:
    good = [t.score for t in parts if t.score >= 0]
    if good:
        return Trial(list(order), list(ops), sum(good) / len(good))
    return Trial(list(order), list(ops), FAILED, parts[0].reason)


def ledger_frame(spark, rows: list[tuple]) -> DataFrame:
    """(run_id, iteration, step_order, ops, score, reason) rows of a search."""
    return spark.createDataFrame(
        rows, "run_id long, iteration long, step_order string, ops array<string>, score double, reason string"
    )
