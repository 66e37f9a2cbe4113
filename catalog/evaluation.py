"""Metrics, models, trials and the choice of a sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import view, with_views
from catalog.knowledge import recorded
from catalog.preparation import CHAIN, CHAIN_STATS, READY, fitted_chain, split_tables
from catalog.registry import query, r, rounded
from winnow.operators import knn, metrics, models, profile
from winnow.plans import evaluate, search

METRICS_SQL = """cf AS (SELECT label, prediction, count(*) AS n FROM pred GROUP BY label, prediction),
cs AS (SELECT label AS c FROM cf UNION SELECT prediction FROM cf),
pc AS (SELECT c, (SELECT coalesce(sum(n), 0) FROM cf WHERE label = c) AS a, (SELECT coalesce(sum(n), 0) FROM cf WHERE prediction = c) AS g,
       (SELECT coalesce(sum(n), 0) FROM cf WHERE label = c AND prediction = c) AS h FROM cs),
sr AS (SELECT c, a, h, coalesce(h / nullif(CAST(g AS DOUBLE), 0), 0) AS p, coalesce(h / nullif(CAST(a AS DOUBLE), 0), 0) AS r FROM pc),
ff AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM sr)"""


@query("confusion", with_views(["pred"], "SELECT label, prediction, count(*) AS n FROM pred GROUP BY label, prediction"))
def confusion(spark, sf):
    return metrics.confusion(view(spark, sf, "pred"))


@query(
    "metrics_classification",
    with_views(["pred"], f"""SELECT {r('sum(h) / sum(a)')} AS accuracy, {r('avg(p)')} AS precision_macro,
      {r('sum(p * a) / sum(a)')} AS precision_weighted, {r('avg(r)')} AS recall_macro, {r('sum(r * a) / sum(a)')} AS recall_weighted,
      {r('avg(f)')} AS f1_macro, {r('sum(f * a) / sum(a)')} AS f1_weighted FROM ff""", METRICS_SQL),
)
def metrics_classification(spark, sf):
    return rounded(metrics.classification_metrics(view(spark, sf, "pred")))


def _knn_sql() -> str:
    z = lambda t, c: f"({t}.{c} - a_{c}) / s_{c}"
    scaled = lambda t: "SELECT row_id, label, " + ", ".join(
        f"round({z('x', c)}, 9) AS {c}" for c in READY) + f" FROM {t} x, st"
    dist = " + ".join(f"(q.{c} - p.{c}) * (q.{c} - p.{c})" for c in READY)
    return with_views(
        ["ds"],
        """SELECT row_id, label, prediction FROM (SELECT row_id, label, pl AS prediction,
             row_number() OVER (PARTITION BY row_id ORDER BY count(*) DESC, pl) AS k
           FROM (SELECT row_id, label, unnest(v) AS pl FROM nb) u GROUP BY row_id, label, pl) x WHERE k = 1""",
        CHAIN + CHAIN_STATS + f""", zt AS ({scaled('fr')}), zq AS ({scaled('ft')}),
        nb AS (SELECT q.row_id, any_value(q.label) AS label, arg_min(p.label, {{'d': sqrt({dist}), 'i': p.row_id}}, 5) AS v
               FROM zq q JOIN zt p ON true GROUP BY q.row_id)""",
    )


@query("model_knn", _knn_sql())
def model_knn(spark, sf):
    """Vote of the five nearest prepared train rows, for every test row."""
    train, test = split_tables(spark, sf)
    chain = fitted_chain(train)
    a, b = rounded(chain.apply(train), digits=9), rounded(chain.apply(test), digits=9)
    return knn.classify(a, b, list(READY))


def _model(name):
    def run(spark, sf):
        train, test = split_tables(spark, sf)
        chain = fitted_chain(train)
        fitted = models.fit_model(chain.apply(train), name)
        return fitted.predict(chain.apply(test))

    return run


query("model_logistic")(_model("LogisticRegression"))
query("model_tree")(_model("DecisionTree"))
query("model_svm")(_model("SVM"))


def _rows(spark, trials):
    data = [("_".join(t.order), [o or "none" for o in t.ops], float(t.score), t.reason) for t in trials]
    return spark.createDataFrame(data, "step_order string, ops array<string>, score double, reason string")


CONFIGS = [
    (["I", "E", "N"], ["mean", "label", "standard"]),
    (["I", "O", "E", "N"], ["median", "iqr", "onehot", "minmax"]),
    (["I", "E", "N", "FT"], ["mean", "frequency", "robust", "pca"]),
]


@query("evaluate_holdout")
def evaluate_holdout(spark, sf):
    t = evaluate.evaluate_holdout(view(spark, sf, "ds"), *CONFIGS[0], "DecisionTree")
    return _rows(spark, [t])


@query("evaluate_cv")
def evaluate_cv(spark, sf):
    return _rows(spark, [evaluate.evaluate_cv(view(spark, sf, "ds"), *CONFIGS[0], "DecisionTree")])


@query("evaluate_candidates")
def evaluate_candidates(spark, sf):
    return _rows(spark, evaluate.evaluate_candidates(view(spark, sf, "ds"), CONFIGS, "DecisionTree"))


def _history(spark, sf):
    """Measures of the 25 tables, and recorded sequences under the same numbers."""
    kb = profile.table_measures(view(spark, sf, "kb"), ["dataset"])
    rec = recorded(spark, sf).withColumn("dataset", F.regexp_replace("dataset", "Brand#", ""))
    return kb, rec


@query("select_sequence")
def select_sequence(spark, sf):
    kb, rec = _history(spark, sf)
    return search.select_sequence(view(spark, sf, "ds"), kb, rec, model="DecisionTree").ledger


@query("run_report")
def run_report(spark, sf):
    kb, rec = _history(spark, sf)
    _, scores = search.run_report(view(spark, sf, "ds"), kb, rec, model="DecisionTree")
    return scores
