"""The tree against Spark ML's, whole and split over passes and tasks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from winnow.operators import features, models, tree


def noisy(spark, n=3000, seed=5):
    """Columns that bins cut, hold apart and leave constant; labels that little predicts."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n), np.ones(n), np.where(rng.random(n) < 0.7, 0.0, rng.lognormal(size=n))])
    y = np.where(rng.random(n) < 0.7, rng.integers(0, 4, n), (x[:, 0] > 0).astype(int))
    rows = [([float(v) for v in x[i]], float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "_x array<double>, _y double").repartition(4).persist()


@pytest.mark.parametrize("node_rows", [10_000, 150, 1])
@pytest.mark.parametrize("depth", [20, 4])
def test_tree_is_spark_mls(spark, node_rows, depth):
    df = noisy(spark)
    fitted = tree.fit_tree(df, tree.class_counts(df, 4), depth, 32, node_rows=node_rows)
    ml = DecisionTreeClassifier(featuresCol="v", labelCol="_y", maxDepth=depth, maxBins=32, maxMemoryInMB=512, seed=42)
    ready = df.withColumn("v", array_to_vector("_x"))
    both = ml.fit(ready).transform(ready).withColumn("mine", fitted.predict(ready, F.col("_x")))
    assert both.where("prediction <> mine").count() == 0
    assert fitted.depth <= depth and (fitted.feature != 2).all()


def test_cuts_of_a_column():
    assert tree.cuts_of(np.array([1.0, 2.0, 4.0]), np.array([5, 1, 1]), 8).tolist() == [1.5, 3.0]
    assert tree.cuts_of(np.arange(8.0), np.ones(8, dtype=int), 4).tolist() == [1.5, 3.5, 5.5]


def test_tree_takes_few_jobs(spark):
    """Fails where every level of a deep tree is a job of its own: 20 levels took over 40."""
    df = noisy(spark, 2000).select(
        F.monotonically_increasing_id().alias("row_id"), *[F.col("_x")[i].alias(f"f_{i}") for i in range(4)], F.col("_y").cast("string").alias("label")
    )
    sc = spark.sparkContext
    sc.setJobGroup("tree", "tree")
    try:
        fitted = models.fit_model(df, "DecisionTree")
        jobs = len(sc.statusTracker().getJobIdsForGroup("tree"))
    finally:
        sc._jsc.clearJobGroup()
    assert fitted.model.depth > 12 and jobs <= 16, jobs


def test_no_column_varies(spark):
    df = spark.createDataFrame([(i, 1.0, "ab"[i % 2]) for i in range(10)], "row_id long, f_a double, label string")
    for rows in (tree.NODE_ROWS, 2):
        fitted = tree.fit_tree(df.selectExpr("array(f_a) AS _x", "double(row_id % 2) AS _y"), np.array([5, 5]), node_rows=rows)
        assert fitted.depth == 0
    assert {r["prediction"] for r in models.fit_model(df, "DecisionTree").predict(df).collect()} == {"a"}


def test_tables_beyond_the_bins_sample_keep_spark_mls_cuts(spark):
    """Where Spark ML cuts the bins by a sample and its histograms are small, the fit is its own."""
    df = noisy(spark, 10_500).select(
        F.monotonically_increasing_id().alias("row_id"), *[F.col("_x")[i].alias(f"f_{i}") for i in range(4)], F.col("_y").cast("string").alias("label")
    ).persist()
    got = models.fit_model(df, "DecisionTree").predict(df)
    ready = models.assembled(df, [f"f_{i}" for i in range(4)], "v").withColumn("y", F.col("label").cast("double")).persist()
    ml = DecisionTreeClassifier(featuresCol="v", labelCol="y", predictionCol="p", maxDepth=20, maxBins=64, maxMemoryInMB=1024, seed=42).fit(ready)
    both = got.join(ml.transform(ready).select("row_id", "p"), "row_id")
    assert both.count() == 10_500 and both.where(F.col("prediction").cast("double") != F.col("p")).count() == 0


def test_the_forest_is_dealt_by_rows(spark):
    """A task of the forest gets a bounded number of rows, however few parts the table has."""
    df = spark.range(1000).repartition(2)
    assert features.in_parts(df, 1000) is df
    few = features.in_parts(df.coalesce(1), 20)
    sizes = [r["n"] for r in few.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 50 and max(sizes) <= 30 and sum(sizes) == 1000


@pytest.mark.parametrize("few", [0, 4])
def test_columns_of_few_bins_are_counted_together(monkeypatch, few):
    """The same tree from sorts and from tables of counts, in shares of the columns too."""
    rng = np.random.default_rng(6)
    codes = np.column_stack([rng.integers(0, k, 600) for k in (2, 1, 3, 30, 2, 4, 9, 2, 2)]).astype(np.uint8)
    y = rng.integers(0, 4, 600).astype(np.int32)
    whole = tree.grow(codes, y, 4, 30, 12)
    monkeypatch.setattr(tree, "FEW_BINS", few)
    monkeypatch.setattr(tree, "COUNTED", 5000)
    assert all(np.array_equal(a, b) for a, b in zip(whole, tree.grow(codes, y, 4, 30, 12)))


def test_many_narrow_columns_take_few_passes(monkeypatch):
    """Fails where every column of a one-hot is sorted by itself at every level."""
    rng = np.random.default_rng(7)
    codes, y = (rng.random((400, 300)) < 0.1).astype(np.uint8), rng.integers(0, 3, 400).astype(np.int32)
    seen, plain = [], tree.gains
    monkeypatch.setattr(tree, "gains", lambda *a: seen.append(1) or plain(*a))
    made = tree.grow(codes, y, 3, 2, 6)
    assert len(made[0]) > 20 and len(seen) <= 12, len(seen)


def test_bins_of_both_routes_are_equal(spark, monkeypatch):
    df = noisy(spark, 2000)
    one = tree.thresholds(df, 2000, 4, 32, 42)
    monkeypatch.setattr(tree, "CUT_CELLS", 0)
    assert all(np.array_equal(a, b) for a, b in zip(one, tree.thresholds(df, 2000, 4, 32, 42), strict=True))
