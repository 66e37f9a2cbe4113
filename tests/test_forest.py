"""The random trees against a plain recursion, in one task and in passes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import features, forest

TREES, DEPTH = 12, 5


def table(n=700, seed=3):
    """A column of many values, one of few, a constant one, and equal rows."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n).astype(float), np.ones(n), np.exp(4 * rng.normal(size=n))])
    return np.vstack([x, x[:50]])


def leaves_by_recursion(x, trees, depth, seed):
    """Column numbers of the one-hot (rows x trees): totally random trees, grown node by node."""
    out, before = np.zeros((len(x), trees), dtype=int), 0
    for t in range(trees):
        leaves = []

        def grow(rows, path):
            if path < 1 << depth:
                rng = np.random.default_rng([seed, t, path])
                order, u = rng.permutation(x.shape[1]), rng.random()
                for c in order:
                    lo, hi = x[rows, c].min(), x[rows, c].max()
                    if lo < hi:
                        right = x[rows, c] > lo * (1 - u) + hi * u
                        grow(rows[~right], 2 * path)
                        grow(rows[right], 2 * path + 1)
                        return
            leaves.append(rows)

        grow(np.arange(len(x)), 1)
        for rows in leaves:
            out[rows, t] = before
            before += 1
    return out, before


def rows_of(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, x array<double>").repartition(parts)


@pytest.mark.parametrize("passes", [False, True])
@pytest.mark.parametrize("asked", [16, 1])
def test_forest_is_the_recursions(spark, monkeypatch, passes, asked):
    x = table()
    monkeypatch.setattr(forest, "ASKED", asked)
    if passes:
        monkeypatch.setattr(forest, "CELLS", 1)
    df = rows_of(spark, x)
    fitted = forest.fit_forest(df, F.col("x"), 4, TREES, DEPTH, 7)
    wanted, size = leaves_by_recursion(x, TREES, DEPTH, 7)
    got = df.withColumn("v", fitted.onehot(df, F.col("x"))).orderBy("row_id").collect()
    assert np.array_equal(np.array([r["v"].indices for r in got]), wanted)
    assert {r["v"].size for r in got} == {size} and all((r["v"].values == 1).all() for r in got)


def test_every_row_counts_once(spark):
    """No rows are drawn: copies, keys and places change nothing, and a single far row gets a side of its own."""
    x = np.vstack([table(), [[1e6, 0.0, 1.0, 1.0]]])
    frame = lambda rows: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "row_id long, a double, b double, c double, d double")
    first = features.fit_features(frame(x), "RandomTrees").apply(frame(x)).orderBy("row_id").collect()
    twice = features.fit_features(frame(np.vstack([x[::-1], x])), "RandomTrees").apply(frame(x)).orderBy("row_id").collect()
    assert [r["0"] for r in first] == [r["0"] for r in twice]
    wanted, size = leaves_by_recursion(x, features.TREES, features.TREE_DEPTH, 0)
    assert np.array_equal(np.array([r["0"].indices for r in first]), wanted) and first[0]["0"].size == size


def test_new_rows_missing_values_and_no_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, "l"), (2, 2.0, 1.0, "l")], "row_id long, a double, b double, label string")
    fitted = features.fit_features(df, "RandomTrees")
    far = spark.createDataFrame([(1, -9.0, "l"), (2, float("inf"), "l")], "row_id long, a double, label string")
    got = fitted.apply(far).orderBy("row_id").collect()  # a column that is not there counts as 0
    assert [list(r["0"].indices[:2]) for r in got] == [[0, 2], [1, 3]] and got[0]["0"].size == 2 * features.TREES
    with pytest.raises(Exception, match="missing"):
        fitted.apply(df.withColumn("a", F.lit(None).cast("double"))).collect()
    with pytest.raises(Exception, match="no rows"):
        features.fit_features(df.limit(0), "RandomTrees")


def test_the_query_reads_what_the_vector_keeps(spark, tmp_path):
    """Fails where each row's vector is written out with a number for every leaf of the forest."""
    rng = np.random.default_rng(2)
    spark.createDataFrame(
        [(i, i % 40, float(rng.random()), "O", "1-URGENT", f"1995-{1 + i % 12:02d}-01") for i in range(1, 300)],
        "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderpriority string, d string",
    ).withColumn("o_orderdate", F.to_date("d")).drop("d").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, float(rng.random()), "BUILDING", 1) for i in range(40)], "c_custkey long, c_acctbal double, c_mktsegment string, c_nationkey long").write.parquet(
        f"{tmp_path}/customer.parquet")
    from __spark_entry__ import queries

    out = queries()["ft_random_trees"](spark, str(tmp_path))
    assert "transform(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.collect()
    assert out.columns == ["row_id", "n_leaves", "first_leaf"] and len(got) == 299
    assert {r["n_leaves"] for r in got} == {features.TREES} and len({r["first_leaf"] for r in got}) > 5
