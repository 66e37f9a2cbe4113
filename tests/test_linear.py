"""Jointly fitted linear models and landmark kernels against numpy, Spark ML and exact kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import features, landmarks, linear, models


def rows(spark, n, seed=0, shift=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) + shift
    z = x - shift
    label = np.where(z[:, 0] ** 2 + z[:, 1] > 1, "a", np.where(z[:, 2] > 0, "b", "c"))
    data = [(i, *map(float, r), str(l)) for i, (r, l) in enumerate(zip(x, label))]
    return spark.createDataFrame(data, "row_id long, p double, q double, s double, label string").repartition(3), x, label


def newton(x, t, ridge):
    a = np.hstack([x, np.ones((len(x), 1))])
    r, w = np.diag([1.0] * x.shape[1] + [ridge]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(t * (a @ w)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + r, r @ w - a.T @ (t * p))
    return w


def kernel(a, b, gamma):
    return np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(axis=2))


def test_logistic_fits_equal_single_ones(spark):
    df, x, label = rows(spark, 300)
    got = models.fit_model(df, "LogisticRegression").solved
    assert got.converged
    for k, c in enumerate("abc"):
        want = newton(x, np.where(label == c, 1.0, -1.0), 1.0)
        assert np.allclose(np.append(got.weights[k], got.offsets[k]), want, atol=1e-5)


def test_two_classes_are_one_problem_and_free_offset_equals_spark(spark):
    from pyspark.ml.classification import LogisticRegression

    df, x, label = rows(spark, 300)
    df = df.withColumn("label", F.when(F.col("label") == "c", "c").otherwise("a"))
    fitted = models.fit_model(df, "LogisticRegression", offset_ridge=0.0)
    ready = features.assembled(df, ["p", "q", "s"], "v").withColumn("y", (F.col("label") == "c").cast("double"))
    other = LogisticRegression(
        featuresCol="v", labelCol="y", regParam=1.0 / 300, standardization=False, tol=1e-12, maxIter=300).fit(ready)
    assert np.allclose(fitted.solved.weights[0], other.coefficients.toArray(), atol=1e-4)
    assert fitted.solved.offsets[0] == pytest.approx(other.intercept, abs=1e-4)
    same = fitted.predict(df).where("prediction = 'c'").count()
    assert same == other.transform(ready).where("prediction = 1").count()


def test_passes_do_not_grow_with_classes(spark, monkeypatch):
    df, x, _ = rows(spark, 300)
    passes = []
    plain = linear.summed
    monkeypatch.setattr(linear, "summed", lambda *a: passes.append(1) or plain(*a))
    counts = []
    for classes in (3, 12):
        passes.clear()
        labelled = df.withColumn("label", (F.floor(F.col("p") * 2 + F.col("row_id") % 3) % classes).cast("string"))
        models.fit_model(labelled, "LogisticRegression")
        counts.append(len(passes))
    assert counts[1] <= counts[0] + 8


def test_blocks_keep_every_row_of_sparse_and_dense_tables(spark, monkeypatch):
    monkeypatch.setattr(linear, "CELLS", 20)
    data = [([0.0, 0.0, float(i % 5 == 0), 0.0], i % 2) for i in range(40)] + [([1.0, 2.0, 3.0, float(i)], 1) for i in range(30)]
    df = spark.createDataFrame(data, "x array<double>, y int").repartition(2)
    got = linear.second_moments(linear.pack(df, "x", "y"), 4)
    a = np.hstack([np.array([d[0] for d in data]), np.ones((70, 1))])
    assert np.allclose(got, a.T @ a)
    with pytest.raises(Exception, match="missing"):
        linear.pack(spark.createDataFrame([([1.0, None], 0)], "x array<double>, y int"), "x", "y").collect()


def test_machine_is_near_the_exact_kernel_machine(spark):
    """The fit gives weights of rows that the exact machine's dual allows; the gap between its two
    objectives, both with the whole kernel matrix, bounds how far the fit is from its best."""
    df, x, label = rows(spark, 500, seed=3)
    df = df.withColumn("label", F.when(F.col("label") == "c", "c").otherwise("a"))
    fitted = models.fit_model(df, "SVM")
    assert fitted.land.error <= landmarks.ERROR and fitted.solved.converged
    y = np.where(label == "c", -1.0, 1.0)
    k = kernel(x, x, 1.0 / (3 * x.var()))
    got = fitted.land.features(x) @ fitted.solved.weights[0] + fitted.solved.offsets[0]
    corner = models.CORNERS[-1][0]
    alpha = np.clip(1 - y * got, 0, corner) / corner
    assert abs(alpha @ y) < 0.5
    exact = k @ (alpha * y)
    size = (alpha * y) @ exact
    primal = 0.5 * size + np.maximum(1 - y * (exact + fitted.solved.offsets[0]), 0).sum()
    dual = alpha.sum() - 0.5 * size
    assert -1.0 < primal - dual < 0.05 * primal
    assert np.abs(exact + fitted.solved.offsets[0] - got).max() < 0.1
    told = {r["row_id"]: r["prediction"] for r in fitted.predict(df).collect()}
    assert [told[i] for i in range(500)] == ["a" if g > 0 else "c" for g in got]


def test_votes_between_pairs_give_ties_to_the_first_class():
    signs = linear.one_against_one(3)
    assert signs.T.tolist() == [[1, -1, 0], [1, 0, -1], [0, 1, -1]]
    got = models.votes(np.array([[1.0, -1.0, 1.0], [-1.0, -1.0, -1.0]]), signs)
    assert got.tolist() == [[1, 1, 1], [0, 1, 2]] and got[0].argmax() == 0


def test_landmarks_follow_the_stated_error(spark):
    df, x, _ = rows(spark, 400, shift=1e4)
    arrays = df.select(F.array("p", "q", "s").alias("x"))
    sizes = []
    for error in (0.3, 0.001):
        land = landmarks.choose(arrays, "x", 0.3, error)
        f = land.features(x)
        assert land.error <= error
        assert land.error == pytest.approx(np.mean(1 - (f * f).sum(axis=1)), abs=1e-6)
        sizes.append(len(land.points))
    assert sizes[0] < sizes[1]
    again = landmarks.choose(arrays.repartition(7), "x", 0.3, 0.001)
    assert np.array_equal(again.points, land.points)


def test_few_distinct_rows_are_spanned_exactly(spark):
    df = spark.createDataFrame([([float(i % 7), 1.0],) for i in range(300)], "x array<double>")
    land = landmarks.choose(df, "x", 0.5, 0.0)
    assert len(land.points) == 7 and land.error < 1e-9
    with pytest.raises(ValueError):
        landmarks.choose(df.limit(0), "x", 0.5)


def test_kernel_projection_equals_the_exact_one(spark):
    df, x, _ = rows(spark, 300, seed=5)
    fitted = features.fit_features(df, "kernelPCA", kernel_error=1e-6)
    out = np.array([[r["0"], r["1"]] for r in fitted.apply(df).orderBy("row_id").collect()])
    k = kernel(x, x, 1.0 / 3)
    centre = np.eye(300) - 1.0 / 300
    values, vectors = np.linalg.eigh(centre @ k @ centre)
    for j in range(2):
        want = vectors[:, -1 - j] * np.sqrt(values[-1 - j])
        assert min(np.abs(out[:, j] - want).max(), np.abs(out[:, j] + want).max()) < 1e-3


def test_streamed_state_gives_the_projection_at_a_large_offset(spark, tmp_path):
    from winnow.streaming.moments import read_state, state_stream

    df, x, _ = rows(spark, 300, seed=7, shift=1e6)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cols, path = ["p", "q", "s"], str(tmp_path / "state")
    state_stream(stream, cols, path, str(tmp_path / "cp")).awaitTermination()
    state_stream(stream, cols, path, str(tmp_path / "cp")).awaitTermination()  # nothing new, nothing twice
    state = read_state(spark, path)
    assert state.n == 300
    want = features.fit_features(df, "pca")
    assert np.allclose(state.projection(cols, 2).weights, want.weights, atol=1e-8)
    c = x - x.mean(axis=0)
    assert np.allclose(state.scatter, c.T @ c, rtol=1e-8, atol=1e-6)


def test_states_merge_in_any_order():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 4)) + 1e6

    def state(a):
        c = a - a.mean(axis=0)
        return features.CentredState(len(a), a.mean(axis=0), c.T @ c)

    parts = [state(x[:10]), state(x[10:11]), state(x[11:])]
    empty = features.CentredState(0.0, np.zeros(4), np.zeros((4, 4)))
    for order in ([0, 1, 2], [2, 0, 1], [1, 2, 0]):
        got = empty.merge(parts[order[0]]).merge(parts[order[1]]).merge(parts[order[2]]).merge(empty)
        assert got.n == 90 and np.allclose(got.scatter, state(x).scatter, atol=1e-6)
    names = ["a", "b", "c", "d"]
    assert np.allclose(got.projection(names, 2).weights, state(x).projection(names, 2).weights, atol=1e-8)


def test_a_fit_has_few_tasks_and_sends_half_the_second_derivatives_as_bytes(spark, monkeypatch):
    """Sixty-four small partitions: a pass has one task per core, and what it sends is bytes."""
    df, x, label = rows(spark, 300, seed=5)
    seen, plain = [], linear.summed
    wide = np.arange(256 * 256).reshape(256, 256) % 7.0

    def watched(blocks, width, part, keys):
        seen.append((blocks.rdd.getNumPartitions(), part(np.ones((2, width)), np.zeros(2, np.int32)).shape))
        return plain(blocks, width, part, keys)

    monkeypatch.setattr(linear, "summed", watched)
    fitted = models.fit_model(df.repartition(64), "SVM", kernel_features=64)
    assert fitted.solved.converged
    assert max(n for n, _ in seen) <= spark.sparkContext.defaultParallelism
    size = len(fitted.land.points) + 1
    assert seen[-1][1][1] == size + 1 + size * (size + 1) // 2
    blocks = linear.pack(spark.createDataFrame([(list(map(float, r)), i % 3) for i, r in enumerate(wide)], "x array<double>, y int").repartition(9), "x", "y")
    got = plain(blocks, 256, lambda m, codes: np.array([m[codes == k].sum(axis=0) for k in range(3)]), 3)
    assert all(np.array_equal(got[k], wide[k::3].sum(axis=0)) for k in range(3))


def test_rows_are_dealt_to_more_tasks_where_there_are_many(spark, monkeypatch):
    df = spark.range(4000).selectExpr("array(double(id), 1D) AS x")
    cores = spark.sparkContext.defaultParallelism
    assert linear.dealt(df.repartition(64), "x").rdd.getNumPartitions() == cores
    assert linear.dealt(df.coalesce(1), "x").rdd.getNumPartitions() == cores
    monkeypatch.setattr(linear, "TASK_CELLS", 200)
    many = linear.dealt(df.repartition(64), "x")
    assert many.rdd.getNumPartitions() == 40 and many.count() == 4000


def test_passes_of_the_machine_do_not_grow_with_the_rows(monkeypatch):
    """Labels that little predicts, a kernel that nearly spans the constant: few passes to the best, for
    few rows and many. Took 34 and 43 with the corner's own second derivatives and a curvature of the
    offset that grows with the rows."""
    rng = np.random.default_rng(4)
    for n in (3000, 24_000):
        x = rng.normal(size=(n, 4))
        y = np.where(rng.random(n) < 0.05, x[:, 0] > 0, rng.random(n) < 0.5).astype(np.int32)
        land = landmarks._spanned(x[:120], 0.2)
        monkeypatch.setattr(linear, "summed", lambda blocks, width, part, keys, x=x, y=y: dict(enumerate(part(x, y))))
        fitted = linear.solve(None, 4, linear.one_against_one(2), linear.hinge_loss(0.05), 20.0, offset_ridge=0.0, basis=land.basis, tol=0.002)
        assert fitted.converged and fitted.rounds <= 22, fitted.rounds
        f, side = land.features(x), np.where(y == 0, 1.0, -1.0)

        def objective(w, b):
            return 0.5 * w @ w + linear.hinge_loss(0.05)(side * (f @ w + b))[0].sum()

        best = objective(fitted.weights[0], fitted.offsets[0])
        for _ in range(50):  # no step nearby is better by more than a trifle
            w, b = fitted.weights[0] + rng.normal(size=f.shape[1]) * 0.02, fitted.offsets[0] + rng.normal() * 0.02
            assert objective(w, b) > best - 1e-6 * best
