"""Hand-computed tables, brute-force comparisons and edge cases."""

import itertools
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from winnow.functions import moments as M
from winnow.functions.quantiles import exact_quantiles, grouped_quantiles
from winnow.functions.ranks import hash_ordinal, ordered_ordinal, running_max_before
from winnow.operators import (
    encode, features, impute, knn, metrics, models, mutual_info, outlier, profile, scale, select, split,
)
from winnow.plans import chain, evaluate, knowledge, ledger, proposals, search, trials
from winnow.roles import lay_out
from winnow.sources import sinks, tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, c, order="row_id"):
    return [r[c] for r in df.orderBy(order).collect()]


# ---------------------------------------------------------------- moments and quantiles


def test_moments_by_hand(spark):
    df = frame(spark, [(float(x),) for x in (1, 2, 2, 3, 9)], "x double")
    r = df.agg(M.corrected_skew(F.col("x")).alias("s"), M.corrected_kurtosis(F.col("x")).alias("k")).first()
    x = np.array([1, 2, 2, 3, 9.0])
    d, n = x - x.mean(), 5
    g1 = (d**3).mean() / (d**2).mean() ** 1.5
    g2 = (d**4).mean() / (d**2).mean() ** 2 - 3
    assert r["s"] == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))
    assert r["k"] == pytest.approx(((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))


def test_constant_and_short_columns(spark):
    df = frame(spark, [(1.0, 5.0, None), (1.0, 6.0, None), (1.0, None, None), (1.0, None, None)], "a double, b double, c double")
    r = df.agg(*[M.corrected_skew(F.col(c)).alias(c) for c in "abc"]).first()
    assert (r["a"], r["b"], r["c"]) == (0.0, None, None)
    assert df.agg(M.corrected_kurtosis(F.col("a"))).first()[0] == 0.0
    assert df.agg(M.abs_correlation(F.col("a"), F.col("b"))).first()[0] is None


@pytest.mark.parametrize("many", [False, True])
def test_quantiles_both_routes(spark, many):
    rng = random.Random(1)
    rows = [(rng.choice([0.0, 0.0, 5.5, rng.random() * 100]), rng.gauss(0, 1), None) for _ in range(3000)]
    rows += [(None, 1.0, None)] * 50
    df = frame(spark, rows, "a double, b double, c double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0] if not many else [i / 200 for i in range(201)]
    got = exact_quantiles(df, ["a", "b", "c"], probs, small_rows=0, bucket_rows=100)
    for i, c in enumerate("ab"):
        x = [r[i] for r in rows if r[i] is not None]
        assert got[c] == pytest.approx([float(v) for v in np.quantile(x, probs)], rel=1e-12, abs=1e-12)
    assert got["c"] == [None] * len(probs)
    small = exact_quantiles(df, ["a", "b"], [0.1, 0.5])
    assert small["a"] == exact_quantiles(df, ["a", "b"], [0.1, 0.5], small_rows=0, bucket_rows=100)["a"]


def test_grouped_quantiles_both_routes(spark):
    rng = random.Random(8)
    rows = [("hot" if i % 3 else f"g{i % 5}", rng.choice([1.0, 2.5, rng.random() * 9])) for i in range(2000)]
    df = frame(spark, rows + [("hot", None)], "k string, value double").repartition(6)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for limit in (0, 10_000):
        got = {r["k"]: r["q"] for r in grouped_quantiles(df, ["k"], probs, small_rows=limit, buckets=16).collect()}
        for k in got:
            want = np.quantile([v for g, v in rows if g == k], probs)
            assert got[k] == pytest.approx(list(want), rel=1e-12)


def test_profiles_of_many_tables_equal_single_ones(spark):
    rng = random.Random(9)
    rows = [("a" if i % 3 else "b", i, rng.choice([None, 0.0, rng.gauss(0, 1)]), 2.0) for i in range(300)]
    df = frame(spark, rows, "dataset string, row_id long, x double, k double")
    many = profile.profile_tables(df, ["dataset"])
    for name in "ab":
        one = profile.profile_table(df.where(F.col("dataset") == name).drop("dataset"))
        got = many.where(F.col("dataset") == name).drop("dataset").withColumn("feature", F.concat(F.lit("col_"), "feature"))
        for r1, r2 in zip(one.orderBy("feature").collect(), got.select(*one.columns).orderBy("feature").collect()):
            for v1, v2 in zip(r1, r2):
                assert v1 == (pytest.approx(v2) if isinstance(v2, float) else v2)


def test_wide_correlation_equals_pairwise(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6))
    x[:, 3] = x[:, 0] * 2 + rng.normal(size=200) * 0.1
    x[:, 5] = 4.0
    rows = [[None if rng.random() < 0.1 and j != 5 else float(v) for j, v in enumerate(r)] for r in x]
    df = frame(spark, rows, "a double, b double, c double, d double, e double, f double")
    narrow = df.agg(profile.mean_abs_correlation(list("abcdef"))).first()[0]
    assert profile.mean_abs_correlation_wide(df, list("abcdef"), block=2) == pytest.approx(narrow, rel=1e-9)


@pytest.mark.parametrize("cells", [profile.BROADCAST_CELLS, 0])
def test_wide_measures_by_table_equal_narrow(spark, monkeypatch, cells):
    """45 columns in three tables, one of them without a name, against every pair by itself."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 45)) + 1e6 * (np.arange(240) % 3)[:, None]
    x[:, 7] = x[:, 2] + rng.normal(size=240) * 0.1
    x[np.arange(240) % 3 == 1, 9] = 0.1
    names = [f"f{i}" for i in range(45)]
    rows = [
        [k, [None, "a", "b"][k % 3], "xyz"[k % 2], *[None if rng.random() < 0.1 and j > 5 else float(v) for j, v in enumerate(r)]]
        for k, r in enumerate(x)
    ]
    df = frame(spark, rows, "row_id long, dataset string, label string, " + ", ".join(f"{c} double" for c in names))
    monkeypatch.setattr(profile, "BROADCAST_CELLS", cells)
    got = {r.dataset: r for r in profile.table_measures(df, ["dataset"]).collect()}
    assert set(got) == {None, "a", "b"}
    for name in got:
        part = pd.DataFrame([r[3:] for r in rows if r[1] == name], columns=names).astype(float)
        r = part.corr().abs().to_numpy()[np.triu_indices(45, 1)]
        varies = [part[b].notna().any() and part.loc[part[b].notna(), a].nunique() > 1 and part.loc[part[a].notna(), b].nunique() > 1
                  for i, a in enumerate(names) for b in names[i + 1:]]
        assert got[name].mean_feature_correlation == pytest.approx(r[varies].mean(), rel=1e-9)
        assert got[name].n_num_features == 45 and got[name].max_mutual_info is not None
    few = profile.grouped_correlation(df, ["dataset"], names[:7], block=3)
    for r in few.collect():
        want = df.where(F.col("dataset").eqNullSafe(r.dataset)).agg(profile.mean_abs_correlation(names[:7])).first()[0]
        assert r.mean_feature_correlation == pytest.approx(want, rel=1e-6)


def test_gram_of_wide_table_equals_narrow(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 50))
    names = [f"c{i}" for i in range(50)]
    n, s, g = M.gram(frame(spark, x.tolist(), ", ".join(f"{c} double" for c in names)), names)
    assert n == 60
    assert np.allclose(s, x.sum(axis=0)) and np.allclose(g, x.T @ x)
    rows = [[None if (i + j) % 9 == 0 else float(v) for j, v in enumerate(r)] for i, r in enumerate(x)]
    holes = frame(spark, rows, ", ".join(f"{c} double" for c in names))
    y = np.where((np.arange(60)[:, None] + np.arange(50)) % 9 == 0, 0.0, x)
    for k in (50, 10):  # one null rule on both routes
        n, s, g = M.gram(holes, names[:k])
        assert n == 60 and np.allclose(s, y[:, :k].sum(axis=0)) and np.allclose(g, y[:, :k].T @ y[:, :k])


# ---------------------------------------------------------------- ranks


def test_hash_ordinal_is_a_plain_row_number(spark):
    df = frame(spark, [(i, "hot" if i % 3 else "b") for i in range(500)], "row_id long, label string").repartition(7)
    got = hash_ordinal(df, "row_id", ["label"], "rn", digits=1)
    want = df.selectExpr("row_id", "row_number() over (partition by label order by md5(cast(row_id as string)), row_id) as rn")
    assert sorted(got.select("row_id", "rn").collect()) == sorted(want.collect())


def test_running_max_over_small_buckets(spark):
    rng = random.Random(2)
    rows = [(r, i, rng.random()) for r in range(2) for i in range(1, 60)]
    got = running_max_before(frame(spark, rows, "run_id long, iteration long, score double"), ["run_id"], "iteration", F.col("score"), "b", width=7)
    for r in got.collect():
        earlier = [s for a, i, s in rows if a == r["run_id"] and i < r["iteration"]]
        assert r["b"] == (max(earlier) if earlier else None)


def test_ordered_ordinal(spark):
    df = frame(spark, [(f"k{i:03d}",) for i in range(300)], "v string").repartition(6)
    got = {r["v"]: r["i"] for r in ordered_ordinal(df, ["v"], "i").collect()}
    assert got == {f"k{i:03d}": i for i in range(300)}


# ---------------------------------------------------------------- imputation and outliers


def brute_impute(rows, k=5):
    d = len(rows[0][1])
    out = {}
    for rid, x in rows:
        y = list(x)
        for f in range(d):
            if x[f] is not None:
                continue
            found = []
            for pid, p in rows:
                both = [i for i in range(d) if x[i] is not None and p[i] is not None]
                if p[f] is None or not both:
                    continue
                found.append((math.sqrt(sum((x[i] - p[i]) ** 2 for i in both) * d / len(both)), pid, p[f]))
            near = sorted(found)[:k]
            mean = [p[f] for _, p in rows if p[f] is not None]
            y[f] = sum(v for *_, v in near) / len(near) if near else sum(mean) / len(mean)
        out[rid] = y
    return out


@pytest.mark.parametrize("block_rows", [10, 1000])
def test_knn_imputation_by_brute_force(spark, monkeypatch, block_rows):
    rng = random.Random(3)
    rows = []
    for i in range(260):
        if i % 3 == 0:  # a third of all rows are one point
            x = [1.0, 2.0, 3.0, 4.0]
        else:
            x = [rng.gauss(0, 1), rng.gauss(5, 3), float(rng.randint(0, 3)), rng.random()]
        x = [None if rng.random() < 0.15 else v for v in x]
        rows.append((i, x))
    rows.append((900, [None] * 4))
    monkeypatch.setattr(knn, "CHUNK_ROWS", 16)
    monkeypatch.setattr(knn, "MAX_PATTERNS", 6)  # force mixed blocks for rare patterns
    monkeypatch.setattr(knn.nearest, "__defaults__", (None, block_rows))
    df = frame(spark, [(i, *x) for i, x in rows], "row_id long, a double, b double, c double, d double")
    got = {r["row_id"]: list(r)[1:] for r in impute.fit_imputer(df, "knn").apply(df).select("row_id", *"abcd").collect()}
    want = brute_impute(rows)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-9), i


def test_knn_classes_by_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    point = lambda i: (0.5, 0.5) if i % 3 == 0 else (rng.random(), float(rng.randint(0, 5)) / 5)
    train = [(i, *point(i), rng.choice("xyz")) for i in range(300)]
    test = [(i, *point(i), "x") for i in range(120)]
    monkeypatch.setattr(knn.nearest, "__defaults__", (None, 20))
    schema = "row_id long, a double, b double, label string"
    got = {r["row_id"]: r["prediction"] for r in knn.classify(frame(spark, train, schema), frame(spark, test, schema), ["a", "b"]).collect()}
    for i, a, b, _ in test:
        near = sorted((math.sqrt((a - p) ** 2 + (b - q) ** 2), j, lab) for j, p, q, lab in train)[:5]
        votes = {}
        for *_, lab in near:
            votes[lab] = votes.get(lab, 0) + 1
        assert got[i] == min(votes, key=lambda v: (-votes[v], v))


def test_median_mode_and_constant(spark):
    df = frame(spark, [(1, 1.0, "b"), (2, 2.0, "a"), (3, 4.0, "a"), (4, 10.0, "b"), (5, None, None)], "row_id long, x double, c string")
    assert impute.fit_imputer(df, "median").numeric == {"x": 3.0}
    assert impute.fit_imputer(df, "most_frequent").numeric == {"x": 1.0}
    assert impute.fit_imputer(df, "mean").categorical == {"c": "a"}
    assert values(impute.fit_imputer(df, "constant", fill_value=7.0).apply(df), "x")[-1] == 7.0
    with pytest.raises(ValueError):
        impute.fit_imputer(df, "nope")


def test_iterative_imputation_recovers_a_line(spark):
    rows = [(i, float(i), 2.0 * i + 1 if i % 5 else None, float((i * 7) % 11)) for i in range(60)]
    df = frame(spark, rows, "row_id long, a double, b double, c double")
    got = values(impute.fit_imputer(df, "iterative").apply(df), "b")
    assert got == pytest.approx([2.0 * i + 1 for i in range(60)], abs=1e-3)


def test_outlier_rules(spark):
    rows = [(i, float(i % 5), 1.0, "l") for i in range(40)] + [(40, 1000.0, 1.0, "l")]
    df = frame(spark, rows, "row_id long, x double, k double, label string")
    for method in ("zscore", "iqr"):
        got = values(outlier.fit_outliers(df, method).mask(df), "x")
        assert got[-1] is None and None not in got[:-1]
    refill = impute.fit_imputer(df, "mean")
    fixed = outlier.fit_outliers(df, "iqr", imputer=refill).apply(df)
    assert fixed.where("x is null").count() == 0


# ---------------------------------------------------------------- encoders and scalers


def test_encoders_unseen_and_null(spark):
    train = frame(spark, [(1, "b", "l"), (2, "a", "l"), (3, "b", "l"), (4, None, "l")], "row_id long, c string, label string")
    new = frame(spark, [(1, "a", "l"), (2, "zz", "l"), (3, None, "l")], "row_id long, c string, label string")
    one = encode.fit_encoder(train, "onehot").apply(new)
    assert one.columns == ["row_id", "c_a", "c_b", "c_null", "label"]
    assert [tuple(r)[1:4] for r in one.orderBy("row_id").collect()] == [(1, 0, 0), (0, 0, 0), (0, 0, 1)]
    assert values(encode.fit_encoder(train, "label").apply(new), "c") == [0.0, -1.0, 2.0]
    assert values(encode.fit_encoder(train, "frequency").apply(new), "c") == [1 / 3, 0.0, None]
    two = encode.fit_encoder(train, "binary").apply(new)
    # first seen: b=1, a=2, null=3
    assert [tuple(r)[1:3] for r in two.orderBy("row_id").collect()] == [(1, 0), (0, 0), (1, 1)]


@pytest.mark.parametrize("method", ["label", "binary", "frequency"])
def test_large_category_tables_agree_with_small(spark, method):
    rows = [(i, f"v{(i * 7919) % 97}", "l") for i in range(400)] + [(400, None, "l")]
    df = frame(spark, rows, "row_id long, c string, label string").repartition(4)
    small = encode.fit_encoder(df, method).apply(df)
    large = encode.fit_encoder(df, method, state_rows=10).apply(df)
    assert small.columns == large.columns
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)


def test_too_many_categories_for_onehot(spark):
    df = frame(spark, [(i, f"v{i}") for i in range(50)], "row_id long, c string")
    with pytest.raises(ValueError):
        encode.fit_encoder(df, "onehot", state_rows=10)


def scaled(spark, method, xs, new=None):
    df = frame(spark, [(i, float(x), "l") for i, x in enumerate(xs)], "row_id long, x double, label string")
    s = scale.fit_scaler(df, method)
    if new is not None:
        df = frame(spark, [(i, float(x), "l") for i, x in enumerate(new)], "row_id long, x double, label string")
    return values(s.apply(df), "x")


def test_scalers_by_hand(spark):
    assert scaled(spark, "standard", [1, 3]) == [-1.0, 1.0]
    assert scaled(spark, "standard", [4, 4, 4]) == [0.0, 0.0, 0.0]
    assert scaled(spark, "minmax", [2, 4, 6]) == [0.0, 0.5, 1.0]
    assert scaled(spark, "minmax", [5, 5]) == [0.0, 0.0]
    assert scaled(spark, "maxabs", [-4, 2]) == [-1.0, 0.5]
    assert scaled(spark, "robust", [7, 8, 9]) == [-1.0, 0.0, 1.0]
    assert scaled(spark, "normalizer", [0, -3]) == [0.0, -1.0]
    assert scaled(spark, "kbins", range(10)) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert scaled(spark, "kbins", [1, 1, 1, 1, 1, 9]) == [0, 0, 0, 0, 0, 0]


def test_quantile_scaler_against_interpolation(spark):
    xs = [1.0, 1.0, 1.0, 2.0, 3.0, 3.0, 8.0]
    refs = np.linspace(0, 1, len(xs))
    q = np.quantile(xs, refs)
    new = [0.0, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0, 9.0]
    both = 0.5 * (np.interp(new, q, refs) - np.interp([-v for v in new], -q[::-1], -refs[::-1]))
    both[0], both[1], both[-1], both[-2] = 0, 0, 1, 1
    assert scaled(spark, "quantile", xs, new) == pytest.approx(list(both))
    assert scaled(spark, "quantile", [2, 2, 2], [1, 2, 3]) == [0.0, 0.0, 1.0]


def test_power_scaler_maximises_likelihood(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.lognormal(size=400), -rng.random(100)])
    df = frame(spark, [(i, float(v), "l") for i, v in enumerate(x)], "row_id long, x double, label string")
    lam, mean, std = scale.fit_scaler(df, "power").params["x"]

    def turned(p):
        out = np.empty_like(x)
        pos = x >= 0
        out[pos] = np.log1p(x[pos]) if p == 0 else ((x[pos] + 1) ** p - 1) / p
        out[~pos] = -np.log1p(-x[~pos]) if p == 2 else -((1 - x[~pos]) ** (2 - p) - 1) / (2 - p)
        return out

    def ll(p):
        return -len(x) / 2 * np.log(turned(p).var()) + (p - 1) * (np.sign(x) * np.log1p(abs(x))).sum()

    grid = np.linspace(-2, 2, 8001)
    assert lam == pytest.approx(grid[np.argmax([ll(p) for p in grid])], abs=2e-3)
    assert mean == pytest.approx(turned(lam).mean(), rel=1e-9)
    out = np.array(scaled(spark, "power", x))
    assert abs(out.mean()) < 1e-9 and out.std() == pytest.approx(1.0)


# ---------------------------------------------------------------- features and selection


def points(spark, n=300, d=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ np.diag([5, 3, 1, 0.5][:d]) + 7
    label = np.where(x[:, 0] + x[:, 1] > 14, "a", np.where(x[:, 2] > 7, "b", "c"))
    names = [f"x{i}" for i in range(d)]
    df = frame(spark, [(i, *map(float, r), str(l)) for i, (r, l) in enumerate(zip(x, label))],
               "row_id long, " + ", ".join(f"{c} double" for c in names) + ", label string")
    return df, x, label, names


def matrix(df, cols):
    return np.array([[r[c] for c in cols] for r in df.orderBy("row_id").collect()])


def test_projections_match_numpy(spark):
    df, x, label, names = points(spark)
    centred = x - x.mean(axis=0)
    vec = np.linalg.svd(centred, full_matrices=False)[2][:2].T
    want = centred @ features.fix_signs(vec)
    got = matrix(features.fit_features(df, "pca").apply(df), ["0", "1"])
    assert np.allclose(got, want, atol=1e-8)
    assert np.allclose(matrix(features.fit_features(df, "IncrementalPCA").apply(df), ["0", "1"]), want, atol=1e-8)
    parts = [features.moment_table(df.where(F.col("row_id") % 3 == i), names) for i in range(3)]
    merged = features.pca_from_moments(features.merge_moments(parts), names, 2)
    assert np.allclose(matrix(merged.apply(df), ["0", "1"]), want, atol=1e-6)
    raw = np.linalg.svd(x, full_matrices=False)[2][:2].T
    svd = matrix(features.fit_features(df, "TruncatedSVD").apply(df), ["0", "1"])
    assert np.allclose(svd, x @ features.fix_signs(raw), atol=1e-6)


def test_discriminant_separates_classes(spark):
    df, x, label, names = points(spark)
    out = matrix(features.fit_features(df, "lda").apply(df), ["0", "1"])
    within = sum(np.cov(out[label == c].T, bias=True) * (label == c).sum() for c in "abc") / (len(x) - 3)
    assert np.allclose(within, np.eye(2), atol=1e-6)
    one = df.withColumn("label", F.lit("a"))
    with pytest.raises(ValueError):
        features.fit_features(one, "lda")


def test_kernel_projection_follows_the_kernel(spark):
    rng = np.random.default_rng(1)
    angle = rng.random(400) * 2 * np.pi
    radius = np.where(np.arange(400) % 2, 0.3, 2.0)
    rows = [(i, float(r * np.cos(a)), float(r * np.sin(a)), str(int(r < 1))) for i, (r, a) in enumerate(zip(radius, angle))]
    df = frame(spark, rows, "row_id long, x double, y double, label string")
    out = matrix(features.fit_features(df, "kernel_pca").apply(df), ["0", "1"])
    inner, outer = out[np.arange(400) % 2 == 1], out[np.arange(400) % 2 == 0]
    assert np.linalg.norm(inner.mean(axis=0) - outer.mean(axis=0)) > 0.2
    fitted = models.fit_model(df, "SVM", kernel_features=96)
    assert models.fit_model(df, "DecisionTree", max_depth=1).model.depth <= 1
    hit = fitted.predict(df).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    assert hit > 0.95  # a ring no plane can cut


def test_products_in_order(spark):
    df = frame(spark, [(1, 2.0, 3.0, "t", "l")], "row_id long, a double, b double, c string, label string")
    poly = features.fit_features(df, "polynomial").apply(df).first()
    assert list(poly)[1:6] == [2.0, 3.0, 4.0, 6.0, 9.0] and poly["c"] == "t"
    inter = features.fit_features(df, "InteractionFeatures").apply(df).first()
    assert list(inter)[1:4] == [2.0, 3.0, 6.0]


def test_random_trees_give_one_leaf_per_tree(spark):
    df, *_ = points(spark, 200, 3)
    out = features.fit_features(df, "RandomTrees").apply(df)
    assert out.columns == ["row_id", "0", "label"]
    assert {r["0"].numNonzeros() for r in out.collect()} == {features.TREES}


def test_selection_rules(spark):
    df, x, label, names = points(spark)
    flat = df.withColumn("k", F.lit(3.0)).withColumn("w", F.lit("text"))
    assert select.select_features(flat) == [*names, "w"]
    assert select.by_anova(flat)[:2] == ["x0", "x1"] and len(select.by_anova(flat)) == 3
    number = flat.withColumn("label", (F.col("x0") * 2 + F.col("x1")).cast("string"))
    assert "x0" in select.by_pearson(number) and "k" not in select.by_pearson(number)
    with pytest.raises(ValueError):
        select.by_pearson(flat)
    only = frame(spark, [(1, 1.0, "l"), (2, 1.0, "l")], "row_id long, k double, label string")
    assert select.by_variance(only) == ["k"]


# ---------------------------------------------------------------- mutual information


def brute_information(x, y, k=3):
    n = len(x)
    psi = lambda m: (-mutual_info.EULER + sum(1.0 / i for i in range(1, m)))
    total = 0.0
    for i in range(n):
        same = sorted(abs(x[i] - x[j]) for j in range(n) if j != i and y[j] == y[i])
        r = same[min(k, len(same)) - 1]
        m = sum(abs(x[i] - x[j]) < r for j in range(n))
        total += psi(min(k, len(same))) - psi(len(same) + 1) - psi(m)
    return max(0.0, total / n + psi(n))


@pytest.mark.parametrize("bucket_rows", [25, 10_000])
def test_neighbour_information_by_brute_force(spark, bucket_rows):
    rng = random.Random(6)
    y = [rng.choice("aab") if i else "b" for i in range(240)] + ["lonely"]
    x = [rng.gauss(0 if c == "a" else 2, 1) for c in y]
    df = frame(spark, [(i, v, c) for i, (v, c) in enumerate(zip(x, y))], "row_id long, x double, label string").repartition(4)
    got = mutual_info.mutual_information(df, bucket_rows=bucket_rows).first()["mutual_info"]
    assert got == pytest.approx(brute_information(x[:-1], y[:-1]), abs=1e-3)


def test_information_of_ties_is_finite(spark):
    df = frame(spark, [(i, float(i % 2), "a" if i % 2 else "b") for i in range(200)], "row_id long, x double, label string")
    assert mutual_info.mutual_information(df).first()["mutual_info"] == pytest.approx(math.log(2), abs=0.1)


# ---------------------------------------------------------------- models and metrics


@pytest.mark.parametrize("name", models.MODELS)
def test_models_learn(spark, name):
    df, *_ = points(spark)
    ready = scale.fit_scaler(df, "standard").apply(df)
    out = models.fit_model(ready, name).predict(ready)
    assert out.columns == ["row_id", "label", "prediction"] and out.count() == 300
    assert metrics.classification_metrics(out).first()["accuracy"] > 0.8


def test_one_class_and_unknown_model(spark):
    df, *_ = points(spark, 40, 3)
    flat = df.withColumn("label", F.lit("only"))
    assert {r["prediction"] for r in models.fit_model(flat, "LogisticRegression").predict(flat).collect()} == {"only"}
    with pytest.raises(ValueError):
        models.fit_model(df, "Perceptron")


def test_metrics_with_an_unseen_prediction(spark):
    df = frame(spark, [("a", "a"), ("a", "z"), ("b", "b"), ("b", "a")], "label string, prediction string")
    r = metrics.classification_metrics(df).first()
    assert r["accuracy"] == 0.5
    assert r["precision_macro"] == pytest.approx((0.5 + 1 + 0) / 3)
    assert r["recall_macro"] == pytest.approx((0.5 + 0.5 + 0) / 3)


# ---------------------------------------------------------------- chains


def mixed(spark, n=400):
    rng = random.Random(7)
    rows = [
        (i, None if i % 9 == 0 else rng.gauss(0, 2), rng.random(), 1.0, rng.choice(["u", "v", None]), rng.choice(["no", "yes"]))
        for i in range(n)
    ]
    return frame(spark, rows, "row_id long, a double, b double, k double, c string, label string")


@pytest.mark.parametrize("order,ops", [
    (["I", "O", "E", "N", "FT"], ["median", "iqr", "onehot", "robust", "polynomial"]),
    (["I", "E", "N"], ["most_frequent", "binary", "power"]),
    (["I", "E", "FT", "N", "FS"], ["mean", "frequency", "pca", "quantile", "variance"]),
    (["I", "E", "N", "FT"], ["mean", "label", "kbins", "RandomTrees"]),
])
def test_chain_apply_equals_fit_columns(spark, order, ops):
    df = mixed(spark)
    train, test = split.divide(split.stratified_split(df))
    fitted = chain.fit_chain(train, chain.steps_of(order, ops))
    a, b = fitted.apply(train), fitted.apply(test)
    assert a.columns == b.columns and a.columns[0] == "row_id" and a.columns[-1] == "label"
    assert "k" not in a.columns
    assert b.count() == test.count()
    assert b.na.drop().count() == test.count()


def test_plan_of_apply_is_plain(spark):
    df = mixed(spark)
    fitted = chain.fit_chain(df, chain.steps_of(["I", "O", "E", "N"], ["mean", "zscore", "label", "standard"]))
    text = fitted.apply(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "ArrowEval" not in text and "Exchange hashpartitioning" not in text


def test_failures_are_reported(spark):
    df = mixed(spark, 80)
    t = evaluate.evaluate_holdout(df, ["I", "N"], ["mean", "no such scaler"], "DecisionTree")
    assert t.score == -1 and "no such scaler" in t.reason
    with pytest.raises(ValueError):
        chain.steps_of(["I"], ["mean", "extra"])


def test_folds_are_level(spark):
    df = mixed(spark, 200)
    sizes = split.stratified_folds(df, 4).groupBy("label", "fold").count().groupBy("label").agg(F.max("count") - F.min("count")).collect()
    assert all(r[1] <= 1 for r in sizes)


# ---------------------------------------------------------------- knowledge tables


def test_empty_history(spark):
    none = frame(spark, [], "dataset string, trial_id long, logic_pipe string, phy_pipe string, accuracy double")
    assert trials.transition_table(none, ["x"], ["E", "N"]).count() == 0
    log = frame(spark, [(0, 1, "E_N", ["label", "power"], 0.5), (0, 2, "E_N", ["label", "robust"], 0.7), (0, 3, "E_N", ["onehot", "robust"], 0.6)],
                "run_id long, iteration long, step_order string, ops array<string>, score double")
    got = {(r["prev"], r["next"]): round(r["score"], 6) for r in trials.transition_update(trials.transition_table(none, ["x"], ["E"]), log).collect()}
    assert got == {(trials.START, "label"): 0.2, ("label", "robust"): 0.2, ("onehot", "robust"): -0.1}


def test_choice_weights_rules(spark):
    s = frame(spark, [("p", "a", 1.0), ("p", "b", 0.0), ("q", "a", 2.0), ("q", "b", 2.0), ("n", "a", -1.0), ("n", "b", -2.0)], "prev string, next string, score double")
    w = {(r["prev"], r["next"]): r["weight"] for r in trials.choice_weights(s).collect()}
    assert w[("q", "a")] == 0.5 and w[("p", "a")] == pytest.approx(1 / (1 + math.exp(-2)))
    lin = {(r["prev"], r["next"]): r["weight"] for r in trials.choice_weights(s, temperature=None).collect()}
    assert lin[("p", "a")] == 1.0 and lin[("n", "a")] == 0.5


def test_space_sizes(spark):
    got = {r["model"]: r["combinations"] for r in knowledge.space_sizes(knowledge.operator_space(spark)).collect()}
    assert got == {"LogisticRegression": 288, "DecisionTree": 192, "KNN": 2592, "SVM": 2592}


def test_missing_default_drops_the_step(spark):
    seqs = frame(spark, [("d", 0, ["I", "FT"], ["mean", None])], "dataset string, pos int, step_order array<string>, ops array<string>")
    r = knowledge.candidates(seqs).first()
    assert (r["step_order"], r["ops"]) == (["I"], ["mean"])


def test_finalists_need_to_have_been_best(spark):
    log = frame(spark, [(0, 1, "N", ["a"], 0.9), (0, 2, "N", ["b"], 0.895), (0, 3, "N", ["c"], 0.905)],
                "run_id long, iteration long, step_order string, ops array<string>, score double")
    assert sorted(r["ops"][0] for r in ledger.finalists(log).collect()) == ["a", "c"]


# ---------------------------------------------------------------- sources, sinks, streams


def test_csv_round_trip(spark, tmp_path):
    src = tmp_path / "set_a.csv"
    src.write_text("y,a,c\nyes,1,u\nno,,v\nyes,3.5,\n")
    df, roles = tables.read_labelled_csv(spark, str(src), target="y")
    assert df.columns == ["row_id", "a", "c", "label"] and df.where("a is null").count() == 1
    with pytest.raises(ValueError):
        tables.read_labelled_csv(spark, str(src), target="nope")
    many = tables.read_many(spark, [str(tmp_path)])
    assert {r["dataset"] for r in many.collect()} == {"set_a"}
    paths = sinks.write_prepared(df, df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(paths["processed_train"]).count() == 3
    single = frame(spark, [(1,)], "x int")
    with pytest.raises(ValueError):
        tables.check_labelled(single, None)


def test_nan_is_missing(spark):
    df = lay_out(frame(spark, [(1, float("nan"), True, "l")], "row_id long, x double, f boolean, label string"))
    r = df.first()
    assert r["x"] is None and r["f"] == "true"


def test_recorded_history_files(spark, tmp_path):
    d = tmp_path / "KNN" / "accuracy" / "json"
    d.mkdir(parents=True)
    (d / "7.json").write_text('{"7": [[0.5, ["O", "N"], ["mean", null, "minmax"]], [0.4, ["N"], ["knn", "power"]]]}')
    got = tables.locate_recorded(spark, str(tmp_path), "KNN", "f1_macro").orderBy("pos").collect()
    assert got[0]["dataset"] == "7" and got[0]["ops"] == ["mean", None, "minmax"] and got[1]["score"] == 0.4
    with pytest.raises(FileNotFoundError):
        tables.locate_recorded(spark, str(tmp_path), "SVM", "accuracy")


def test_stream_equals_batch(spark, tmp_path):
    from winnow.streaming.apply import prepare_stream

    df = mixed(spark)
    src = str(tmp_path / "in")
    df.repartition(3).write.parquet(src)
    fitted = chain.fit_chain(df, chain.steps_of(["I", "E", "N"], ["mean", "label", "quantile"]))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = prepare_stream(fitted, stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fitted.apply(df).collect()))


def test_streamed_moments_give_the_same_projection(spark, tmp_path):
    from winnow.streaming.moments import moment_stream, to_memory

    df, x, label, names = points(spark)
    src = str(tmp_path / "in")
    df.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = to_memory(moment_stream(stream, names), "moments_out")
    q.awaitTermination()
    fitted = features.pca_from_moments(spark.table("moments_out"), names, 2)
    want = matrix(features.fit_features(df, "pca").apply(df), ["0", "1"])
    assert np.allclose(matrix(fitted.apply(df), ["0", "1"]), want, atol=1e-6)


# ---------------------------------------------------------------- rows and nulls are kept


def test_knn_keeps_rows_without_any_value(spark):
    from winnow.operators.knn import classify

    train = spark.createDataFrame([(i, float(i), "a" if i < 7 else "b") for i in range(10)], "row_id long, f_x double, label string")
    test = spark.createDataFrame([(1, 0.0, "a"), (2, 9.0, "b"), (3, None, "b")], "row_id long, f_x double, label string")
    got = {r.row_id: r.prediction for r in classify(train, test, ["f_x"], 3).collect()}
    assert got == {1: "a", 2: "b", 3: "a"}


def test_null_keys_keep_their_rows(spark):
    from pyspark.sql import functions as F
    from winnow.functions.ranks import bucket_ordinal, running_max_before

    df = spark.createDataFrame([(None if i % 5 == 0 else "k", i, float(i % 7)) for i in range(40)], "g string, i long, v double")
    numbered = bucket_ordinal(df.withColumn("b", F.when(F.col("i") > 30, 1)), ["g"], "b", ["i"], "n").collect()
    assert sorted(r.n for r in numbered if r.g is None) == list(range(1, 9)) and len(numbered) == 40
    assert running_max_before(df, ["g"], "i", F.col("v"), "m", 10).count() == 40


def test_iterative_imputation_feeds_rounds(spark):
    import numpy as np
    from winnow.operators.impute import fit_imputer

    rng = np.random.default_rng(0)
    b = rng.normal(size=300)
    table = np.column_stack([2 * b + 0.3 * rng.normal(size=300), b, -b + 0.3 * rng.normal(size=300)])
    holes = table.copy()
    holes[:40, :2] = np.nan  # two columns missing together
    holes[40:60, 2] = np.nan
    rows = [(i, *[None if np.isnan(x) else float(x) for x in r], "y") for i, r in enumerate(holes)]
    df = spark.createDataFrame(rows, "row_id long, f_a double, f_b double, f_c double, label string")
    imputer = fit_imputer(df, "iterative", rounds=10)
    got = np.array([[r.f_a, r.f_b, r.f_c] for r in imputer.apply(df).orderBy("row_id").collect()])

    state = np.where(np.isnan(holes), np.nanmean(holes, axis=0), holes)
    order = sorted(range(3), key=lambda j: (np.isnan(holes[:, j]).sum()))
    steps = len(imputer.coefficients) // 3
    for _ in range(steps):
        for j in order:
            other, known = [x for x in range(3) if x != j], ~np.isnan(holes[:, j])
            x = np.column_stack([np.ones(known.sum()), state[known][:, other]])
            w = np.linalg.lstsq(x, state[known, j], rcond=None)[0]
            state[~known, j] = np.column_stack([np.ones((~known).sum()), state[~known][:, other]]) @ w
    assert np.abs(got - state).max() < 1e-5


def test_csv_rows_are_numbered_by_place(spark, tmp_path):
    from winnow.sources.tables import read_labelled_csv

    for part in range(3):
        (tmp_path / f"p{part}.csv").write_text("x,y\n" + "".join(f"{part * 500 + i},a\n" for i in range(500 - 100 * part)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for width in ("512", size):
            spark.conf.set("spark.sql.files.maxPartitionBytes", width)
            df, _ = read_labelled_csv(spark, str(tmp_path), "y", schema="x int, y string")
            rows = sorted((r[0], r[1]) for r in df.select("row_id", df.columns[1]).collect())
            assert [i for i, _ in rows] == list(range(1200)) and [v for _, v in rows] == sorted(v for _, v in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_onehot_tells_null_from_the_word_null(spark):
    from winnow.operators.encode import fit_encoder

    df = spark.createDataFrame([(1, "null", "a"), (2, None, "b"), (3, "x", "a")], "row_id long, c_s string, label string")
    out = fit_encoder(df, "onehot").apply(df)
    assert len(set(out.columns)) == len(out.columns) and out.count() == 3


def proposed(spark, log, lists, round_no=1, batch=4, max_iter=30, **options):
    rows = [(run, i, "_".join("IENF"[: len(ops)]), list(ops), score, None) for run, i, ops, score in log]
    table = evaluate.ledger_frame(spark, rows)
    edges = search.starting_edges(spark, None, [], {})
    got = proposals.next_lists(table, lists, edges, round_no, batch, max_iter, **options).orderBy("run_id", "place").collect()
    return [(r.run_id, tuple(r.ops)) for r in got]


def test_search_tries_every_list(spark):
    """Each round proposes untried lists only, and all of them in the end; a list from outside the
    space closes nothing."""
    space = {"I": ["a", "b", "c"], "E": ["d", "e"], "N": ["f", "g"]}
    lists = proposals.operator_lists(spark, [list("IEN"), ["I"]], space).persist()
    assert lists.count() == 12 + 3
    every = {0: set(itertools.product(*space.values())), 1: {("a",), ("b",), ("c",)}}
    log, done = [(0, 1, ("z", "d", "f"), 0.5), (1, 1, ("z",), 0.5)], {0: 1, 1: 1}
    assert proposed(spark, log, lists, 0) == proposed(spark, log, lists, 0)
    for round_no in range(20):
        got = proposed(spark, log, lists, round_no, batch=7)
        assert len(set(got)) == len(got)
        if not got:
            break
        for run, ops in got:
            assert (run, ops) not in {(r, o) for r, _, o, _ in log} and ops in every[run]
            done[run] += 1
            log.append((run, done[run], ops, random.Random(str(ops)).random()))
    assert {run: {o for r, _, o, _ in log if r == run} - {("z", "d", "f"), ("z",)} for run in (0, 1)} == every
    assert proposed(spark, log[:3], lists, 1, max_iter=2) and not proposed(spark, log[:2], lists, 1, max_iter=1)
    stale = [(1, i, ("z",), 0.5) for i in range(1, proposals.PATIENCE + 2)]
    assert not proposed(spark, stale, lists, 1, max_iter=500)
    lists.unpersist()


def test_search_walks_by_upper_confidence_and_weight(spark):
    space = {"I": ["a", "b"], "E": ["d", "e"]}
    lists = proposals.operator_lists(spark, [list("IE")], space)
    # both choices of I were tried: the walk goes to the one with the higher upper confidence value
    log = [(0, 1, ("a", "d"), 0.2), (0, 2, ("b", "d"), 0.9)]
    ucb = {r.prefix: r.ucb for r in ledger.prefix_scores(evaluate.ledger_frame(spark, [(r, i, "I_E", list(o), s, None) for r, i, o, s in log]), 2.0).collect()}
    assert ucb["b"] > ucb["a"]
    assert proposed(spark, log, lists, batch=1) == [(0, ("b", "e"))]
    # fresh choices of a slot are drawn in proportion to exp(score / temperature)
    wide = proposals.operator_lists(spark, [["I"]], {"I": ["p", "q", "r"]})
    edges = spark.createDataFrame([(0, trials.START, "p", 1.0), (0, trials.START, "q", 0.5)], "run_id long, prev string, next string, score double")
    log = evaluate.ledger_frame(spark, [(n, 1, "I", ["z"], 0.5, None) for n in range(200)])
    runs = spark.range(200).select(F.col("id").alias("run_id"))
    every = proposals.next_lists(log, wide.drop("run_id").crossJoin(runs), edges.drop("run_id").crossJoin(runs), 1, 1, 30, explore=0.0)
    seen = {r.op: r["count"] / 200 for r in every.groupBy(F.col("ops")[0].alias("op")).count().collect()}
    weight = {"p": math.e**2, "q": math.e, "r": 1.0}
    for op, w in weight.items():
        assert abs(seen.get(op, 0.0) - w / sum(weight.values())) < 0.12


def test_prefixes_are_shared_by_trials_at_the_same_time(spark):
    df = mixed(spark)
    with evaluate.HoldOut(df, "DecisionTree") as split:
        split.run_many([(list("IEN"), ["mean", "label", n]) for n in ("standard", "minmax", "maxabs", "robust")])
        fitted = [k for k in split.shared._steps if k[-1] != "keep"]
        assert sum(len(k) and k[-1] == ("I", "mean") for k in fitted) == 1
        assert sorted(k[-1][1] for k in fitted if k[-1][0] == "N") == ["maxabs", "minmax", "robust", "standard"]
        chained = chain.fit_chain(split.train, chain.steps_of(list("IEN"), ["mean", "label", "minmax"]), shared=split.shared)
        alone = chain.fit_chain(split.train, chain.steps_of(list("IEN"), ["mean", "label", "minmax"]))
        for ready, part in zip(chained.ready, (split.train, split.test)):
            assert sorted(map(tuple, ready.collect())) == sorted(map(tuple, alone.apply(part).collect()))


def test_batch_run_writes_all_outputs_once(spark, tmp_path):
    from catalog.evaluation import _history

    rng = random.Random(4)
    files = {}
    for name, n in (("first", 90), ("second", 80)):
        rows = [(rng.gauss(0, 1), rng.random(), rng.choice("uv")) for _ in range(n)]
        lines = [f"{a:.4f},{b if b > 0.1 else ''},{c},{'yes' if a + (c == 'u') > 0.5 else 'no'}" for a, b, c in rows]
        (tmp_path / f"{name}.csv").write_text("a,b,c,y\n" + "\n".join(lines) + "\n")
        files[name] = str(tmp_path / f"{name}.csv")
    kb, rec = _history(spark, "/root/testdata/sf0.001")
    kb, out = kb.persist(), str(tmp_path / "out")
    options = dict(target="y", model="DecisionTree", max_iter=2, batch=1, orders=1, folds=2)
    records = {r.dataset: r for r in search.run_batch(spark, files, kb, rec, out, **options).collect()}
    assert set(records) == set(files)
    for r in records.values():
        assert r.seconds > 0 and 0 <= r.best_score <= 1 and 0 <= r.test_accuracy <= 1 and ":" in r.best_sequence
    log = spark.read.parquet(f"{out}/search_log")
    assert {r.dataset: r["count"] for r in log.groupBy("dataset").count().collect()} == {n: 2 for n in files}
    curve = spark.read.parquet(f"{out}/global_curve")
    assert curve.count() == 4 and curve.where("dataset = 'first'").agg(F.max("global_best_score")).first()[0] == log.where("dataset = 'first'").agg(F.max("score")).first()[0]
    best = json.loads(spark.read.text(f"{out}/first/best_sequence").first()[0])
    report = json.loads(spark.read.text(f"{out}/first/run_report").first()[0])
    assert report["best"] == best and records["first"].best_sequence.startswith("_".join(best["order"]))
    prepared = spark.read.option("header", True).csv(f"{out}/first/processed_test")
    assert prepared.count() > 10 and "label" in prepared.columns
    # again over one file: its rows are replaced, the others stay
    before = sorted(map(str, log.drop("reason").collect()))
    key = {"dataset": "second", "model": "DecisionTree"}
    rows = log.where("dataset = 'second'").drop("dataset", "model").collect()
    sinks.write_keyed(spark.createDataFrame(rows, log.drop("dataset", "model").schema), f"{out}/search_log", key)
    again = spark.read.parquet(f"{out}/search_log")
    assert sorted(map(str, again.drop("reason").collect())) == before
    kb.unpersist()


def test_scores_of_a_prepared_table(spark):
    rows = [(i, float(i % 10), "yes" if i % 10 > 4 else "no") for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, a double, label string")
    assert evaluate.score_prepared(df, "DecisionTree") == 1.0
    assert evaluate.score_prepared(df, "DecisionTree", rows=100) == 1.0
    assert evaluate.evaluate_cv(df, ["N"], ["standard"], "DecisionTree", k=2).score == 1.0


def test_registered_search_has_the_default_budget(monkeypatch):
    from types import SimpleNamespace

    from catalog import evaluation

    asked = []
    for name in ("select_sequence", "run_report"):
        monkeypatch.setattr(search, name, lambda *a, **k: asked.append(k) or (SimpleNamespace(ledger=None) if len(asked) == 1 else (None, None)))
    monkeypatch.setattr(evaluation, "view", lambda *a: None)
    monkeypatch.setattr(evaluation, "_history", lambda *a: (None, None))
    evaluation.select_sequence(None, None)
    evaluation.run_report(None, None)
    assert asked == [{"model": "DecisionTree"}] * 2


@pytest.mark.parametrize("cells", [profile.BROADCAST_CELLS, 0])
def test_table_measures_have_mutual_information(spark, monkeypatch, cells):
    monkeypatch.setattr(profile, "BROADCAST_CELLS", cells)  # 0: rows of a table dealt over salts
    rows = [(i, "a" if i % 3 else "b", float(i % 7) if i % 5 else None, float(i % 2), "xyz"[i % 2 + (i % 4 == 0)]) for i in range(60)]
    rows += [(100, None, 1.0, 2.0, "x"), (101, None, 5.0, 2.0, "y"), (102, "n", 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "row_id long, dataset string, f_p double, f_q double, label string")
    got = {r.dataset: r for r in profile.table_measures(df, ["dataset"]).collect()}
    for name, part in (("a", df.where("dataset = 'a'")), ("b", df.where("dataset = 'b'")), (None, df.where("dataset is null"))):
        one = [r.mutual_info for r in profile.binned_mutual_information(part.drop("dataset")).collect()]
        assert len(one) == 2 and got[name].mean_mutual_info == pytest.approx(sum(one) / 2)
        assert got[name].max_mutual_info == pytest.approx(max(one))
        whole = profile.table_measures(part.drop("dataset")).first()
        assert whole.max_mutual_info == pytest.approx(max(one))
    assert got[None].max_mutual_info == pytest.approx(math.log(2)) and got["n"].mean_mutual_info == 0.0
    few = profile.table_measures(df.drop("f_p", "f_q").withColumn("c_k", F.lit("k")), ["dataset"])
    assert few.where("max_mutual_info <> 0 or mean_mutual_info is null").count() == 0


def test_nearest_datasets_asks_for_every_measure(spark):
    kb = spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, 0.1)], "dataset string, n_instances double, max_mutual_info double")
    with pytest.raises(ValueError, match="max_mutual_info"):
        knowledge.nearest_datasets(kb, kb.drop("max_mutual_info"))


@pytest.mark.parametrize("copies", [0, 8])
def test_knn_imputation_by_views_and_trees(spark, monkeypatch, copies):
    """Blocks searched by a tree, several blocks a cell, and views of a pattern or none."""
    rng = random.Random(8)
    rows = []
    for i in range(500):
        x = [round(rng.gauss(0, 3), 1), float(rng.randint(0, 2)), rng.random(), 1.0]
        rows.append((i, [None if j < 2 and rng.random() < 0.2 else v for j, v in enumerate(x)]))
    for name, value in (("TREE_ROWS", 60), ("BRUTE_ROWS", 10), ("LEAF_ROWS", 12), ("CELLS", 200), ("COPIES", copies), ("CHUNK_ROWS", 40)):
        monkeypatch.setattr(knn, name, value)
    monkeypatch.setattr(knn.nearest, "__defaults__", (None, 40))
    df = frame(spark, [(i, *x) for i, x in rows], "row_id long, a double, b double, c double, d double")
    got = {r["row_id"]: list(r)[1:] for r in impute.fit_imputer(df, "knn").apply(df).select("row_id", *"abcd").collect()}
    want = brute_impute(rows)
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-9), i


def test_knn_tree_finds_what_all_distances_find():
    rng = np.random.default_rng(1)
    p = np.round(rng.normal(size=(700, 3)), 1)  # many equal distances
    a = np.round(rng.normal(size=(90, 3)), 1)
    every = np.sqrt(((a[:, None] - p[None]) ** 2).sum(axis=2) * 3 / 3)
    i, j, dist = knn._near_halved(a, knn._halved(p, 5), 5, 3, np.full(90, np.inf))
    for q in range(90):
        near = sorted(zip(dist[i == q], j[i == q]))[:5]
        assert [n for _, n in near] == [n for _, n in sorted(zip(every[q], range(700)))[:5]]
    assert len(i) < 90 * 700 / 4
    assert len(knn._near_halved(a, knn._halved(p, 5), 5, 3, np.full(90, -1.0))[0]) == 0


def test_knn_keeps_points_once_by_the_columns_that_queries_have(spark):
    """Queries without ``a`` see 6 different points, not 3,000; before, they were sent to all of them."""
    pts = spark.range(3000).selectExpr("id AS pid", "double(id) AS x0", "double(id % 6) AS x1")
    qs = spark.range(50).selectExpr("id AS qid", "'0' AS need", "CAST(NULL AS double) AS x0", "double(id % 7) AS x1")
    cells, boxes, views = knn._pack(pts, qs, ["x0", "x1"], 5, 1000, True)
    assert views == {"11": ["01"]}
    assert cells.count() == 30 and boxes["n"].sum() == 30


def test_knn_routes_and_ranks_in_small_matrices(monkeypatch):
    """No matrix of a task has more than half a million numbers, however many cells or points there are."""
    cells, seen = 1500, []
    boxes = pd.DataFrame({"cell": [f"1,1,{i}" for i in range(cells)], "pat": "1", "view": "1", "n": 10, "lo_x0": np.arange(cells) * 1.0, "hi_x0": np.arange(cells) + 0.5})
    plain, parted = knn._lower, np.partition
    monkeypatch.setattr(knn, "_lower", lambda index, q: seen.append(len(q) * cells) or plain(index, q))
    monkeypatch.setattr(np, "partition", lambda m, *a, **b: seen.append(m.size) or parted(m, *a, **b))
    asked = pd.DataFrame({"qid": range(2000), "need": "", "x0": np.arange(2000) % cells + 0.1, "_r": 2.0})
    index = knn._index(boxes, ["x0"], False, {"1": ["1"]})
    got = pd.concat(knn._route(iter([asked]), index, 5, ["x0"], "_r"))
    assert set(got["qid"]) == set(range(2000)) and set(got["r"]) == {2.0}
    p = np.random.default_rng(2).normal(size=(1900, 2))
    q = np.random.default_rng(3).normal(size=(3000, 2))
    top = knn._topk(np.arange(3000), np.array([""] * 3000), q, np.arange(1900), p, 5, 2, np.full(3000, np.inf), False)
    assert len(top) == 15_000 and max(seen) <= 1 << 19
