"""Downstream classifiers with one fit/predict surface: (row_id, label, prediction)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.constants import constant_array
from winnow.operators import knn, landmarks, linear, tree
from winnow.operators.features import assembled, dot
from winnow.roles import ROLES, Roles, col, ident

MODELS = ("KNN", "LogisticRegression", "DecisionTree", "SVM")
# Landmarks of the SVM at most: every pass adds up second derivatives between all of them.
KERNEL_FEATURES = 256
# The SVM's hinge with its corner rounded, and how far the fit goes.
CORNERS = ((0.05, 0.002),)


def known_model(name: str) -> str:
    if name not in MODELS:
        raise ValueError(f"unsupported model: {name}. Available: {list(MODELS)}")
    return name


def inputs_of(df: DataFrame, roles: Roles) -> list[str]:
    return roles.numeric(df) + roles.vectors(df)


@dataclass
class Fitted:
    name: str
    columns: list[str]
    roles: Roles
    model: tree.Tree | DecisionTreeClassificationModel | None = None
    classes: list[str] | None = None
    train: DataFrame | None = None
    solved: linear.Solved | None = None
    land: landmarks.Landmarks | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        r = self.roles
        if self.classes is not None and len(self.classes) == 1:
            return df.select(*r.ids(df), *r.labels(df), F.lit(self.classes[0]).alias("prediction"))
        have = set(df.columns)
        df = df.selectExpr(
            *map(ident, r.ids(df)), *map(ident, r.labels(df)),
            *[ident(c) if c in have else f"0D AS {ident(c)}" for c in self.columns],
        )
        if self.name == "KNN":
            return knn.classify(self.train, df, self.columns, 5, r)
        ready = assembled(df, self.columns, "_vec")
        if self.name == "DecisionTree":
            names = F.array(*[F.lit(c) for c in self.classes])
            if isinstance(self.model, tree.Tree):
                place = self.model.predict(ready, vector_to_array("_vec"))
            else:
                ready, place = self.model.transform(ready), F.col("_pred").cast("int")
            return ready.select(*r.ids(df), *r.labels(df), F.get(names, place).alias("prediction"))
        scored = ready.withColumn("_x", vector_to_array("_vec")).withColumn("_s", self._scores())
        best = F.array_position("_s", F.array_max("_s")) - 1
        names = F.array(*[F.lit(c) for c in self.classes])
        return scored.select(*r.ids(df), *r.labels(df), F.get(names, best.cast("int")).alias("prediction"))

    def _scores(self):
        """One number per class; the largest wins, and of equal ones the first class."""
        w, b = self.solved.weights, self.solved.offsets
        if self.land is not None:
            signs = linear.one_against_one(len(self.classes))
            return self.land.linear(F.col("_x"), w.T, b, lambda d: votes(d, signs))
        if len(self.classes) == 2:
            w, b = np.vstack([np.zeros_like(w), w]), np.append(0.0, b)
        rows = [([float(v) for v in w[k]], float(b[k])) for k in range(len(w))]
        return F.transform(
            constant_array(rows, "w array<double>, b double"), lambda g: dot(F.col("_x"), g["w"]) + g["b"]
        )


def votes(decisions: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Votes for each class from the decisions of the problems between pairs."""
    won = (decisions > 0).astype(np.float64)
    return won @ (signs > 0).T + (1.0 - won) @ (signs < 0).T


def fit_model(
    df: DataFrame, name: str, roles: Roles = ROLES, seed: int = 0, max_depth: int = 20, max_bins: int = 64,
    kernel_features: int = KERNEL_FEATURES, kernel_error: float = landmarks.ERROR, cost: float = 1.0,
    offset_ridge: float | None = None,
) -> Fitted:
    """``max_depth`` and ``max_bins`` bound the tree. The SVM's radial kernel is replaced by its
    restriction to landmark rows, as many as leave out at most ``kernel_error`` of k(x, x) on
    average, ``kernel_features`` at most (``land.error`` is the part measured). ``cost`` weighs the rows' losses against the weights' size;
    ``offset_ridge`` is the penalty on the offset (by default 1 for the logistic regression, 0 for
    the SVM)."""
    known_model(name)
    cols = inputs_of(df, roles)
    if not cols:
        raise ValueError("no numeric columns to learn from")
    df = df.where(col(roles.label).isNotNull())
    if name == "KNN":
        if roles.vectors(df):
            raise ValueError("the neighbour model needs scalar columns")
        return Fitted(name, cols, roles, train=df)
    out = Fitted(name, cols, roles)
    # cached before anything is counted, so that the preparation runs once
    ready = assembled(df, cols, "_vec").select("_vec", col(roles.label).cast("string").alias("_label")).persist()
    try:
        indexer = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(ready)
        out.classes = list(indexer.labelsArray[0])
        coded = indexer.transform(ready)
        if len(out.classes) < 2:
            return out
        if name == "DecisionTree":
            rows = coded.select(vector_to_array("_vec").alias("_x"), "_y")
            counts = tree.class_counts(rows, len(out.classes))
            if max(tree.CUT_ROWS, max_bins * max_bins) < counts.sum() <= tree.NODE_ROWS:
                # bins cut by Spark ML's own sample, which nothing else draws; its histograms are small here
                ml = DecisionTreeClassifier(
                    featuresCol="_vec", labelCol="_y", predictionCol="_pred", maxDepth=max_depth, maxBins=max_bins,
                    maxMemoryInMB=1024, seed=42,
                )
                out.model = ml.fit(coded.select("_vec", "_y"))
            else:
                out.model = tree.fit_tree(rows, counts, max_depth, max_bins)
        else:
            _linear(coded.select(vector_to_array("_vec").alias("_x"), "_y"), out, seed, kernel_features,
                    kernel_error, cost, offset_ridge)
    finally:
        ready.unpersist()
    return out


def _linear(data: DataFrame, out: Fitted, seed: int, size: int, error: float, cost: float, ridge: float | None) -> None:
    width = len(data.select("_x").first()[0])
    classes = len(out.classes)
    data = linear.dealt(data, "_x")
    blocks = linear.pack(data, "_x", "_y").persist()
    try:
        if out.name == "LogisticRegression":
            out.solved = linear.solve(
                blocks, width, linear.one_against_rest(classes), linear.logistic_loss, 0.25, cost,
                1.0 if ridge is None else ridge,
            )
            return
        out.land = landmarks.choose(data, "_x", _gamma(blocks, width), error, size, seed)
        corner, tol = CORNERS[-1]
        out.solved = linear.solve(
            blocks, width, linear.one_against_one(classes), linear.hinge_loss(corner), 1.0 / corner, cost,
            0.0 if ridge is None else ridge, out.land.basis, tol=tol,
        )
    finally:
        blocks.unpersist()


def _gamma(blocks: DataFrame, width: int) -> float:
    """Radial kernel width 1 / (d * variance over all cells), as the exact machine sets it."""
    m = linear.second_moments(blocks, width)
    cells = m[-1, -1] * width
    mean = m[-1, :-1].sum() / cells
    var = np.trace(m[:-1, :-1]) / cells - mean * mean
    return 1.0 / (width * var) if var > 0 else 1.0
