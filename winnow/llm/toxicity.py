"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

Grades 0 < 1 < 2 < 3 share one weight vector and differ in their thresholds:
P(grade >= k) = sigmoid(w.x - theta_k), theta_1 <= theta_2 <= theta_3. The features are the
presence of words of a vocabulary; the expected severity is the sum of P(grade >= k).

The labels table says only toxic or not. Grade 0 is a document labelled not toxic. Toxic ones
are graded 1 to 3 by the terciles of their lexical load: the summed log odds of their words in
toxic against other labelled documents. A caller with graded labels passes those instead.

The vocabulary and the fit use a bounded sample of the labelled rows (``SAMPLE``, chosen by a
hash of doc_id by label, so scarce toxic rows are all seen); scoring reads every whole text. The sample stays on the executors: counts are
aggregated by Spark, and each step of the fit sums gradients of the partitions.

Defined cases: a null, empty or wordless text has expected severity from the thresholds alone
and is never rejected; labels that are null or name no document are ignored; a doc_id labelled
more than once counts as toxic if any of its labels is; without both toxic and other labels
nothing is rejected, every severity is 0 and a warning is logged; other columns pass through untouched.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import DENSE_CHARS, SPOTS, cut, drawn, keep_texts, map_texts, sample_shares
from winnow.llm.words import WORD, counted, hash_spans, runs, to_bytes

log = logging.getLogger(__name__)

#: Labelled rows used for the fit, about this many, and about LEAST of either label at least.
SAMPLE = 20_000
LEAST = 1_000
#: Words of the vocabulary, at most; a word needs MIN_DOCS labelled documents and a chi-square
#: above CHI_SQUARE (p < 0.001) against the toxic label.
VOCABULARY, MIN_DOCS, CHI_SQUARE = 4096, 5, 10.83
GRADES = 3
RIDGE, ROUNDS, ENOUGH = 0.05, 40, 1e-3
#: Beta squared of the F-measure that sets the cutoff.
BETA2 = 0.25

_LETTERS = WORD.copy()
_LETTERS[48:58] = False


@dataclass
class OrdinalModel:
    """``words``: sorted word hashes; ``weights`` beside them; ``thresholds`` ascending; a text
    whose margin w.x reaches ``cutoff`` is toxic."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cutoff: float = np.inf

    def margins(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The margin of each text, and whether it has a word at all."""
        element, doc, n = present_words(texts)
        worded = np.bincount(doc, minlength=n) > 0
        if not len(self.words) or not len(element):
            return np.zeros(n), worded
        at = np.searchsorted(self.words, element)
        at[at == len(self.words)] = 0
        hit = self.words[at] == element
        return np.bincount(doc[hit], weights=self.weights[at[hit]], minlength=n), worded

    def judge(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity (the sum over k of P(grade >= k)) and grade of each text."""
        margin, worded = self.margins(texts)
        if not len(self.thresholds):
            return np.zeros(len(texts)), np.zeros(len(texts), np.int32)
        at_least = sigmoid(margin[:, None] - self.thresholds[None, :])
        likely = np.maximum((at_least >= 0.5).sum(axis=1), 1)
        toxic = (margin >= self.cutoff) & worded
        return at_least.sum(axis=1), np.where(toxic, likely, 0).astype(np.int32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def present_words(texts: list) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct words (runs of letters, 44-bit hashes) of each text, its number, number of texts."""
    buf, starts = to_bytes(texts)
    begin, end = runs(_LETTERS[buf])
    doc = np.searchsorted(starts, begin, side="right") - 1
    element, doc, _ = counted(hash_spans(buf, begin, end), doc)
    return element, doc, len(texts)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, sample: int) -> DataFrame:
    """(doc_id, toxic, words) for about ``sample`` labelled documents, but about ``LEAST`` of each
    label at least (all where there are no more), cut from lineage."""
    known = (
        labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull())
        .groupBy(key)
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    counts = {str(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().collect()}  # two numbers
    shares = sample_shares(counts or {"0": 1}, sample, LEAST)
    chosen = known.where(drawn(shares, F.col("toxic").cast("string"), F.pmod(F.xxhash64(F.col(key)), F.lit(SPOTS)).cast("long")))

    def fn(texts, batch):
        element, doc, n_texts = present_words(texts)
        ends = np.searchsorted(doc, np.arange(n_texts + 1)).astype(np.int32)
        words = pa.ListArray.from_arrays(pa.array(ends), pa.array(element.astype(np.int64)))
        return [batch.column(0), batch.column(1), words]

    # about SAMPLE rows of two numbers: small enough for every task, so no text is shuffled
    texts = docs.select(key, text).join(F.broadcast(chosen), key).select(key, "toxic", text)
    return cut(map_texts(texts, text, fn, f"{key} long, toxic int, words array<long>"))


def vocabulary(sample: DataFrame, n_toxic: int, n_other: int) -> dict[int, float]:
    """Word hash -> log odds of toxic, for the words that tell most (chi-square)."""
    n = n_toxic + n_other
    counts = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("t"), F.count("*").alias("n")
    )
    t, o = F.col("t"), F.col("n") - F.col("t")
    gap = t * n_other - o * n_toxic
    chi = gap * gap * F.lit(float(n)) / (F.lit(float(n_toxic) * n_other) * F.col("n") * F.greatest(F.lit(n) - F.col("n"), F.lit(1)))
    odds = F.log((t + 0.5) / (F.lit(n_toxic) + 1.0)) - F.log((o + 0.5) / (F.lit(n_other) + 1.0))
    best = (
        counts.where(F.col("n") >= MIN_DOCS)
        .select("word", odds.alias("odds"), chi.cast("double").alias("chi"))
        .where(F.col("chi") >= CHI_SQUARE)
        .orderBy(F.desc("chi"), "word")
        .limit(VOCABULARY)
    )
    return {r["word"]: r["odds"] for r in best.collect()}


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, graded: DataFrame | None = None) -> OrdinalModel:
    """``graded`` (doc_id, grade 0..GRADES) replaces the grades derived from the toxic labels."""
    if graded is not None:
        labels = graded.select(key, F.col("grade").alias("toxic"))
    rows = labelled_sample(docs, labels, key, text, sample)
    totals = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    n_toxic, n_other = totals["t"], totals["n"] - totals["t"]
    if not n_toxic or not n_other:
        log.warning("labels of one kind only (%s toxic, %s others): no document will be graded", n_toxic, n_other)
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    odds = vocabulary(rows, n_toxic, n_other)
    words = np.array(sorted(odds), dtype=np.int64)
    load = np.array([odds[int(w)] for w in words])

    def features(batches):
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at = np.searchsorted(words, flat) if len(words) else np.zeros(len(flat), np.int64)
            at[at == len(words)] = 0
            hit = words[at] == flat if len(words) else np.zeros(len(flat), bool)
            owner, at = owner[hit], at[hit]
            ends = np.searchsorted(owner, np.arange(len(lists) + 1)).astype(np.int32)
            total = np.bincount(owner, weights=load[at], minlength=len(lists)).astype(float)
            columns = pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total), columns], names=[key, "toxic", "load", "columns"])

    table = cut(rows.mapInArrow(features, f"{key} long, toxic int, load double, columns array<int>"))
    if graded is not None:
        table = table.join(graded.groupBy(key).agg(F.max("grade").alias("g")), key).select("g", "columns")
    else:
        cuts = table.where("toxic = 1").agg(F.percentile("load", F.array(*[F.lit(i / GRADES) for i in range(1, GRADES)])).alias("q")).first()["q"]
        grade = F.lit(1)
        for c in cuts:
            grade = grade + (F.col("load") > F.lit(c)).cast("int")
        table = table.select(F.when(F.col("toxic") == 1, grade).otherwise(0).alias("g"), "columns")
    # the sample is bounded: as many gradients reach the driver, whatever the table has of partitions
    table = table.select(F.col("g").cast("int").alias("g"), "columns").coalesce(16).persist()
    try:
        weights, thresholds = descend(table, len(words), n_toxic / (n_toxic + n_other))
        cutoff = best_cutoff(table, weights)
    finally:
        table.unpersist()
    order = np.argsort(words.astype(np.uint64))
    return OrdinalModel(words.astype(np.uint64)[order], weights[order], thresholds, cutoff)


def descend(table: DataFrame, dim: int, toxic_share: float) -> tuple[np.ndarray, np.ndarray]:
    """Newton steps with a diagonal curvature, halved while the loss grows; one job per step.

    The loss is the sum over rows and thresholds of the logistic loss of "grade >= k", plus a
    ridge on the weights; thresholds are kept ascending.
    """
    k = GRADES

    def evaluate(w, theta):
        def part(batches):
            out = np.zeros(1 + 2 * (dim + k))
            for batch in batches:
                lists = batch.column(1)
                flat = lists.flatten().to_numpy()
                owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                z = np.bincount(owner, weights=w[flat], minlength=len(lists))[:, None] - theta[None, :]
                y = (batch.column(0).to_numpy()[:, None] >= np.arange(1, k + 1)[None, :]).astype(float)
                p = sigmoid(z)
                out[0] += np.sum(np.logaddexp(0.0, z) - y * z)
                slope, bend = p - y, p * (1.0 - p)
                out[1 : 1 + dim] += np.bincount(flat, weights=slope.sum(axis=1)[owner], minlength=dim)[:dim] if dim else 0
                out[1 + dim : 1 + dim + k] -= slope.sum(axis=0)
                rest = out[1 + dim + k :]
                if dim:
                    rest[:dim] += np.bincount(flat, weights=bend.sum(axis=1)[owner], minlength=dim)[:dim]
                rest[dim:] += bend.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["v"])

        # one vector of the model's size for each partition of the bounded sample
        parts = np.array([r["v"] for r in table.mapInArrow(part, "v array<double>").collect()])
        v = parts.sum(axis=0) if len(parts) else np.zeros(1 + 2 * (dim + k))
        grad = v[1 : 1 + dim + k].copy()
        bend = v[1 + dim + k :].copy()
        grad[:dim] += RIDGE * w
        bend[:dim] += RIDGE
        return v[0] + 0.5 * RIDGE * float(w @ w), grad, bend

    w = np.zeros(dim)
    theta = np.log((1 - toxic_share) / toxic_share) + np.arange(k, dtype=float)
    loss, grad, bend = evaluate(w, theta)
    step = 1.0
    for _ in range(ROUNDS):
        move = step * grad / np.maximum(bend, 1e-3)
        move = np.clip(move, -2.0, 2.0)
        new_w, new_theta = w - move[:dim], np.maximum.accumulate(theta - move[dim:])
        new_loss, new_grad, new_bend = evaluate(new_w, new_theta)
        if new_loss > loss:
            step *= 0.5
            if step < 1e-3:
                break
            continue
        gain = loss - new_loss
        w, theta, loss, grad, bend = new_w, new_theta, new_loss, new_grad, new_bend
        step = min(1.0, step * 1.3)
        if gain < ENOUGH * max(loss, 1.0):
            break
    return w, theta


def best_cutoff(table: DataFrame, w: np.ndarray, bins: int = 20) -> float:
    """The margin that separates grade 0 from the rest with the best F-measure on the sample
    (precision counts double): the middle of the gap between the bins on its two sides.
    Margins are counted in bins of 1/20 in +-50."""

    def margins(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            z = np.bincount(owner, weights=w[flat], minlength=len(lists))
            spot = np.floor(np.clip(z, -50, 50) * bins).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(spot), batch.column(0)], names=["spot", "g"])

    counted_bins = (
        table.mapInArrow(margins, "spot int, g int").groupBy("spot")
        .agg(F.sum((F.col("g") > 0).cast("int")).alias("bad"), F.count("*").alias("n")).orderBy("spot").collect()
    )
    spot, bad, n = (np.array([r[c] for r in counted_bins], dtype=float) for c in ("spot", "bad", "n"))
    caught = np.cumsum(bad[::-1])[::-1]
    chosen = np.cumsum(n[::-1])[::-1]
    best = int(np.argmax((1 + BETA2) * caught / (chosen + BETA2 * bad.sum())))
    below = spot[best - 1] + 1 if best else spot[best]
    return float((below + spot[best]) / 2 / bins)


def score(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, severity, grade, toxic): expected severity; 0 for a text under the cutoff, else the
    most severe grade that is at least as likely as not (1 at least); whether that is over 0."""

    def fn(texts, batch):
        severity, grade = model.judge(texts)
        return [batch.column(0), pa.array(severity), pa.array(grade), pa.array((grade > 0).astype(np.int32))]

    return map_texts(docs.select(key, text), text, fn, f"{key} long, severity double, grade int, toxic int", DENSE_CHARS)


def drop_toxic(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose grade is 0, as they are."""
    return keep_texts(docs, text, lambda texts: model.judge(texts)[1] == 0, DENSE_CHARS)
