"""Quality by importance resampling: a hashed n-gram model of good text against one of all text.

Tokens are runs of word characters and runs of other visible ones; unigrams and bigrams are
hashed to ``BUCKETS`` counters. The raw model counts every text of the corpus, the target model
the labelled good ones. A document's weight is the log of p_target(text) / p_raw(text): the sum of
the log ratios of its n-grams. Adding Gumbel noise (a hash of doc_id) and keeping the k largest
samples k documents without replacement in proportion to that ratio. ``effective`` replaces the
sum by the mean times that number, for callers who want long and short texts to compete alike.

The target model is fitted on at most about ``SAMPLE`` labelled rows of quality 1,
chosen by a hash of doc_id; k is ``keep`` of all rows, by default the share of such rows among
the labelled ones. The k-th largest value is found exactly by narrowing histograms.

Defined cases: a null, empty or blank text has no n-grams and ranks below all others; without
labels every weight is 0 and the sample is uniform; ties in the noisy weight go to the smaller
doc_id, and rows equal in both are kept or left together; other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import cut, in_chunks, map_texts
from winnow.llm.words import SPACE, WORD, U, constants, hash_spans, mix, to_bytes

BUCKETS = 10_000
#: Labelled rows used for the target model, at most about this many.
SAMPLE = 20_000
#: The weight of a text without n-grams, below any sum of log ratios.
LOWEST = -1e15

_CLASS = np.where(WORD, 1, np.where(SPACE, 0, 2)).astype(np.int8)


def grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every unigram and bigram, and the text it is in."""
    buf, starts = to_bytes(texts)
    kind = _CLASS[buf]
    edges = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(kind)]])
    begin, end = edges[:-1], edges[1:]
    visible = kind[begin] > 0
    begin, end = begin[visible], end[visible]
    doc = np.searchsorted(starts, begin, side="right") - 1
    h = hash_spans(buf, begin, end)
    if not len(h):
        return np.zeros(0, np.int64), doc
    same = doc[1:] == doc[:-1]
    a, b = constants(2, 71)
    with np.errstate(over="ignore"):
        pairs = mix(h[:-1] * a + h[1:] * b)[same]
    return (np.concatenate([h, pairs]) % U(BUCKETS)).astype(np.int64), np.concatenate([doc, doc[1:][same]])


def good_rows(labels: DataFrame, key: str) -> DataFrame:
    """(doc_id, good): one row per labelled document, good if all its labels have quality 1."""
    rated = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull())
    return rated.groupBy(key).agg((F.min("quality") > 0).alias("good"))


def log_ratios(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The log ratio of each bucket, and the share of good rows among the labelled ones."""
    rated = good_rows(labels, key)
    known = rated.agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good")).first()
    n, good = known["n"], known["good"] or 0
    if not good:
        return np.zeros(BUCKETS), 1.0
    spot = F.pmod(F.xxhash64(F.col(key), F.lit(9)), F.lit(1 << 30))
    chosen = rated.where("good").where(spot < F.lit(int(min(1.0, sample / good) * (1 << 30)))).select(key, F.lit(True).alias("target"))
    flagged = docs.select(key, text).join(F.broadcast(chosen), key, "left").select(text, F.coalesce("target", F.lit(False)).alias("target"))

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts, flags = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in in_chunks(texts):
                bucket, doc = grams(texts[a:b])
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[flags[a:b][doc]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    sums = flagged.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("r"), F.sum("target").alias("t"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in sums.collect():  # one row for each bucket
        raw[row["bucket"]], target[row["bucket"]] = row["r"], row["t"]
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    return ratio, good / n


def weigh(
    docs: DataFrame, ratio: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = 9, effective: int | None = None
) -> DataFrame:
    """(doc_id, log_weight, noisy): the importance weight and that plus Gumbel noise."""

    def fn(texts, batch):
        bucket, doc = grams(texts)
        n = np.bincount(doc, minlength=len(texts))
        total = np.bincount(doc, weights=ratio[bucket], minlength=len(texts))
        if effective is not None:
            total = effective * total / np.maximum(n, 1)
        return [batch.column(0), pa.array(np.where(n > 0, total, LOWEST))]

    kind = dict(docs.dtypes)[key]
    weights = map_texts(docs.select(key, text), text, fn, f"{key} {kind}, log_weight double")
    u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit("gumbel")), F.lit((1 << 52) - 1)) + 1) / F.lit(float(1 << 52))
    return weights.withColumn("noisy", F.col("log_weight") - F.log(-F.log(u)))


def kth_largest(df: DataFrame, column: str, key: str, k: int, bins: int = 1024) -> tuple[float, int | None]:
    """(value, key) of the k-th row by descending ``column``, then ascending key."""
    rest, want = df.select(column, key), k
    while True:
        span = rest.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count("*").alias("n")).first()
        low, high = span["a"], span["b"]
        if span["n"] <= 4 * bins or low == high:
            row = rest.orderBy(F.desc(column), F.asc_nulls_last(key)).limit(want).orderBy(column, F.desc_nulls_first(key)).first()
            return row[column], row[key]
        bin_of = F.least(F.floor((F.col(column) - low) / F.lit((high - low) / bins)), F.lit(bins - 1)).alias("bin")
        counts = {r["bin"]: r["count"] for r in rest.groupBy(bin_of).count().collect()}
        for b in sorted(counts, reverse=True):
            if want <= counts[b]:
                rest = rest.where(bin_of == b)
                break
            want -= counts[b]


def resample(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", keep: float | None = None, seed: int = 9,
    effective: int | None = None,
) -> DataFrame:
    """(doc_id, log_weight, keep) for every row of ``docs``; ``keep`` marks the sample."""
    ratio, share = log_ratios(docs, labels, key, text)
    weighed = cut(weigh(docs, ratio, key, text, seed, effective))
    k = round((share if keep is None else keep) * weighed.count())
    if not k:
        return weighed.select(key, "log_weight", F.lit(False).alias("keep"))
    value, last = kth_largest(weighed, "noisy", key, k)
    tie = F.col(key).isNotNull() & (F.col(key) <= F.lit(last)) if last is not None else F.lit(True)
    return weighed.select(key, "log_weight", ((F.col("noisy") > value) | ((F.col("noisy") == value) & tie)).alias("keep"))
