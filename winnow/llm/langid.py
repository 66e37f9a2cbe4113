"""Language identification with string kernels: Nystroem landmarks and kernel ridge regression.

A text is the set of its blended n-grams (all lengths 1 to ``LONGEST`` of the lower-cased code
points, hashed to ``FEATURES`` slots). The presence kernel of two texts is the number of slots
both have, over the root of the product of their sizes. ``LANDMARKS`` training texts span the
approximation; one ridge regression per language (against the rest, targets 0 and 1) is solved
on the landmark features, whose normal equations are summed over the partitions.

A prediction is linear in the kernel values, and these are linear in the presence vector, so
landmarks and coefficients fold into one matrix (slots x languages) and a batch of texts is
scored by one product of its presence matrix with it - the same numbers as through the kernel.

The fit uses about ``SAMPLE`` labelled rows, chosen by a hash of doc_id among those with
crc32(doc_id) mod 4 other than 2, but of each language about ``LEAST`` at least and all rows where
it has no more, so every labelled language is learned on a table of any size. The prediction
reads nothing but the text.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every text
where no labelled row exists; an equal best score goes to the language first in order; a row
with a null doc_id is neither held out nor learned from; other columns are never looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import SPOTS, cut, drawn, map_texts, sample_shares

LONGEST = 4
FEATURES = 1 << 15
LANDMARKS = 256
#: Labelled rows used for the fit, about this many.
SAMPLE = 8_000
#: Labelled rows of each language used at least, where it has as many.
LEAST = 200
RIDGE = 1e-3
#: Texts scored in one product.
ROWS = 128

LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263)


def presence(texts: list) -> np.ndarray:
    """(texts, FEATURES) as 0/1 bytes."""
    out = np.zeros(len(texts) * FEATURES, dtype=np.uint8)
    points = [np.frombuffer((t or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points])
    flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
    base = np.repeat(np.arange(len(texts), dtype=np.int64) * FEATURES, sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
    shift = np.uint32(32 - (FEATURES.bit_length() - 1))
    with np.errstate(over="ignore"):
        h = np.zeros(len(flat), dtype=np.uint32)
        for n in range(LONGEST):
            h = (h[: len(flat) - n] + flat[n:] + np.uint32(n + 1)) * np.uint32(_MULTIPLIERS[n % 4])
            h ^= h >> np.uint32(15)
            fits = left[: len(h)] > n
            spot = (h * np.uint32(_MULTIPLIERS[(n + 1) % 4])) >> shift
            out[base[: len(h)][fits] + spot[fits]] = 1
            h = h[:-1] if len(h) else h
            if n + 1 < LONGEST and not len(h):
                break
    return out.reshape(len(texts), FEATURES)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (FEATURES, languages)

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for a in range(0, len(texts), ROWS):
            part = texts[a : a + ROWS]
            if not self.languages:
                names += ["und"] * len(part)
                continue
            x = presence(part).astype(np.float32)
            size = np.maximum(x.sum(axis=1), 1.0)
            y = (x @ self.weights) / np.sqrt(size)[:, None]
            best = y.argmax(axis=1)
            for i, t in enumerate(part):
                if t and LETTER.search(t):
                    names.append(self.languages[best[i]])
                    scores[a + i] = min(1.0, max(0.0, float(y[i, best[i]])))
                else:
                    names.append("und")
        return names, scores


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE, landmarks: int = LANDMARKS) -> LanguageModel:
    known = docs.where(F.col(key).isNotNull() & ~held_out(key) & F.col(label).isNotNull())
    lang = F.col(label).cast("string")
    counts = {r["lang"]: r["count"] for r in known.groupBy(lang.alias("lang")).count().collect()}
    if not counts:
        return LanguageModel([], np.zeros((FEATURES, 0), np.float32))
    spot = F.pmod(F.xxhash64(F.col(key), F.lit(6)), F.lit(SPOTS))
    chosen = known.where(drawn(sample_shares(counts, sample, LEAST), lang, spot))

    def packed(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a in range(0, len(texts), ROWS):
                bits = np.packbits(presence(texts[a : a + ROWS]), axis=1)
                part = batch.slice(a, ROWS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([b.tobytes() for b in bits], pa.binary())], names=["spot", "lang", "bits"]
                )

    rows = cut(chosen.select(spot.cast("long").alias("spot"), lang.alias("lang"), text).mapInArrow(packed, "spot long, lang string, bits binary"))
    languages = sorted(counts)
    order = Window.partitionBy("lang").orderBy("spot", "bits")
    firsts = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= landmarks).orderBy("n", "lang").limit(landmarks)
    marks = np.unpackbits(np.array([np.frombuffer(r["bits"], np.uint8) for r in firsts.collect()]), axis=1).astype(np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(axis=1), 1.0))[:, None]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    solid = values > 1e-8 * values.max()
    whiten = vectors[:, solid] / np.sqrt(values[solid])[None, :]  # K_mm^(-1/2) on its range
    m, number = whiten.shape[1], {x: i for i, x in enumerate(languages)}

    def sums(batches):
        gram, cross = np.zeros((m, m)), np.zeros((m, len(languages)))
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x = np.unpackbits(np.array([np.frombuffer(b, np.uint8) for b in part.column(1).to_pylist()]), axis=1).astype(np.float32)
                x /= np.sqrt(np.maximum(x.sum(axis=1), 1.0))[:, None]
                phi = (x @ marks.T).astype(np.float64) @ whiten
                gram += phi.T @ phi
                for i, lang in enumerate(part.column(0).to_pylist()):
                    cross[:, number[lang]] += phi[i]
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([cross.tobytes()])], names=["gram", "cross"])

    # the sample is bounded, so a fixed number of partitions gives a bounded number of sums
    parts = rows.select("lang", "bits").coalesce(12).mapInArrow(sums, "gram binary, cross binary").collect()
    gram = sum(np.frombuffer(r["gram"]).reshape(m, m) for r in parts)
    cross = sum(np.frombuffer(r["cross"]).reshape(m, len(languages)) for r in parts)
    total = max(rows.count(), 1)
    solved = np.linalg.solve(gram + RIDGE * total * np.eye(m), cross)
    return LanguageModel(languages, (marks.T @ (whiten @ solved)).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score)"""

    def fn(texts, batch):
        names, scores = model.predict(texts)
        return [batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores)]

    kind = dict(docs.dtypes)[key]
    return map_texts(docs.select(key, text, held_out(key).alias("_out")), text, fn, f"{key} {kind}, held_out boolean, lang_pred string, score double")
