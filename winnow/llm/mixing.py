"""Mixing sources to target weights with soft domain membership. DataFrame and ML functions only.

A classifier fitted on a labelled table (bag of hashed words, multinomial logistic regression)
gives each document posteriors p over the domains; t is its number of tokens. Rates r >= floor
are fitted so that the expected tokens E_d = sum r t p_d of each domain meet the targets T_d:

    minimise  1/2 sum_d (E_d - T_d)^2 / B_d  +  RIDGE / 2 sum t (r - 1)^2,   B_d = sum t p_d

by projected gradient in the metric weighted by t, where a step is

    r <- max(floor, r - STEP * (sum_d p_d (E_d - T_d) / B_d + RIDGE (r - 1))).

B_d is what every document gives at rate 1, so the scaled problem has curvature at most 1 +
RIDGE whatever the number and size of the domains, and few rounds suffice. A round is one
aggregate of one number per domain; a document's rate follows from its posteriors and the
rounds' residuals, so no state per document is kept between rounds. The rounds end once every
domain is within ``CLOSE`` of the corpus's tokens and within ``NEAR`` of its own target; where
``ROUNDS`` do not get there (a floor, or posteriors too mixed), ``Mixture.off`` has the errors
left, ``Mixture.converged`` is false and a warning is logged.

``copies`` turns a rate into a whole number: its floor, and one more with the probability of
the rest, by a hash of doc_id.

The default targets flatten the domains' shares of tokens: share^POWER, normalised; the token
budget defaults to that of the corpus. The classifier uses about ``SAMPLE`` labelled
rows, chosen by a hash of doc_id, but of each domain about ``LEAST`` at least and all rows where
it has no more, so no domain is without rows on a table of any size. Posteriors are then weighted
by the inverse of each domain's share in the sample, which gives back the domains' true shares.

Defined cases: a null or empty text has 0 tokens and the posteriors of a text without known
words; a null label is no label, nor is one without a document; without labels every rate is 1 (or the floor, if higher); a
single domain takes all; a target domain without any mass is ignored; repeated rows are each a
document; other columns pass through untouched, also those named like the results.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import SPOTS, cut, drawn, sample_shares

SLOTS = 1 << 13
#: Labelled rows used for the classifier, about this many.
SAMPLE = 10_000
#: Labelled rows of each domain used at least, where it has as many.
LEAST = 200
POWER = 0.7
RIDGE = 1e-3
STEP = 1.0 / (1.0 + RIDGE)
ROUNDS, CLOSE = 40, 1e-3
#: Largest error of a domain's tokens as a share of its own target.
NEAR = 1e-2

log = logging.getLogger(__name__)

# column names inside this module, unlikely to clash with those of documents
_TEXT, _WORDS, _BAG, _P, _T, _SUM = "_mix_text", "_mix_words", "_mix_bag", "_mix_p", "_mix_t", "_mix_sum"


@dataclass
class Mixture:
    """Domains, their classifier and the residuals of each round (one list per round)."""

    domains: list[str]
    classifier: LogisticRegressionModel | None
    rounds: list[list[float]] = field(default_factory=list)
    floor: float = 0.0
    #: Inverse shares of the domains in the sample; empty where all are equal.
    weights: list[float] = field(default_factory=list)
    #: After the fit: each domain's error as a share of its target (of all tokens where that is 0).
    off: dict[str, float] = field(default_factory=dict)
    converged: bool = True


def with_words(docs: DataFrame, text: str) -> DataFrame:
    """Adds the words, their hashed bag and the number of tokens."""
    cleaned = docs.withColumn(_TEXT, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    words = RegexTokenizer(inputCol=_TEXT, outputCol=_WORDS, pattern=r"\s+").transform(cleaned)
    bag = HashingTF(inputCol=_WORDS, outputCol=_BAG, numFeatures=SLOTS, binary=True).transform(words)
    return bag.withColumn(_T, F.size(_WORDS).cast("long"))


def with_posteriors(docs: DataFrame, text: str, mixture: Mixture) -> DataFrame:
    """Adds the posteriors (array of doubles in the order of ``domains``) and the number of tokens."""
    ready = with_words(docs, text)
    if mixture.classifier is None:
        ready = ready.withColumn(_P, F.array(*[F.lit(1.0) for _ in mixture.domains]).cast("array<double>"))
    else:
        ready = mixture.classifier.transform(ready).withColumn(_P, vector_to_array(_P))
        if mixture.weights:
            weights = F.array(*[F.lit(w) for w in mixture.weights])
            ready = ready.withColumn(_P, F.zip_with(_P, weights, lambda p, w: p * w))
            ready = ready.withColumn(_SUM, F.aggregate(_P, F.lit(0.0), lambda a, p: a + p))
            ready = ready.withColumn(_P, F.transform(_P, lambda p: p / F.col(_SUM))).drop(_SUM)
    return ready.drop(_TEXT, _WORDS, _BAG)


def classify(docs: DataFrame, labelled: DataFrame, key: str, text: str, sample: int) -> Mixture:
    """``labelled``: (doc_id, domain); rows that share a doc_id count with their smallest domain."""
    known = labelled.where(F.col(key).isNotNull() & F.col("domain").isNotNull()).groupBy(key).agg(
        F.min(F.col("domain").cast("string")).alias("_domain")
    ).join(docs.select(key), key, "left_semi")
    totals = known.groupBy("_domain").count().orderBy("_domain").collect()  # one row per domain
    domains = [r["_domain"] for r in totals]
    if len(domains) < 2:
        return Mixture(domains, None)
    shares = sample_shares({r["_domain"]: r["count"] for r in totals}, sample, LEAST)
    spot = F.pmod(F.xxhash64(F.col(key), F.lit(8)), F.lit(SPOTS))
    chosen = known.where(drawn(shares, F.col("_domain"), spot))
    place = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("_domain")) - 1
    rows = docs.select(key, text).join(F.broadcast(chosen), key)  # about SAMPLE short rows, LEAST a domain at least
    train = cut(with_words(rows.select(F.col(text), place.cast("double").alias("_label")), text).select(_BAG, "_label"))
    # as many classes as domains, whatever the largest label of the sample is
    train = train.withMetadata("_label", {"ml_attr": {"type": "nominal", "num_vals": len(domains)}})
    lr = LogisticRegression(
        featuresCol=_BAG, labelCol="_label", probabilityCol=_P, rawPredictionCol="", predictionCol="",
        family="multinomial", maxIter=25, regParam=1e-3,
    )
    uneven = max(shares.values()) > min(shares.values())
    return Mixture(domains, lr.fit(train), weights=[1.0 / shares[d] for d in domains] if uneven else [])


def rate_of(mixture: Mixture, posteriors: str = _P) -> Column:
    """The rate as one fold over the rounds' residuals, which are a constant of the plan: the
    expression has the same size after any number of rounds."""
    start, p = F.lit(max(1.0, mixture.floor)), F.col(posteriors)
    if not mixture.rounds:
        return start

    def one_round(rate: Column, residual: Column) -> Column:
        pull = F.lit(0.0)
        for d in range(len(mixture.domains)):
            pull = pull + p[d] * residual[d] * F.lit(STEP)
        return F.greatest(F.lit(float(mixture.floor)), rate * F.lit(1.0 - STEP * RIDGE) + F.lit(STEP * RIDGE) - pull)

    return F.aggregate(F.lit(mixture.rounds), start, one_round)


def flattened(mass: list[float], power: float = POWER) -> list[float]:
    """share^power, normalised."""
    raised = [(m / sum(mass)) ** power if m > 0 else 0.0 for m in mass]
    return [x / sum(raised) for x in raised]


def fit(
    docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", targets: dict[str, float] | None = None,
    budget: float | None = None, floor: float = 0.0, sample: int = SAMPLE,
) -> tuple[Mixture, DataFrame]:
    """The fitted mixture, and (doc_id, tokens, posteriors) cut from lineage.

    ``budget`` is the number of tokens aimed at as a multiple of the corpus's; with ``floor`` 1
    and no budget it is the least that lets every domain meet its target without dropping.
    """
    mixture = classify(docs, labelled, key, text, sample)
    mixture.floor = floor
    known = cut(with_posteriors(docs.select(key, text), text, mixture).select(key, F.col(_T).alias("tokens"), F.col(_P)))
    n = len(mixture.domains)
    if not n:
        return mixture, known

    def totals(rate: Column) -> list[float]:
        rated = known.select(_P, (rate * F.col("tokens")).alias("_mass"))
        row = rated.agg(*[F.sum(F.col("_mass") * F.col(_P)[d]).alias(f"d{d}") for d in range(n)]).first()
        return [float(x or 0.0) for x in row]

    base = totals(F.lit(1.0))
    whole = sum(base)
    if not whole:
        return mixture, known
    if targets is None:
        weights = flattened(base)
    else:
        given = [targets.get(d, 0.0) if base[i] > 0 else 0.0 for i, d in enumerate(mixture.domains)]
        weights = [x / sum(given) for x in given] if sum(given) else flattened(base)
    if budget is None:
        budget = max([1.0] + [base[d] / whole / weights[d] for d in range(n) if weights[d] > 0]) if floor >= 1.0 else 1.0
    aims = [w * whole * budget for w in weights]
    reached = totals(rate_of(mixture)) if floor > 1.0 else base
    limits = [min(CLOSE * whole, NEAR * t) if t > 0 else CLOSE * whole for t in aims]

    def met() -> bool:
        return all(abs(e - t) <= limit for e, t, limit in zip(reached, aims, limits))

    for _ in range(ROUNDS):
        if met():
            break
        mixture.rounds.append([(e - t) / b if b > 0 else 0.0 for e, t, b in zip(reached, aims, base)])
        reached = totals(rate_of(mixture))
    mixture.off = {d: abs(e - t) / (t if t > 0 else whole) for d, e, t in zip(mixture.domains, reached, aims)}
    mixture.converged = met()
    if not mixture.converged:
        log.warning("mixing: targets not met after %d rounds; errors as shares of them: %s", ROUNDS, mixture.off)
    return mixture, known


def copies_of(rate: Column, key: Column, seed: int = 8) -> Column:
    u = F.pmod(F.xxhash64(key, F.lit(seed), F.lit("copies")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    whole = F.floor(rate)
    return (whole + F.when(u < rate - whole, 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(doc_id, tokens, domain, share, rate, copies) for every row; ``domain`` is the likeliest one
    and ``share`` its posterior."""
    mixture, known = fit(docs, labelled, key, text, **settings)
    names = F.array(*[F.lit(d) for d in mixture.domains]).cast("array<string>")
    share = F.array_max(_P)
    rated = known.withColumn("rate", rate_of(mixture))
    return rated.select(
        key, "tokens", F.try_element_at(names, F.array_position(_P, share).cast("int")).alias("domain") if mixture.domains else F.lit(None).cast("string").alias("domain"),
        share.alias("share"), "rate", copies_of(F.col("rate"), F.col(key)).alias("copies"),
    )


def resample(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with every row repeated as often as its rate says; columns unchanged, no shuffle."""
    mixture, _ = fit(docs, labelled, key, text, **settings)
    rated = with_posteriors(docs, text, mixture).withColumn("_mix_rate", rate_of(mixture))
    times = copies_of(F.col("_mix_rate"), F.col(f"`{key}`"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # no copies: an empty array, whose row explode leaves out
    return rated.select(*columns, F.explode(F.array_repeat(F.lit(1), times)).alias("_mix_n")).drop("_mix_n")
