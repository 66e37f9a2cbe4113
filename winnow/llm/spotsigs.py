"""Document fingerprints by SpotSigs: chains of content words that follow common words.

Wherever an anchor (a very common word) stands, the next ``CHAIN`` content words at distance
``DISTANCE`` (counted in content words) form a signature with it; a fingerprint is the set of a
text's signatures. Two fingerprints are as like as the Jaccard measure of their sets.

``compare_next`` gives each document its fingerprint, that of an edited text (the last quarter
replaced by the beginning of the next document) and both likenesses. The successor of id i is
known where the next row of the scan is i + 1, so such neighbours are compared while the scan
streams by; only the ends of such runs are shuffled. Tables in any order give the same rows.

``similar_documents`` finds all pairs of like fingerprints: sets are partitioned by length
(sets whose lengths differ by more than the bound cannot be alike), meet in the join on one of
their rarest signatures, are pruned by what is left to share, and are compared exactly.

Defined cases: a null text is empty; a text without any anchor chain is fingerprinted by its pairs
of neighbouring words (a single word by itself), one without words has the empty fingerprint,
which is like another empty one with 1 and like any other with 0; of rows that share a doc_id the
"next document" is the one with the smallest text, each row keeping its own result; rows with a
null doc_id are followed by the first document, and follow none unless no doc_id is known; a
table's only document is its own successor. Other columns are never looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import cut, in_chunks, repeated_ids
from winnow.llm.words import constants, counted, hash_of, mix, shingles, words_of

CHAIN = 2
DISTANCE = 1
#: Very common words of four languages.
ANCHORS = (
    "a an and are as at be but by for from had has have in is it of on or that the this to was were with "
    "au avec ce dans de des du elle en est et il la le les ne pas par pour que qui se sur un une "
    "als auf das dem den der des die ein eine er es für im ist mit nicht sich sie und von zu "
    "al con como del el ella los las lo no para por se su una y"
).split()


def signature_sets(texts: list, chain: int = CHAIN, distance: int = DISTANCE, anchors: list[str] = ANCHORS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct signatures (44 bits) of all texts, and the text each belongs to."""
    h, doc, n = words_of(texts)
    known = np.unique(hash_of(list(anchors)))
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    common = known[at] == h if len(h) else np.zeros(0, bool)
    content = np.flatnonzero(~common)
    spots = np.flatnonzero(common)
    # the first content word after each anchor, then every `distance`-th
    first = np.searchsorted(content, spots)
    last = first + (chain - 1) * distance + (distance - 1)
    fits = last < len(content)
    spots, first, last = spots[fits], first[fits], last[fits]
    same = doc[content[last]] == doc[spots]
    spots, first = spots[same], first[same]
    salts = constants(chain + 1, 61)
    with np.errstate(over="ignore"):
        sig = h[spots] * salts[0]
        for j in range(chain):
            sig = sig + h[content[first + j * distance + distance - 1]] * salts[j + 1]
        sig = mix(sig)
    where = doc[spots]
    plain = np.ones(n, dtype=bool)
    plain[where] = False  # texts without any chain: pairs of neighbouring words instead
    rest = plain[doc]
    pairs, pair_doc = shingles(h[rest], doc[rest], 2)
    keys, owner, _ = counted(np.concatenate([sig, pairs]), np.concatenate([where, pair_doc]))
    return keys, owner


def split_sets(keys: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    ends = np.searchsorted(owner, np.arange(n + 1))
    return [keys[i:j] for i, j in zip(ends[:-1], ends[1:])]


def fingerprint(keys: np.ndarray) -> str:
    """Length of the set and 128 bits of its sorted signatures."""
    return f"{len(keys)}-{hashlib.blake2b(keys.tobytes(), digest_size=16).hexdigest()}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted sets; two empty sets are alike."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return shared / (len(a) + len(b) - shared)


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as much of the beginning of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def judged(texts: list[str], followers: list[str]) -> list[pa.Array]:
    """The result columns for texts and the texts that follow them."""
    n = len(texts)
    changed = [edited(t, f) for t, f in zip(texts, followers)]
    # in runs of neighbours a follower is the next text: its set is not cut out twice
    new = [i for i in range(n) if i + 1 >= n or followers[i] is not texts[i + 1]]
    sets = split_sets(*signature_sets(texts + [followers[i] for i in new]), n + len(new))
    extra = dict(zip(new, sets[n:]))
    own, after = sets[:n], [extra[i] if i in extra else sets[i + 1] for i in range(n)]
    edit = split_sets(*signature_sets(changed), n)
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
        pa.array([fingerprint(s) for s in own], pa.string()),
        pa.array([fingerprint(s) for s in edit], pa.string()),
        pa.array([likeness(a, b) for a, b in zip(own, edit)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, after)], pa.float64()),
    ]


_OPEN = f"{{key}} long, {_RESULT}, kind string, body string"


def stream_neighbours(docs: DataFrame, key: str, text: str, adjacent: bool) -> DataFrame:
    """Results of rows whose successor comes next in the scan (kind ``done``); the text of a row
    whose successor does not (``wants``) and of one that no predecessor came before (``gives``)."""
    empty = [pa.nulls(0, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]

    def rows(ids, results, kind, bodies):
        n = len(ids)
        values = results if results is not None else [pa.nulls(n, x.type) for x in empty]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), *values, pa.array([kind] * n, pa.string()), pa.array(bodies, pa.string())],
            names=[key, *[c.split()[0] for c in _RESULT.split(", ")], "kind", "body"],
        )

    def run(batches):
        held = None  # the last row, whose successor is not known yet
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in in_chunks(texts):
                these, bodies = ids[a:b], texts[a:b]
                heads = held is None
                if not heads:
                    these, bodies = [held[0], *these], [held[1], *bodies]
                held = (these[-1], bodies[-1])
                n = len(these)
                joined = [
                    adjacent and these[i] is not None and these[i + 1] is not None and these[i + 1] == these[i] + 1 for i in range(n - 1)
                ]
                run_of = [i for i in range(n - 1) if joined[i]]
                if run_of:
                    out = judged([bodies[i] for i in run_of], [bodies[i + 1] for i in run_of])
                    yield rows([these[i] for i in run_of], out, "done", [None] * len(run_of))
                open_ = [i for i in range(n - 1) if not joined[i]]
                if open_:
                    yield rows([these[i] for i in open_], None, "wants", [bodies[i] for i in open_])
                gives = [i + 1 for i in open_] + ([0] if heads else [])
                gives = [i for i in gives if these[i] is not None]
                if gives:
                    yield rows([these[i] for i in gives], None, "gives", [bodies[i] for i in gives])
        if held is not None:
            yield rows([held[0]], None, "wants", [held[1]])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, _OPEN.format(key=key))


def successors(wants: DataFrame, gives: DataFrame, key: str) -> DataFrame:
    """(key, next): for each id that wants one, the smallest id of ``gives`` above it, else the first.

    Ids are put in order by a range partition; the first given id of each later partition (one
    number a partition) completes what a partition cannot see.
    """
    ids = wants.select(F.col(key).alias("id")).distinct().withColumn("w", F.lit(1)).unionByName(
        gives.select(F.col(key).alias("id")).distinct().withColumn("w", F.lit(0))
    )
    merged = ids.groupBy("id").agg(F.max("w").alias("w"), F.min("w").alias("g"))
    spread = cut(merged.repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id()))
    firsts = {r["part"]: r["m"] for r in spread.where("g = 0").groupBy("part").agg(F.min("id").alias("m")).collect()}
    least = min(firsts.values()) if firsts else None
    after, following = {}, least
    for part in sorted({r["part"] for r in spread.select("part").distinct().collect()}, reverse=True):
        after[part] = following
        following = firsts.get(part, following)

    def run(batches):
        ids, wanted, given, part = [], [], [], None
        for batch in batches:
            ids += batch.column(0).to_pylist()
            wanted += batch.column(1).to_pylist()
            given += batch.column(2).to_pylist()
            part = batch.column(3)[0].as_py() if batch.num_rows else part
        nxt, out = after.get(part), []
        for i in range(len(ids) - 1, -1, -1):
            if wanted[i]:
                out.append((ids[i], least if ids[i] is None else nxt))
            if given[i] == 0:
                nxt = ids[i]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=[key, "next"])

    return spread.mapInArrow(run, f"{key} long, next long")


def compare_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    streamed = cut(stream_neighbours(docs, key, text, adjacent=not repeated_ids(docs, key)))
    done = streamed.where("kind = 'done'").drop("kind", "body")
    wants = streamed.where("kind = 'wants'").select(key, "body")
    gives = streamed.where("kind = 'gives'").groupBy(key).agg(F.min("body").alias("given"))
    if gives.limit(1).count():
        nexts = cut(successors(wants, gives, key))
        paired = wants.join(nexts.select(F.col(key).alias("_k"), "next"), F.col(key).eqNullSafe(F.col("_k"))).join(
            gives.select(F.col(key).alias("next"), "given"), "next"
        )
    else:  # no row has an id: the smallest text follows each
        least = wants.groupBy(F.lit(0).alias("_k")).agg(F.min("body").alias("given"))
        paired = wants.withColumn("_k", F.lit(0)).join(least, "_k")

    def finish(batches):
        for batch in batches:
            texts, followers = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in in_chunks(texts):
                out = judged(texts[a:b], followers[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *out], names=[key, *[c.split()[0] for c in _RESULT.split(", ")]])

    return done.unionByName(paired.select(key, "body", "given").mapInArrow(finish, f"{key} long, {_RESULT}"))


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """(a, b, likeness) for all pairs of different fingerprints whose likeness reaches ``similarity``,
    between the smallest ids of equal fingerprints (a < b)."""
    known = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), text)

    def sets(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_chunks(texts):
                each = split_sets(*signature_sets(texts[a:b]), b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([fingerprint(s) for s in each], pa.string()), pa.array([s.astype(np.int64) for s in each], pa.list_(pa.int64()))],
                    names=["doc", "fp", "sigs"],
                )

    every = known.mapInArrow(sets, "doc long, fp string, sigs array<long>").where(F.size("sigs") > 0)
    one = cut(every.groupBy("fp").agg(F.min("doc").alias("doc"), F.min("sigs").alias("sigs")).select("doc", "sigs"))
    n = F.size("sigs")
    flat = one.select("doc", n.alias("n"), F.explode("sigs").alias("sig"))
    order = Window.partitionBy("doc").orderBy("df", "sig")
    rare = flat.join(flat.groupBy("sig").agg(F.count("*").alias("df")), "sig").withColumn("at", F.row_number().over(order))
    # a pair shares one of the (1 - s) n + 1 rarest of both
    lead = rare.where(F.col("at") <= F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1)
    part = F.floor(F.log("n") / F.log(F.lit(1 / similarity)) + 1e-9).cast("int")
    lead = lead.select("sig", "doc", "n", "at", part.alias("part"))
    left = lead.select("sig", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = lead.select("sig", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), "part")
    least = F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb"))
    able = (F.col("na") >= similarity * F.col("nb")) & (F.col("nb") >= similarity * F.col("na"))
    able &= F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) + 1 >= least - 1e-9
    met = left.join(right, ["sig", "part"]).where(able & (F.col("a") != F.col("b")))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.join(one.select(F.col("doc").alias("a"), F.col("sigs").alias("sa")), "a").join(one.select(F.col("doc").alias("b"), F.col("sigs").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    like = shared / (F.size("sa") + F.size("sb") - shared)
    return both.select("a", "b", like.alias("likeness")).where(F.col("likeness") >= similarity)
