"""Whitening, packing and hard negatives against brute force, and on awkward tables."""

import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from winnow.llm import hardneg, packing, queries, whitening
from winnow.llm.common import table

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
BPE = public_tokenizers.path("byte_bpe_50k.json")

VECTORS = [
    (0, [0.5, -0.25, 0.125], 1), (1, [0.5, -0.25, 0.125], 1), (2, [0.4, 0.3, -0.1], 2), (2, [0.4, 0.3, -0.1], 2),
    (3, [0.45, -0.2, 0.1], 3), (4, None, 1), (5, [0.1, None, 0.2], 1), (6, [0.1, NAN, 0.2], 1), (7, [INF, 0.0, 0.0], 1),
    (8, [], 1), (9, [0.3], 2), (10, [0.5, -0.2, 0.1], None), (None, [0.2, 0.2, 0.2], 1), (100, [0.6, -0.3, 0.0], 1),
    (200, [0.0, 0.0, 0.0], 4), (11, [0.52, -0.26, 0.05], 1), (12, [0.5, -0.22, 0.02], 3), (13, [0.5, -0.22, 0.02], 2),
]


@pytest.fixture(scope="module")
def vectors(spark):
    """With columns named like the operators' own."""
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>, label int")
    return df.select("*", *[F.lit(1).alias(c) for c in ("id", "v", "place", "score", "rank", "n", "component", "block")])


# ---- whitening ------------------------------------------------------------------------------


def integers(rows):
    kept = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    x = [[int(np.floor(1024 * c)) + 100000 for c in list(v) + [0.0] * (width - len(v))] for _, v in kept]
    return [i for i, _ in kept], np.array(x, dtype=object).reshape(len(kept), width)


def check_whitening(got, rows, k=8):
    ids, x = integers(rows)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(r, sums))) for r in x]
    a = np.array([[float(n * c - s) / n for c, s in zip(r, sums)] for r in x])
    _, sigma, axes = np.linalg.svd(a, full_matrices=False)
    k = min(k, int((sigma > 1e-12 * sigma[0]).sum()))
    assert len(got) == n * k and {r.n for r in got} == {n}
    by = defaultdict(list)
    for r in got:
        by[r.component].append(r)
    for c in range(1, k + 1):
        want = sorted((str(i), d, w) for i, d, w in zip(ids, deviation, a @ axes[c - 1] / (sigma[c - 1] / np.sqrt(n))))
        have = sorted((str(r.vec_id), r.deviation, r.whitened) for r in by[c])
        assert [w[:2] for w in want] == [h[:2] for h in have]
        w, h = np.array([r[2] for r in want]), np.array([r[2] for r in have])
        assert min(np.abs(w - h).max(), np.abs(np.sort(w) + np.sort(h)[::-1]).max()) < 1e-7
        assert abs(by[c][0].explained - sigma[c - 1] ** 2 / (sigma**2).sum()) < 1e-9
    assert got[0].identity_error < 1e-9


def test_whitening_equals_svd(spark):
    rows = [tuple(r) for r in table(spark, SF, "embeddings").collect()]
    check_whitening(queries.QUERIES["op11_whitening"](spark, SF).collect(), rows)


def test_whitening_awkward_rows(vectors):
    check_whitening(whitening.whiten(vectors).collect(), VECTORS)


def test_whitening_of_dependent_and_lopsided_dimensions(spark):
    """A constant and a doubled dimension, and spreads of 1 to 1e5: the small ones keep their
    accuracy, which a covariance matrix in doubles would lose."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6)) * [1e3, 30.0, 1.0, 1e-1, 1e-2, 1.0]
    x[:, 5] = 7.0
    x = np.hstack([x, x[:, 1:2]])
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    check_whitening(got, rows)
    assert {r.component for r in got} == {1, 2, 3, 4, 5}


def test_whitening_without_spread(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [NAN])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 0.1])] * 3, schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, [])], schema)).count() == 0


def test_deviation_beyond_64_bits(spark):
    mid = whitening.Centre(3, (0, 0), 1 << 61)
    assert mid.deviation(np.array([[1, 2]])).tolist() == [45]
    with pytest.raises(OverflowError):
        mid.deviation(np.array([[1 << 40, 0]]))
    big = spark.createDataFrame([(1, [1e20]), (2, [0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(big).collect()


# ---- packing --------------------------------------------------------------------------------


def reference_ids(text):
    from tokenizers import Tokenizer

    tok = reference_ids.__dict__.setdefault("tok", Tokenizer.from_file(BPE))
    return tok.encode(text or "", add_special_tokens=False).ids + [1]


def check_packed(pieces, docs, window=packing.WINDOW):
    """Every id in one piece, windows without gaps, no padding; documents as (doc_id, text)."""
    assert Counter(r.doc_id for r in pieces if not r.start) == Counter(i for i, _ in docs)
    ids = {i: reference_ids(t) for i, t in docs}
    covered, filled = Counter(), defaultdict(list)
    for r in pieces:
        want = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(want) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        covered.update((r.doc_id, j) for j in range(r.start, r.start + r.length))
        filled[r.sequence_id].append((r.offset, r.length))
    copies = Counter(i for i, _ in docs)
    assert all(covered[i, j] == copies[i] for i in ids for j in range(len(ids[i])))
    sizes = []
    for w in sorted(filled):
        at = 0
        for offset, length in sorted(filled[w]):
            assert offset == at
            at += length
        sizes.append(at)
    assert sorted(filled) == list(range(len(sizes)))
    full = sum(sizes) // window
    assert sizes[:full] == [window] * full and all(s & (s - 1) == 0 for s in sizes[full:])


def test_packing_covers_every_id_once(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_packing"](spark, SF).collect()
    check_packed(got, docs)
    by_source, per_window = Counter(), defaultdict(Counter)
    for r in got:
        by_source[r.source] += r.length
        per_window[r.sequence_id][r.source] += r.length
    whole, sent = sum(by_source.values()), Counter()
    for w in sorted(per_window):
        sent.update(per_window[w])
        so_far = sum(sent.values())
        for s, n in by_source.items():
            assert abs(sent[s] - so_far * n / whole) <= 2 * packing.CELL


AWKWARD_TEXTS = [
    (1, None, "a"), (2, "", None), (3, "one two  three\n\n  <|endoftext|> it's 12 don't", "a"), (4, "ab " * 9000, "hot"),
    (5, "日本語 🙂 ñ" * 700, "hot"), (6, "x" * 5000, "b"), (6, "x" * 5000, "b"), (None, "no id", "b"), (7, " ", "c"), (8, " lead  trail ", "c"),
]


@pytest.mark.parametrize("targets", [None, {"hot": 1.0, "b": 0.5, "a": 0.0}, {"nobody": 1.0}])
def test_packing_awkward_rows(spark, targets):
    df = spark.createDataFrame(AWKWARD_TEXTS, "doc_id long, text string, source string")
    df = df.select("*", *[F.lit(1).alias(c) for c in ("n", "part", "ids", "queue", "begin", "offset")])
    for most in (packing.MAX_QUEUES, 2):
        got = packing.pack(df, BPE, targets=targets, max_queues=most).withColumn("ids_crc32", F.crc32("ids")).collect()
        check_packed(got, [(i, t) for i, t, _ in AWKWARD_TEXTS])


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string"), BPE).count() == 0


def test_schedule_equals_round_robin():
    """A literal walk: at every step the queue whose next cell is due first sends it."""
    for trial in range(200):
        rng = random.Random(trial)
        totals = [rng.choice([0, 1, 5, rng.randint(1, 400), rng.randint(1, 3000)]) for _ in range(rng.randint(1, 6))]
        targets = None if trial % 2 else [rng.choice([0, 1, 0.3, 5]) for _ in totals]
        plan = packing.Schedule(totals, targets, window=64, cell=8)
        sent, stream = [0] * len(totals), []
        while any(s * 8 < t for s, t in zip(sent, totals)):
            _, q = min((plan.due(i, sent[i]), i) for i, t in enumerate(totals) if sent[i] * 8 < t)
            stream += [q] * min(8, totals[q] - sent[q] * 8)
            sent[q] += 1
        ends = [plan.end_of(w) for w in range(plan.windows + 1)]
        assert ends[-1] == len(stream) == sum(totals)
        want = np.array([[stream[:e].count(q) for q in range(len(totals))] for e in ends])
        for a in range(0, plan.windows, 5):
            assert (plan.bounds(a, min(a + 9, plan.windows)) == want[a : a + 10]).all()
        if targets is None and sum(totals):
            most = 8 * (1.5 + len(totals) * np.array(totals) / 2 / sum(totals)) + 1
            assert all((np.abs(plan.deficits(w)) <= most).all() for w in range(plan.full + 1))


def test_schedule_of_a_huge_corpus():
    """40 trillion tokens: windows of the middle come from the totals, and stay in proportion."""
    plan = packing.Schedule([20 * 10**12, 15 * 10**12 + 7, 5 * 10**12 + 3, 1000])
    first = plan.windows // 3
    held = plan.bounds(first, first + 700)
    assert (held.sum(axis=1) == [plan.end_of(w) for w in range(first, first + 701)]).all()
    assert (np.diff(held, axis=0) >= 0).all()
    assert held[350].tolist() == plan.sent(plan.end_of(first + 350))[0]
    share = np.diff(held, axis=0)[:, 0]
    assert share.min() >= 1024 - 2 * packing.CELL and share.max() <= 1024 + 2 * packing.CELL


def test_encoder_equals_tokenizers():
    enc = packing.encoder(BPE)
    assert enc.fast is not None
    rng = random.Random(5)
    alphabet = [*"ab 'st\n\t1.,-_<|>", "é", "日", "🙂", " ", " ", "\x85", "ﬁ", "١", "<|endoftext|>", "'ll"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += [" " * 500_000 + "x", "a" * 450_000, "word " * 100_000, "two  spaces " * 40_000, None]
    for t in texts:
        assert enc.ids(t).tolist() + [1] == reference_ids(t)
    assert all("".join(packing.parts_of(t, 10)) == t for t in texts[:200])


# ---- hard negatives -------------------------------------------------------------------------


def mined(rows, anchor=lambda i: i % 100 == 0):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        one = (label, [int(np.floor(256 * c)) for c in v])
        kept[i] = min(kept.get(i, one), one)
    out = []
    for a in (i for i in kept if anchor(i)):
        label, v = kept[a]
        score = {i: sum(p * q for p, q in zip(v, w)) for i, (_, w) in kept.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if kept[i][0] == label][:5]:
            inside = [i for i in order if kept[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(inside[:5], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_hard_negatives_equal_sql_and_brute_force(spark):
    got = rows_of(queries.QUERIES["op13_hard_negatives"](spark, SF))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == sorted(con.execute(queries.ORACLES["op13_hard_negatives"]).fetchall())
    rows = [tuple(r) for r in table(spark, SF, "embeddings").collect()]
    assert got == mined([(i, v, (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in rows])


@pytest.mark.parametrize("block", [1, 3, 128])
def test_hard_negatives_awkward_rows(vectors, block):
    assert rows_of(hardneg.mine(vectors, F.col("id") % 100 == 0, block=block)) == mined(VECTORS)


def test_hard_negatives_with_many_copies(spark):
    """A third of the rows are one vector under two labels; ties everywhere."""
    rng = random.Random(2)
    rows = [(i, [0.5, 0.25], i % 2) if i % 3 == 0 else (i, [rng.randint(0, 3) / 4, rng.randint(-2, 2) / 4], rng.randint(0, 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert rows_of(hardneg.mine(df, F.col("id") % 100 == 0, block=16)) == mined(rows)


def test_hard_negatives_of_nothing(spark):
    schema = "vec_id long, embedding array<double>, label int"
    for rows in ([], [(100, None, 1)], [(1, [0.5], 1)], [(100, [0.5], 1)]):
        assert hardneg.mine(spark.createDataFrame(rows, schema), F.col("id") % 100 == 0).count() == 0


def test_slices_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "SLICE", 2)
    rows = [tuple(r) for r in table(spark, SF, "embeddings").limit(300).collect()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert rows_of(hardneg.mine(df, F.col("id") % 60 == 0)) == mined(rows, lambda i: i % 60 == 0)


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        at = hardneg.hilbert(cells, bits)
        assert sorted(at) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_zone_maps_bound_scores_and_prune(spark, tmp_path):
    """Bounds hold for every row of every block; among apart groups few blocks are read."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(16, 8))
    x = centres[np.arange(4000) % 16] + 0.02 * rng.normal(size=(4000, 8))
    rows = [(i, i % 16 % 5, [int(np.floor(256 * c)) for c in r]) for i, r in enumerate(x)]
    blocks, dim = hardneg.write_blocks(spark.createDataFrame(rows, "id long, label int, v array<int>"), str(tmp_path / "b"), 32)
    assert dim == 8 and blocks.agg(F.sum("n")).first()[0] == 4000
    vectors = np.array([r[2] for r in rows[:10]], dtype=float)
    n = len(vectors)
    windows = hardneg.Windows(
        np.arange(n), np.array([r[1] for r in rows[:10]]), vectors, np.arange(n), np.full(n, -1e15), np.full(n, 1e15), True, 5
    )
    for b in blocks.collect():
        v = np.frombuffer(b.rows, "<i4").reshape(-1, 8)
        low, high = windows.bounds(np.array([b.low], float), np.array([b.high], float))
        scores = v @ vectors.T
        assert (scores >= low).all() and (scores <= high).all()
        assert (np.diff(np.frombuffer(b.ids, "<i8")) > 0).all()
    best = {r["window"]: r["score"] for r in hardneg.search(blocks, windows, 8).collect() if r["rank"] == 5}
    closer = hardneg.Windows(windows.ids, windows.labels, vectors, windows.at, np.array([float(best[i]) for i in range(n)]), windows.high, True, 5)
    asked = hardneg.requests_of(blocks, closer, 8).collect()
    read = sum(bin(int.from_bytes(r["windows"], "big")).count("1") for r in asked)
    assert 0 < read < 0.3 * n * blocks.count()


def test_queries_of_this_round_are_registered():
    assert {"op11_whitening", "op12_packing", "op13_hard_negatives"} <= set(entry.queries())
    assert os.path.exists(BPE)


# ---- names of the caller, long runs, scarce labels -------------------------------------------


def test_redact_and_encode_keep_the_callers_columns(spark):
    from winnow.llm import pieces, pii

    names = ["_text", "_base", "_cands", "_spans", "_rid", "_row", "_body", "_parts", "_key", "i", "m"]
    text = "mail a.b@c.de now"
    df = spark.createDataFrame([(1, text), (2, "word " * 20_000)], "doc_id long, text string")
    df = df.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names])
    clean = {r.doc_id: r.asDict() for r in pii.redact(df).collect()}
    assert clean[1]["text"] == "mail <EMAIL> now"
    assert all(clean[d][n] == f"{n} {d}" for d in (1, 2) for n in names)
    coded = {r.doc_id: r.asDict() for r in pieces.encode(df, giant=1000, chunk=4000, same="back").collect()}
    assert coded[1]["back"] and coded[2]["back"]
    assert all(coded[d][n] == f"{n} {d}" for d in (1, 2) for n in names) and all(coded[d]["ids"] for d in (1, 2))


def test_long_runs_are_scanned_in_linear_time(spark):
    import time

    from winnow.llm import pii

    rows = [(1, "a" * 1_000_000 + " @ x"), (2, "7" * 1_000_000), (3, "a" * 500_000 + "@b.c"), (4, "1." * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pii.with_base(df.limit(1), "text").collect()
    begin = time.time()
    found = {r.doc_id: r._base for r in pii.with_candidates(pii.with_base(df, "text"), "text").select("doc_id", "_base").collect()}
    assert time.time() - begin < 20
    assert not found[1] and [(b.start, b.stop) for b in found[3]] == [(0, 500_004)]


def test_runs_tried_from_their_start_give_the_spans_of_the_plain_patterns(spark):
    import re

    from winnow.llm import pii

    rng = random.Random(9)
    alphabet = [*"ab1..@@_-  +", "a.b@c.de", "10.0.0.255", "1.2", "256", "@x", "z@"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for i in range(500)]
    plain = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}
    found = pii.with_base(spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()
    for r in found:
        for kind, pattern in plain.items():
            want = [m.span() for m in re.finditer(pattern, r.text)]
            if kind:
                want = [(a, b) for a, b in want if all(int(p) <= 255 for p in r.text[a:b].split("."))]
            assert [(b.start, b.stop) for b in r._base if b.kind == kind] == want, r.text


def test_scarce_toxic_labels_are_all_learned_from(spark):
    from winnow.llm import toxicity

    rows = [(i, "vile slur rotten " * 3 if i % 4000 == 7 else f"calm words about tea {i % 97}") for i in range(40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = df.select("doc_id", (F.col("doc_id") % 4000 == 7).cast("int").alias("toxic"))
    sample = toxicity.labelled_sample(df, labels, "doc_id", "text", 2000)
    seen = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    assert seen[1] == 10 and 1500 < seen[0] < 2500


def test_wordless_texts_are_not_graded():
    from winnow.llm import toxicity

    model = toxicity.OrdinalModel(np.array([1], np.uint64), np.zeros(1), np.array([-3.0, -2.0, -1.0]), -1.0)
    assert model.judge(["!!! 123", "", None, "word"])[1].tolist()[:3] == [0, 0, 0]
