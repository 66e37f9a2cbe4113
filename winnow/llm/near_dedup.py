"""Near-duplicate documents by DartMinHash signatures and a banded join.

A document is a weighted set: its five-word shingles with the number of times each occurs.
Darts are thrown at the region of every element (weight along one axis, time along the other):
a Poisson process whose darts are hashes of (element, weight band, number), so equal regions of
different documents are hit by the same darts. A dart belongs to one of K coordinates; in each
the earliest dart under the document's weights is kept. Two documents agree in a coordinate
with a probability equal to their weighted Jaccard similarity.

Signatures are cut into bands; documents that agree in a band meet in its bucket. Within a
bucket documents are compared exactly (weighted Jaccard over all shingles): first all with one
member, then, by parts of bounded size, those outside the largest group with all members of
other groups. So a bucket of n near copies of its first member takes n comparisons, and no link
between different groups is lost to a cap.

Defined cases: a null or wordless text has no shingles, is linked to nothing and stays; texts
with the same words are copies whatever their length; a text under five words is one shingle;
rows that share a doc_id are one document (smallest text); a row without doc_id takes no part
and stays; other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import DENSE_CHARS, bits_at, cut, id_filter, map_texts, one_row_per_id, repeated_ids, text_slices
from winnow.llm.graph import components
from winnow.llm.words import U, constants, counted, mix, shingles, text_digest, unit, words_of

WIDTH = 5
SIMILARITY = 0.8
#: 25 bands of 5 coordinates: a pair at 0.8 meets in some band with probability 0.99995.
BANDS, ROWS = 25, 5
#: Shingles (6 bytes each) and documents of a bucket that are compared in one piece.
PART_BYTES, PART_DOCS = 2_000_000, 2_048


def dart_signatures(
    element: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, k: int, seed: int = 41
) -> np.ndarray:
    """(n_docs, k) dart ids; a document without elements has zeros. ``doc`` is sorted, weights > 0.

    The weight axis of an element is cut into [0, 1), [1, 2), [2, 4), ...; each piece is its own
    Poisson process, so a light document never pays for the darts of a heavy one. A document
    looks at times up to (about) k ln k + 3k expected darts; where a coordinate is still empty
    the time is doubled.
    """
    sig = np.zeros((n_docs, k), dtype=np.uint64)
    if not len(element):
        return sig
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    salts = constants(4, seed)
    region, low, width = [np.arange(len(element))], [np.zeros(len(element))], [np.ones(len(element))]
    piece = 0
    while True:
        edge = float(1 << piece)
        some = np.flatnonzero(weight > edge)
        if not len(some):
            break
        region.append(some)
        low.append(np.full(len(some), edge))
        width.append(np.full(len(some), edge))
        piece += 1
    region, low, width = map(np.concatenate, (region, low, width))
    with np.errstate(over="ignore"):
        start = mix(element[region] ^ mix(low.astype(np.uint64) * salts[0] + salts[1]))
    owner, most = doc[region], weight[region]
    todo = np.flatnonzero(total > 0)
    horizon = np.zeros(n_docs)
    horizon[todo] = (k * np.log(k) + 3.0 * k) / total[todo]
    best = np.full(n_docs * k, np.inf)
    while len(todo):
        wanted = np.zeros(n_docs, dtype=bool)
        wanted[todo] = True
        live = np.flatnonzero(wanted[owner])
        clock, number = np.zeros(len(live)), 0
        spots, times, darts = [], [], []
        while len(live):
            number += 1
            with np.errstate(over="ignore"):
                dart = mix(start[live] + U(number) * salts[2])
                clock = clock - np.log(unit(dart)) / width[live]
                on = clock <= horizon[owner[live]]
                live, clock, dart = live[on], clock[on], dart[on]
                where = mix(dart ^ salts[3])
            hit = low[live] + width[live] * unit(mix(where)) <= most[live]
            spots.append(owner[live[hit]] * k + (where[hit] % U(k)).astype(np.int64))
            times.append(clock[hit])
            darts.append(dart[hit])
        spots, times, darts = map(np.concatenate, (spots, times, darts))
        best.reshape(n_docs, k)[todo] = np.inf
        np.minimum.at(best, spots, times)
        first = times == best[spots]
        sig.reshape(-1)[spots[first]] = darts[first] | U(1)
        todo = todo[np.isinf(best.reshape(n_docs, k)[todo]).any(axis=1)]
        horizon[todo] *= 2.0
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n_docs, bands) bucket keys; the band number is part of the key."""
    with np.errstate(over="ignore"):
        parts = mix(sig.reshape(len(sig), bands, rows)) * constants(rows, 51)
        return mix(parts.sum(axis=2, dtype=np.uint64) + constants(bands, 52)).astype(np.int64)


def weighted_shingles(texts: list, width: int):
    h, doc, n = words_of(texts)
    return (*counted(*shingles(h, doc, width)), h, doc, n)


def signatures(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, w0, w1, n_shingles, keys): 128 bits of the words, total weight, bucket keys."""

    def fn(texts, batch):
        element, doc, weight, h, word_doc, n = weighted_shingles(texts, width)
        digest, _ = text_digest(h, word_doc, n)
        sig = dart_signatures(element, doc, weight.astype(float), n, bands * rows)
        keys = band_keys(sig, bands, rows)
        total = np.bincount(doc, weights=weight, minlength=n).astype(np.int64)
        offsets = pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32))
        return [
            batch.column(batch.schema.get_field_index(key)),
            pa.array(digest[0].astype(np.int64)),
            pa.array(digest[1].astype(np.int64)),
            pa.array(total),
            pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1))),
        ]

    return map_texts(docs.select(key, text), text, fn, f"{key} long, w0 long, w1 long, n_shingles long, keys array<long>", DENSE_CHARS)


def shingle_table(docs: DataFrame, wanted: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(doc, elements) as packed arrays, for the documents in ``wanted`` (doc).

    A Bloom filter of fixed size keeps most other texts from being cut up at all; the join then
    removes its few false positives. Texts are not shuffled.
    """
    bits = 1 << 23
    keep = id_filter(wanted, "doc", bits)
    spotted = docs.select(F.col(key).alias("doc"), text, F.pmod(F.xxhash64(F.col(key)), F.lit(bits)).alias("_spot"))

    def run(batches):
        for batch in batches:
            on = bits_at(keep, batch.column(2).to_numpy())
            for part in text_slices(batch.filter(pa.array(on)), 1, DENSE_CHARS):
                element, doc, weight, *_ = weighted_shingles(part.column(1).to_pylist(), width)
                each = np.repeat(element, weight)
                ends = np.searchsorted(np.repeat(doc, weight), np.arange(part.num_rows + 1))
                packed = [pack(each[i:j]) for i, j in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["doc", "elements"])

    cut_up = spotted.where(F.col("doc").isNotNull()).mapInArrow(run, "doc long, elements binary")
    return cut_up.join(wanted, "doc", "left_semi")


def pack(elements: np.ndarray) -> bytes:
    """44-bit elements, sorted and repeated as often as they occur, in 6 bytes each."""
    return (elements >> U(12)).astype(np.uint32).tobytes() + (elements & U(0xFFF)).astype(np.uint16).tobytes()


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements and their numbers."""
    n = len(packed) // 6
    high, low = np.frombuffer(packed, np.uint32, n), np.frombuffer(packed, np.uint16, n, 4 * n)
    return np.unique((high.astype(np.uint64) << U(12)) | low, return_counts=True)


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum of minima over sum of maxima; both element arrays are sorted and distinct."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    same = b[at] == a
    shared = int(np.minimum(wa[same], wb[at[same]]).sum())
    return shared / (int(wa.sum()) + int(wb.sum()) - shared)


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity) by the exact measure."""
    left = sets.select(F.col("doc").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("doc").alias("b"), F.col("elements").alias("eb"))

    def run(batches):
        for batch in batches:
            sims = [weighted_jaccard(*unpack(x), *unpack(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ea", "eb")
    return joined.mapInArrow(run, "a long, b long, similarity double")


def first_round(members: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Compare each member of a bucket with the first: (links, distances), where links (a, b) reach
    the bound and distances are (bucket, doc, d). One row for each member."""
    first = members.groupBy("bucket").agg(F.min(F.struct("doc", "size")).alias("first"))
    met = cut(
        members.join(first, "bucket")
        .where((F.col("doc") != F.col("first.doc")) & (F.least("size", "first.size") >= similarity * F.greatest("size", "first.size")))
        .select("bucket", F.col("first.doc").alias("a"), F.col("doc").alias("b"))
    )
    compared = cut(similarities(met.select("a", "b").distinct(), sets))
    distances = met.join(compared, ["a", "b"]).select("bucket", F.col("b").alias("doc"), (1.0 - F.col("similarity")).alias("d"))
    firsts = first.select("bucket", F.col("first.doc").alias("doc"), F.lit(0.0).alias("d"))
    return compared.where(F.col("similarity") >= similarity).select("a", "b"), distances.unionByName(firsts)


def open_buckets(members: DataFrame, links: DataFrame, distances: DataFrame, similarity: float) -> DataFrame:
    """(bucket, doc, size, grp, home) of the buckets whose members are not all one group yet.

    ``grp`` is the group by all links so far, through whatever buckets; ``home`` marks the
    bucket's largest group. Members of home are known to be connected, so only the others have
    to be compared; of home those stay that can be near any other by size and by distance to the
    first member (the distance is a metric).
    """
    far = 1.0 - similarity + 1e-9
    classes = components(links).select(F.col("node").alias("doc"), "class_id")
    state = members.join(classes, "doc", "left").select("bucket", "doc", "size", F.coalesce("class_id", "doc").alias("grp"))
    groups = state.groupBy("bucket", "grp").agg(F.count("*").alias("n"))
    largest = groups.groupBy("bucket").agg(F.max_by("grp", F.struct("n", "grp")).alias("home_grp"), F.count("*").alias("groups"))
    live = (
        state.join(largest.where("groups > 1"), "bucket")
        .join(distances, ["bucket", "doc"], "left")
        .select("bucket", "doc", "size", "grp", (F.col("grp") == F.col("home_grp")).alias("home"), "d")
    )
    live = cut(live)
    # a missing distance says nothing: the range is then open
    d_range = [F.min(F.coalesce("d", F.lit(0.0))).alias("d_low"), F.max(F.coalesce("d", F.lit(1.0))).alias("d_high")]
    others = live.where("not home").groupBy("bucket").agg(F.min("size").alias("least"), F.max("size").alias("most"), *d_range)
    can_be_near = (
        (F.col("size") >= similarity * F.col("least"))
        & (similarity * F.col("size") <= F.col("most"))
        & F.coalesce((F.col("d") >= F.col("d_low") - far) & (F.col("d") <= F.col("d_high") + far), F.lit(True))
    )
    return live.join(others, "bucket").where(~F.col("home") | can_be_near).select("bucket", "doc", "size", "grp", "home")


def in_parts(state: DataFrame, part_bytes: int = PART_BYTES, part_docs: int = PART_DOCS) -> DataFrame:
    """(bucket, i, j, part, doc, size, grp, home): every member once for each pair of parts it is in.

    A bucket is cut by hash into parts of bounded expected size; a small one is a single part.
    In a larger one the members outside home are parts 0 to p - 1 and those of home follow. Each
    pair (i, j) with i < p and i <= j is work of its own.
    """
    size = F.sum("size") * 6
    parts = lambda kept: F.ceil(F.greatest(F.sum(F.when(kept, F.col("size"))) * 6 / part_bytes, F.count(F.when(kept, 1)) / part_docs))
    totals = state.groupBy("bucket").agg(
        ((size <= part_bytes) & (F.count("*") <= part_docs)).alias("single"),
        F.coalesce(parts(~F.col("home")), F.lit(0)).alias("p"),
        F.coalesce(parts(F.col("home")), F.lit(0)).alias("q"),
    )
    spot = F.xxhash64("doc")
    part = (
        F.when(F.col("single"), F.lit(0))
        .when(F.col("home"), F.col("p") + F.pmod(spot, F.greatest("q", F.lit(1))))
        .otherwise(F.pmod(spot, F.greatest("p", F.lit(1))))
    )
    placed = state.join(totals, "bucket").withColumn("part", part.cast("int"))
    # pairs (i, part) with i below, and for the parts outside home (part, j) with j from there on
    below = F.expr("transform(filter(sequence(0, cast(p as int)), i -> i < least(part, p)), i -> struct(i as i, part as j))")
    onward = F.expr("transform(filter(sequence(0, cast(p + q as int)), j -> j >= part and j < p + q and part < p), j -> struct(part as i, j as j))")
    pairs = F.when(F.col("single"), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.concat(below, onward))
    return placed.withColumn("pair", F.explode(pairs)).select("bucket", "pair.i", "pair.j", "part", "doc", "size", "grp", "home")


def shared_counts(packed: list[bytes], left: np.ndarray, right: np.ndarray, columns: int = 2048) -> np.ndarray:
    """Sum of minima for every left and right position: the n-th occurrence of an element is an
    element of its own, so sums of minima are products of 0/1 rows, taken some columns at a time."""
    keys, rows = [], []
    for k, one in enumerate(packed):
        element, times = unpack(one)
        at = np.repeat(np.cumsum(times) - times, times)
        number = np.arange(len(at)) - at
        with np.errstate(over="ignore"):
            keys.append(mix(np.repeat(element, times) * U(0x9E3779B97F4A7C15) + number.astype(np.uint64)))
        rows.append(np.full(len(at), k))
    keys, rows = np.concatenate(keys), np.concatenate(rows)
    _, ids, seen = np.unique(keys, return_inverse=True, return_counts=True)
    common = seen > 1
    new_id = np.cumsum(common) - 1
    on = common[ids]
    ids, rows = new_id[ids[on]], rows[on]
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    total = np.zeros((len(left), len(right)), dtype=np.float64)
    for start in range(0, int(common.sum()), columns):
        a, b = np.searchsorted(ids, [start, start + columns])
        block = np.zeros((len(packed), columns), dtype=np.float32)
        block[rows[a:b], ids[a:b] - start] = 1.0
        total += block[left] @ block[right].T
    return total


def connected(near: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest position that each of n positions is connected to by ``near`` (left x right)."""
    label = np.arange(n)
    x, y = np.nonzero(near)
    x, y = left[x], right[y]
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def connect_part(docs: np.ndarray, grp: np.ndarray, left: np.ndarray, right: np.ndarray, packed: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): each document that the links found here connect to another, with the first of them."""
    size = np.array([len(x) // 6 for x in packed], dtype=np.float64)
    shared = shared_counts(packed, left, right)
    union = size[left][:, None] + size[right][None, :] - shared
    near = (shared / np.maximum(union, 1.0) >= similarity) & (grp[left][:, None] != grp[right][None, :])
    label = connected(near, left, right, len(docs))
    moved = np.flatnonzero(label != np.arange(len(docs)))
    return docs[label[moved]], docs[moved]


def links_by_parts(state: DataFrame, sets: DataFrame, similarity: float, **part_sizes: int) -> DataFrame:
    """Pairs (a, b) that connect what the links of the open buckets connect.

    All comparing happens inside a task on one pair of parts; of the links found there only a
    tree leaves it, so no more rows come out than went in, however alike the members are.
    """
    work = in_parts(state, **part_sizes).join(sets, "doc").select("bucket", "i", "j", "part", "doc", "grp", "home", "elements")
    dealt = work.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def solve(held: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(held)
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        part, home = rows.column("part").to_numpy(), rows.column("home").to_numpy(zero_copy_only=False)
        left = np.flatnonzero((part == i) & ~home)
        right = np.flatnonzero(part == j)
        if not len(left) or not len(right):
            return
        a, b = connect_part(rows.column("doc").to_numpy(), rows.column("grp").to_numpy(), left, right, rows.column("elements").to_pylist(), similarity)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)])
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            edges = [0, *new.tolist(), batch.num_rows]
            for x, y in zip(edges[:-1], edges[1:]):
                if x == y:
                    continue
                own = tuple(keys[:, x].tolist())
                if held and own != last:
                    yield from solve(held)
                    held = []
                held.append(batch.slice(x, y - x))
                last = own
        if held:
            yield from solve(held)

    return dealt.mapInArrow(run, "a long, b long")


def links_within_buckets(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that join every two members of a bucket whose similarity reaches the bound,
    directly or through others. ``members``: (bucket, doc, size).

    First each member is compared with the first of its bucket, which settles most buckets of
    copies of one text. In those that are left every member outside the largest group is compared
    with all members of other groups, by parts of bounded size. Copies of the shingles grow with
    the number of parts, comparisons with (members outside the largest group) x (members).
    """
    links, distances = first_round(members, sets, similarity)
    links = cut(links)
    state = cut(open_buckets(members, links, distances, similarity))
    return links.union(cut(links_by_parts(state, sets, similarity)))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(doc_id, class_id): the smallest doc_id among the document's near duplicates, itself included."""
    docs = one_row_per_id(docs.select(key, text).where(F.col(key).isNotNull()), key, text)
    sigs = cut(signatures(docs, text, key, width, bands, rows))
    has = F.col("n_shingles") > 0
    # copies: the smallest id for each sequence of words, pre-aggregated in every task
    copies = sigs.where(has).groupBy("w0", "w1").agg(F.min(key).alias("copy_of"))
    member_of = cut(
        sigs.where(has).select(key, "w0", "w1").join(copies, ["w0", "w1"]).select(F.col(key).alias("doc"), "copy_of")
    )
    distinct = sigs.join(member_of.where("doc = copy_of").select(F.col("doc").alias(key)), key, "left_semi")
    spread = distinct.select(F.explode("keys").alias("bucket"), F.col(key).alias("doc"), F.col("n_shingles").alias("size"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = cut(spread.join(shared, "bucket", "left_semi"))
    sets = cut(shingle_table(docs, members.select("doc").distinct(), text, key, width))
    links = links_within_buckets(members, sets, similarity)
    groups = components(links).select(F.col("node").alias("copy_of"), "class_id")
    classes = member_of.join(groups, "copy_of", "left").select("doc", F.coalesce("class_id", "copy_of").alias("class_id"))
    return (
        sigs.select(F.col(key))
        .join(classes.withColumnRenamed("doc", key), key, "left")
        .select(key, F.coalesce("class_id", key).alias("class_id"))
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest doc_id. Columns unchanged."""
    known = docs.where(F.col(key).isNotNull())
    if repeated_ids(known, key):
        docs = one_row_per_id(known, key, text).unionByName(docs.where(F.col(key).isNull()))
    classes = near_duplicates(docs, key, text, **settings)
    extra = cut(classes.where(F.col("class_id") != F.col(key)).select(key))
    return docs.join(extra, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
