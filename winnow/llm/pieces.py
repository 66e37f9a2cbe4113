"""SentencePiece encoding and decoding: best-scoring pieces, giant texts by a max-plus scan.

A text is prepared as the model file says (a leading space, spaces as U+2581) and cut into the
pieces of the vocabulary with the greatest sum of scores; a character without a piece costs a
little more than the worst piece and becomes its UTF-8 byte pieces. Scores are whole numbers
and sums are exact; between equal sums the longer last piece wins. (The file at hand was made
for merging pairs by rank; its ranks are used as scores, as the method asks. The ids therefore
are not those of the merge procedure, though both decode to the same text.)

No piece runs past a space after another character, nor past an unknown character, so the best
cut of a text is that of its parts side by side. Parts of at most ``SPAN`` characters go to the
library's lattice search, whose 32-bit sums are exact for them; the few for which they would
not be (runs of spaces, a space before a character that no piece joins it to, very long words)
are cut here.

Texts over ``GIANT`` characters are cut into chunks of ``CHUNK``. The state at a chunk border is
how many characters the piece across it reaches over. Each chunk yields a matrix: the best sum
from each state at its left border to each state at its right one. Max-plus products combine
matrices associatively, 64 to a group and level by level, so no task holds a whole text; then
states are fixed from the top down, and every chunk is traced back by itself. A chunk with a
place that no piece crosses is a head, a middle cut as any other text, and a tail.

Defined cases: a null text is an empty one, without ids; U+2581 in a text decodes to a space, as
in the library, everything else comes back exactly; at chunk borders equal sums are told apart
by the lower state; repeated rows are each encoded; other columns pass through ``encode``.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import cut, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters that the lattice takes at once, at most; hard words remembered by a task.
SPAN, CACHED = 256, 100_000
#: Dearer than SPAN characters one by one; 32-bit sums of a span stay exact (under 2^24).
AVOIDED = -8_200_000.0
GIANT, CHUNK, GROUP = 65_536, 16_384, 64
#: Bytes of text encoded at once; their ids are held as Python numbers for a moment.
AT_ONCE = 250_000
NEVER = -(1 << 60)


class Pieces:
    """The vocabulary of a model file, given as its bytes."""

    def __init__(self, blob: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(blob)
        model.trainer_spec.model_type = 1  # the lattice search over pieces and scores
        model.normalizer_spec.add_dummy_prefix = False  # the texts are prepared here
        normal = {p.piece: (i, int(p.score)) for i, p in enumerate(model.pieces) if p.type == 1}
        for p in model.pieces:
            # pieces of spaces cost 1e9, beside which 32-bit sums lose their last digits; no part
            # that goes to the lattice needs one, and AVOIDED is dear enough that none takes one
            p.score = max(p.score, AVOIDED) if p.type == 1 else p.score
        self.lattice = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.pieces = normal
        self.longest = max(map(len, normal))
        self.unknown = min(s for _, s in normal.values()) - 10
        self.byte_id = [0] * 256
        table, scores = [], np.zeros(len(model.pieces), np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                value = int(p.piece[3:5], 16)
                self.byte_id[value] = i
                table.append(bytes([value]))
            elif p.type == 1:
                table.append(p.piece.replace(SPACE, " ").encode())
                scores[i] = normal[p.piece][1]
            else:
                table.append(b"")
        self.scores = scores
        self.table = table
        known = "".join(re.escape(c) for c in normal if len(c) == 1)
        joined = "".join(re.escape(p[1]) for p in normal if len(p) == 2 and p[0] == SPACE and p[1] != SPACE)
        self.parts = re.compile(f"[^{known}]+|[{known}]+")
        self.is_known = re.compile(f"[{known}]")
        plain = "".join(re.escape(c) for c in normal if len(c) == 1 and c != SPACE)
        # runs of unknown characters, and words whose space no piece joins to what follows
        self.special = re.compile(f"([^{known}]+|{SPACE}{SPACE}+[{plain}]*|{SPACE}(?![{joined}{SPACE}])[{plain}]*)")
        self.spans = re.compile(f".{{1,{SPAN}}}(?={SPACE}|$)", re.DOTALL)
        self.cuts = re.compile(f"(?<=[^{SPACE}])(?={SPACE})|(?<=[^{known}])|(?=[^{known}])")
        self.cache: dict[str, list[int]] = {}  # special parts met before

    def matches(self, text: str, at: int):
        """(end, id, score) of the pieces that begin at ``at``; id -1 for an unknown character."""
        if not self.is_known.match(text[at]):
            yield at + 1, -1, self.unknown
            return
        for end in range(at + 1, min(at + self.longest, len(text)) + 1):
            got = self.pieces.get(text[at:end])
            if got:
                yield end, got[0], got[1]

    def search(self, text: str, begin: int = 0, end: int | None = None) -> tuple[np.ndarray, list]:
        """Best sums from ``begin`` to every place up to ``end`` (pieces may not pass it), and the
        last piece (from, id) of each."""
        end = len(text) if end is None else end
        best = np.full(end + 1, NEVER, np.int64)
        back: list = [None] * (end + 1)
        best[begin] = 0
        for at in range(begin, end):
            here = int(best[at])
            if here == NEVER:
                continue
            for stop, piece, score in self.matches(text, at):
                if stop <= end and here + score > best[stop]:
                    best[stop] = here + score
                    back[stop] = (at, piece)
        return best, back

    def trace(self, text: str, back: list, end: int) -> list[int]:
        out = []
        while back[end] is not None:
            at, piece = back[end]
            out.append([self.byte_id[b] for b in text[at].encode()] if piece < 0 else [piece])
            end = at
        return [i for ids in reversed(out) for i in ids]

    def by_hand(self, part: str) -> list[int]:
        """The ids of a part by the exact search; short parts recur and are remembered."""
        got = self.cache.get(part)
        if got is None:
            _, back = self.search(part)
            got = self.trace(part, back, len(part))
            if len(part) <= 32:
                if len(self.cache) >= CACHED:
                    self.cache.clear()
                self.cache[part] = got
        return got

    def plan(self, prepared: str, easy: list[str]) -> list:
        """What a prepared text consists of: numbers into ``easy`` (to which spans for the lattice
        are added) and lists of ids."""
        out: list = []
        for i, part in enumerate(self.special.split(prepared)):
            if i % 2:
                out.append(self.by_hand(part))
                continue
            while part:
                m = self.spans.match(part)
                if m:
                    span, part = m.group(), part[m.end() :]
                    out.append(len(easy))
                    easy.append(span)
                else:  # one very long word
                    stop = part.find(SPACE, 1)
                    word, part = (part, "") if stop < 0 else (part[:stop], part[stop:])
                    out.append(self.by_hand(word))
        return out

    def encode(self, prepared: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin (one more than texts)."""
        easy: list[str] = []
        plans = [self.plan(text, easy) for text in prepared]
        found = self.lattice.encode(easy, num_threads=1) if easy else []
        flat: list[int] = []
        starts = np.zeros(len(prepared) + 1, np.int64)
        for i, out in enumerate(plans):
            for x in out:
                flat += found[x] if type(x) is int else x
            starts[i + 1] = len(flat)
        return np.array(flat, np.int32), starts

    def score(self, prepared: str, ids: np.ndarray) -> int:
        """The sum of scores of a cut of ``prepared``."""
        unknown = sum(len(m.group()) for m in self.parts.finditer(prepared) if not self.is_known.match(m.group()))
        return int(self.scores[ids].sum()) + unknown * self.unknown

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        each, places = ids.tolist(), starts.tolist()
        texts = (b"".join(map(self.table.__getitem__, each[a:b])).decode("utf-8", "replace") for a, b in zip(places[:-1], places[1:]))
        return [t[1:] if t.startswith(" ") else t for t in texts]

    # chunks: `text` is a chunk and, after its `size` characters, what a piece may reach into

    def border(self, text: str, size: int) -> tuple[int, int] | None:
        """The first and last place of a chunk that no piece crosses."""
        places = [m.start() for m in self.cuts.finditer(text) if m.start() <= size]
        return (places[0], places[-1]) if places else None

    def matrix(self, text: str, size: int) -> np.ndarray:
        """Best sums from ``i`` characters after the chunk's begin to ``j`` after its end."""
        n = self.longest
        out = np.full((n, n), NEVER, np.int64)
        inside = self.border(text, size)
        last = min(size + n - 1, len(text))
        if inside is None:
            for i in range(min(n, size + 1)):
                best, _ = self.search(text, i, last)
                out[i, : last - size + 1] = self.reaching(text, best, i, size, last)
            return out
        first, final = inside
        ids, _ = self.encode([text[first:final]])
        middle = self.score(text[first:final], ids)
        tail, _ = self.search(text, final, last)
        after = self.reaching(text, tail, final, size, last)
        for i in range(min(n - 1, first) + 1):
            head, _ = self.search(text, i, first)
            if head[first] != NEVER:
                out[i, : last - size + 1] = np.where(after == NEVER, NEVER, after + (head[first] + middle))
        return out

    def reaching(self, text: str, best: np.ndarray, begin: int, size: int, last: int) -> np.ndarray:
        """Best sums of cuts whose last piece begins inside the chunk and ends at each place from
        ``size`` to ``last``."""
        out = np.full(last - size + 1, NEVER, np.int64)
        out[0] = best[size] if begin <= size else NEVER
        for at in range(max(begin, size - self.longest + 1), size):
            if best[at] != NEVER:
                for stop, _, score in self.matches(text, at):
                    if size < stop <= last:
                        out[stop - size] = max(out[stop - size], best[at] + score)
        return out

    def between(self, text: str, size: int, begin: int, over: int) -> np.ndarray:
        """The ids of a chunk from ``begin`` up to ``over`` characters after its end."""
        stop = size + over
        inside = self.border(text, size)
        if inside is None or inside[0] < begin:
            return np.array(self.traced(text, begin, size, stop), np.int32)
        first, final = inside
        _, back = self.search(text, begin, first)
        head = self.trace(text, back, first)
        ids, _ = self.encode([text[first:final]])
        return np.concatenate([np.array(head, np.int32), ids, np.array(self.traced(text, final, size, stop), np.int32)])

    def traced(self, text: str, begin: int, size: int, stop: int) -> list[int]:
        """The ids of the best cut of text[begin:stop] whose last piece begins before ``size``."""
        best, back = self.search(text, begin, min(stop, size))
        if stop <= size:
            return self.trace(text, back, stop)
        ways = []
        for at in range(max(begin, stop - self.longest), size):
            if best[at] != NEVER:
                ways += [(int(best[at]) + score, -at, piece) for end, piece, score in self.matches(text, at) if end == stop]
        _, at, piece = max(ways)
        return self.trace(text, back, -at) + [piece]


@lru_cache(maxsize=2)
def pieces(blob: bytes) -> Pieces:
    return Pieces(blob)


def prepare(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def model_bytes(path: str = MODEL) -> bytes:
    """The model file (about half a megabyte), read on the driver and sent with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two matrices."""
    out = (a[:, :, None] + b[None, :, :]).max(axis=1)
    return np.where(out < NEVER // 2, NEVER, out)


def packed_lists(arrays: list[np.ndarray]) -> pa.Array:
    starts = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=starts[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(flat.astype(np.int32)))


def encode(
    docs: DataFrame, text: str = "text", ids: str = "ids", path: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, same: str | None = None
) -> DataFrame:
    """``docs`` with a column ``ids`` (array of int, never null) added; it replaces one of that name.
    ``same`` names a further column: whether the ids decode to the text (a null text is an empty
    one), found beside the encoding, without a second Python worker."""
    blob = model_bytes(path)
    docs = docs.drop(ids, *([same] if same else []))
    at, names = docs.columns.index(text), [*docs.columns, ids, *([same] if same else [])]
    big = F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)) > giant

    def run(batches):
        p = pieces(blob)
        for batch in batches:
            for part in text_slices(batch, at, AT_ONCE):
                texts = part.column(at).to_pylist()
                flat, starts = p.encode([prepare(t) for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat))
                back = [pa.array([a == (b or "") for a, b in zip(p.decode(flat, starts), texts)])] if same else []
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *back], names=names)

    flag = [F.lit(True).alias(same)] if same else []
    schema = docs.select("*", F.array(F.lit(0)).alias(ids), *flag).schema
    small = docs.where(~big).mapInArrow(run, schema)
    if not docs.where(big).limit(1).count():
        return small
    rows = cut(docs.where(big).select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_rid")))
    cut_up = encode_giants(rows.select("_rid", F.col(f"_row.`{text}`").alias("_body")), "_body", blob, chunk)
    each = cut_up.groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("_parts"))
    joined = rows.join(each, "_rid").select("_row", F.flatten(F.col("_parts.ids")).alias("_ids"))
    found = [F.col("_ids").alias(ids)]
    if same:
        joined = decode(joined, "_ids", "_back", path)
        found.append((F.col("_back") == F.col(f"_row.`{text}`")).alias(same))
    whole = joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns], *found)
    return small.unionByName(whole)


def encode_giants(rows: DataFrame, text: str, blob: bytes, chunk: int) -> DataFrame:
    """(_rid, i, ids): the ids of each chunk of each text."""

    def chop(batches):
        longest = pieces(blob).longest
        for batch in batches:
            for n in range(batch.num_rows):
                rid, whole = batch.column(0)[n].as_py(), prepare(batch.column(1)[n].as_py())
                for i, a in enumerate(range(0, len(whole), chunk)):
                    size = min(chunk, len(whole) - a)
                    # the size is negative where nothing is left to reach into
                    signed = -size if a + size == len(whole) else size
                    yield pa.RecordBatch.from_pydict(
                        {"_rid": [rid], "i": pa.array([i], pa.int64()), "body": [whole[a : a + size + longest]], "size": pa.array([signed], pa.int32())}
                    )

    def matrices(batches):
        p = pieces(blob)
        for batch in batches:
            for n in range(batch.num_rows):
                body, signed = batch.column(2)[n].as_py(), batch.column(3)[n].as_py()
                m = p.matrix(body, abs(signed))
                if signed < 0:
                    m[:, 1:] = NEVER
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(n, 1).columns[:3], pa.array([abs(signed)], pa.int32()), pa.array([m.tobytes()])],
                    names=["_rid", "i", "body", "size", "m"],
                )

    # a text is cut where it is read; its chunks are dealt out, so its matrices are made side by side
    chopped = rows.select("_rid", text).mapInArrow(chop, "_rid long, i long, body string, size int")
    chunks = cut(chopped.repartition("_rid", "i").mapInArrow(matrices, "_rid long, i long, body string, size int, m binary"))
    levels = [chunks.select("_rid", "i", "m")]
    while (levels[-1].agg(F.max("i").alias("n")).first()["n"] or 0) > 0:
        groups = levels[-1].withColumn("g", F.expr(f"i div {GROUP}")).groupBy("_rid", "g")
        levels.append(cut(groups.applyInPandas(combine, "_rid long, i long, m binary")))
    states = levels[-1].select("_rid", "i", F.lit(0).alias("s_in"), F.lit(0).alias("s_out"))
    for level in reversed(levels[:-1]):
        above = states.select("_rid", F.col("i").alias("g"), "s_in", "s_out")
        below = level.withColumn("g", F.expr(f"i div {GROUP}")).join(above, ["_rid", "g"])
        states = cut(below.groupBy("_rid", "g").applyInPandas(descend, "_rid long, i long, s_in int, s_out int"))

    def trace(batches):
        p = pieces(blob)
        for batch in batches:
            body, size, s_in, s_out = (batch.column(j).to_pylist() for j in range(2, 6))
            lists = [p.between(*x) for x in zip(body, size, s_in, s_out)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed_lists(lists)], names=["_rid", "i", "ids"])

    ready = chunks.join(states, ["_rid", "i"]).select("_rid", "i", "body", "size", "s_in", "s_out")
    return ready.mapInArrow(trace, "_rid long, i long, ids array<int>")


def matrices(column) -> list[np.ndarray]:
    flat = [np.frombuffer(m, np.int64) for m in column]
    n = int(round(len(flat[0]) ** 0.5))
    return [m.reshape(n, n) for m in flat]


def combine(group):
    """The product of the matrices of at most GROUP neighbours."""
    group = group.sort_values("i")
    each = matrices(group["m"])
    total = each[0]
    for m in each[1:]:
        total = product(total, m)
    out = group.iloc[:1][["_rid"]].copy()
    out["i"], out["m"] = int(group["i"].iloc[0]) // GROUP, total.tobytes()
    return out


def descend(group):
    """States at the borders between at most GROUP neighbours, given those at their two ends."""
    group = group.sort_values("i")
    each = matrices(group["m"])
    reach = np.full(len(each[0]), NEVER, np.int64)
    reach[int(group["s_in"].iloc[0])] = 0
    ways = []
    for m in each:
        sums = reach[:, None] + m
        ways.append(sums.argmax(axis=0))
        reach = np.maximum(sums.max(axis=0), NEVER)
    state, enters, leaves = int(group["s_out"].iloc[0]), [], []
    for way in reversed(ways):
        leaves.append(state)
        state = int(way[state])
        enters.append(state)
    out = group[["_rid", "i"]].copy()
    out["s_in"], out["s_out"] = enters[::-1], leaves[::-1]
    return out


def decode(encoded: DataFrame, ids: str = "ids", text: str = "decoded", path: str = MODEL) -> DataFrame:
    """``encoded`` with a column ``text`` made from ``ids`` added; it replaces one of that name."""
    blob = model_bytes(path)
    encoded = encoded.drop(text)
    at, names = encoded.columns.index(ids), [*encoded.columns, text]

    def run(batches):
        p = pieces(blob)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                lists = part.column(at)
                lengths = np.diff(lists.offsets.to_numpy())
                starts = np.concatenate([[0], np.cumsum(lengths)])
                texts = p.decode(lists.flatten().to_numpy(), starts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return encoded.mapInArrow(run, encoded.select("*", F.lit("").alias(text)).schema)
