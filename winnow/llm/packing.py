"""Mixture-controlled packing: deficit round-robin over one token queue per source.

Every document becomes token ids and an end id; the ids of a source form a queue. Sources earn
tokens in proportion to their targets (the sources' own totals by default) and pay for what they
send: a source sends its next ``cell`` of tokens as soon as its deficit reaches half a cell, and
what is still owed is carried into the next window. So up to any window a source with the share p
of S sources has sent its target to within (3 + S p) / 2 cells (a test holds it to that and a token),
and a source that has run out leaves its place to the others in their proportions. A document is cut wherever a window ends; nothing is padded but by the
caller: what is left after the last full window goes into windows of powers of two.

The deficits at the start of any window follow from the totals alone (``Schedule.sent``): cell j
of a source with target P is due at time (2 j + 1) cell / (2 P). A task that holds documents of
the middle of a queue takes the deficits carried there and goes on by rounds, so partitions
need nothing from each other but the number of tokens before them.

1. Ids are computed once and written with the number of tokens of the same source before the
   document in its task.
2. Totals of (task, source) are summed up to offsets; nothing else is shuffled.
3. Each task cuts its own documents at the window bounds of its queues.

Defined cases: a null or empty text is the end id alone; a null source is a source; rows that
share a doc_id, or have none, are documents of their own; with more than ``max_queues`` sources
the smallest share one queue; a source without a target gets what the others leave, so every
document is packed; an empty table gives no rows. Texts of any length are encoded in parts
that end where no token can cross. Columns but doc_id, text and source are never looked at.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import shared_folder

WINDOW = 2048
#: Tokens a source sends at once; a window has WINDOW / CELL turns.
CELL = 128
END = 1
MAX_QUEUES = 1024
#: Windows whose rounds are run together from one carried state.
STRETCH = 512
#: Characters encoded at once; a part without a place to cut beyond LONG goes to the slower encoder.
PART, LONG = 200_000, 400_000
#: Documents handled at once in a task.
ROWS = 256
#: Rows of (task, source) offsets that are broadcast; beyond, the join moves the ids.
OFFSETS = 50_000
PIECES = "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of a byte-level BPE file, as ``tokenizers`` gives them.

    The merges are handed to the faster library where the file lists them by rank; a test holds
    both against each other.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.slow = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.fast = self._by_rank(spec)
        self.dtype = np.dtype("<u2" if self.slow.get_vocab_size() <= 1 << 16 else "<u4")

    def _by_rank(self, spec):
        import public_tokenizers
        import tiktoken

        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if not plain or any(vocab["".join(m)] != 256 + i for i, m in enumerate(pairs)):
            return None
        # a byte is written as itself where it is printable, else as the next character from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a whole text."""
        found = [self._plain(part) for part in parts_of(text or "")]
        return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, self.dtype)

    def _plain(self, part: str) -> np.ndarray:
        if self.fast is None or len(part) > LONG or any(s in part for s in self.special):
            return np.array(self.slow.encode(part, add_special_tokens=False).ids, dtype=self.dtype)
        return self.fast.encode_to_numpy(part, disallowed_special=()).astype(self.dtype)


def parts_of(text: str, size: int = PART) -> list[str]:
    """Parts of about ``size`` characters, cut before a single space between two other characters,
    where a token of the byte-level pattern always starts."""
    out, a = [], 0
    while len(text) - a > size:
        b = text.find(" ", a + size)
        while 0 < b < len(text) - 1 and (text[b - 1].isspace() or text[b + 1].isspace()):
            b = text.find(" ", b + 1)
        if not 0 < b < len(text) - 1:
            break
        out.append(text[a:b])
        a = b
    return [*out, text[a:]] if a < len(text) else out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Schedule:
    """Which tokens of which queue a window holds; ``totals`` and ``targets`` by queue."""

    def __init__(self, totals: list[int], targets: list[float] | None = None, window: int = WINDOW, cell: int = CELL):
        self.totals, self.window, self.cell = [int(t) for t in totals], window, cell
        self.tokens = sum(self.totals)
        if targets is None:
            weights = self.totals
        else:
            whole = sum(targets) or 1.0
            weights = [round(t / whole * (1 << 20)) for t in targets]
        self.weights = [max(1, w) for w in weights]
        self.cells = [-(-t // cell) for t in self.totals]
        #: Ticks of the clock in the time that the targets take to go round once.
        self.ticks = 4 * (sum(self.weights) // cell + len(self.totals) + 1) if targets is None else 1 << 40
        self.full = self.tokens // window
        rest = self.tokens - self.full * window
        self.tail = [1 << b for b in reversed(range(window.bit_length())) if rest >> b & 1]
        self.windows = self.full + len(self.tail)

    def end_of(self, w: int) -> int:
        """Tokens in the windows before ``w``."""
        return w * self.window if w <= self.full else self.full * self.window + sum(self.tail[: w - self.full])

    def due(self, s: int, j: int) -> int:
        """The tick at which cell ``j`` of queue ``s`` is due."""
        return (2 * j + 1) * self.cell * self.ticks // (2 * self.weights[s])

    def sent_by(self, s: int, tick: int) -> int:
        """Cells of queue ``s`` due up to ``tick``."""
        n = ((tick + 1) * 2 * self.weights[s] - 1) // (self.cell * self.ticks)
        return max(0, min(self.cells[s], (n + 1) // 2))

    def tokens_by(self, tick: int) -> int:
        return sum(min(self.sent_by(s, tick) * self.cell, t) for s, t in enumerate(self.totals))

    def sent(self, tokens: int) -> tuple[list[int], int]:
        """(tokens sent by each queue, first tick not wholly sent) after ``tokens`` in all."""
        low, high = -1, max((self.due(s, n - 1) for s, n in enumerate(self.cells) if n), default=0)
        while low < high:  # the first tick by which more than ``tokens`` are due
            mid = (low + high) // 2
            if self.tokens_by(mid) > tokens:
                high = mid
            else:
                low = mid + 1
        out = [min(self.sent_by(s, low - 1) * self.cell, t) for s, t in enumerate(self.totals)]
        left = tokens - sum(out)
        for s, t in enumerate(self.totals):  # within a tick queues go in order
            due = min(self.sent_by(s, low) * self.cell, t) - out[s]
            out[s] += min(left, due)
            left -= min(left, due)
        return out, low

    def bounds(self, first: int, last: int) -> np.ndarray:
        """(last - first + 1, queues): tokens sent by each queue before windows first .. last.

        The state carried into window ``first`` comes from the totals; from there the cells go
        out by their due ticks, and a window ends wherever its tokens are full.
        """
        start, tick = self.sent(self.end_of(first))
        _, stop = self.sent(self.end_of(last))
        due, queue, size = [], [], []
        for s, total in enumerate(self.totals):
            a, b = start[s] // self.cell, self.sent_by(s, stop)
            if a >= b:
                continue
            # ticks from ``tick`` on; the large part of the product is taken out before numpy sees it
            step, unit = 2 * self.cell * self.ticks, 2 * self.weights[s]
            base, rest = divmod((2 * a + 1) * self.cell * self.ticks, unit)
            j = np.arange(b - a, dtype=np.int64 if (b - a + 1) * step + unit < 1 << 62 else object)
            due.append(((j * step + rest) // unit + (base - tick)).astype(np.int64))
            queue.append(np.full(b - a, s))
            n = np.minimum(self.cell, total - (a + np.arange(b - a)) * self.cell)
            n[0] -= start[s] - a * self.cell
            size.append(n)
        ends = np.array([self.end_of(w) for w in range(first, last + 1)], dtype=np.int64)
        out = np.tile(np.array(start, dtype=np.int64), (last - first + 1, 1))
        if not due:
            return out
        due, queue, size = map(np.concatenate, (due, queue, size))
        order = np.lexsort((queue, due))
        queue, size = queue[order], size[order]
        after = np.cumsum(size) + ends[0]
        # a cell that crosses the end of a window is sent in two
        at = np.searchsorted(after, ends, side="left")
        for s in np.unique(queue):
            mine = np.concatenate([[0], np.cumsum(np.where(queue == s, size, 0))])
            whole = mine[np.minimum(at, len(size))]
            inside = at < len(size)
            cut = np.minimum(at, len(size) - 1)
            part = np.where(inside & (queue[cut] == s), ends - (after[cut] - size[cut]), 0)
            out[:, s] += whole + part
        return out

    def deficits(self, w: int) -> np.ndarray:
        """What each queue is owed by its target after the windows before ``w``."""
        n = self.end_of(w)
        return n * np.array(self.weights, dtype=float) / sum(self.weights) - np.array(self.sent(n)[0], dtype=float)


def cut_pieces(plan: Schedule, stretch, queue: int, begin: np.ndarray, end: np.ndarray):
    """(row, from, to, window, offset) of the token intervals [begin, end) of one queue, in the
    queue's own numbers; ``stretch(i)`` gives the bounds of the i-th stretch of windows."""
    out = []
    todo = np.argsort(begin, kind="stable")
    todo = todo[end[todo] > begin[todo]]
    while len(todo):
        a = int(begin[todo].min())
        tick = plan.due(queue, a // plan.cell)
        i = min(plan.tokens_by(tick - 1) // plan.window, plan.windows - 1) // STRETCH
        while a < stretch(i)[0][0, queue]:
            i -= 1
        while a >= stretch(i)[0][-1, queue]:
            i += 1
        held, place = stretch(i)
        mine = held[:, queue]
        here = todo[begin[todo] < mine[-1]]
        low, high = np.maximum(begin[here], mine[0]), np.minimum(end[here], mine[-1])
        first = np.searchsorted(mine, low, side="right") - 1
        last = np.searchsorted(mine, high, side="left") - 1
        count = last - first + 1
        row = np.repeat(here, count)
        w = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        start = np.maximum(np.repeat(low, count), mine[w])
        stop = np.minimum(np.repeat(high, count), mine[w + 1])
        some = stop > start
        row, w, start, stop = row[some], w[some], start[some], stop[some]
        out.append((row, start, stop, w + i * STRETCH, place[w, queue] + start - mine[w]))
        begin = begin.copy()
        begin[here] = high
        todo = todo[end[todo] > begin[todo]]
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5


def tokenised(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(part, source, before, doc_id, n, ids): ids of each document and the tokens of its source
    before it in its task."""

    def run(batches):
        enc, part, before = encoder(path), TaskContext.get().partitionId(), defaultdict(int)
        last = np.array([end], dtype=enc.dtype)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                rows = batch.slice(a, ROWS)
                ids = [np.append(enc.ids(t), last) for t in rows.column(1).to_pylist()]
                sources, starts = rows.column(2).to_pylist(), []
                for s, x in zip(sources, ids):
                    starts.append(before[s])
                    before[s] += len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), part, np.int32)), rows.column(2), pa.array(starts, pa.int64()), rows.column(0),
                        pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()),
                    ],
                    names=["part", "source", "before", "doc_id", "n", "ids"],
                )

    return docs.mapInArrow(run, "part int, source string, before long, doc_id long, n long, ids binary")


def pack(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", source: str = "source", targets: dict | None = None,
    window: int = WINDOW, cell: int = CELL, end: int = END, max_queues: int = MAX_QUEUES,
) -> DataFrame:
    """Pieces of all documents: doc_id, source, start, length, ids (unsigned 32-bit, little
    endian), doc_tokens, sequence_id, offset. ``targets`` maps sources to weights."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    wanted = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
    tokenised(wanted, path, end).write.option("compression", "zstd").parquet(folder)
    tokens = spark.read.parquet(folder)
    each = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    totals = each.groupBy("source").agg(F.sum("n").alias("n"))
    largest = totals.orderBy(F.desc("n"), "source").limit(max_queues + 1).collect()
    if not largest:
        return spark.createDataFrame([], PIECES)
    own = largest if len(largest) <= max_queues else largest[: max_queues - 1]
    sums = [r["n"] for r in own]
    if len(largest) > max_queues:
        sums.append(totals.agg(F.sum("n").alias("n")).first()["n"] - sum(sums))
    weights = None if targets is None else [targets.get(r["source"], 0) for r in own] + [0] * (len(sums) - len(own))
    plan = Schedule(sums, weights, window, cell)

    queue_of = F.broadcast(spark.createDataFrame([(r["source"], i) for i, r in enumerate(own)], "source string, queue int"))
    placed = each.alias("e").join(queue_of.alias("q"), F.col("e.source").eqNullSafe(F.col("q.source")), "left")
    placed = placed.select("e.source", "part", "n", F.coalesce("queue", F.lit(len(own))).alias("queue"))
    # rows of a queue are as many as tasks (and, in the shared queue, scarce sources), not documents
    ahead = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.select("source", "part", "queue", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    few = offsets.limit(OFFSETS + 1).collect()
    if len(few) <= OFFSETS:
        offsets = F.broadcast(spark.createDataFrame(few, offsets.schema))
    same = (F.col("t.part") == F.col("o.part")) & F.col("t.source").eqNullSafe(F.col("o.source"))
    rows = tokens.alias("t").join(offsets.alias("o"), same).select(
        "doc_id", "t.source", "n", "ids", "queue", (F.col("ahead") + F.col("before")).alias("begin")
    )
    width = 2 if encoder(path).dtype.itemsize == 2 else 4

    def run(batches):
        @lru_cache(maxsize=8)
        def stretch(i):
            held = plan.bounds(i * STRETCH, min((i + 1) * STRETCH, plan.windows))
            sizes = np.diff(held, axis=0)
            return held, np.cumsum(sizes, axis=1) - sizes

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n, queue, begin = (part.column(i).to_numpy() for i in (2, 4, 5))
                ids = part.column(3).to_pylist()
                found = []
                for s in np.unique(queue):
                    mine = np.flatnonzero(queue == s)
                    row, *rest = cut_pieces(plan, stretch, int(s), begin[mine], begin[mine] + n[mine])
                    found.append((mine[row], *rest))
                row, start, stop, w, offset = (np.concatenate(c) for c in zip(*found))
                start, stop = start - begin[row], stop - begin[row]
                cuts = [
                    np.frombuffer(ids[r], f"<u{width}", b - a, a * width).astype("<u4").tobytes()
                    for r, a, b in zip(row.tolist(), start.tolist(), stop.tolist())
                ]
                at_row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(at_row), part.column(1).take(at_row), pa.array(start), pa.array(stop - start),
                        pa.array(cuts, pa.binary()), pa.array(n[row]), pa.array(w), pa.array(offset),
                    ],
                    names=[f.split()[0] for f in PIECES.split(", ")],
                )

    return rows.mapInArrow(run, PIECES)
