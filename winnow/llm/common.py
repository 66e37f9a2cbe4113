"""What the operators of this package share: lineage cuts, row identity, batches, bitmaps."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text handled at once inside a task; bounds the memory of the array work.
CHUNK_CHARS = 2_000_000
#: The same where each character takes some hundred bytes of arrays.
DENSE_CHARS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read from there.

    A folder below the warehouse is set only where the session names none (tests).
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one below the
    warehouse where the session names none (tests)."""
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    return spark.conf.get("spark.checkpoint.dir", os.path.join(warehouse, "_checkpoints"))


def repeated_ids(df: DataFrame, key: str) -> bool:
    """Whether a key occurs on more than one row; reads the key column only."""
    return bool(df.groupBy(key).count().where("count > 1").limit(1).count())


def one_row_per_id(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows that share a key become one: that with the smallest text, then the smallest rest."""
    if not repeated_ids(df, key):
        return df
    rest = [c for c in df.columns if c not in (key, text)]
    least = F.min(F.struct(F.col(text), *[F.col(f"`{c}`") for c in rest])).alias("_least")
    # pre-aggregated map-side: min() of a struct keeps one row for each key and task
    kept = df.groupBy(key).agg(least)
    return kept.select(*[F.col(key) if c == key else F.col(f"_least.`{c}`").alias(c) for c in df.columns])


def in_chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive (from, to) spans of at most ``limit`` characters, at least one text each."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def text_slices(batch: pa.RecordBatch, at: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text in column ``at``, one row at least;
    nothing is turned into Python strings for it."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin, before = 0, 0
    while begin < batch.num_rows:
        stop = max(int(np.searchsorted(ends, before + limit, side="right")), begin + 1)
        yield batch.slice(begin, stop - begin)
        begin, before = stop, int(ends[stop - 1])


#: Hashes of rows that a sample is drawn by lie below this.
SPOTS = 1 << 30


def sample_shares(counts: dict[str, int], sample: int, least: int) -> dict[str, float]:
    """The share of each class's rows to draw: that of ``sample`` rows in all, but such that
    about ``least`` rows of every class are drawn, and all rows of a class with no more."""
    whole = sum(counts.values())
    return {c: min(1.0, max(sample / whole, least / n)) for c, n in counts.items()}


def drawn(shares: dict[str, float], label: Column, spot: Column) -> Column:
    """Whether a row with the hash ``spot`` (below ``SPOTS``) is in the sample of its class."""
    place = F.array_position(F.array(*[F.lit(c) for c in shares]), label) - 1
    limits = F.array(*[F.lit(int(s * SPOTS)) for s in shares.values()])
    return spot < F.get(limits, place.cast("int"))


def map_texts(
    df: DataFrame, text: str, fn: Callable[[list, pa.RecordBatch], list], schema: str, limit: int = CHUNK_CHARS
) -> DataFrame:
    """``fn(texts, rows)`` on chunks of bounded size; it returns Arrow arrays in the order of ``schema``."""
    names = [part.split()[0] for part in schema.split(", ")]
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, at, limit):
                yield pa.RecordBatch.from_arrays(fn(part.column(at).to_pylist(), part), names=names)

    return df.mapInArrow(run, schema)


def keep_texts(df: DataFrame, text: str, keep: Callable[[list], np.ndarray], limit: int = CHUNK_CHARS) -> DataFrame:
    """The rows of ``df`` (all columns as they are) whose text ``keep`` accepts."""
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, at, limit):
                yield part.filter(pa.array(keep(part.column(at).to_pylist())))

    return df.mapInArrow(run, df.schema)


def bit_table(keys: DataFrame, positions: list[Column]) -> dict[int, int]:
    """Words of 64 bits with the bits at ``positions`` set, or-ed together on the executors.

    The result has at most (number of bits / 64) entries, so the caller's choice of the number
    of bits bounds what reaches the driver.
    """
    spots = keys.select(F.explode(F.array(*positions)).alias("p"))
    words = spots.groupBy(F.shiftright("p", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")
    )
    return {r["word"]: r["bits"] for r in words.collect()}


def bit_array(words: dict[int, int], n_bits: int) -> np.ndarray:
    out = np.zeros((n_bits + 63) // 64, dtype=np.uint64)
    for word, bits in words.items():
        out[word] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    return out


def bits_at(words: np.ndarray, positions: np.ndarray) -> np.ndarray:
    p = positions.astype(np.uint64)
    return ((words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)


def id_filter(ids: DataFrame, key: str, n_bits: int = 1 << 23) -> np.ndarray:
    """A one-hash Bloom filter of fixed size (1 MB) over ``ids``: no id of it is ever missed."""
    spot = F.pmod(F.xxhash64(key), F.lit(n_bits))
    return bit_array(bit_table(ids.where(F.col(key).isNotNull()), [spot]), n_bits)
