"""Running column moments of a stream, for projections refitted as batches arrive."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from winnow.operators.features import CentredState, centred_state
from winnow.roles import col

STATE = "batch long, n double, mean array<double>, scatter array<double>"


def state_stream(stream: DataFrame, cols: list[str], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merge every micro-batch into a ``CentredState`` kept below ``path``, for ``read_state``.

    A batch is aggregated to one state; rows are never multiplied. Even and odd batches write to two
    places in turn, each from the state before it, so a batch that is run again after a failure
    gives the same state and never reads what it overwrites.
    """

    def step(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            now = centred_state(kept, cols)
        finally:
            kept.unpersist()
        if number:
            now = _read(batch.sparkSession, f"{path}/slot={(number - 1) % 2}", number - 1).merge(now)
        row = (number, float(now.n), [float(v) for v in now.mean], [float(v) for v in now.scatter.ravel()])
        out = batch.sparkSession.createDataFrame([row], STATE).coalesce(1)
        out.write.mode("overwrite").parquet(f"{path}/slot={number % 2}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_state(spark: SparkSession, path: str) -> CentredState:
    """The state after the last batch written; ``projection`` makes the feature map of it."""
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    return _read(spark, f"{path}/slot={last % 2}", last)


def _read(spark: SparkSession, place: str, number: int) -> CentredState:
    r = spark.read.schema(STATE).parquet(place).where(F.col("batch") == number).first()
    if r is None:
        raise ValueError(f"no state of batch {number}: the checkpoint and the state's folder differ")
    d = len(r["mean"])
    return CentredState(r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(d, d))


def moment_stream(stream: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, n, sa, sb, sab) kept up to date; feed it to ``pca_from_moments``. The state is
    one row per column pair."""
    cells = [
        F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"), col(a).alias("x"), col(b).alias("y")
        )
        for i, a in enumerate(cols)
        for b in cols[i:]
    ]
    long = stream.select(F.explode(F.array(*cells)).alias("e")).select("e.*")
    return long.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sa"), F.sum("y").alias("sb"),
        F.sum(F.col("x") * F.col("y")).alias("sab"),
    )


def to_memory(stream: DataFrame, name: str) -> StreamingQuery:
    return stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
