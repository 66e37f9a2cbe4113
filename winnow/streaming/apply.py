"""Apply a fitted chain to a stream. Fitted steps are row-wise with constant or static
state, so the same chain runs on a batch and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from winnow.plans.chain import FittedChain


def prepare_stream(
    chain: FittedChain, stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = True
) -> StreamingQuery:
    """Start writing prepared rows; with ``once`` it processes what is there and stops."""
    writer = (
        chain.apply(stream)
        .writeStream.outputMode("append")
        .format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
