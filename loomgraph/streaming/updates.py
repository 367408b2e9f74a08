"""An extension beside the batch operators: edge rows that arrive as a stream are appended to the edge table.

Each micro-batch is written once: its id is part of the path, so a batch that is run again overwrites itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_edges(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
