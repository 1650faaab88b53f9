"""Extension: candidates for left entities that arrive as a stream, against a static target index (no state)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftlink.operators.blocking import BlockingConfig, candidates


def stream_candidates(arrivals: DataFrame, targets: DataFrame, path: str, checkpoint: str, config: BlockingConfig = BlockingConfig()) -> StreamingQuery:
    """Each micro-batch is matched like a batch and written under its own number, so a repeated batch replaces itself."""

    def match(batch: DataFrame, number: int) -> None:
        candidates(batch, targets, config).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arrivals.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
