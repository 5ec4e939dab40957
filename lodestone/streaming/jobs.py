"""File streams: metrics as items arrive, resumable by checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def evaluate_stream(spark: SparkSession, source: str, schema: str, metrics: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 10) -> StreamingQuery:
    """Reads JSON lines as files come, adds row-local metrics, appends JSON; starts again where it ended."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    return metrics(rows).writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_until_complete(start: Callable[[], StreamingQuery], times: int = 3) -> None:
    """Runs a query to its end, again after a failure, a bounded number of times."""
    for attempt in range(times):
        try:
            start().awaitTermination()
            return
        except Exception:
            if attempt == times - 1:
                raise
