"""Run files as they arrive.

A run file is complete when it appears and all state of the features is per file, so the
features of a new file never depend on an earlier micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from sunledger.operators.features import LOOKBACK, POA_THRESHOLD, add_features
from sunledger.sources.telemetry import downcast, wall_clock


def read_arrivals(spark: SparkSession, data_dir: str, schema: T.StructType,
                  pattern: str = "*_noisy.parquet", files_per_batch: int = 1000) -> DataFrame:
    """A stream of raw rows, keyed by ``source_file`` and ``row_index``."""
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
              .option("maxFilesPerTrigger", files_per_batch).parquet(data_dir))
    return stream.select("*", F.col("_metadata.file_name").alias("source_file"),
                         F.col("_metadata.row_index").alias("row_index"))


def feature_stream(stream: DataFrame, array_kwp: float | None, sink: Callable, checkpoint: str,
                   threshold: float = POA_THRESHOLD, lookback: int = LOOKBACK) -> StreamingQuery:
    """Feature every micro-batch of whole files and pass it to ``sink(df, batch_id)``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        sink(add_features(downcast(wall_clock(batch)), array_kwp, threshold, lookback), batch_id)

    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def append_features(path: str) -> Callable:
    """A sink that writes each micro-batch once: a repeated batch replaces its own folder."""
    def sink(features: DataFrame, batch_id: int) -> None:
        features.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return sink
