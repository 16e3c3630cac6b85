"""The bounded ordered pipeline as a stream.

Files arrive in order; ``maxFilesPerTrigger`` is the backpressure, a micro-batch one
submission, ``foreachBatch`` the consumer that takes them in order, ``availableNow``
closes intake and drains.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def drain(spark: SparkSession, path: str, schema, work: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, files: int = 1) -> DataFrame:
    """Run ``work`` on every micro-batch of Parquet files (a glob) and return all that it appended to ``table``."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)

    def take(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure replaces its own folder
        work(batch).withColumn("sequence", F.lit(number)).write.mode("overwrite").parquet(f"{table}/sequence={number}")

    query = source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(table)


def ewma_stream(events: DataFrame, key: str, value: str) -> DataFrame:
    """Whole-number moving average of each key as keyed state: (key, ewma, seen) after each micro-batch."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        average, seen = state.get if state.exists else (None, 0)
        for frame in frames:
            for x in frame.sort_values("seq")[value].tolist():
                average, seen = (x if average is None else (7 * average + x) // 8), seen + 1
        state.update((average, seen))
        yield pd.DataFrame({key: [k[0]], "ewma": [average], "seen": [seen]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} long, ewma long, seen long", "ewma long, seen long", "update", GroupStateTimeout.NoTimeout)


def watermarked_counts(events: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Events by tumbling window of their own time; what is later than ``late`` is left out."""
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).groupBy(F.window("_t", width)).count()
