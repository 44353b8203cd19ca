"""Pages and events as they arrive: each once, and counted by windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(rows: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark, by any of its rows; state older than that is dropped, and so are rows that come later."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def earliest(rows: DataFrame, keys: list[str], order: str, folder: str) -> DataFrame:
    """The least ``order`` of each key over all that a stream has now, as ``(keys, order)``; no row is too late, however rows are dealt over files and batches.

    Each batch is reduced by itself and stored in a part of ``folder``, which all executors have to share, and the parts are reduced
    again when they are read: no state is held for a key, and a batch that is run again replaces its part.  Null keys are one; an order
    that is null counts only where a key has no other.
    """
    own, parts = f"{folder}/earliest-{uuid.uuid4().hex}", {}
    least = lambda df: df.groupBy(*keys).agg(F.min(order).alias(order))

    def store(df: DataFrame, batch: int) -> None:
        parts[batch] = f"{own}/rows/{batch}"
        least(df).write.mode("overwrite").parquet(parts[batch])

    rows = rows.select(*keys, order)
    rows.writeStream.foreachBatch(store).option("checkpointLocation", f"{own}/state").trigger(availableNow=True).start().awaitTermination()
    spark = rows.sparkSession
    return least(spark.read.schema(rows.schema).parquet(*parts.values()) if parts else spark.createDataFrame([], rows.schema))


def windowed(rows: DataFrame, time: str, keys: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of ``value`` by tumbling window and key; works on a table as well as on a stream."""
    timed = rows.withWatermark(time, late) if rows.isStreaming else rows
    return timed.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")
