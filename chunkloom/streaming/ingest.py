"""Streams: windowed counts with late data, and listings without repetition.

Every function runs over what is available and ends; called again with the same
checkpoint it goes on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.operators.compaction import readable_source, stored
from chunkloom.session import fresh_path


def window_counts(stream: DataFrame, when: str, key: str, value: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """``window_start, key, n_events, total`` of tumbling or sliding windows."""
    w = F.window(when, size, slide) if slide else F.window(when, size)
    out = stream.withWatermark(when, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n_events"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n_events", "total")


def sessions(stream: DataFrame, when: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """``key, session_start, session_end, n_events`` of runs without a longer pause."""
    out = stream.withWatermark(when, late).groupBy(F.session_window(when, gap).alias("w"), key).agg(F.count("*").alias("n_events"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def first_deliveries(stream: DataFrame, keys: list[str], when: str, late: str = "1 hour") -> DataFrame:
    """Rows without repetitions that follow within the time allowed for late data."""
    return stream.withWatermark(when, late).dropDuplicatesWithinWatermark(keys)


def run_available(spark: SparkSession, source: str, schema: T.StructType, shape, mode: str = "complete", out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over the Parquet files of ``source`` and returns its table.

    In complete mode each batch replaces the table (aggregates are small); otherwise
    each batch is kept under its number, so a retried batch replaces itself.
    """
    out, checkpoint = out or fresh_path(spark, "stream"), checkpoint or fresh_path(spark, "progress")
    shaped = shape(spark.readStream.schema(schema).parquet(readable_source(spark, source)))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out + ("/table" if mode == "complete" else f"/batch={number:012d}"))

    query = shaped.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stored(spark, out, shaped.schema)
