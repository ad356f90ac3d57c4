"""Incremental collection: result documents or events as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_per_key(events: DataFrame, key: str, order: str, late: str = "1 hour") -> DataFrame:
    """Streaming or batch: rows without repeats of the key within the watermark."""
    if events.isStreaming:
        return events.withWatermark(order, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def windowed_counts(events: DataFrame, time: str, width: str, by: str) -> DataFrame:
    """Counts and sums in tumbling windows, for both kinds of frame."""
    w = F.window(time, width)
    return events.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def collect_files(spark: SparkSession, path: str, schema: str, target: str, checkpoint: str):
    """Appends new summary files below path to a Parquet table once each, and stops when none is left."""
    raw = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "summary.json").text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", schema).alias("doc")).select("doc.*")
    return parsed.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
