"""Bars of an event stream, kept up incrementally.

Prints arrive as rows with a time; tumbling windows make bars, and a watermark
lets late rows in for a while before a bar is final and its state is dropped.
State is one row for each symbol and open window, whatever the input's size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.sources.scratch import shared_folder


def stream_bars(prints: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Bars (symbol, start, open, high, low, close, volume, prints) of a stream (symbol, ts, order, price, quantity)."""
    at = F.struct("ts", "order")
    bars = prints.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("quantity").alias("volume"), F.count("*").alias("prints"),
    )
    return bars.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "prints")


def drain(bars: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all input there is, append its final bars to a table, and return the table."""
    run = f"{folder.rstrip('/')}/bars-{uuid.uuid4().hex}"
    query = bars.writeStream.format("parquet").option("path", f"{run}/table").option("checkpointLocation", f"{run}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return bars.sparkSession.read.schema(bars.schema).parquet(f"{run}/table")


def event_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a folder as a stream of prints, by type."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    return events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("order"), F.col("value").alias("price"), F.lit(1.0).alias("quantity"))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(stream_bars(event_prints(spark, sf_dir)), shared_folder(spark)).withColumn("start", F.col("start").cast("timestamp_ntz"))
