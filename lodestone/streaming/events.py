"""Event streams: tumbling daily counts with a watermark, and incremental batches with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, event_type, count, total) per calendar day; a stream drops events later than ``late`` behind the newest."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    total = F.round(F.sum(F.col("value").cast("decimal(20,4)")).cast("double"), 4)
    days = timed.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("count"), total.alias("total"))
    return days.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "count", "total")


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the stream over what there is and returns the last state of each day and type.

    Batches bring the rows that changed, and days behind the watermark leave the state; of each key the newest batch counts.
    """
    out = scratch(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = daily(event_stream(spark, sf_dir)).writeStream.outputMode("update").option("checkpointLocation", f"{out}-state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    newest = spark.read.parquet(out).groupBy("day", "event_type").agg(F.max(F.struct("batch", "count", "total")).alias("_s"))
    return newest.select("day", "event_type", "_s.count", "_s.total")


def incremental_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows since the checkpoint, appended once each; a second run adds nothing."""
    out = scratch(spark, "copy")
    for _ in range(2):
        rows = event_stream(spark, sf_dir).select("event_id", "event_type")
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, count) of runs of events with no longer gap."""
    w = F.session_window(F.col("ts").cast("timestamp"), gap)
    return events.groupBy("user_id", w).agg(F.count(F.lit(1)).alias("count")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "count")
