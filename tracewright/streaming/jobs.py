"""Structured Streaming jobs over the event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.plans.scan import running
from tracewright.session import shared_dir


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream; ``ts`` becomes a timestamp so that it can carry a watermark."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return s.select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value",
                    F.get_json_object("props", "$.k").cast("int").alias("k"))


def drained(df: DataFrame, name: str) -> DataFrame:
    """Run the stream over all available data into a Parquet table of the shared folder and read it back."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/stream-{name}-{uuid.uuid4().hex[:8]}"
    q = (df.writeStream.outputMode("append").format("parquet").option("path", f"{base}/data")
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/data")


def repeat_sessions(stream: DataFrame, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """Bursts of one event type of one run: sessions closed by ``gap``; later than ``delay`` is dropped."""
    return (stream.withWatermark("ts", delay).groupBy("run_id", "event_type", F.session_window("ts", gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
            .select("run_id", "event_type", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n", "last_ts"))


def backlog_steps(stream: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Assignments minus deliveries per run and tumbling window."""
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    return (stream.withWatermark("ts", delay).groupBy("run_id", F.window("ts", width).alias("w"))
            .agg(F.sum(F.when(step > 0, 1).otherwise(0)).alias("opened"), F.sum(F.when(step < 0, 1).otherwise(0)).alias("closed"))
            .select("run_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "opened", "closed"))


def backlog_levels(steps: DataFrame) -> DataFrame:
    """Running backlog over the emitted windows of each run (read side)."""
    day = F.floor(F.unix_micros("start_ts") / 86_400_000_000 / 32)
    return running(steps, ["run_id"], ["start_ts"], {"backlog": ("sum", F.col("opened") - F.col("closed"))}, chunk=day)
