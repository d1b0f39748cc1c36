"""Audit of requests: a stream of JSON lines, its rates, and what may be deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "time timestamp, request_id string, client_id string, direct_ip string, forwarded_for string, method string, path string, status_code int, elapsed_ms double, content_length bigint, user_agent string, error_type string"
SHORT, LONG = 128, 512


def trimmed(events: DataFrame) -> DataFrame:
    """Header values cut to size; a request without an id gets one."""
    short = {c: F.substring(c, 1, SHORT) for c in ("client_id", "direct_ip", "request_id") if c in events.columns}
    long = {c: F.substring(c, 1, LONG) for c in ("forwarded_for", "user_agent") if c in events.columns}
    return events.withColumns(short | long).withColumn("request_id", F.coalesce("request_id", F.uuid())).withColumn("day", F.to_date("time"))


def rates(events: DataFrame, size: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Requests, errors and mean time of each window and path; late events are taken up to ``lateness``."""
    own = events.withWatermark("time", lateness) if events.isStreaming else events
    out = own.groupBy(F.window("time", size).alias("w"), "path").agg(F.count("*").alias("n"), F.count_if(F.col("status_code") >= 500).alias("errors"), F.avg("elapsed_ms").alias("mean_ms"))
    return out.select(F.col("w.start").alias("start"), "path", "n", "errors", "mean_ms")


def keep_log(spark: SparkSession, source: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the events of a folder to a log partitioned by day."""
    events = trimmed(spark.readStream.schema(EVENT).json(source))
    return events.writeStream.partitionBy("day").format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expired_days(log: DataFrame, days: int = 30) -> DataFrame:
    """Days of the log that are older than may be kept, by its own newest day; only partition values are read."""
    newest = log.agg(F.max("day").alias("d"))
    return log.select("day").distinct().join(F.broadcast(newest), F.col("day") < F.date_sub("d", days)).select("day")  # one row
