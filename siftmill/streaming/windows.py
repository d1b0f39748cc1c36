"""Windows over events; the same functions serve batch tables and streams (with a watermark)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, ts: str, lateness: str | None) -> DataFrame:
    return events.withWatermark(ts, lateness) if lateness and events.isStreaming else events


def _measure(grouped, value: str) -> DataFrame:
    return grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).withColumns({"start": F.col("__w.start"), "end": F.col("__w.end")}).drop("__w")


def tumbling(events: DataFrame, ts: str, size: str, by: Sequence[str], value: str, lateness: str | None = None) -> DataFrame:
    return _measure(_late(events, ts, lateness).groupBy(F.window(ts, size).alias("__w"), *by), value)


def sliding(events: DataFrame, ts: str, size: str, step: str, by: Sequence[str], value: str, lateness: str | None = None) -> DataFrame:
    return _measure(_late(events, ts, lateness).groupBy(F.window(ts, size, step).alias("__w"), *by), value)


def sessions(events: DataFrame, ts: str, gap: str, by: Sequence[str], lateness: str | None = None) -> DataFrame:
    grouped = _late(events, ts, lateness).groupBy(F.session_window(ts, gap).alias("__w"), *by)
    return grouped.agg(F.count("*").alias("n")).withColumns({"start": F.col("__w.start"), "end": F.col("__w.end")}).drop("__w")
