"""Queries of the general data operators: drifting schemas and mixed times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators import drift, timestamps
from siftmill.plans.tables import table
from siftmill.session import materialise, table_path


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "payload_files"))


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "payload_files")
    return drift.unify(lines, materialise(drift.schema_changes(lines), "changes"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ppt_import").select("import_id", "scan_time", "site")
    told = timestamps.normalise_times(rows, table(spark, d, "sites"), "scan_time", "site", "utc").where(F.col("utc").isNotNull())
    return told.select("import_id", F.substring(F.col("utc").cast("string"), 1, 19).alias("scan_utc"))


def p6_twice(spark: SparkSession, d: str) -> DataFrame:
    """``(run, n_parsed, n_told)``: two runs over all slides with one kept dictionary; the second has nothing left to parse."""
    rows, path = table(spark, d, "ppt_import").select("import_id", "scan_time", "site"), table_path(spark, "kept_times")
    out, before = [], 0
    for run in (1, 2):
        told = timestamps.normalise_times(rows, table(spark, d, "sites"), "scan_time", "site", "utc", path).agg(F.count("utc").alias("n")).first()["n"]
        held = spark.read.parquet(path).count()
        out.append((run, held - before, told))
        before = held
    return spark.createDataFrame(out, "run int, n_parsed bigint, n_told bigint")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_unified, p6_found, p6_twice)}
ORACLES: dict[str, str] = {}
