"""Tables that are kept: entities, notes, and results shown on a console."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions.ids import uuid5
from siftmill.functions.text import present
from siftmill.operators.evidence import document_text
from siftmill.operators.records import best_rows, upsert
from siftmill.session import materialise

# What fields are called on the console.
LABELS = {
    "dn_no": "DN编号", "class_type": "类型", "lot_id": "LotID", "product_id": "产品编号", "platform": "平台", "station": "站点",
    "machine": "扫描机器", "scan_time": "扫描时间", "total_wafers": "Wafer总数", "scanned_wafers": "已扫描Wafer数", "bad_wafers": "坏Wafer数",
    "defect_type": "缺陷类型", "edx_elements": "EDX元素", "edx_bg": "EDX背景", "map_location": "Map位置", "dft_location": "DFT位置",
}
ENTITY = "point_id string, dn_no string, text_content string, images array<struct<image_type:string,file_name:string,storage_key:string,url:string>>, text_chunks array<array<float>>, sem array<array<float>>, binmap array<array<float>>, content_hash string, schema_version int, updated_at timestamp"


def create_entities(spark: SparkSession, name: str, buckets: int = 64, recreate: bool = False) -> None:
    """A table of entities, bucketed and sorted by record number so that joins and look-ups on it need no shuffle."""
    if recreate:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ENTITY}) USING parquet CLUSTERED BY (dn_no) SORTED BY (dn_no) INTO {buckets} BUCKETS")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A kept table; None if there is none yet. Other faults are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def save(rows: DataFrame, path: str, key: str, buckets: int = 64) -> DataFrame:
    """Upsert ``rows`` (unique by ``key``) into the table kept at ``path`` and return them.

    The table lies in buckets by hash of the key; only buckets that hold one of the keys are read and written anew, each
    replaced whole when the job commits. What runs again changes nothing more.
    """
    spark = rows.sparkSession
    new = materialise(rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "saved")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # ``buckets`` at most
    if not touched:
        return new.drop("bucket")
    old = stored(spark, path)
    merged = new if old is None else materialise(upsert(old.where(F.col("bucket").isin(touched)), new, [key]), "merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return new.drop("bucket")


def knowledge_points(notes: DataFrame) -> DataFrame:
    """Notes with their id, their text for embedding, and where they come from."""
    texts = document_text(notes)
    return notes.join(texts, "knowledge_id").select(uuid5(F.concat(F.lit("knowledge:"), "knowledge_id")).alias("point_id"), "*", F.lit("analysis_knowledge").alias("source_type"))


def served_id(id_: Column) -> Column:
    """The id a result is served under; ``UNKNOWN`` without one."""
    return F.coalesce(present(id_), F.lit("UNKNOWN"))


def served_score(score: Column, compat: bool = False) -> Column:
    """The score a result is served with: NULL is 0. With ``compat`` both NULL and 0 are 1, as they once were."""
    plain = F.coalesce(score.cast("double"), F.lit(0.0))
    return F.when(plain == 0, F.lit(1.0)).otherwise(plain) if compat else plain


def result_table(hits: DataFrame, key: str, score: str, order: str, fields: Sequence[str] = tuple(LABELS)) -> DataFrame:
    """One row a record with its best score, highest first, fields under their labels, missing ones as 未知."""
    best = best_rows(hits, [key], score, order).orderBy(F.desc(F.coalesce(F.col(score), F.lit(1.0))), key)
    shown = [F.coalesce(present(F.col(f).cast("string")), F.lit("未知")).alias(LABELS[f]) for f in fields if f in hits.columns]
    return best.select(key, F.coalesce(F.col(score), F.lit(1.0)).alias(score), *shown)
