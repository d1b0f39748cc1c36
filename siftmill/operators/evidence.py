"""Evidence for a report: hits of several searches made one list, compacted and summed up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.functions.text import is_missing, present

# Fields that may be shown to the language model, and sizes of its input.
SHOWN = (
    "dn_no", "class_type", "lot_id", "product_id", "platform", "station", "machine", "scan_time", "total_wafers", "bad_wafers", "defect_type", "edx_elements",
    "edx_bg", "map_location", "dft_location",
)
MAX_ROWS, MAX_TEXT = 20, 180


def merge_evidence(hits: DataFrame, fields: Sequence[str], limit: int = MAX_ROWS) -> DataFrame:
    """``(record_id, score, sources, place, *fields)``: one row a record of ``hits(source, source_ord, row_ord, record_id, score, ...)``.

    The highest score, of each field the first value that isn't missing, the sources in order without repeats. Records
    come in the order they are first met; the first ``limit`` are kept. Hits without a record id are left out.
    """
    at = F.struct("source_ord", "row_ord")
    firsts = [F.min_by(F.col(f), F.when(~is_missing(F.col(f).cast("string")), at)).alias(f) for f in fields]
    met = F.sort_array(F.collect_set(F.struct("source_ord", "source")))
    rows = hits.where(~is_missing(F.col("record_id").cast("string"))).groupBy("record_id").agg(F.max("score").alias("score"), met.alias("__m"), F.min(at).alias("__at"), *firsts)
    rows = rows.withColumn("sources", F.array_distinct(F.transform("__m", lambda m: m["source"])))
    return rows.orderBy("__at", "record_id").limit(limit).select("record_id", "score", "sources", F.col("__at.source_ord").alias("source_ord"), F.col("__at.row_ord").alias("row_ord"), *fields)


def compact(rows: DataFrame, order: Sequence[str], text: str = "text_content", limit: int = MAX_ROWS) -> DataFrame:
    """The first rows with shown fields only: placeholders NULL, score to four places, the text's first characters."""
    kept = rows.orderBy(*order).limit(limit)
    out = [present(F.col(f)).alias(f) if dict(rows.dtypes)[f] == "string" else F.col(f) for f in SHOWN if f in rows.columns]
    score = [F.round("score", 4).alias("score")] if "score" in rows.columns else []
    return kept.select(*[c for c in order if c not in SHOWN], *out, *score, F.substring(F.coalesce(F.col(text), F.lit("")), 1, MAX_TEXT).alias("description"))


def knowledge_query(rows: DataFrame, query: str, context: str, order: str, fields: Sequence[str], limit: int = 10, size: int = 2000) -> DataFrame:
    """``(text)``: one row with the query, its context and the values of the first rows' fields, cut to ``size``."""
    first = rows.orderBy(order).limit(limit)
    line = F.concat_ws(" ", *[present(F.col(f)) for f in fields])
    told = first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda x: x["t"]), " ").alias("t"))
    return told.select(F.substring(F.concat_ws(" ", F.lit(query), F.lit(context), "t"), 1, size).alias("text"))


def document_text(notes: DataFrame) -> DataFrame:
    """``(knowledge_id, document_text)`` of knowledge notes: six parts, one a line; lists joined."""
    parts = ["title", "organization", F.array_join("topics", " "), "summary_zh", F.array_join("analysis_methods", "；"), "limitations"]
    return notes.select("knowledge_id", F.concat_ws("\n", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]).alias("document_text"))
