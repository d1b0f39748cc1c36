"""The requests of the application as functions. Each returns a plan; where one needs statistics or the size of something it
asks for, small jobs run while it is built."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions import asked
from siftmill.operators import evidence, facets, images, records, retrieval


@dataclass
class Found:
    rows: DataFrame
    mode: str
    conditions: dict[str, str]


def health(tables: Mapping[str, DataFrame]) -> dict[str, dict]:
    """Row counts; a table that can't be read is reported, not raised."""
    out: dict[str, dict] = {}
    for name, df in tables.items():
        try:
            out[name] = {"ok": True, "rows": df.count()}
        except Exception as e:  # noqa: BLE001
            out[name] = {"ok": False, "error": str(e).splitlines()[0]}
    return out


def search(corpus: DataFrame, query: str, vectors: DataFrame | None = None, query_vector: Sequence[float] | None = None, filters: Mapping[str, Sequence[str]] | None = None, limit: int = 10, offset: int = 0, index: retrieval.PairIndex | None = None) -> Found:
    """Search ``corpus(record_id, text_content, matched_grains?, fields)``: by fields where the question names them exactly, else by
    words, character pairs and, if given, vectors, fused and reranked; then filters, then the page. A question without
    letters or digits is refused, as are limits beyond 1 to 500 and pages beyond the first ``MAX_RECALL`` hits. ``index`` is the corpus' own,
    kept from one request to the next."""
    if not any(c.isalnum() for c in query or ""):
        raise ValueError("empty question")
    if not 1 <= limit <= 500 or offset < 0 or offset + limit > retrieval.MAX_RECALL:
        raise ValueError("limit out of range")
    spark = corpus.sparkSession
    query = retrieval.asked_for(spark, query)
    found, exact = asked.understand(spark, query)
    known = {f: v for f, v in found.items() if f in corpus.columns}
    keep = facets.any_of_each(filters or {})
    if known and exact:
        hits = facets.exact_or_squeezed(corpus.withColumn("score", F.lit(1.0)), known, "record_id", "record_id", max(offset + limit, 500))
        return Found(retrieval.page_after(hits, "record_id", keep, offset, limit), "exact", found)
    ranked = retrieval.hybrid(corpus, query, known, vectors, query_vector, max(retrieval.RECALL_K, offset + limit), index)
    return Found(retrieval.page_after(ranked.drop("score").withColumnRenamed("final", "score"), "record_id", keep, offset, limit), "hybrid", found)


def explain(spark: SparkSession, query: str) -> dict:
    found, exact = asked.understand(spark, query)
    return {"conditions": found, "mode": "exact" if exact else "hybrid"}


def refresh(spark: SparkSession, tables: Sequence[str]) -> None:
    """Forget what is cached of tables that were written anew."""
    for name in tables:
        spark.catalog.refreshTable(name)


def facet_counts(rows: DataFrame) -> DataFrame:
    """``(field, value, n)`` of the fields that may be filtered on, the most frequent values first."""
    return facets.facet_counts(rows, [f for f in facets.FILTER_FIELDS if f in rows.columns]).orderBy("field", F.desc("n"), "value")


def filters(rows: DataFrame) -> DataFrame:
    return facets.facet_values(rows, [f for f in facets.FILTER_FIELDS if f in rows.columns]).orderBy("field", "value")


def record(rows: DataFrame, images_: DataFrame, dn_no: str) -> DataFrame:
    """One row: the record of a number and its images in order of display; none where there are no images. ``rows`` and
    ``images_(dn_no, image_type, file_name)``; a record without a row has a stub."""
    return records.with_images(rows.where(F.upper(F.trim("dn_no")) == dn_no.strip().upper()).limit(1), images_.where(F.upper(F.trim("dn_no")) == dn_no.strip().upper()))


def filter_search(rows: DataFrame, raw: Mapping[str, Sequence[str] | str], limit: int = 100, order: str = "dn_no") -> DataFrame:
    if not 1 <= limit <= 5000:
        raise ValueError("limit out of range")
    return rows.where(facets.any_of_each(facets.clean_filters(raw))).orderBy(order).limit(limit)


def similar(rows: DataFrame, key: str, source: str, by: str = "combined", limit: int = 20) -> DataFrame:
    return facets.similar_records(rows, key, source, by).orderBy(F.desc("score"), key).limit(limit)


def image_search(index: DataFrame, queries: DataFrame, mode: str = "unified", limit: int = 20) -> DataFrame:
    """``(dn_no, score, rank)``. ``index(dn_no, modality, vector)``, ``queries(query_id, query_vector)``; unified takes the best
    kind of image for all queries, local the best image for each query."""
    n = queries.count()
    sims = images.similarities(index, queries, "vector", "query_vector")
    hits = images.max_sim(sims, "dn_no", "modality", "query_id", n) if mode == "unified" else images.max_then_mean(sims, "dn_no", "query_id", n)
    best = hits.select("dn_no", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "dn_no").limit(limit)
    return images.numbered(best, "score", "dn_no")


def report(hits: DataFrame, fields: Sequence[str], chart_fields: Sequence[str] = facets.CHART_FIELDS) -> tuple[DataFrame, DataFrame]:
    """Merged evidence, and the most frequent values of its chart fields."""
    merged = evidence.merge_evidence(hits, fields)
    have = [f for f in chart_fields if f in fields]
    return merged, facets.top_values(merged.withColumn("place_key", F.struct("source_ord", "row_ord", "record_id")), have, "place_key")


def unify(points: DataFrame, images_: DataFrame, vectors: DataFrame) -> DataFrame:
    """One entity a record from points, images and vectors."""
    return records.assemble(records.merge_points(points), records.image_manifest(images_), vectors)
