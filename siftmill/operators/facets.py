"""Filters, facets and look-ups over records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftmill.functions.text import fold_code, is_missing, present, strip

# Fields that may be filtered on, and fields charted in a report.
FILTER_FIELDS = ("lot_id", "machine", "station", "platform", "defect_type", "map_location", "dft_location", "product_id")
CHART_FIELDS = ("defect_type", "platform", "product_id", "machine", "station", "map_location")
ANALYSIS_FIELDS = ("defect_type", "platform", "product_id", "machine", "lot_id", "station", "map_location", "dft_location")
# Signs and blanks that equality after normalisation ignores (on folded text).
IGNORED = r"[\s:=,。;()\[\]{}]"


def clean_filters(raw: Mapping[str, Sequence[str] | str]) -> dict[str, list[str]]:
    """Known fields only; single values as lists, trimmed, empty ones dropped, equal ones (in any case) once."""
    out: dict[str, list[str]] = {}
    for field in FILTER_FIELDS:
        values = raw.get(field) or []
        seen: dict[str, str] = {}
        for v in [values] if isinstance(values, str) else values:
            if text := str(v).strip():
                seen.setdefault(text.casefold(), text)
        if seen:
            out[field] = list(seen.values())
    return out


def any_of_each(filters: Mapping[str, Sequence[str]]) -> Column:
    """Or within a field, and between fields; trimmed, whatever the case. A field without values filters nothing."""
    tests = [F.lower(F.trim(F.coalesce(F.col(f).cast("string"), F.lit("")))).isin(*[v.strip().lower() for v in vs]) for f, vs in filters.items() if vs]
    return reduce(and_, tests, F.lit(True))


def exactly(conditions: Mapping[str, str]) -> Column:
    """Equality on every field, case and all: what a storage filter can take."""
    return reduce(and_, [F.col(f) == v for f, v in conditions.items()], F.lit(True))


def equal_any_case(conditions: Mapping[str, str]) -> Column:
    return reduce(and_, [F.lower(F.trim(F.col(f))) == v.strip().lower() for f, v in conditions.items()], F.lit(True))


def squeezed(value: Column) -> Column:
    return F.lower(F.regexp_replace(fold_code(F.coalesce(value, F.lit(""))), IGNORED, ""))


def equal_squeezed(conditions: Mapping[str, str]) -> Column:
    """Equality once signs, blanks, width and case are taken away."""
    return reduce(and_, [squeezed(F.col(f)) == squeezed(F.lit(v)) for f, v in conditions.items()], F.lit(True))


def exact_or_squeezed(rows: DataFrame, conditions: Mapping[str, str], key: str, order: str, limit: int) -> DataFrame:
    """Rows that meet the conditions exactly; only if there are none, the first row of each key that meets them
    squeezed. At most ``limit``, in order."""
    hits = rows.where(exactly(conditions)).withColumn("match_mode", F.lit("exact"))
    none = hits.limit(1).agg(F.count("*").alias("__n"))
    loose = rows.where(equal_squeezed(conditions)).withColumn("match_mode", F.lit("normalized"))
    first = loose.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(order))).where("__r = 1").drop("__r")
    loose = first.crossJoin(F.broadcast(none)).where("__n = 0").drop("__n")  # one row
    return hits.unionByName(loose).orderBy(order).limit(limit)


def contains_keyword(fields: Sequence[str], keyword: str) -> Column:
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))
    return text.contains(keyword.strip().lower())


def _long(rows: DataFrame, fields: Sequence[str], keep: Sequence[str | Column] = ()) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return rows.select(*keep, cells.alias("__c")).select("*", "__c.field", "__c.value").drop("__c")


def facet_counts(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(field, value, n)`` of each value that isn't missing."""
    return _long(rows, fields).where(~is_missing(F.col("value"))).groupBy("field", "value").agg(F.count("*").alias("n"))


def facet_values(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    return facet_counts(rows, fields).select("field", "value")


def facet_options(rows: DataFrame, field: str, keyword: str, limit: int = 50) -> DataFrame:
    """Values of a field that hold the keyword, in order, for a search box."""
    return facet_values(rows, [field]).where(F.lower("value").contains(keyword.lower())).select("value").orderBy("value").limit(limit)


def canonical_value(rows: DataFrame, field: str, typed: Sequence[str]) -> DataFrame:
    """``(typed, value)``: for each typed value the spelling the data uses; of several the least."""
    asked = rows.sparkSession.createDataFrame([(t,) for t in typed], "typed string")
    known = facet_values(rows, [field]).groupBy(F.lower(F.trim("value")).alias("k")).agg(F.min("value").alias("value"))
    return known.join(F.broadcast(asked), F.col("k") == F.lower(F.trim("typed"))).select("typed", "value")  # a handful typed


def top_values(rows: DataFrame, fields: Sequence[str], order: str, k: int = 8) -> DataFrame:
    """``(field, value, n, place)``: the k most frequent values of each field, of equals the one that comes first."""
    counts = _long(rows, fields, [order]).where(~is_missing(F.col("value"))).groupBy("field", "value").agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    place = F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), "__first"))
    return counts.withColumn("place", place).where(F.col("place") <= k).select("field", "value", "n", "place")


def dominant_by_weight(ranked: DataFrame, fields: Sequence[str], score: str, rank: str, evidence: int = 20) -> DataFrame:
    """``(field, dominant_value)`` of the first ``evidence`` rows: greatest sum of positive scores, then count, then value."""
    part = _long(ranked.where(F.col(rank) <= min(max(evidence, 1), 50)), fields, [F.col(score).alias("__s")]).where(~is_missing(F.col("value")) & (F.col("value") != "0"))
    sums = part.groupBy("field", "value").agg(F.sum(F.greatest("__s", F.lit(0.0))).alias("w"), F.count("*").alias("n"))
    return sums.groupBy("field").agg(F.max_by("value", F.struct(F.round("w", 9), "n", "value")).alias("dominant_value"))


def dominant_by_count(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(field, dominant_value)``: most rows, then the least value."""
    return facet_counts(rows, fields).groupBy("field").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("dominant_value"))


def similar_records(rows: DataFrame, key: str, source: str, by: str = "combined") -> DataFrame:
    """``(key, score)`` of records like the one called ``source``: 1.0 for an equal main value (and, combined, an equal defect),
    0.8 for one with the same beginning (all but two characters). Score, then key, is the order.

    The source is one row; the rest is one scan.
    """
    if by not in ("combined", "platform", "machine", "defect"):
        raise ValueError(by)
    src = rows.where(F.col(key) == source).orderBy(key).limit(1).select("platform", "machine", "defect_type").first()
    if src is None:
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)
    clean = lambda v: None if v is None or v.strip().lower() in ("", "unknown", "未知", "nan", "—") else v
    field = "machine" if by == "platform" and clean(src.machine) else "platform"
    value = clean(src[field]) or ""
    prefix = value[:-2] if len(value) > 2 else value
    if not value:
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)
    same_defect = F.lit(True) if by != "combined" else F.coalesce(F.col("defect_type") == F.lit(src.defect_type), F.lit(False))
    score = F.when((F.col(field) == value) & same_defect, 1.0).when(F.col(field).startswith(prefix), 0.8)
    return rows.where(F.col(key) != source).select(key, score.alias("score")).where("score is not null")


def compare_table(records: DataFrame, key: str, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Fields as rows and up to four records as columns ``r1`` to ``r4``; a missing value is a dash."""
    chosen = list(keys)[:4]
    cells = _long(records.where(F.col(key).isin(*chosen)), fields, [key])
    aggs = [F.coalesce(F.min(F.when(F.col(key) == k, present(F.col("value")))), F.lit("—")).alias(f"r{i + 1}") for i, k in enumerate(chosen)]
    return cells.groupBy("field").agg(*aggs)


def first_spelling(rows: DataFrame, value: str, order: str) -> DataFrame:
    """``(value)``: each value once whatever its case, in the spelling that comes first."""
    some = rows.where(~is_missing(F.col(value)))
    return some.groupBy(F.lower(F.trim(F.col(value))).alias("folded")).agg(F.min_by(F.trim(F.col(value)), order).alias(value))


def candidates(records: DataFrame, file: str, order: str, fields: Sequence[str] = FILTER_FIELDS) -> DataFrame:
    """``(file, field, values)``: what the slides of a file tell of each field, to be offered as filters: each value once whatever its
    case, in the spelling and order in which it first comes; missing ones and 0 not. A file's slides are few."""
    told = _long(records, fields, [file, order]).where(~is_missing(F.col("value"))).withColumn("value", strip(F.col("value"))).where("value <> '0'")
    once = told.groupBy(file, "field", F.lower("value").alias("__k")).agg(F.min(F.struct(F.col(order).alias("o"), F.col("value").alias("v"))).alias("f"))
    return once.groupBy(file, "field").agg(F.transform(F.sort_array(F.collect_list("f")), lambda x: x["v"]).alias("values"))


def union_filters(a: Column, b: Column) -> Column:
    """Two maps of field to values made one, the values of a common field united."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(a, b, lambda _, x, y: F.array_union(F.coalesce(x, none), F.coalesce(y, none)))
