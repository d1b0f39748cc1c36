"""JSON objects found in the answers of language models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_json(raw: Column) -> Column:
    """The object in a raw answer as JSON text; NULL if there is none.

    Thoughts in think tags and code fences are dropped; if the rest is no JSON, what lies between the first
    opening and the last closing brace is tried. Arrays and plain values are no objects.
    """
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?is)<think>.*?</think>", "")
    bare = F.trim(F.regexp_replace(bare, r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    inner = F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))
    whole = F.try_parse_json(bare)
    # Something that is JSON already isn't searched further.
    text = F.when(whole.isNotNull(), bare).otherwise(inner)
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text)
