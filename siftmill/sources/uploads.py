"""Uploaded files: what they are and how many are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# First bytes of the kinds of file that are taken, in hexadecimal digits.
MAGIC = (("png", "89504e470d0a1a0a"), ("jpeg", "ffd8ff"), ("bmp", "424d"), ("tiff", "49492a00"), ("tiff", "4d4d002a"), ("pptx", "504b0304"))
# Files, bytes of one image, of one deck, and of all together in a request.
MAX_FILES, MAX_IMAGE, MAX_DECK, MAX_TOTAL = 30, 20 << 20, 100 << 20, 200 << 20


def sniff(content: Column) -> Column:
    """Kind of a file by its first bytes; NULL if none fits."""
    head = F.lower(F.hex(F.substring(content, 1, 12)))
    kinds = [F.when(head.startswith(m), F.lit(k)) for k, m in MAGIC]
    webp = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), F.lit("webp"))
    return F.coalesce(*kinds, webp)


def decode_data_url(text: Column) -> Column:
    """Bytes of base64 text with or without a data-URL prefix; NULL if it isn't valid."""
    return F.try_to_binary(F.regexp_replace(text, r"^data:[^,]*,", ""), F.lit("base64"))


def accept(files: DataFrame, request: list[str], order: str, size: str, total: int = MAX_TOTAL, count: int = MAX_FILES) -> DataFrame:
    """``files`` with the running sum of sizes in each request and whether the file is still within the limits."""
    w = W.partitionBy(*request).orderBy(order)
    running = F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))
    return files.withColumn("running", running).withColumn("accepted", (F.col("running") <= total) & (F.row_number().over(w) <= count))
