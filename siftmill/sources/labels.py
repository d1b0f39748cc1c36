"""Labelled images from delimited files and directory listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions.text import is_missing


def read_labels(spark: SparkSession, path: str, sep: str = ";", image: str = "image_path", label: str = "label") -> DataFrame:
    """All columns as text; rows without an image or a label are left out, labels trimmed. A file without these columns
    is refused. Quotes inside quoted values are doubled; a backslash is a character like others."""
    rows = spark.read.csv(path, sep=sep, header=True, inferSchema=False, multiLine=True, escape='"')
    if lacking := {image, label} - set(rows.columns):
        raise ValueError(f"columns missing: {sorted(lacking)}")
    return rows.where(~is_missing(F.col(image)) & ~is_missing(F.col(label))).withColumn(label, F.trim(label))


def manifest(records: DataFrame, files: DataFrame, key: str, name: str) -> DataFrame:
    """``(key, status, name)``: of each record its file (of several the first by name) or that there is none."""
    first = files.groupBy(key).agg(F.min(name).alias(name))
    return records.join(first, key, "left").select(key, F.when(F.col(name).isNull(), "skipped_missing_image").otherwise("included").alias("status"), name)


def preferred(files: DataFrame, folder: str, stem: str, wanted: str) -> DataFrame:
    """Of each folder the files of the wanted stem (whatever the case), or all of them where it has none."""
    mark = files.withColumn("__w", F.lower(stem) == wanted.lower())
    some = mark.where("__w").select(folder).distinct()
    return mark.where("__w").drop("__w").unionByName(mark.join(some, folder, "left_anti").drop("__w"))
