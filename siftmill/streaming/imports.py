"""Incremental import: each file content once, records upserted by number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftmill.operators.records import new_imports, slide_record
from siftmill.operators.tables import save, stored
from siftmill.sources.pptx import read_slides, slide_lines

BINARY = "path string, modificationTime timestamp, length long, content binary"


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The records kept by ``import_decks``."""
    kept = stored(spark, path)
    return None if kept is None else kept.drop("bucket")


def records_of(decks: DataFrame) -> DataFrame:
    """Records of ``decks(file_name, sha256, content)``, one a slide."""
    lines = slide_lines(read_slides(decks.select(F.col("file_name").alias("file"), "sha256", "content")))
    return lines.select("sha256", "file", "slide", *[c.alias(f) for f, c in slide_record(F.col("lines"), F.col("file"), F.col("slide")).items()])


def import_batch(spark: SparkSession, decks: DataFrame, ledger: str, records: str, epoch: int) -> DataFrame:
    """Import those of ``decks`` whose content the ledger lacks and return their records. A batch that runs again changes
    nothing more."""
    known = stored(spark, ledger)
    empty = spark.createDataFrame([], "sha256 string, file_name string, imported_at timestamp")
    fresh = new_imports(known.where(F.col("epoch") != epoch) if known is not None else empty, decks, "sha256")
    made = records_of(fresh)
    first = made.groupBy("dn_no").agg(F.min_by(F.struct(*[c for c in made.columns if c != "dn_no"]), F.struct("file", "slide")).alias("r")).select("dn_no", "r.*")
    saved = save(first, records, "dn_no")
    fresh.select("sha256", "file_name", F.current_timestamp().alias("imported_at")).write.mode("overwrite").parquet(f"{ledger}/epoch={epoch}")
    return saved


def import_decks(spark: SparkSession, folder: str, ledger: str, records: str, checkpoint: str, after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """A stream over the decks of a folder; ``after`` gets the records of each batch, to bring only these up to date elsewhere."""
    decks = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.pptx").load(folder)

    def each(batch: DataFrame, epoch: int) -> None:
        files = batch.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.sha2("content", 256).alias("sha256"), "content")
        saved = import_batch(batch.sparkSession, files, ledger, records, epoch)
        if after is not None:
            after(saved)

    return decks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
