"""Records, notes, ledgers and image catalogues from files."""

from __future__ import annotations

import io
import os
import tarfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions.paths import EXTENSIONS, image_role
from siftmill.operators.records import first_rows, parse_records
from siftmill.session import numbered

NOTE = "knowledge_id string, title string, organization string, url string, topics array<string>, summary_zh string, analysis_methods array<string>, limitations string"
LEDGER = "file_name string, sha256 string, imported_at string, slide_count int, record_count int, image_count int, records array<struct<dn_no:string,slide:int,images:array<struct<image_type:string,file_name:string>>>>"


def write_tar(files: DataFrame, path: str) -> int:
    """Write ``files(name, content)`` as one archive on the driver's file system and return how many there were: one row at a time
    goes to the driver, in order of name, and the archive gets its name only when it is whole."""
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    n = 0
    try:
        with tarfile.open(part, "w") as tar:
            for row in files.select("name", "content").orderBy("name").toLocalIterator():
                entry = tarfile.TarInfo(row["name"])
                entry.size = len(row["content"] or b"")
                tar.addfile(entry, io.BytesIO(bytes(row["content"] or b"")))
                n += 1
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return n


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that are objects; blank and broken ones are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole file that is one array; a broken one gives no rows."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; each file begins with a byte-order mark, as spreadsheets expect of UTF-8: it stands before the first
    column's name, and readers of ``read_texts`` take it off."""
    first, *rest = rows.columns
    rows.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def read_texts(spark: SparkSession, path: str, imported: DataFrame | None = None) -> DataFrame:
    """Records of a CSV of notes: column ``TEXT``, else the first; parsed, called ``local-n`` by their place among the texts that
    aren't NULL. Of records of one number the last counts. ``imported(record_id, ...)`` replaces rows of the same id."""
    rows = spark.read.option("ignoreLeadingWhiteSpace", "false").csv(path, header=True, multiLine=True, escape='"')
    rows = rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])
    column = "TEXT" if "TEXT" in rows.columns else rows.columns[0]
    texts = numbered(rows.select(F.col(f"`{column}`").alias("text_content")).where("text_content is not null"), "ord")
    records = parse_records(texts, "text_content").withColumn("record_id", F.coalesce("dn_no", F.concat(F.lit("local-"), F.col("ord").cast("string"))))
    last = first_rows(records, ["record_id"], [F.desc("ord")])
    if imported is None:
        return last
    return last.join(imported.select("record_id").distinct(), "record_id", "left_anti").unionByName(imported, allowMissingColumns=True)


def choose_table(spark: SparkSession, wanted: str, other: str, strict: bool = False) -> str:
    """The wanted table where it exists, else the other; with ``strict`` a missing one is refused."""
    if spark.catalog.tableExists(wanted):
        return wanted
    if strict:
        raise ValueError(f"no table {wanted}")
    return other


def first_folder(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of some folders that exists, on whatever file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        files = path.getFileSystem(conf)
        if files.exists(path) and files.getFileStatus(path).isDirectory():
            return p
    return None


def image_catalogue(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """``(dn_no, file_name, image_type, path, size)`` of image files in the folders of records; contents aren't read. ``only`` names
    records, whose folders alone are listed."""
    paths = [f"{root}/{dn}" for dn in only] if only else [root]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length")
    parts = raw.select(F.regexp_extract("path", r"/(DN-[^/]+)/[^/]+$", 1).alias("dn_no"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "path", F.col("length").alias("size"))
    kind = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    return parts.where((F.col("dn_no") != "") & kind.isin(*EXTENSIONS)).select(F.upper("dn_no").alias("dn_no"), "file_name", image_role(F.col("file_name")).alias("image_type"), "path", "size")


def catalogue_signature(catalogue: DataFrame, *versions: str) -> DataFrame:
    """``(signature)``: one row, a digest of all names and sizes and of the versions given; what is cached under it is up to date.
    The order-free sum of row hashes needs no list of the files."""
    return catalogue.agg(F.sha1(F.concat_ws("|", F.sum(F.xxhash64("dn_no", "file_name", "size").cast("decimal(38,0)")).cast("string"), F.count("*").cast("string"), *[F.lit(v) for v in versions])).alias("signature"))
