"""Records from points: parsing, repair, merging, de-duplication, upserts and manifests.

Every rule that says first, last or latest goes by an explicit order column with unique values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftmill.functions.bind import let
from siftmill.functions.ids import content_hash, normalize_dn
from siftmill.functions.parse import COUNTS, FIELDS, parse_fields
from siftmill.functions.paths import modality, role_order
from siftmill.functions.text import is_missing, present, strip

# Fields that the text chunk about the defect tells.
DEFECT_FIELDS = ("dn_no", "platform", "station", "machine", "defect_type", "edx_elements", "edx_bg", "map_location", "dft_location")
# Keys under which a record's text may stand, in order: the first with a value wins.
TEXT_KEYS = ("text_content", "description", "TEXT", "text", "search_text", "content", "document")
# What fields are called where a record without a text is told in words, and what is said of one without any.
DESCRIBED = {
    "dn_no": "DN编号", "class_type": "类型", "lot_id": "LotID", "product_id": "产品", "platform": "平台", "station": "站点", "machine": "机器", "scan_time": "扫描时间",
    "total_wafers": "Wafer总数", "scanned_wafers": "已扫描Wafer", "bad_wafers": "坏Wafer", "defect_type": "缺陷类型", "edx_elements": "EDX元素", "edx_bg": "EDX背景",
    "map_location": "Map位置", "dft_location": "DFT位置",
}
UNDESCRIBED = "原始记录未保存描述文本。"


def given(column: str, kind: str = "string") -> Column:
    """A field's value or NULL: placeholders are no value, nor is a count of 0 that may be a default."""
    c = F.col(column)
    return F.when(c != 0, c) if column in COUNTS or kind in ("int", "bigint") else present(c)


def record_id(dn_no: Column, rec_id: Column, fallback: Column) -> Column:
    """The record number, else the record id, else the fallback, trimmed; empty if all are missing."""
    return strip(F.coalesce(present(dn_no), present(rec_id), present(fallback), F.lit("")))


def parse_records(rows: DataFrame, text: str, compat: bool = False) -> DataFrame:
    """``rows`` with the 16 fields that ``text`` states; equally named columns are replaced."""
    told = rows.withColumn("__told", parse_fields(F.col(text), compat))
    return told.withColumns({f: F.col("__told")[f] for f in FIELDS}).drop("__told")


def canonicalise(rows: DataFrame) -> DataFrame:
    """Payload rows repaired: the text is the first of the known keys that has a value, missing fields are filled
    from it, the record id is the record number where there is one. Other columns stay as they are. Two keys may differ
    in case only."""
    names = rows.columns
    told = rows.toDF(*[f"c{i}" for i in range(len(names))])
    at = lambda name: F.col(f"c{names.index(name)}")
    text = F.coalesce(*[present(at(k).cast("string")) for k in TEXT_KEYS if k in names], F.lit(None).cast("string"))
    told = told.withColumn("__text", strip(text)).withColumn("__told", parse_fields(F.col("__text")))
    mine = lambda f: F.when(at(f) != 0, at(f)) if f in COUNTS else present(at(f))
    fields = {f: F.coalesce(mine(f) if f in names else F.lit(None), F.col("__told")[f]) for f in FIELDS}
    told = told.withColumns({f"__{f}": c for f, c in fields.items()})
    own = present(at("record_id")) if "record_id" in names else F.lit(None).cast("string")
    keep = [at(c).alias(c) for c in names if c not in (*FIELDS, "record_id", "text_content")]
    return told.select(*keep, F.coalesce("__dn_no", own).alias("record_id"), F.col("__text").alias("text_content"), *[F.col(f"__{f}").alias(f) for f in FIELDS])


def describe(rows: DataFrame, out: str = "description") -> DataFrame:
    """``rows`` with the record told in words; an own text is kept."""
    parts = [F.when(given(f).isNotNull(), F.concat(F.lit(f"{label}为"), strip(F.col(f).cast("string")))) for f, label in DESCRIBED.items() if f in rows.columns]
    told = F.concat_ws("；", *parts)
    words = F.when(told != "", F.concat(told, F.lit("。"))).otherwise(F.lit(UNDESCRIBED))
    return rows.withColumn(out, F.coalesce(present(F.col("text_content")), words))


def text_chunks(rows: DataFrame) -> Column:
    """Up to three chunks: all fields, the fields about the defect, the text; equal ones (in any case) once."""
    told = lambda fields: F.concat_ws("；", *[F.when(given(f).isNotNull(), F.concat(F.lit(f"{f}="), strip(F.col(f).cast("string")))) for f in fields if f in rows.columns])
    raw = F.array(told(FIELDS), told(DEFECT_FIELDS), F.coalesce(strip(present(F.col("text_content"))), F.lit("")))
    def distinct(some: Column) -> Column:
        folded = F.transform(some, lambda x: F.lower(x))
        return F.filter(some, lambda c, i: F.array_position(folded, F.lower(c)) == i + 1)

    none = F.array(F.coalesce(F.col("dn_no"), F.lit("")))
    return let(F.filter(raw, lambda c: c != ""), lambda some: F.when(F.size(some) > 0, distinct(some)).otherwise(none))


def merge_points(points: DataFrame, order: str = "ord", drop_unknown: bool = True, grains: str | None = None) -> DataFrame:
    """One row a record: of each field the first value in ``order``, of the text the longest (of equals the first).

    Missing values never win, nor does a placeholder text however long. The key is the upper-cased record number,
    else record id, else point id; rows without any are left out, and with ``drop_unknown`` those of placeholders. The
    distinct kinds of point of each record come as ``matched_grains`` if their column is named.
    """
    key = F.upper(record_id(F.col("dn_no"), F.col("record_id"), F.col("point_id")))
    keyed = points.withColumn("__key", key).where(F.col("__key") != "" if drop_unknown else F.lit(True))
    fields = [f for f in FIELDS if f in points.columns and f != "dn_no"]
    firsts = [F.min_by(F.col(f), F.when(given(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    text = F.max_by("text_content", F.when(present(F.col("text_content")).isNotNull(), F.struct(F.length("text_content"), -F.col(order)))).alias("text_content")
    return keyed.groupBy(F.col("__key").alias("dn_no")).agg(*firsts, text, F.count("*").alias("n_points"), *([F.array_sort(F.collect_set(present(F.col(grains)))).alias("matched_grains")] if grains else []))


def first_rows(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; a window with a limit of one, applied before the shuffle too."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def best_rows(rows: DataFrame, key: list[str], score: str, order: str) -> DataFrame:
    """The row of the highest score of each key (NULL counts as 1), ties by order."""
    return first_rows(rows, key, [F.desc(F.coalesce(F.col(score), F.lit(1.0))), F.col(order)])


def merge_grains(hits: DataFrame, key: str, score: str, grain: str, order: str) -> DataFrame:
    """``(key, score, order, matched_grains)``: the highest score of each record, the hit that has it, and the
    grains of all its hits in order, repeated ones too, missing ones not."""
    best = F.max_by(F.col(order), F.struct(F.col(score), -F.col(order)))
    grains = F.sort_array(F.collect_list(F.when(present(F.col(grain)).isNotNull(), F.struct(F.col(order).alias("o"), F.col(grain).alias("g")))))
    return hits.where(~is_missing(F.col(key).cast("string"))).groupBy(key).agg(F.max(score).alias(score), best.alias(order), F.transform(grains, lambda x: x["g"]).alias("matched_grains"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` rows, and those ``old`` rows whose key isn't among them. Keys of ``new`` should be unique."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def image_manifest(images: DataFrame) -> DataFrame:
    """``images(dn_no, image_type, file_name)`` to one row a record with its distinct images in order, storage keys and
    links made from the names."""
    dn = normalize_dn(F.col("dn_no"))
    one = F.struct(
        "image_type",
        "file_name",
        F.concat(F.lit("images/"), dn, F.lit("/"), F.col("file_name")).alias("storage_key"),
        F.concat(F.lit("/image/"), dn, F.lit("/"), F.col("file_name")).alias("url"),
    )
    return images.where(dn != "").groupBy(dn.alias("dn_no")).agg(F.sort_array(F.collect_set(one)).alias("images"), F.count_distinct("image_type", "file_name").alias("image_count"))


def with_images(records: DataFrame, images: DataFrame) -> DataFrame:
    """``(dn_no, has_record, *fields, images)``: each record number with images, its record (one row of ``records`` at most, by
    upper-cased number; NULL fields without) and its distinct images in order of display. A record's images are few."""
    order = F.struct(role_order(F.col("image_type")).alias("o"), F.col("file_name"), F.col("image_type"))
    own = images.where(strip(F.coalesce("dn_no", F.lit(""))) != "").groupBy(normalize_dn(F.col("dn_no")).alias("dn_no")).agg(F.sort_array(F.collect_set(order)).alias("__i"))
    shown = F.transform("__i", lambda i: F.struct(i["image_type"].alias("image_type"), i["file_name"].alias("file_name")))
    named = records.withColumn("dn_no", normalize_dn(F.col("dn_no"))).withColumn("has_record", F.lit(True))
    fields = [c for c in records.columns if c != "dn_no"]
    return own.join(named, "dn_no", "left").select("dn_no", F.coalesce("has_record", F.lit(False)).alias("has_record"), *fields, shown.alias("images"))


def assign_roles(pictures: DataFrame, record: list[str], kind: str, order: list[str]) -> DataFrame:
    """``pictures`` with the role each gets by its turn among its record's pictures of one kind: the first map and the
    first two micrographs take part in searches, others are only shown."""
    nth = F.row_number().over(W.partitionBy(*record, kind).orderBy(*order))
    named = pictures.withColumn("role_no", nth)
    map_ = F.when(F.col("role_no") == 1, F.lit("DefectMapPost")).otherwise(F.concat(F.lit("ImportedBinMap"), F.col("role_no").cast("string")))
    sem = F.when(F.col("role_no") <= 2, F.concat(F.lit("TypicalDefectImage"), F.col("role_no").cast("string")))
    sem = F.coalesce(sem, F.concat(F.lit("ImportedSEMImage"), F.col("role_no").cast("string")))
    return named.withColumn("role", F.when(F.col(kind) == "binmap", map_).otherwise(sem))


def assemble(records: DataFrame, manifest: DataFrame, vectors: DataFrame) -> DataFrame:
    """One entity a record: its fields, its images and how many vectors of each kind it has. ``vectors(dn_no, modality)``."""
    kinds = vectors.groupBy("dn_no").agg(F.count_if(F.col("modality") == "binmap").alias("binmap_vectors"), F.count_if(F.col("modality") == "sem").alias("sem_vectors"))
    out = records.join(manifest, "dn_no", "left").join(kinds, "dn_no", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.withColumns({c: zero(F.col(c)) for c in ("image_count", "binmap_vectors", "sem_vectors")})


def sync_report(records: DataFrame, images: DataFrame) -> DataFrame:
    """``(measure, n)``: what bringing entities up to date would find: records, images, records without images and images'
    records that there are none of. ``records(dn_no)``, ``images(dn_no, file_name)`` by normal numbers."""
    side = records.groupBy("dn_no").agg(F.lit(1).alias("r")).join(images.groupBy("dn_no").agg(F.count("*").alias("i")), "dn_no", "full")
    told = {"dn_count": F.count("r"), "image_count": F.coalesce(F.sum("i"), F.lit(0)), "missing_images": F.count_if(F.col("i").isNull()), "orphan_image_dns": F.count_if(F.col("r").isNull())}
    one = side.agg(*[c.cast("bigint").alias(n) for n, c in told.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("n")) for n in told])).alias("x")).select("x.measure", "x.n")


def hashed(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumn("content_hash", content_hash(*columns))


def new_imports(ledger: DataFrame, files: DataFrame, digest: str) -> DataFrame:
    """Files whose content the ledger doesn't have; of equal files the first by name."""
    once = first_rows(files, [digest], [F.col("file_name")])
    return once.join(ledger.select(digest).distinct(), digest, "left_anti")


# How lines of a slide are told apart and read, and what its counts are called.
SLIDE_DN = r"(?i)(DN-[A-Za-z0-9-]+)"
SLIDE_TOTAL = r"(?i)(?:^|[^A-Za-z0-9_])Total\s*(\d+)"
SLIDE_DEFECT = r"^#?\s*\d+\s+([A-Za-z][A-Za-z0-9_-]+)"
SLIDE_PLACE = r"(?i)(Cluster|Random|Center|Edge)"
SLIDE_DATE = r"(\d{4}/\d{1,2}/\d{1,2})"
SLIDE_TIME = r"(\d{4}/\d{1,2}/\d{1,2}\s+\d{1,2}:\d{2}:\d{2})"


def slide_record(lines: Column, file_name: Column, slide: Column) -> dict[str, Column]:
    """The record a slide's ordered text lines tell, by field; NULL where a line is missing. A slide without a number
    gets one from its file and position."""
    told = F.filter(F.transform(lines, lambda x: strip(x)), lambda x: x != "")
    first = lambda p: F.try_element_at(F.filter(told, lambda x: x.rlike(p)), F.lit(1))
    got = lambda line, p, i=1: F.nullif(strip(F.regexp_extract(F.coalesce(line, F.lit("")), p, i)), F.lit(""))
    title, identity, defect, place, dated = first(SLIDE_DN), first(SLIDE_TOTAL), first(SLIDE_DEFECT), first(SLIDE_PLACE), first(SLIDE_DATE)
    named = r"(?i)(?:^|[^A-Za-z0-9_])Class\s*\d+\s+([A-Za-z0-9_.-]+)"
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    made = F.concat(F.lit("PPT-"), stem, F.lit("-"), F.lpad(slide.cast("string"), 3, "0"))
    low = lambda p: F.try_element_at(F.filter(told, lambda x: F.lower(x).rlike(p)), F.lit(1))
    return {
        "dn_no": F.coalesce(got(title, SLIDE_DN), made),
        "class_type": got(title, r"(?i)(?:^|[^A-Za-z0-9_])(Class\s*\d+)"),
        "product_id": got(title, named),
        "station": got(title, named + r"\s+([A-Za-z0-9_.-]+)", 2),
        "platform": got(identity, r"(?:^|[^A-Za-z0-9_])([A-Z]{2,}\d+[A-Z0-9]*)"),
        "lot_id": F.nullif(strip(F.try_element_at(F.split(identity, "/"), F.lit(2))), F.lit("")),
        "bad_wafers": got(identity, r"(?i)(?:^|[^A-Za-z0-9_])NG\s*(\d+)").try_cast("int"),
        "scanned_wafers": got(identity, r"(?i)AdhCANC\s*(\d+)").try_cast("int"),
        "total_wafers": got(identity, SLIDE_TOTAL).try_cast("int"),
        "defect_type": F.coalesce(got(defect, SLIDE_DEFECT), got(title, r"\s([A-Za-z][A-Za-z0-9_-]+)\s*$")),
        "map_location": F.nullif(strip(F.element_at(F.split(place, "/"), -1)), F.lit("")),
        "machine": got(dated, r"^([A-Za-z0-9_.-]+)"),
        "scan_time": got(dated, SLIDE_TIME),
        "equipment_status": low("^(down|up)$"),
        "lot_status": low("^(scrap|hold|release)"),
    }


def searchable(images: DataFrame, role: str = "image_type") -> DataFrame:
    """Only images whose role takes part in searches, with their kind."""
    return images.withColumn("modality", modality(F.col(role))).where(F.col("modality").isNotNull())
