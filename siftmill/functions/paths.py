"""File names and paths of images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a file name contains, misspellings too, and the role it then has; the first that fits.
ROLE_ALIASES = (
    ("addscandefectmapgallary1", "AddScanDefectMapGallary1"),
    ("addscandefectmapgallery1", "AddScanDefectMapGallary1"),
    ("addscandefectmapgallary", "AddScanDefectMapGallary"),
    ("addscandefectmapgallery", "AddScanDefectMapGallary"),
    ("typicaldefectimage1", "TypicalDefectImage1"),
    ("typeicaldefectimage1", "TypicalDefectImage1"),
    ("typicaldefectimage2", "TypicalDefectImage2"),
    ("typeicaldefectimage2", "TypicalDefectImage2"),
    ("defectparetochart", "DefectParetoChart"),
    ("defecttrendchart", "DefectTrendChart"),
    ("defectbarchart", "DefectBarChart"),
    ("defectmappost", "DefectMapPost"),
    ("defectmappre", "DefectMapPre"),
    ("edxdefectimage", "EDXDefectImage"),
    ("diestack", "DieStack"),
    ("moreimage", "MoreImage"),
    ("typicalmap2", "TypicalMap2"),
    ("typeicalmap2", "TypicalMap2"),
    ("typicalmap", "TypicalMap"),
    ("typeicalmap", "TypicalMap"),
)
# Order in which a record's images are shown.
ROLES = (
    "DefectMapPost", "TypicalDefectImage1", "TypicalDefectImage2", "AddScanDefectMapGallary", "AddScanDefectMapGallary1", "DefectBarChart", "DefectMapPre",
    "DefectParetoChart", "DefectTrendChart", "DieStack", "EDXDefectImage", "MoreImage", "TypicalMap", "TypicalMap2",
)
# Image roles that take part in a search, by modality; all others are only shown.
MODALITIES = {"binmap": ("DefectMapPost",), "sem": ("TypicalDefectImage1", "TypicalDefectImage2")}
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".\.([^.]*)$", 1))


def image_role(path: Column) -> Column:
    """The role a file name tells, else its own stem."""
    plain = F.regexp_replace(F.lower(stem(path)), r"[^\p{IsAlphabetic}\p{IsDigit}]", "")
    known = [F.when(plain.contains(k), F.lit(v)) for k, v in ROLE_ALIASES]
    return F.coalesce(*known, F.nullif(F.trim(stem(path)), F.lit("")), F.lit("Image"))


def modality(role: Column) -> Column:
    return F.coalesce(*[F.when(role.isin(*roles), F.lit(m)) for m, roles in MODALITIES.items()])


def role_order(role: Column) -> Column:
    """Position in the order of display; 99 for a role of its own."""
    at = F.array_position(F.array(*[F.lit(r) for r in ROLES]), role)
    return F.when(at > 0, at - 1).otherwise(F.lit(99)).cast("int")


def safe_name(name: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9._\x{4e00}-\x{9fff}-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("uploaded.pptx"))


def resolve(base: Column, target: Column) -> Column:
    """A relative part name against the folder of ``base``; steps beyond the top are ignored."""
    folder = F.filter(F.split(F.regexp_replace(base, r"[^/]*$", ""), "/"), lambda p: p != "")
    steps = F.filter(F.split(F.replace(target, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(steps, folder, up), "/")
