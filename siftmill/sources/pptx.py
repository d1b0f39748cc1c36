"""Slides of .pptx files as rows, read with the standard library inside Arrow batches."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
#: Where an element without a position is put: behind all others.
LAST = 10**18
ELEMENTS = "file string, sha256 string, slide int, kind string, y bigint, x bigint, ord int, text string, extension string, content binary"


def is_pptx(data: bytes) -> bool:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return "ppt/presentation.xml" in z.namelist()
    except zipfile.BadZipFile:
        return False


def _links(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    join = lambda t: posixpath.normpath(posixpath.join("/", folder, t.replace("\\", "/"))).lstrip("/")
    return {e.get("Id", ""): join(e.get("Target", "")) for e in ElementTree.fromstring(z.read(rels)).iter(REL)}


def _place(element: ElementTree.Element) -> tuple[int, int]:
    for frame in element.iter(f"{A}off"):
        return int(frame.get("y", 0)), int(frame.get("x", 0))
    for frame in element.iter(f"{P}xfrm"):
        off = frame.find(f"{A}off")
        if off is not None:
            return int(off.get("y", 0)), int(off.get("x", 0))
    return LAST, LAST


def elements(data: bytes) -> Iterator[tuple[int, str, int, int, str | None, str | None, bytes | None]]:
    """``(slide, kind, y, x, text, extension, content)`` of texts and pictures, slides in order of presentation, elements from
    top to bottom. Blanks are squeezed; pictures whose part is missing are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names, links = set(z.namelist()), _links(z, "ppt/presentation.xml")
        shown = [links.get(s.get(f"{R}id", "")) for s in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter(f"{P}sldId")]
        for no, part in enumerate((s for s in shown if s in names), 1):
            root, media = ElementTree.fromstring(z.read(part)), _links(z, part)
            found = []
            for tag in (f"{P}sp", f"{P}graphicFrame"):
                for e in root.iter(tag):
                    if text := re.sub(r"\s+", " ", "".join(t.text or "" for t in e.iter(f"{A}t"))).strip():
                        found.append(("text", *_place(e), text, None, None))
            for e in root.iter(f"{P}pic"):
                blip = next(e.iter(f"{A}blip"), None)
                source = media.get(blip.get(f"{R}embed", "")) if blip is not None else None
                if source in names:
                    found.append(("picture", *_place(e), None, posixpath.splitext(source)[1].lower() or ".png", z.read(source)))
            for kind, y, x, text, ext, content in sorted(found, key=lambda f: (f[0] != "text", f[1], f[2])):
                yield no, kind, y, x, text, ext, content


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("sha256", pa.string()), ("slide", pa.int32()), ("kind", pa.string()), ("y", pa.int64()), ("x", pa.int64()), ("ord", pa.int32()), ("text", pa.string()), ("extension", pa.string()), ("content", pa.binary())])
    for batch in batches:
        for name, digest, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                rows = [(name, digest, s, k, y, x, i, t, e, c) for i, (s, k, y, x, t, e, c) in enumerate(elements(data))]
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                rows = []
            # One file a batch: decks are large.
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


def read_slides(files: DataFrame) -> DataFrame:
    """Elements of ``files(file, sha256, content)``; a file that is no deck gives none."""
    return files.select("file", "sha256", "content").mapInArrow(_read, ELEMENTS)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """``(file, sha256, content)`` of all decks under a path."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pptx").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"), "content")


def slide_lines(slides: DataFrame) -> DataFrame:
    """``(file, sha256, slide, lines)``: the ordered texts of each slide (a slide's are few)."""
    own = slides.where("kind = 'text'").groupBy("file", "sha256", "slide").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("__l"))
    return own.select("file", "sha256", "slide", F.transform("__l", lambda x: x["text"]).alias("lines"))
