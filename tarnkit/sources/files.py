"""Files as tables: a folder scan and parsers that keep to the standard library.

scan gives path, kind, size and content; parse adds text, metadata and images. A file
that can't be parsed has an error instead, and the others go on."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkit.functions import checks, text as T
from tarnkit.sources import compound, pdf

# XML name spaces of office files.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
IMAGE = pa.struct([("name", pa.string()), ("data", pa.binary()), ("place", pa.int32())])
IMAGES = "array<struct<name string, data binary, place int>>"  # place: slide or page, where there are such


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All files below path with a known extension, whatever its case; no others are read."""
    any_case = ",".join("".join(f"[{c}{c.upper()}]" for c in extension) for extension in checks.FILE_TYPES)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{any_case}}}").load(path)
    return files.withColumn("kind", checks.file_type(F.col("path"))).where("kind is not null").select("path", "kind", F.col("length").alias("size"), "content")


def docx(data: bytes) -> tuple[str, list]:
    """Paragraphs on lines of their own, and the media."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        lines = ["".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in root.iter(f"{WORD}p")]
        media = [{"name": n, "data": z.read(n)} for n in sorted(z.namelist()) if n.startswith("word/media/")]
    return "\n".join(lines), media


def xlsx(data: bytes) -> tuple[str, list]:
    """A line "Sheet-row,column: value", counted from 1, for each cell that holds something."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        lines = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
            part = "xl/" + targets[sheet.get(f"{OFFICE}id")].removeprefix("/xl/")
            for cell in ElementTree.fromstring(z.read(part)).iter(f"{SHEET}c"):
                letters, row = re.fullmatch(r"([A-Z]+)([0-9]+)", cell.get("r")).groups()
                column = 0
                for c in letters:
                    column = column * 26 + ord(c) - 64
                value = "".join(t.text or "" for t in cell.iter(f"{SHEET}t")) if cell.get("t") == "inlineStr" else cell.findtext(f"{SHEET}v") or ""
                value = shared[int(value)] if cell.get("t") == "s" and value else value
                if value.strip():
                    lines.append(f"{sheet.get('name')}-{row},{column}: {value}")
    return "\n".join(lines), []


def pptx(data: bytes) -> tuple[str, list]:
    """"Slide n:" and its text for each slide, blank lines between, and the media of each slide.

    A picture comes once, with the first slide that shows it; media that no slide shows come last."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        slides = sorted((int(m.group(1)), n) for n in names if (m := re.fullmatch(r"ppt/slides/slide([0-9]+)\.xml", n)))
        parts, shown = [], {}
        for number, name in slides:
            root = ElementTree.fromstring(z.read(name))
            lines = ["".join(t.text or "" for t in p.iter(f"{DRAW}t")) for p in root.iter(f"{DRAW}p")]
            parts.append(f"Slide {number}:\n" + "\n".join(line for line in lines if line.strip()))
            links = f"ppt/slides/_rels/slide{number}.xml.rels"
            for link in ElementTree.fromstring(z.read(links)) if links in names else ():
                target = posixpath.normpath(posixpath.join("/ppt/slides", link.get("Target", ""))).lstrip("/")
                if target in names and target.startswith("ppt/media/"):
                    shown.setdefault(target, number)
        rest = sorted(n for n in names if n.startswith("ppt/media/") and n not in shown)
        media = [{"name": n, "data": z.read(n), "place": shown.get(n)} for n in [*shown, *rest]]
    return "\n\n".join(parts), media


PARSERS = {"word": docx, "excel": xlsx, "ppt": pptx, "pdf": pdf.parse, "word_legacy": compound.doc, "excel_legacy": compound.xls, "ppt_legacy": compound.ppt}
TEXTUAL = ("markdown", "html")


def parse(files: DataFrame) -> DataFrame:
    """path, kind, text, images and error of each scanned file.

    Markdown and HTML are cleaned by column expressions; PDF and office files are read by
    PARSERS, to which parsers of further kinds can be added."""
    kinds = [*PARSERS]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, images, errors = [], [], []
            for kind, content in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                try:
                    text, found = PARSERS[kind](content.as_py())
                    texts.append(text)
                    images.append(found)
                    errors.append(None)
                except (KeyError, ValueError, IndexError, AttributeError, struct.error, zlib.error, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    texts.append(None)
                    images.append([])
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(images, pa.list_(IMAGE)), pa.array(errors, pa.string())], ["path", "kind", "text", "images", "error"])

    schema = f"path string, kind string, text string, images {IMAGES}, error string"
    binary = files.where(F.col("kind").isin(kinds)).select("path", "kind", "content").mapInArrow(work, schema)
    body = F.decode("content", "UTF-8")
    none = F.array().cast(IMAGES.replace(" string", ":string").replace(" binary", ":binary").replace(" int", ":int"))
    plain = files.where(F.col("kind").isin(*TEXTUAL)).select("path", "kind", F.when(F.col("kind") == "html", T.html_to_text(body)).otherwise(T.strip_markdown(body)).alias("text"), none.alias("images"), F.lit(None).cast("string").alias("error"))
    other = files.where(~F.col("kind").isin(*kinds, *TEXTUAL)).select("path", "kind", F.lit(None).cast("string").alias("text"), none.alias("images"), F.concat(F.lit("no parser for "), F.col("kind")).alias("error"))
    binary = binary.withColumn("text", F.when(F.col("kind") == "word_legacy", T.drop_field_codes(F.col("text"))).otherwise(F.col("text")))
    done = binary.withColumn("text", T.clean_text(F.col("text"))).unionByName(plain).unionByName(other)
    return done.withColumn("error", F.when(F.col("error").isNull() & (F.coalesce("text", F.lit("")) == "") & (F.size("images") == 0), "empty").otherwise(F.col("error")))
