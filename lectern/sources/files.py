"""Files of a directory tree as DataFrames: listing, checks, text extraction.

``listing`` reads names, sizes and times only; content is read by ``contents`` for the
files that are left. Formats without a parser in the standard library (PDF, images) go
through ``EXTRACTORS``, where a function ``bytes -> [(page, text)]`` can be put in.

Defined results: an empty file has one empty page; bytes that are no UTF-8 become the
replacement character; a file that can't be parsed has no pages and an error text.
"""

from __future__ import annotations

import csv
import io
import os
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import materialize

#: What a scan takes and leaves.
SUPPORTED = ("pdf", "docx", "pptx", "txt", "csv")
JUNK_FOLDERS = ("@eaDir", "@Recycle", "#recycle", "$RECYCLE.BIN", "System Volume Information", "@Recently-Snapshot", "@Snapshot")
JUNK_FILES = r"^(?:Thumbs\.db|desktop\.ini|\.DS_Store|~\$.*|\..*)$"
MOST_BYTES = 100 * 1024 * 1024


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def is_junk(relpath: Column) -> Column:
    """In a folder that is left out (or hidden), or a file that is."""
    parts = F.split(relpath, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(folders, lambda x: x.isin(*JUNK_FOLDERS) | x.startswith(".")) | F.element_at(parts, -1).rlike(JUNK_FILES)


def classify(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files ``(relpath, size, ...)`` with ``verdict``: excluded, unsupported, oversized or ok."""
    verdict = F.when(is_junk(F.col("relpath")), "excluded").when(~suffix(F.col("relpath")).isin(*SUPPORTED), "unsupported").when(F.col("size") > most_bytes, "oversized").otherwise("ok")
    return files.withColumn("verdict", verdict)


def upload_check(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Uploads ``(filename, size)`` with ``reject_reason``: null if accepted."""
    reason = F.when(F.coalesce(F.col("size"), F.lit(0)) == 0, "empty").when(F.col("size") > most_bytes, "too large").when(~F.coalesce(suffix(F.col("filename")), F.lit("")).isin(*SUPPORTED), "unsupported")
    return files.withColumn("reject_reason", reason)


def scan_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("verdict").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def resolve(root: str, sub: str = "") -> str:
    """The path of ``sub`` below ``root``; refused if it is absolute, climbs out or leads out by a link."""
    if os.path.isabs(sub) or ".." in re.split(r"[/\\]", sub):
        raise ValueError("path outside of the root")
    base, full = os.path.realpath(root), os.path.realpath(os.path.join(root, sub))
    if full != base and not full.startswith(base + os.sep):
        raise ValueError("path outside of the root")
    return full


def listing(spark: SparkSession, root: str, sub: str = "") -> DataFrame:
    """``(path, relpath, size, mtime, folder, verdict)``. Names that Spark's own listing hides (a leading ``_``) are in it.

    Folders are listed level by level, each level by all tasks, so ``root`` must be mounted
    on every worker. Excluded folders are one row each and not gone into; links out of
    ``root`` are excluded, links to folders not followed.
    """
    start = resolve(root, sub)
    base = os.path.realpath(root)
    cols = ["path", "relpath", "size", "mtime", "kind"]

    def look(batches):
        for pdf in batches:
            rows = []
            for folder in pdf["path"]:
                try:
                    found = list(os.scandir(folder))
                except OSError:
                    continue
                for e in found:
                    try:
                        s = e.stat()
                    except OSError:
                        continue
                    kind = "file"
                    if e.is_dir():
                        if e.is_symlink():
                            continue
                        kind = "junk" if e.name in JUNK_FOLDERS or e.name.startswith(".") else "folder"
                    elif e.is_symlink() and not os.path.realpath(e.path).startswith(base + os.sep):
                        kind = "junk"
                    rows.append((e.path, os.path.relpath(e.path, base), s.st_size if kind == "file" else 0, s.st_mtime, kind))
            yield pd.DataFrame(rows, columns=cols)

    schema = "path string, relpath string, size bigint, mtime double, kind string"
    level, found = spark.createDataFrame([(start,)], "path string"), None
    # As many rounds as the tree is deep.
    while True:
        seen = materialize(level.mapInPandas(look, schema), "listing")
        found = seen if found is None else found.unionByName(seen)
        folders = seen.where("kind = 'folder'").select("path")
        if folders.isEmpty():
            break
        level = folders.repartition("path")
    found = classify(found.where("kind <> 'folder'")).withColumn("verdict", F.when(F.col("kind") == "junk", "excluded").otherwise(F.col("verdict")))
    return found.drop("kind").withColumn("folder", text.folder_of(F.col("relpath")))


def to_reindex(files: DataFrame, *, names=None, limit: int | None = None) -> DataFrame:
    """Files ``(relpath, ...)`` of a folder that a rebuild takes: of a supported kind, those named if any are, by name the first ``limit`` if one is given."""
    f = files.where(suffix(F.col("relpath")).isin(*SUPPORTED))
    if names is not None:
        f = f.where(text.basename(F.col("relpath")).isin(list(names)))
    return f if limit is None else f.orderBy("relpath").limit(limit)


def contents(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length, modificationTime, content)`` by Spark's reader; unread columns cost nothing."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


# -- formats -------------------------------------------------------------------
def _cell(x) -> str:
    return ("" if x is None else str(x)).strip().replace("|", "\\|").replace("\n", " ")


def markdown(rows) -> str:
    rows = [r for r in rows if any(_cell(c) for c in r)]
    if not rows:
        return ""
    show = lambda r: "| " + " | ".join(map(_cell, r)) + " |"
    return "\n".join([show(rows[0]), "| " + " | ".join("---" for _ in rows[0]) + " |", *map(show, rows[1:])])


def _plain(data: bytes):
    keep = [x for x in data.decode("utf-8", "replace").splitlines() if not re.match(r"\s*\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}", x)]
    return [(1, "\n".join(keep))]


def _csv(data: bytes):
    return [(1, markdown(csv.reader(io.StringIO(data.decode("utf-8", "replace")))))]


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _docx(data: bytes):
    """Paragraphs, each behind the heading above it, then tables, each behind its label; one page."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    said = lambda p: "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
    out, heading, used = [], None, True
    for p in body.findall(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        t = said(p)
        if not t:
            continue
        if style is not None and style.get(f"{_W}val", "").lower().startswith("heading"):
            if not used:
                out.append(heading)
            heading, used = t, False
        else:
            out.append(f"{heading}\n{t}" if heading else t)
            used = True
    if not used:
        out.append(heading)
    for n, t in enumerate(body.findall(f"{_W}tbl")):
        if table := markdown([["\n".join(said(p) for p in c.findall(f"{_W}p")) for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")]):
            out.append(f"Table {n}\n{table}")
    return [(1, "\n\n".join(x for x in out if x))]


def _pptx(data: bytes):
    """A slide is a page; texts of shapes (grouped ones too) and tables; slides without text are left out."""
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((int(m.group(1)), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    for number, name in slides:
        root, parts = ET.fromstring(z.read(name)), []
        inside = {id(p) for t in root.iter(f"{_A}tbl") for p in t.iter(f"{_A}p")}
        for p in root.iter(f"{_A}p"):
            if id(p) not in inside and (t := "".join(x.text or "" for x in p.iter(f"{_A}t")).strip()):
                parts.append(t)
        for t in root.iter(f"{_A}tbl"):
            parts.append(markdown([["".join(x.text or "" for x in c.iter(f"{_A}t")) for c in r.findall(f"{_A}tc")] for r in t.findall(f"{_A}tr")]))
        if any(parts):
            out.append((number, "\n".join(x for x in parts if x)))
    return out


#: By suffix: bytes -> [(page, text)]; others are read as plain text.
EXTRACTORS = {"csv": _csv, "docx": _docx, "pptx": _pptx}


def extract(files: DataFrame, extractors: dict | None = None) -> DataFrame:
    """``(doc_id, filename, page, text, error)`` of ``files(filename, content)``: by suffix, one function for each format."""
    by = EXTRACTORS if extractors is None else EXTRACTORS | extractors
    src = files.select(text.content_id(F.col("content")).alias("doc_id"), "filename", "content")

    def run(batches):
        for pdf in batches:
            rows = []
            for d, n, c in zip(pdf["doc_id"], pdf["filename"], pdf["content"]):
                kind = n.rsplit(".", 1)[-1].lower() if "." in n else ""
                try:
                    rows += [(d, n, p, t, None) for p, t in by.get(kind, _plain)(bytes(c))]
                except Exception as e:  # noqa: BLE001 - one bad file must not fail the batch
                    rows.append((d, n, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["doc_id", "filename", "page", "text", "error"])
            out["page"] = out["page"].astype("Int32")
            yield out

    return src.mapInPandas(run, "doc_id string, filename string, page int, text string, error string")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a question file, blank ones and comments left out."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> '' and not text like '#%'")
