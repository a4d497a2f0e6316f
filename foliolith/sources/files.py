"""File sources: folders of papers as rows, validated and parsed in Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolith.functions import values as V
from foliolith.operators.relational import running_total
from foliolith.operators.structure import FORMAT
from foliolith.sources.docx import docx_info, parse_docx
from foliolith.sources.gdoc import gdoc_info, parse_google_doc
from foliolith.sources.latex import latex_info, parse_latex

# Limits of uploads, archives, PDF files and folder listings.
FILE_LIMIT, BATCH_LIMIT, BATCH_FILES = 50 * 1024 * 1024, 100 * 1024 * 1024, 200
ARCHIVE_ENTRIES, ARCHIVE_BYTES, ARCHIVE_RATIO = 2000, 100 * 1024 * 1024, 200
PDF_PAGES, PDF_OBJECTS = 500, 100_000
FOLDER_DEPTH = 3


def read_folder(spark: SparkSession, path: str, most: int | None = None, depth: int = FOLDER_DEPTH) -> DataFrame:
    """(filename, path, content, size) of the files below a folder, at most ``depth`` folders
    down, each once; ``most`` limits the listing in order of path."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath()
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.substring_index(F.regexp_replace("path", "^[A-Za-z0-9+.-]+:(//[^/]*)?", ""), root.rstrip("/") + "/", -1)
    df = df.filter(F.size(F.split(below, "/")) - 1 <= depth)
    df = df.select(F.substring_index("path", "/", -1).alias("filename"), "path", "content", F.col("length").alias("size")).dropDuplicates(["path"])
    return df.orderBy("path").limit(most) if most else df


def bounded(files: DataFrame, batch: str, order: str, per_file: int = FILE_LIMIT, per_batch: int = BATCH_LIMIT) -> DataFrame:
    """Files within the limits: each, and the running total of its batch."""
    fit = files.filter(F.col("size") <= per_file)
    return running_total(fit, batch, order, "size", "__t").filter(F.col("__t") <= per_batch).drop("__t")


def _archive_error(data: bytes) -> str | None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        entries = z.infolist()
        names = [e.filename for e in entries]
        if len(entries) > ARCHIVE_ENTRIES or sum(e.file_size for e in entries) > ARCHIVE_BYTES:
            return "expands too much"
        if len(set(names)) != len(names):
            return "duplicate entries"
        if not {"[Content_Types].xml", "word/document.xml"} <= set(names):
            return "no document"
        for e in entries:
            link = (e.external_attr >> 16) & 0o170000 == 0o120000
            if link or e.filename.startswith("/") or "\\" in e.filename or ".." in e.filename.split("/"):
                return "unsafe path"
            if e.flag_bits & 1 or e.file_size > ARCHIVE_RATIO * max(1, e.compress_size):
                return "encrypted or expands too much"
            if e.filename.lower().endswith("vbaproject.bin"):
                return "macros"
            if e.filename.endswith((".xml", ".rels")) and re.search(rb"<!DOCTYPE|<!ENTITY", z.read(e), re.I):
                return "document type declaration"
    return None


def container_error(data: bytes, fmt: str) -> str | None:
    """Why a file must not be parsed, or None."""
    if len(data) > FILE_LIMIT:
        return "too large"
    if fmt == "docx":
        try:
            return _archive_error(data)
        except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError):
            return "damaged archive"
    if fmt == "pdf":
        if re.search(rb"/Encrypt\b", data):
            return "encrypted"
        if len(re.findall(rb"/Type\s*/Page\b", data)) > PDF_PAGES:
            return "too many pages"
        if len(re.findall(rb"\b\d+ \d+ obj\b", data)) > PDF_OBJECTS:
            return "too many objects"
        if re.search(rb"/(JavaScript|JS|Launch|EmbeddedFiles?)\b", data):
            return "active content"
    return None


_FMT = f"struct<{', '.join(x.replace(' ', ':') for x in FORMAT.split(', '))}>"
_INFO = "width:double,height:double,top:double,bottom:double,left:double,right:double,orientation:string,columns:int,title:string,anonymous_package:boolean,base_size:double"
_PARSED = f"filename string, path string, format string, error string, size bigint, sha256 string, info struct<{_INFO}>, blocks array<struct<pos:int,text:string,fmt:{_FMT},heading_style:boolean>>"
_NONE = dict.fromkeys(x.split()[0] for x in FORMAT.split(", "))
_NO_INFO = dict.fromkeys(x.split(":")[0] for x in _INFO.split(","))
PARSERS = {"docx": (parse_docx, docx_info), "latex": (parse_latex, latex_info), "gdoc": (parse_google_doc, gdoc_info)}


def parse_files(files: DataFrame) -> DataFrame:
    """(filename, path, format, error, size, sha256, info, blocks) of files (filename, path,
    content): one row a file, whose blocks and page are null where it can't be read. Text is
    parsed in Python, file by file, because formats are nested byte streams; everything
    after it is columns. Write the result before it is used more than once."""

    def one(fmt, data):
        error = container_error(data, fmt)
        if error is None and fmt not in PARSERS:
            error = "no parser for this format here" if fmt == "pdf" else "unsupported file type"
        if error is None:
            try:
                blocks, info = (f(data) for f in PARSERS[fmt])
            except Exception as x:  # a file's own fault must not stop the batch
                return f"unreadable: {type(x).__name__}", None, None
            if blocks:
                rows = [{"pos": i, "text": t, "fmt": {**_NONE, **f}, "heading_style": h} for i, (t, f, h) in enumerate(blocks)]
                return None, {k: info.get(k) for k in _NO_INFO}, rows
            error = "no text"
        return error, None, None

    def run(batches):
        for pdf in batches:
            found = [one(f, bytes(d or b"")) for f, d in zip(pdf["format"], pdf["content"], strict=True)]
            out = pdf[["filename", "path", "format", "size", "sha256"]].copy()
            out["error"], out["info"], out["blocks"] = ([x[i] for x in found] for i in range(3))
            yield out[["filename", "path", "format", "error", "size", "sha256", "info", "blocks"]]

    fmt = F.when(F.lower("filename").endswith(".gdoc"), "gdoc").otherwise(V.sniff_format(F.col("content"), F.col("filename")))
    rows = files.select("filename", "path", fmt.alias("format"), "content", F.length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"))
    return rows.mapInPandas(run, _PARSED)


def parse(files: DataFrame) -> DataFrame:
    """Blocks of every file (filename, format, error, pos, text, fmt, heading_style); a file
    that can't be read has one row with its error."""
    if "path" not in files.columns:
        files = files.withColumn("path", F.col("filename"))
    return parse_files(files).select("filename", "format", "error", F.inline_outer("blocks"))


def read_stores(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Parquet tables by name."""
    return {k: spark.read.parquet(v) for k, v in paths.items()}


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").json(path)
