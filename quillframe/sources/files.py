"""Delimited text, zipped text, spreadsheets and Parquet to typed frames."""

from __future__ import annotations

import gzip
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.frame import Frame
from quillframe.shared import copy_url, new_path
from quillframe.sources.infer import infer, project
from quillframe.sources.sniff import COMMENTS, Setup, lines_of, sniff, tokenize

#: Where a line stands: its file, the block that one task reads, its place there.
PLACE = ["_file", "_block", "_row"]
_SAMPLE = 1 << 16


def compression(head: bytes) -> str:
    """zip, gzip, xls or none, by the first bytes."""
    if head[:4] == b"PK\x03\x04":
        return "zip"
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    return "xls" if head[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" else "none"


def _heads(spark: SparkSession, path: str) -> Iterator[bytes]:
    """The first bytes of each file that has any, by name."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    waiting = [fs.getFileStatus(p)]
    while waiting:
        status = waiting.pop()
        if status.isDirectory():
            inside = (s for s in fs.listStatus(status.getPath()) if not s.getPath().getName().startswith((".", "_")))
            waiting += sorted(inside, key=lambda s: s.getPath().toString(), reverse=True)
        elif n := min(_SAMPLE, status.getLen()):
            stream = fs.open(status.getPath())
            try:
                yield bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
            finally:
                stream.close()


def _head(spark: SparkSession, path: str) -> tuple[bytes, str]:
    """The first bytes and lines of the first file that shows what the lines are: two of them, for a header alone doesn't say so; else of the first with one.

    Writers leave files without a line, or with a header only, where a part of
    their table has no rows. The lines come after the comments of the files before.
    """
    best, most, comments = (b"", ""), -1, ""
    for head in _heads(spark, path):
        if compression(head) in ("zip", "xls") or head[:4] == b"PAR1":
            return (head, "") if most < 1 else best
        text = _text(head)
        found = sum(not x.startswith(COMMENTS) for x in lines_of(text))
        if found > most:
            best, most = (head, comments + text), found
        if found >= 2:
            break
        comments = comments or "".join(f"{x}\n" for x in lines_of(text) if x.startswith(COMMENTS))
    return best


def _text(head: bytes) -> str:
    return (_gunzip(head) if compression(head) == "gzip" else head).decode("utf-8", "replace")


def _gunzip(head: bytes) -> bytes:
    try:
        return gzip.GzipFile(fileobj=io.BytesIO(head)).read(_SAMPLE)
    except EOFError:
        import zlib

        return zlib.decompressobj(31).decompress(head)


def _zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """_file, _block, _row, value: lines of the first entry of each archive."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                z = zipfile.ZipFile(io.BytesIO(content))
                lines = lines_of(z.read(z.namelist()[0]).decode("utf-8", "replace"))
                n = len(lines)
                yield pa.record_batch([pa.array([file] * n, pa.string()), pa.array([0] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(lines, pa.string())], [*PLACE, "value"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, "_file string, _block long, _row long, value string")


def _text_lines(spark: SparkSession, path: str) -> DataFrame:
    """_file, _block, _row, value: lines of text files with where they stand."""
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), "value")
    lines = raw.select("_file", "_block", F.explode(F.split("value", "[\r\x0b\x0c]")).alias("value"))
    return lines.select("_file", "_block", F.monotonically_increasing_id().alias("_row"), "value")  # ascending within a block of a file


def _data_lines(lines: DataFrame, first: str | None) -> DataFrame:
    """lines without each file's comments before its first other line, and without that one if it is the header first."""
    comment = F.lit(False)
    for c in COMMENTS:
        comment = comment | F.col("value").startswith(c)
    begin = lines.filter((F.col("_block") == 0) & ~comment).groupBy("_file").agg(F.min(F.struct("_row", "value")).alias("_first"))
    header = (F.col("value") == F.lit(first)) if first is not None else F.lit(False)
    at = F.col("_first._row")
    keep = (F.col("_block") > 0) | F.coalesce((F.col("_row") > at) | (F.col("_row") == at) & ~header, F.lit(False))
    return lines.join(begin, "_file", "left").filter(keep).select(*PLACE, "value")


def read_delimited(spark: SparkSession, path: str, header: bool | None = None, separator: str | None = None) -> Frame:
    """A file, or all files under a folder, as a typed frame in the order of files by name and of their lines.

    Separator, header and types are found from the text unless given. Lines
    that begin with # or @ are comments where a file begins with them. The
    header goes where a file's first line is the same. Short rows miss their
    last fields, surplus fields go.
    """
    head, sample = _head(spark, path)
    if compression(head) == "zip":
        lines = _zip_lines(spark, path)
        sample = "\n".join(r["value"] for r in lines.limit(200).collect())
    else:
        lines = _text_lines(spark, path)
    setup = sniff(sample, header, separator)
    lines = lines.filter(F.trim("value") != "")
    first = next((x for x in lines_of(sample) if not x.startswith(COMMENTS)), None)
    if setup.header or sample.lstrip().startswith(COMMENTS):
        lines = _data_lines(lines, first if setup.header else None)
    return _typed(_fields(lines, setup), setup.names)


def _fields(lines: DataFrame, setup: Setup) -> DataFrame:
    """Text columns of lines: by Spark's own parser, or by ours where ' quotes or blanks separate."""
    n = len(setup.names)
    if setup.quote is None and setup.separator != " ":
        schema = ", ".join(f"c{k} string" for k in range(n + 1))
        options = {"sep": setup.separator, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "PERMISSIVE"}
        parsed = lines.select(*PLACE, F.from_csv("value", F.lit(schema), options).alias("r"))
        return parsed.select(*PLACE, *(F.col(f"r.c{k}").alias(name) for k, name in enumerate(setup.names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(tokenize(x, setup.separator) + [None] * n)[:n] for x in b.column("value").to_pylist()]
            fields = [pa.array([r[k] for r in rows], pa.string()) for k in range(n)]
            yield pa.record_batch([*(b.column(c) for c in PLACE), *fields], [*PLACE, *(f"c{k}" for k in range(n))])

    parsed = lines.mapInArrow(run, ", ".join(["_file string, _block long, _row long", *(f"c{k} string" for k in range(n))]))
    return parsed.select(*PLACE, *(F.col(f"c{k}").alias(name) for k, name in enumerate(setup.names)))


def _typed(df: DataFrame, names: list[str]) -> Frame:
    kinds = infer(df, names)
    return Frame.of(project(df, kinds, PLACE), PLACE, names)


def _xlsx_rows(content: bytes) -> Iterator[tuple[int, int, list[str | None]]]:
    """Sheet, row and cells of all rows."""
    z = zipfile.ZipFile(io.BytesIO(content))
    text = lambda e: "".join(t.text or "" for t in e.iter() if t.tag.endswith("}t"))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = [text(e) for e in ET.fromstring(z.read("xl/sharedStrings.xml")) if e.tag.endswith("}si")]
    sheets = sorted((n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    for k, sheet in enumerate(sheets):
        for n, row in enumerate(e for e in ET.fromstring(z.read(sheet)).iter() if e.tag.endswith("}row")):
            cells: list[str | None] = []
            for c in (e for e in row if e.tag.endswith("}c")):
                at = 0
                for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(ch) - 64
                at = at - 1 if at else len(cells)
                cells += [None] * (at + 1 - len(cells))
                v = next((e for e in c if e.tag.endswith("}v")), None)
                kind = c.get("t")
                cells[at] = text(c) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
            yield k, n, cells


def read_xlsx(spark: SparkSession, path: str) -> Frame:
    """A workbook as a typed frame: its sheets one after the other, names from the first row, which goes on every sheet that begins with it."""
    df = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                sheet, row, cells = list(zip(*_xlsx_rows(content), strict=True)) or [(), (), ()]
                columns = [pa.array([file] * len(row), pa.string()), pa.array(sheet, pa.int64()), pa.array(row, pa.int64()), pa.array(cells, pa.list_(pa.string()))]
                yield pa.record_batch(columns, [*PLACE, "cells"])

    cells = df.mapInArrow(run, "_file string, _block long, _row long, cells array<string>")
    first = cells.orderBy(*PLACE).limit(1).collect()
    names = [n or str(k) for k, n in enumerate(first[0]["cells"])] if first else []
    header = (F.col("_row") == 0) & (F.col("cells") == F.array(*(F.lit(n) for n in first[0]["cells"]))) if first else F.lit(False)
    return _typed(cells.filter(~header).select(*PLACE, *(F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names))), names)


def import_path(spark: SparkSession, path: str, **options) -> Frame:
    """Whatever lies at a path (local, HDFS, S3 or any other Hadoop file system): Parquet, a workbook, or delimited text."""
    head, _ = _head(spark, path)
    if head[:4] == b"PAR1":
        df = spark.read.parquet(path)
        place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")]
        return Frame.of(df.select(*place, "*"), PLACE, df.columns)
    kind = compression(head)
    if kind == "xls":
        raise ValueError("the old binary workbook format isn't read")
    if kind == "zip" and b"[Content_Types].xml" in head[:4096] or path.endswith(".xlsx"):
        return read_xlsx(spark, path)
    return read_delimited(spark, path, **options)


def import_url(spark: SparkSession, url: str, **options) -> Frame:
    """A file behind http, ftp or file, copied once into the folder that all executors share."""
    path = f"{new_path(spark)}/{url.rstrip('/').rpartition('/')[2] or 'data'}"
    copy_url(spark, url, path)
    return import_path(spark, path, **options)


def inspect_path(spark: SparkSession, path: str, rows: int = 10) -> dict:
    """What a parse would make of unparsed data: compression, separator, header, names, the first rows, bytes and about how many rows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    head, text = _head(spark, path)
    kind = compression(head)
    if kind in ("zip", "xls"):
        return {"path": path, "bytes": size, "compression": kind}
    lines, setup = lines_of(text), sniff(text)
    data = [x for x in lines if not x.startswith(COMMENTS)][setup.header :]
    # of a compressed sample, about a third of the text's bytes are on disk
    mean = max(1.0, len(text.encode()) / max(1, len(lines))) / (3 if kind == "gzip" else 1)
    return {
        "path": path, "bytes": size, "compression": kind, "separator": setup.separator, "header": setup.header, "names": setup.names,
        "rows": [tokenize(x, setup.separator) for x in data[:rows]], "about_rows": len(data) if size <= len(head) else round(size / mean),
    }
