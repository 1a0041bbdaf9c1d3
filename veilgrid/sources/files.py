"""File lists, folders, archives and line lists as DataFrames."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.sources.encodings import decode_html

READ_LIMIT = 8 << 20


def files(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """path (relative), bytes, sha256, content: regular files below a folder, hidden ones left out; contents over limit are null."""
    root = folder.removeprefix("file://").rstrip("/")
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + _quote(root) + "/", "")
    content = F.col("content") if limit is None else F.when(F.col("length") <= limit, F.col("content"))
    return b.select(rel.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), content.alias("content")).where(~F.col("path").rlike(r"(^|/)\."))


def _quote(s: str) -> str:
    return "\\Q" + s + "\\E"


def skipped(spark: SparkSession, folder: str) -> DataFrame:
    """path, reason: links and special files below a folder, which files() must not follow; a walk on the driver over names only."""
    root, rows = folder.removeprefix("file://").rstrip("/"), []
    for here, dirs, names in os.walk(root):
        for n in [*dirs, *names]:
            p = os.path.join(here, n)
            if os.path.islink(p):
                rows.append((os.path.relpath(p, root), "symlink"))
            elif not os.path.isdir(p) and not os.path.isfile(p):
                rows.append((os.path.relpath(p, root), "special_file"))
    return spark.createDataFrame(rows, "path string, reason string")


def submissions(listing: DataFrame) -> DataFrame:
    """listing with group (the first folder) and file (the rest); files at the top are their own groups' none."""
    return listing.where(F.contains("path", F.lit("/"))).withColumn("group", F.substring_index("path", "/", 1)).withColumn("file", F.regexp_replace("path", "^[^/]*/", ""))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """item, pos: one item a line; a blank line is refused when read."""
    t = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    item = F.regexp_replace("value", "\r\\z", "")
    return t.select(F.when(F.trim(item) == "", F.raise_error(F.lit("blank line")).cast("string")).otherwise(item).alias("item"), "pos")


def html_pages(listing: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, html, encoding, reason (undecodable, or too_large where the content wasn't read): pages decoded strictly (see decode_html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(1).to_pylist():
                text, name = (None, None) if data is None else decode_html(data)
                rows.append((text, name, "too_large" if data is None else "undecodable" if name is None else None))
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in cols)], ["path", "html", "encoding", "reason"])

    return listing.select(F.col(path).cast("string").alias("path"), F.col(content).cast("binary").alias("c")).mapInArrow(run, "path string, html string, encoding string, reason string")


def zip_entries(archives: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """archive, pos, path, bytes, body: the entries of zip archives, in the archive's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                    for n, i in enumerate(z.infolist()):
                        yield pa.RecordBatch.from_pydict({"archive": [name], "pos": [n], "path": [i.filename], "bytes": [i.file_size], "body": [z.read(i)]})

    return archives.select(path, content).mapInArrow(run, "archive string, pos bigint, path string, bytes bigint, body binary")
