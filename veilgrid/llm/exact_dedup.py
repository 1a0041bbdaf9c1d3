"""Exact duplicates by skew-safe combining: local winners, salted digest groups, then one winner among the salts.

Full content is compared at every stage: the content itself (compressed, which keeps equality: one compressor with one
setting maps equal texts to equal bytes, and different texts to different ones) is a grouping key beside its digest.
A content that a third of all rows share leaves one row per salt and map task, then one row per salt, then one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilgrid.llm.common import LOWER, UPPER, fresh, salts

_KEYS = ["digest", "mark"]


def _sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _keyed(with_content: bool, digest, parts: int):
    """Per row: id, salt (by id), digest and a second hash of the normalised text, and the content itself where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
        for batch in batches:
            ids = batch.column(0)
            texts = pc.ascii_lower(pc.fill_null(batch.column(1), "")).cast(pa.binary()).to_pylist()
            cols = [
                ids,
                pa.array([salt_of(i, parts) for i in ids.to_pylist()], pa.int32()),
                pa.array([digest(t) for t in texts], pa.binary()),
                pa.array([xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts], pa.int64()),
            ]
            names = ["id", "salt", *_KEYS]
            if with_content:
                cols.append(pa.array([squeeze(t) for t in texts], pa.binary()))
                names.append("content")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def salt_of(value, parts: int) -> int:
    return xxhash.xxh32_intdigest(repr(value).encode()) % parts


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=_sha256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest id stays; of rows with
    that text and id exactly one is marked kept. A null text counts as empty. A null id is smaller than all others: its row
    is kept only if all its group's ids are null (keep_id is then null). An empty table gives no rows; other columns are
    not read. text_sha256 is the digest in hex (of the normalised text in UTF-8).
    """
    kind, parts = dict(docs.dtypes)[id_col], salts(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = f"id {kind}, salt int, digest binary, mark bigint"
    full = src.mapInArrow(_keyed(True, digest, parts), schema + ", content binary")
    salted = full.groupBy(*_KEYS, "salt", "content").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    classes = (
        salted.groupBy(*_KEYS, "content")
        .agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))
        .select(*_KEYS, "keep_id", "group_size", "salts")
        .withColumn("variants", F.count("*").over(W.partitionBy(*_KEYS)))
        # Two contents with one digest and one second hash would need a break of SHA-256: stop rather than mix them up.
        .withColumn("group_size", F.when(F.col("variants") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two contents share both hashes")).cast("long")))
        .select(*_KEYS, F.explode("salts").alias("salt"), "keep_id", "group_size")
    )
    rows = src.mapInArrow(_keyed(False, digest, parts), schema)
    first = F.row_number().over(W.partitionBy(*_KEYS, "salt", "id").orderBy(F.lit(1))) == 1
    return (
        rows.join(classes, [*_KEYS, "salt"])
        .withColumn("first", first)
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & F.col("first")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, whole, with docs' columns.

    Of rows that repeat both id and text one stays. Rows with a null id stay, one a text, where no row with an id has their text.
    """
    kept = exact_dedup(docs, id_col, text_col).where("kept")
    name, nth = fresh(docs, "__key"), fresh(docs, "__n")
    key = lambda sha, i: F.concat(sha, F.coalesce(F.concat(F.lit(":"), i.cast("string")), F.lit("")))
    digest = F.sha2(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER).cast("binary"), 256)
    kept = kept.select(key(F.col("text_sha256"), F.col(id_col)).alias(name))
    rows = docs.withColumn(name, key(digest, F.col(id_col))).join(kept, name, "left_semi")
    # The join leaves rows hashed by key, so that this needs no exchange of its own; of rows that repeat id and text, any.
    return rows.withColumn(nth, F.row_number().over(W.partitionBy(name).orderBy(F.lit(1)))).where(F.col(nth) == 1).select(docs.columns)
