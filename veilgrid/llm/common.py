"""Helpers that the training-data operators share."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.plans.storage import drop_folder, shared_folder
from veilgrid.plans.storage import stored as _stored

__all__ = ["drop_folder", "shared_folder"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The characters that separate words: space and U+0009 to U+000D.
BLANKS = "\t\n\x0b\x0c\r "
#: bytes.translate table that lower-cases A-Z and leaves all other bytes, so all of UTF-8's others, alone.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def crc_mod_py(value, n: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    return _stored(df, name, folder or shared_folder(df.sparkSession, "table"))


def salts(spark: SparkSession) -> int:
    """Parts that a hot key is split in: as many as tasks of a shuffle, so that a key that a third of all rows share is no larger a part than others."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
