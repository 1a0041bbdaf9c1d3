"""File and archive names: symbols, collisions, rename plans."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from veilgrid.plans.numbering import number_rows

SYMBOLS = "not_utf8_name reserved_name_win forbidden_char_win trailing_dot_or_space too_long_name too_long_path case_collision normalization_collision".split()
_RESERVED = [*"CON PRN AUX NUL".split(), *(f"COM{i}" for i in range(10)), *(f"LPT{i}" for i in range(1, 10))]


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def name_symbols(entries: DataFrame, path: str = "path", folding=casefold, composing=nfc) -> DataFrame:
    """Entries with a column symbols: what may go wrong with each entry's name elsewhere, in the fixed order of SYMBOLS.

    Collisions are between different names in one folder, equal when folded or composed; all are counted by grouping on the
    folder and the folded name, no siblings are gathered. Spark strings are UTF-8, so not_utf8_name marks U+FFFD.
    """
    name, parent = F.substring_index(F.col(path), "/", -1), F.regexp_replace(F.col(path), r"[^/]*\z", "")
    e = entries.withColumn("__name", name).withColumn("__parent", parent).withColumn("__fold", folding(name)).withColumn("__nfc", composing(name))
    # Repeated rows of one name are no collision: more than one name, so least and greatest differ.
    apart = lambda by: (F.min("__name").over(W.partitionBy("__parent", by)) != F.max("__name").over(W.partitionBy("__parent", by)))
    base = F.when(F.contains("__name", F.lit(".")), F.regexp_replace("__name", r"\.[^.]*\z", "")).otherwise(F.col("__name"))
    tests = [
        F.contains("__name", F.lit("�")),
        F.upper(base).isin(_RESERVED) | F.upper("__name").isin(_RESERVED),
        F.col("__name").rlike(r'[<>:"|?*\\\x00-\x1F]'),
        F.col("__name").rlike(r"[. ]\z"),
        F.octet_length("__name") > 255,
        F.octet_length(path) > 240,
        apart("__fold"),
        apart("__nfc"),
    ]
    symbols = F.filter(F.array(*(F.when(t, F.lit(s)) for t, s in zip(tests, SYMBOLS))), lambda x: x.isNotNull())
    return e.withColumn("symbols", symbols).drop("__name", "__parent", "__fold", "__nfc")


def rename_plan(entries: DataFrame, template: str, path: str = "path", digest: Column | None = None) -> DataFrame:
    """Entries with new_path by a template of {seq}, {seq:w}, {stem}, {ext}, {parent}, {hash8}, and collision: the symbol, or null.

    Numbers follow the paths' byte order. A new path that another entry before it takes exactly, or when folded, collides.
    """
    name = F.substring_index(F.col(path), "/", -1)
    folder = F.regexp_replace(F.col(path), r"[^/]*\z", "")
    has_ext = name.rlike(r"^.+\.[^.]*\z")
    stem, ext = F.when(has_ext, F.regexp_replace(name, r"\.[^.]*\z", "")).otherwise(name), F.when(has_ext, F.regexp_extract(name, r"(\.[^.]*)\z", 1)).otherwise("")
    seq = F.col("__seq").cast("string")
    parts, at = [], 0
    for m in re.finditer(r"\{(seq(?::(\d+))?|stem|ext|parent|hash8)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[1].startswith("seq"):
            width = int(m[2] or 0)
            parts.append(F.lpad(seq, F.greatest(F.lit(width), F.length(seq)), F.lit("0")))
        elif m[1] == "hash8":
            if digest is None:
                raise ValueError("{hash8} needs a digest column")
            parts.append(F.substring(digest, 1, 8))
        else:
            parts.append({"stem": stem, "ext": ext, "parent": F.element_at(F.split(F.concat(F.lit("/"), F.rtrim(folder, F.lit("/"))), "/"), -1)}[m[1]])
    rest = template[at:]
    if "{" in rest or "}" in rest:
        raise ValueError("unknown field in the template")
    new = F.concat(folder, *parts, F.lit(rest))
    numbered = number_rows(entries.withColumn("__order", F.col(path).cast("binary")), ["__order"], "__seq")
    out = numbered.withColumn("new_path", new).drop("__order", "__seq")
    nth = lambda key: F.row_number().over(W.partitionBy(key).orderBy(F.col(path).cast("binary")))
    return out.withColumn("collision", F.when(nth(F.col("new_path")) > 1, "exact").when(nth(F.lower("new_path")) > 1, "casefold"))


def archive_symbols(entries: DataFrame, path: str = "path", order: str = "pos", folding=casefold) -> DataFrame:
    """Entries with symbol: absolute_path, drive_letter, parent_ref, collision or null; a backslash separates like a slash.

    A collision is an entry whose name (or folded name) an earlier sound entry has, or a path within an earlier file entry.
    """
    checked = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    sound = F.when(checked.startswith("/"), "absolute_path").when(checked.rlike(r"^[A-Za-z]:(/|\z)"), "drive_letter").when(checked.rlike(r"(^|/)\.\.(/|\z)"), "parent_ref")
    e = entries.withColumn("__bad", sound).withColumn("__base", F.regexp_replace(checked, r"/+\z", "")).withColumn("__file", ~checked.endswith("/"))
    e = e.withColumn("__fold", folding(F.col("__base")))
    again = F.col("__bad").isNull() & (F.row_number().over(W.partitionBy("__bad", "__fold").orderBy(order)) > 1)
    files = e.where("__bad IS NULL AND __file").groupBy(F.col("__base").alias("__up")).agg(F.min(order).alias("__first"))
    # Every proper prefix of a path that ends before a slash is looked up: an equi-join, not a prefix join.
    parts = F.split("__base", "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    nested = (
        e.where("__bad IS NULL").select(path, order, F.explode(F.when(F.size(parts) > 1, ups)).alias("__up"))
        .join(files, "__up").where(F.col("__first") < F.col(order)).select(path, order).distinct().withColumn("__in", F.lit(True))
    )
    e = e.withColumn("__again", again).join(nested, [path, order], "left")
    symbol = F.coalesce("__bad", F.when(F.col("__again") | F.coalesce("__in", F.lit(False)), "collision"))
    return e.withColumn("symbol", symbol).drop("__bad", "__base", "__file", "__fold", "__again", "__in")
