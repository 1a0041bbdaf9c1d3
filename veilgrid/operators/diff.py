"""Differences: keyed tables, file lists, receipts; duplicates and hash trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

STATES = "same changed removed added".split()


def _text(c):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def table_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys as strings, state (same, changed, removed, added) and columns (names that changed, sorted), by full outer join.

    Keys that repeat on either side leave the comparison (see duplicate_keys): each side becomes one row a key before the join,
    so a key of many rows is never multiplied. Cells are compared as strings, null as empty (in keys, too), in the columns that
    both sides have; rows of blank cells only are skipped.
    """
    common = sorted(set(a.columns) & set(b.columns) - set(keys))

    def side(df, name):
        some = F.lit(False)
        for c in df.columns:
            some = some | (_text(c) != "")
        rows = df.where(some).select(*(_text(k).alias(k) for k in keys), F.struct(F.lit(1).alias("here"), *(_text(c).alias(c) for c in common)).alias(name))
        # Rows of a key are combined before the exchange, which is also that of the join.
        return rows.groupBy(*keys).agg(F.count("*").alias(f"{name}n"), F.first(name).alias(name))

    j = side(a, "__a").join(side(b, "__b"), keys, "full_outer")
    j = j.where((F.coalesce("__an", F.lit(1)) == 1) & (F.coalesce("__bn", F.lit(1)) == 1))
    changed = F.filter(F.array(*(F.when(F.col(f"__a.{c}") != F.col(f"__b.{c}"), F.lit(c)) for c in common)), lambda x: x.isNotNull()) if common else F.array().cast("array<string>")
    state = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("same")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return j.select(*keys, state.alias("state"), F.when(both, changed).otherwise(F.array().cast("array<string>")).alias("columns"))


def duplicate_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, as strings, that repeat in a or in b."""
    rep = lambda df: df.select(*(_text(k).alias(k) for k in keys)).groupBy(*keys).count().where("count > 1").select(*keys)
    return rep(a).union(rep(b)).distinct()


def duplicate_groups(files: DataFrame, key: str, name: str, content: str | None = None) -> DataFrame:
    """key, n, least: groups of two or more rows with one key; with content, only rows of equal content are a group."""
    by = [key] if content is None else [key, content]
    if content is not None:  # contents are only moved where keys are equal
        files = files.join(files.groupBy(key).count().where("count > 1").select(key), key, "left_semi")
    return files.groupBy(*by).agg(F.count("*").alias("n"), F.min(name).alias("least")).where("n >= 2").select(key, "n", "least")


def folder_diff(a: DataFrame, b: DataFrame, path: str = "path", sha: str = "sha256") -> DataFrame:
    """path, state (same, changed, removed, added, moved), moved_to, ambiguous.

    A digest that is both among the removed and the added makes one moved pair, of the smallest paths; ambiguous marks it where
    either side has more of it.
    """
    j = a.select(F.col(path).alias("path"), F.col(sha).alias("x")).join(b.select(F.col(path).alias("path"), F.col(sha).alias("y")), "path", "full_outer")
    j = j.withColumn("state", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") == F.col("y"), "same").otherwise("changed"))
    one = j.where("state IN ('removed', 'added')").groupBy(F.coalesce("x", "y").alias("sha")).agg(
        F.min(F.when(F.col("state") == "removed", F.col("path"))).alias("from_"), F.min(F.when(F.col("state") == "added", F.col("path"))).alias("to_"),
        F.count_if(F.col("state") == "removed").alias("r"), F.count_if(F.col("state") == "added").alias("s"),
    ).where("from_ IS NOT NULL AND to_ IS NOT NULL")
    moved = one.select(F.col("from_").alias("path"), F.col("to_").alias("moved_to"), ((F.col("r") > 1) | (F.col("s") > 1)).alias("ambiguous"))
    gone = one.select(F.col("to_").alias("path"))
    out = j.join(gone, "path", "left_anti").join(moved, "path", "left")
    return out.select("path", F.when(F.col("moved_to").isNotNull(), "moved").otherwise(F.col("state")).alias("state"), "moved_to", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def manifest_check(wanted: DataFrame, present: DataFrame, path: str = "path", sha: str = "sha256") -> DataFrame:
    """path, reason: input_missing, input_changed, item_added; equal entries are left out."""
    j = wanted.select(path, F.col(sha).alias("__w")).join(present.select(path, F.col(sha).alias("__p")), path, "full_outer")
    reason = F.when(F.col("__p").isNull(), "input_missing").when(F.col("__w").isNull(), "item_added").when(F.col("__w") != F.col("__p"), "input_changed")
    return j.select(path, reason.alias("reason")).where("reason IS NOT NULL")


def first_reasons(found: DataFrame, item: str = "item", priority: str = "priority") -> DataFrame:
    """One row per item: the reason of least priority number."""
    return found.withColumn("__n", F.row_number().over(W.partitionBy(item).orderBy(priority))).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and new; where both have a key, new's row."""
    both = old.withColumn("__p", F.lit(1)).unionByName(new.withColumn("__p", F.lit(0)))
    return first_reasons(both, key, "__p").drop("__p")


def hash_tree(files: DataFrame, path: str = "path", sha: str = "sha256", folders: list[str] = ()) -> DataFrame:
    """dir, sha256: of every folder ('' is the root), from its rows `kind NUL name NUL child's digest LF` in order of name bytes and kind.

    One grouping a level of depth, deepest first. folders: empty ones to be counted, too.
    """
    spark = files.sparkSession
    parent = lambda p: F.regexp_replace(p, r"(^|/)[^/]*\z", "")
    nodes = files.select(F.col(path).alias("p"), F.col(sha).alias("h")).withColumn("kind", F.lit("f"))
    dirs = nodes.select(F.split("p", "/").alias("s")).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda n: F.array_join(F.slice("s", F.lit(1), n), "/"))).alias("d"))
    extra = [x for f in folders for x in ["/".join(f.split("/")[: i + 1]) for i in range(len(f.split("/")))]]
    dirs = dirs.union(spark.createDataFrame([(x,) for x in ["", *extra]], "d string")).distinct().persist()
    deepest = dirs.agg(F.max(F.when(F.col("d") == "", 0).otherwise(F.size(F.split("d", "/"))))).first()[0]
    depth = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, "/")))
    out, below = None, None
    for level in range(deepest, -1, -1):
        own = nodes.where((F.size(F.split("p", "/")) == level + 1)).select("p", "h", "kind")
        kids = own if below is None else own.union(below.select(F.col("d").alias("p"), "h", F.lit("d")))
        zero = F.lit(bytearray(b"\0"))
        line = F.concat(F.col("kind").cast("binary"), zero, F.substring_index("p", "/", -1).cast("binary"), zero, F.col("h").cast("binary"), F.lit(bytearray(b"\n")))
        kids = kids.select(parent(F.col("p")).alias("d"), F.struct(F.substring_index("p", "/", -1).cast("binary").alias("n"), "kind", line.alias("line")).alias("r"))
        joined = kids.groupBy("d").agg(F.array_sort(F.collect_list("r")).alias("rs"))
        here = dirs.where(depth("d") == level).join(joined, "d", "left")
        hexes = F.array_join(F.transform(F.coalesce("rs", F.array().cast("array<struct<n:binary,kind:string,line:binary>>")), lambda r: F.hex(r["line"])), "")
        below = here.select("d", F.sha2(F.unhex(hexes), 256).alias("h"))
        out = below if out is None else out.union(below)
    return out.select(F.col("d").alias("dir"), F.col("h").alias("sha256"))
