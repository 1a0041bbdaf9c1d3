"""What columns hold: shapes, hidden characters, leaks, derived relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import text as T

MIN_SUPPORT, PAIR_LIMIT, MAX_CELL_CHARS = 50, 400, 4096


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value: all cells of the columns as strings; null: empty."""
    return df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns))))


def inspect(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, distinct, empty, unique_ratio (4 places), shape (integer, date or text), of stripped values; all columns in one grouping."""
    c = cells(df, columns or df.columns).select("column", T.strip(F.col("value")).alias("v")).groupBy("column", "v").agg(F.count("*").alias("n"))
    full = F.col("v") != ""
    is_int, is_date = F.col("v").rlike(r"(?U)^[+-]?\d+\z"), F.col("v").rlike(r"(?U)^\d\d\d\d(?:-\d\d){2}\z")
    c = c.groupBy("column").agg(F.count_if(full).alias("distinct"), F.coalesce(F.sum(F.when(~full, F.col("n"))), F.lit(0)).alias("empty"), F.sum("n").alias("n"), F.bool_and(~full | is_int).alias("i"), F.bool_and(~full | is_date).alias("d"))
    shape = F.when((F.col("distinct") > 0) & F.col("i"), "integer").when((F.col("distinct") > 0) & F.col("d"), "date").otherwise("text")
    held = F.col("n") - F.col("empty")
    return c.select("column", "distinct", "empty", F.when(held > 0, F.round(F.col("distinct") / held, 4)).otherwise(0.0).alias("unique_ratio"), shape.alias("shape"))


def hidden_chars(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows, chars, kinds (sorted): cells with invisible characters; columns without any are left out."""
    c = cells(df, columns)
    counts = [T.invisible_count(F.col("value"), k).alias(k) for k in T.INVISIBLE]
    kinds = list(T.INVISIBLE)
    c = c.select("column", *counts).withColumn("all", sum((F.col(k) for k in kinds), F.lit(0))).where(F.col("all") > 0)
    c = c.groupBy("column").agg(F.count("*").alias("rows"), F.sum("all").alias("chars"), *(F.max(k).alias(k) for k in kinds))
    return c.select("column", "rows", "chars", F.array_sort(F.filter(F.array(*(F.when(F.col(k) > 0, F.lit(k)) for k in kinds)), lambda x: x.isNotNull())).alias("kinds"))


def derived(df: DataFrame, keep: list[str], qi: list[str], norm=T.nfc_strip) -> DataFrame:
    """keep, qi, relation (reveals_qi, implied_by_qi), groups, support, violations, verdict (unchecked, trivial, flagged, clear).

    All pairs (PAIR_LIMIT at most, in order) are crossed in one grouping; empty cells aren't compared.
    """
    pairs = [(x, q) for x in keep for q in qi if x != q][:PAIR_LIMIT]
    if not pairs:
        return df.sparkSession.createDataFrame([], "keep string, qi string, relation string, groups bigint, support bigint, violations bigint, verdict string")
    used = sorted({c for p in pairs for c in p})
    normal = df.select(*(norm(F.col(c)).alias(c) for c in used))
    cross = normal.select(F.inline(F.array(*(F.struct(F.lit(i).alias("p"), F.col(x).alias("x"), F.col(q).alias("q")) for i, (x, q) in enumerate(pairs)))))
    cross = cross.where("x <> '' AND q <> ''").groupBy("p", "x", "q").agg(F.count("*").alias("n"))
    side = lambda c: cross.groupBy("p", c).agg(F.sum("n").alias("s"), F.max("n").alias("m")).groupBy("p").agg(F.count("*").alias("groups"), F.sum("s").alias("support"), (F.sum("s") - F.sum("m")).alias("violations"))
    a, b = side("x"), side("q")
    named = df.sparkSession.createDataFrame([(i, x, q) for i, (x, q) in enumerate(pairs)], "p int, keep string, qi string")
    rows = named.join(F.broadcast(a.join(b.select("p", F.col("groups").alias("others")), "p")), "p", "left").withColumn("relation", F.lit("reveals_qi"))
    rows = rows.unionByName(named.join(F.broadcast(b.join(a.select("p", F.col("groups").alias("others")), "p")), "p", "left").withColumn("relation", F.lit("implied_by_qi")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = rows.select("keep", "qi", "relation", *(zero(c).alias(c) for c in ("groups", "support", "violations", "others")))
    s, m, v = F.col("support"), F.col("groups"), F.col("violations")
    verdict = F.when(s < MIN_SUPPORT, "unchecked").when((m == 1) | (F.col("others") == 1) | (s == m), "trivial").when((100 * v <= s) & (10 * v <= s - m), "flagged").otherwise("clear")
    return rows.select("keep", "qi", "relation", "groups", "support", "violations", verdict.alias("verdict"))


def check_values(df: DataFrame, column: str, check: dict) -> DataFrame:
    """match, mismatch, cannot_check over the distinct values of a column; check: {'set': [...]}, {'range': (lo, hi)}, {'shape': ...}, {'luhn': True}, {'my_number': True} or {'email': True}."""
    (kind, arg), = check.items()
    v = F.col("v")
    plain = F.replace(v, F.lit("-"), F.lit(""))
    ok = {
        "set": lambda: v.isin(list(arg)),
        "range": lambda: v.try_cast("decimal(38,10)").between(*arg),
        "shape": lambda: v.rlike(T.compile_shape(arg)),
        "luhn": lambda: T.luhn_ok(plain),
        "my_number": lambda: T.my_number_ok(plain),
        "email": lambda: v.rlike("^(?:" + T.EMAIL + r")\z"),
    }[kind]()
    rows = cells(df, [column]).where("value <> ''").groupBy(T.strip(F.col("value")).alias("v")).agg(F.count("*").alias("n"))
    state = F.when(ok.isNull(), "cannot_check").when(ok, "match").otherwise("mismatch")
    return rows.agg(*(F.coalesce(F.sum(F.when(state == s, F.col("n"))), F.lit(0)).alias(s) for s in ("match", "mismatch", "cannot_check")))


def leaks(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, rule, cells, checked, skipped: cells with at least one token (also without its dashes) that is an e-mail address, card number, 12-digit or 13-digit number of right check digit."""
    c = cells(df, columns).where("value <> ''")
    long = F.length("value") > MAX_CELL_CHARS
    tokens = F.regexp_extract_all("value", F.lit(T.TOKENS), F.lit(0))
    bare = F.transform(tokens, lambda t: F.replace(t, F.lit("-"), F.lit("")))
    some = lambda f, xs: F.exists(xs, lambda t: F.coalesce(f(t), F.lit(False)))
    rules = {
        "email": some(lambda t: t.rlike("^(?:" + T.EMAIL + r")\z"), tokens),
        "card": some(T.luhn_ok, F.concat(tokens, bare)),
        "my_number": some(T.my_number_ok, F.concat(tokens, bare)),
        "corporate": some(T.corporate_number_ok, F.concat(tokens, bare)),
    }
    c = c.select("column", long.alias("long"), *(F.when(~long, r).alias(k) for k, r in rules.items()))
    c = c.groupBy("column").agg(F.count_if(~F.col("long")).alias("checked"), F.count_if("long").alias("skipped"), *(F.count_if(F.coalesce(F.col(k), F.lit(False))).alias(k) for k in rules))
    return c.select("column", F.inline(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("cells"), "checked", "skipped") for k in rules))))


def forms(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, mixed_form (full and half width in one cell), japanese_era (era dates): cells that show each."""
    c = cells(df, columns)
    mixed = F.col("value").rlike("[A-Za-z0-9]") & F.col("value").rlike("[\\x{FF10}-\\x{FF19}\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}]")
    era = F.col("value").rlike("(?:明治|大正|昭和|平成|令和)(?:元|[0-9０-９]{1,2})年")
    return c.groupBy("column").agg(F.count_if(mixed).alias("mixed_form"), F.count_if(era).alias("japanese_era"))
