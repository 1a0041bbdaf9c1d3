"""Line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host; a line's frequency is the number of the host's pages that contain it over the host's pages.
Lines are counted by 128-bit digest, so that no text is shuffled for counting. Joins on (host, line) are salted: the hot
line of a hot host is spread over SALTS tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import shared_folder, stored

SALTS = 16
#: What begins a new line: the ends and beginnings of block elements.
_BLOCK = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|title|nav|header|footer|article|section|main|aside|body|head|html|blockquote|pre|form|option)\b[^>]*>"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and trailing dot; '' where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*?)\.?(?:[:/?#]|$)", 1), F.lit(""))


def html_text(html: Column) -> Column:
    """Visible text of HTML: scripts, styles and comments out, a new line at block elements, other tags out, five entities decoded."""
    x = F.coalesce(html, F.lit(""))
    x = F.regexp_replace(x, r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", "")
    x = F.regexp_replace(x, _BLOCK, "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def lines_of(text: Column) -> Column:
    """The non-blank lines, trimmed of blanks, in order."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.regexp_replace(s, r"^[ \t\r\x0b\x0c]+|[ \t\r\x0b\x0c]+$", "")), lambda s: s != "")


def line_dedup(
    pages: DataFrame,
    host: Column,
    text: Column,
    id_col: str = "page_id",
    ratio: float = 0.2,
    min_pages: int = 3,
) -> DataFrame:
    """One row per input row: id, host, n_lines, n_dropped, text (the lines kept, joined by new lines).

    A line goes if more than ratio of its host's pages, and at least min_pages of them, contain it (with few pages a share
    says nothing). A page counts once for a line however often it repeats it; repeated rows count as pages of their own. Pages
    with no host form one host ''. Null and empty texts have no lines; null ids are kept; an empty table gives no rows; other
    columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(host, F.lit("")).alias("host"), lines_of(text).alias("lines"))
    # The key of a row is its content: rows of equal content get equal results.
    rows = rows.withColumn("key", F.md5(F.to_json(F.struct("id", "host", "lines"), {"ignoreNullFields": "false"}).cast("binary")))
    # Four branches read the lines: extract them once.
    rows = stored(rows, "lines", shared_folder(pages.sparkSession, "line_dedup"))
    marks = F.transform("lines", lambda s: F.unhex(F.md5(s.cast("binary"))))
    each = rows.select("host", F.explode(F.array_distinct(marks)).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = rows.groupBy("host").agg(F.count("*").alias("of"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    common = (
        counts.withColumn("salt", F.pmod(F.xxhash64("line"), F.lit(SALTS)).cast("int"))
        .join(totals.select("host", "of", salts), ["host", "salt"])
        .where(F.col("n") > ratio * F.col("of"))
        .select("host", "line")
    )
    places = rows.select("key", "host", F.posexplode(marks).alias("at", "line")).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    gone = places.join(common.select("host", "line", salts), ["host", "line", "salt"]).groupBy("key").agg(F.collect_set("at").alias("gone"))
    out = rows.join(gone, "key", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.filter("lines", lambda s, i: ~F.array_contains(F.col("gone"), i))
    return out.select(F.col("id").alias(id_col), "host", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("text"))
