"""What a gate run adds to the items' own results: lanes for tables and images, stages of reasons, pairs and findings looked up, totals, receipts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.operators.anonymize import Config, Result, anonymize
from veilgrid.operators.diff import duplicate_groups, hash_tree
from veilgrid.operators.gate import kind_of
from veilgrid.plans.numbering import number_rows
from veilgrid.sources import sinks

#: Reason -> stage: what can be mended at the file, in the environment, or is left out by design.
UNOBSERVED_STAGES = {r: s for s, rs in {"remedy": "refused parse_failed unreadable too_large symlink_skipped", "environment": "engine_unavailable", "excluded": "not_applicable empty_input"}.items() for r in rs.split()}
NOT_PRODUCED_STAGES = {r: s for s, rs in {"remedy": "needs_settings engine_refused write_failed", "environment": "engine_unavailable", "excluded": "not_applicable"}.items() for r in rs.split()}


def _stage(reason: Column, stages: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for pair in stages.items() for x in pair))
    unknown = F.raise_error(F.concat(F.lit("unknown reason: "), reason)).cast("string")
    return F.when(reason.isNotNull(), F.coalesce(F.try_element_at(known, reason), unknown))


def unobserved_stage(reason: Column) -> Column:
    """Null for null; a reason outside the closed list raises."""
    return _stage(reason, UNOBSERVED_STAGES)


def not_produced_stage(reason: Column, unobserved: Column) -> Column:
    """As unobserved_stage, of reasons for which nothing was produced; `unobserved` takes the stage of the item's own reason."""
    own = F.when(reason == "unobserved", F.coalesce(unobserved_stage(unobserved), F.raise_error(F.lit("unobserved needs its reason")).cast("string")))
    return F.coalesce(own, _stage(F.when(reason != "unobserved", reason), NOT_PRODUCED_STAGES))


def without_short_circuits(pairs: DataFrame, mark: str = "short_circuited") -> DataFrame:
    """pairs that an engine compared in full, without the mark."""
    return pairs.where(~F.coalesce(F.col(mark), F.lit(False))).drop(mark)


def short_circuits(pairs: DataFrame, mark: str = "short_circuited") -> DataFrame:
    """kept, excluded: how many pairs were compared in full, and how many an engine cut short."""
    return pairs.agg(F.count_if(~F.coalesce(F.col(mark), F.lit(False))).alias("kept"), F.count_if(F.coalesce(F.col(mark), F.lit(False))).alias("excluded"))


def path_less(items: DataFrame, path: str = "path") -> DataFrame:
    """items with index (1, 2, ... in the order of the paths' bytes) in place of their paths."""
    keyed = items.withColumn("__bytes", F.col(path).cast("binary"))
    return number_rows(keyed, ["__bytes"], "index").drop("__bytes", path)


def with_worksheets(audit: DataFrame, worksheets: DataFrame, sha: str = "sentence_sha256") -> DataFrame:
    """Each audited sentence with the worksheet of the same digest (of several the smallest), and whether there is one."""
    one = worksheets.groupBy(sha).agg(F.min("worksheet").alias("worksheet"))
    return audit.join(one, sha, "left").withColumn("answered", F.col("worksheet").isNotNull())


def findings_by_column(columns: DataFrame, findings: DataFrame) -> DataFrame:
    """column, findings (code -> count): of each column its findings (column, code, count), counts of one code added up; none: an empty map."""
    sums = findings.groupBy("column", "code").agg(F.sum("count").alias("n")).where("n > 0")
    maps = sums.groupBy("column").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("findings"))
    return columns.join(maps, "column", "left").withColumn("findings", F.coalesce("findings", F.create_map().cast("map<string,bigint>")))


def version_drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """name, recorded, current: engines (name, version) of a receipt that are absent now or have another version."""
    j = recorded.select("name", F.col("version").alias("recorded")).join(current.select("name", F.col("version").alias("current")), "name", "left")
    return j.where(~F.col("recorded").eqNullSafe(F.col("current")))


def duplicate_totals(files: DataFrame, key: str = "sha256", name: str = "path", size: str = "bytes") -> DataFrame:
    """items, duplicate_groups, duplicate_files, duplicate_bytes (of all files of the groups)."""
    sizes = files.groupBy(key).agg(F.max(size).alias("__size"))
    g = duplicate_groups(files, key, name).join(sizes, key)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    totals = g.agg(F.count("*").alias("duplicate_groups"), zero(F.sum("n")).alias("duplicate_files"), zero(F.sum(F.col("n") * F.col("__size"))).alias("duplicate_bytes"))
    return files.agg(F.count("*").alias("items")).crossJoin(totals)  # a row by a row


def summary_consistent(summary: dict, pairs: list[dict]) -> bool:
    """Whether a cohort receipt's counts fit the flagged pairs that it lists (each of one lane) and one another."""
    lanes = ("referee", "scope", "generic")
    own = [[lane for lane in lanes if lane in p] for p in pairs]
    if summary.get("flagged") != len(pairs) or any(len(x) != 1 for x in own):
        return False
    n = {lane: sum(x == [lane] for x in own) for lane in lanes}
    texts = summary.get("referee") or {}
    marked = texts.get("RED", 0) + texts.get("YELLOW", 0)
    if texts and (marked != n["referee"] or texts.get("GREEN", 0) != texts.get("total", 0) - marked):
        return False
    return all(not summary.get(lane) or summary[lane].get("pairs", 0) == n[lane] for lane in ("scope", "generic"))


def path_fields(path: Column) -> Column:
    """struct(path, path_hex) of a path's bytes: the text where they are UTF-8, else null and the bytes in hex."""
    text = path.cast("string")
    ok = F.is_valid_utf8(text)
    return F.struct(F.when(ok, text).alias("path"), F.when(~ok, F.lower(F.hex(path))).alias("path_hex"))


#: What a file of an image kind begins with.
_IMAGES = {"png": b"\x89PNG\r\n\x1a\n", "jpg": b"\xff\xd8\xff", "jpeg": b"\xff\xd8\xff"}


def gate_images(files: DataFrame) -> DataFrame:
    """files (path, content) of the image lane -> path, status, produced, reason, unobserved_reason: observed, and never produced, as regions to mask are a setting."""
    i = files.where(kind_of(F.col("path")) == "image")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)\z", 1))
    ok = F.lit(False)
    for name, head in _IMAGES.items():
        ok = ok | ((ext == name) & (F.substring("content", 1, len(head)) == F.lit(bytearray(head))))
    why = F.when(F.col("content").isNull(), "too_large").when(~ok, "refused")
    return i.select("path", F.when(why.isNull(), "clean").otherwise("unobserved").alias("status"), F.lit(False).alias("produced"), F.when(why.isNull(), "needs_settings").otherwise("unobserved").alias("reason"), why.alias("unobserved_reason"))


def gate_tables(paths: list[str], read: Callable[[str], DataFrame], config: Config | None, **options) -> list[tuple[str, bool, str | None, Result | None]]:
    """path, produced, reason, result of each table file: made anonymous where there is a config, else needs_settings; a refusal of the reader or the config's is engine_refused.

    paths are the files of a folder's table lane, each a job of its own; rows never come to the driver.
    """
    out = []
    for path in paths:
        if config is None:
            out.append((path, False, "needs_settings", None))
            continue
        try:
            result = anonymize(read(path), config, **options)
        except Exception:  # whatever the reader refuses, as Spark reports it
            out.append((path, False, "engine_refused", None))
            continue
        out.append((path, result.table is not None, None if result.table is not None else "engine_refused", result))
    return out


def gate_receipt(summary: dict[str, int], inputs: DataFrame, key: bytes | None = None) -> dict:
    """The sealed receipt of a run. Under a key it is bound to the whole checksum of the input listing (path, sha256) and has a check code."""
    receipt = {"kind": "gate", "summary": dict(summary)}
    overall = ""
    if key is not None:
        overall = hash_tree(inputs).where("dir = ''").first()["sha256"]
        receipt["summary"]["overall_sha256"] = overall
    return sinks.sealed(receipt, key, overall)


def verify_receipt(receipt: dict, inputs: DataFrame, key: bytes | None = None) -> str:
    """match, differs or not_verifiable: the digest, and under a key the inputs' checksum and the check code."""
    overall = receipt.get("summary", {}).get("overall_sha256", "")
    if key is not None and overall and hash_tree(inputs).where("dir = ''").first()["sha256"] != overall:
        return "differs"
    return sinks.verify(receipt, key, overall)
