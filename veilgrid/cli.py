"""python -m veilgrid VERB ...: inspect, audit, scan, run, diff, draw, redact, manifest, verify.

Exit codes: 0 done or equal, 1 different or refused, 2 not verifiable or bad settings.
"""

from __future__ import annotations

import argparse
import json
import re
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from veilgrid.operators import diff, hints, profile, redact, risk
from veilgrid.operators.anonymize import anonymize, parse_config
from veilgrid.operators.draw import draw
from veilgrid.sources import sinks
from veilgrid.sources.encodings import Refused
from veilgrid.sources.files import files, lines
from veilgrid.sources.tables import StrictTable


def _read(spark: SparkSession, path: str) -> DataFrame:
    """Parquet as it is; other formats strictly, all strings, in file order."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    spark.dataSource.register(StrictTable)
    return spark.read.format("strict_table").load(path)


def _show(df: DataFrame, out) -> None:
    for r in df.toLocalIterator():
        out.write(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str) + "\n")


def main(argv: list[str] | None = None, out=sys.stdout) -> int:
    p = argparse.ArgumentParser(prog="veilgrid")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, args in {"inspect": ["table"], "scan": ["table"], "audit": ["table", "-c"], "run": ["table", "-c", "-o"], "diff": ["a", "b", "--key"], "draw": ["roster", "--seed", "--groups"], "redact": ["table", "--id", "--text", "--rules", "-o"], "manifest": ["folder", "-o"], "verify": ["receipt", "folder"]}.items():
        v = verbs.add_parser(verb)
        for a in args:
            v.add_argument(a, **({"required": a in ("-c", "-o", "--key", "--seed", "--id", "--text")} if a.startswith("-") else {}))
    v = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        return _run(spark, v, out)
    except Refused as e:
        out.write(json.dumps({"refused": e.code}) + "\n")
        return 1
    except PySparkException as e:  # the source's refusals come back as text
        if not (m := re.search(r"Refused: (\w+)", str(e))):
            raise
        out.write(json.dumps({"refused": m[1]}) + "\n")
        return 1
    except (ValueError, OSError) as e:
        out.write(json.dumps({"error": str(e)}, ensure_ascii=False) + "\n")
        return 2


def _run(spark: SparkSession, v, out) -> int:
    if v.verb == "inspect":
        _show(profile.inspect(_read(spark, v.table).drop("_rid")), out)
    elif v.verb == "scan":
        _show(hints.candidates(hints.scan(_read(spark, v.table).drop("_rid"))), out)
    elif v.verb == "audit":
        cfg = parse_config(json.load(open(v.c, encoding="utf-8")))
        _show(risk.audit(_read(spark, v.table), cfg.by_role("qi"), cfg.k), out)
    elif v.verb == "run":
        cfg = parse_config(json.load(open(v.c, encoding="utf-8")))
        table = _read(spark, v.table)
        result = anonymize(table.orderBy("_rid").drop("_rid") if "_rid" in table.columns else table, cfg)
        if result.table is None:
            out.write(json.dumps({"refused": result.reason, **result.report}, ensure_ascii=False, default=str) + "\n")
            return 1
        sha = sinks.write_table(result.table, v.o)
        receipt = sinks.sealed({"kind": "crowd", "output_sha256": f"sha256:{sha}", **json.loads(json.dumps(result.report, default=str))})
        sinks.write_atomic(v.o + ".receipt.json", sinks.canonical(receipt))
    elif v.verb == "diff":
        rows = diff.table_diff(_read(spark, v.a).drop("_rid"), _read(spark, v.b).drop("_rid"), v.key.split(","))
        counts = {r["state"]: r["count"] for r in rows.groupBy("state").count().collect()}
        twice = diff.duplicate_keys(_read(spark, v.a), _read(spark, v.b), v.key.split(",")).count()
        out.write(json.dumps({s: counts.get(s, 0) for s in diff.STATES} | {"duplicate_keys": twice}) + "\n")
        return int(twice > 0 or any(counts.get(s) for s in diff.STATES[1:]))
    elif v.verb == "draw":
        _show(draw(lines(spark, v.roster), "item", v.seed, groups=int(v.groups) if v.groups else None).orderBy("position"), out)
    elif v.verb == "redact":
        rules = redact.parse_rules(open(v.rules, encoding="utf-8").read()) if v.rules else redact.DEFAULT
        done = redact.redact(_read(spark, v.table), v.id, v.text, rules)
        done.write.mode("overwrite").parquet(v.o)
        _show(redact.mode_counts(spark.read.parquet(v.o)), out)
    elif v.verb == "manifest":
        rows = files(spark, v.folder).select("path", "bytes", "sha256").orderBy("path")
        tree = diff.hash_tree(rows).where("dir = ''").first()["sha256"]
        receipt = sinks.sealed({"kind": "manifest", "overall": f"sha256:{tree}", "files": [r.asDict() for r in rows.toLocalIterator()]})
        sinks.write_atomic(v.o, sinks.canonical(receipt))
    elif v.verb == "verify":
        receipt = json.load(open(v.receipt, encoding="utf-8"))
        if receipt.get("kind") != "manifest":
            return 2
        if sinks.verify(receipt) != "match":
            return 1
        wanted = spark.createDataFrame([(f["path"], f["sha256"]) for f in receipt["files"]], "path string, sha256 string")
        found = diff.manifest_check(wanted, files(spark, v.folder).select("path", "sha256"))
        _show(found, out)
        return int(found.count() > 0)
    return 0
