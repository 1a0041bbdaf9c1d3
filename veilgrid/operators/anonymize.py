"""k-anonymity with l-diversity: least-loss generalization, suppression of what is left, and measurement of the output itself."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.functions.text import nfc_strip, pseudonym
from veilgrid.operators.draw import shuffled
from veilgrid.operators.generalize import make, resolve
from veilgrid.operators.risk import diagnose, measure
from veilgrid.plans.lattice import Infeasible, Lattice, SearchLimit

ROLES = "id qi sensitive keep drop".split()
REFUSALS = "no_records resource_limit_rows missing_exceeds_budget infeasible resource_limit_search verification_failed".split()


@dataclass
class Config:
    """columns: name -> {'role': one of ROLES, 'action': drop or pseudonym (id), 'gen': generalizer settings (qi)}."""

    columns: dict[str, dict]
    missing: str = "star"
    max_suppression: float = 0.05
    l: int = 1
    k: int = 5
    shuffle: bool = True
    seed: int = 0
    max_rows: int = 200_000
    max_evals: int = 20_000
    key: bytes | None = None

    def __post_init__(self):
        if self.k < 2 or self.l < 1 or not 0 <= self.max_suppression < 1 or self.missing not in ("star", "suppress"):
            raise ValueError("k >= 2, l >= 1, 0 <= max_suppression < 1, missing: star or suppress")
        if any(c.get("role") not in ROLES for c in self.columns.values()) or not self.by_role("qi"):
            raise ValueError("every column needs a role, and at least one qi")
        if self.key is None and any(c["role"] == "id" and c.get("action", "drop") != "drop" for c in self.columns.values()):
            raise ValueError("pseudonyms need a key")

    def by_role(self, role: str) -> list[str]:
        return [c for c, s in self.columns.items() if s["role"] == role]


@dataclass
class Result:
    status: str
    reason: str | None = None
    table: DataFrame | None = None
    report: dict = field(default_factory=dict)


def parse_config(obj: dict, **over) -> Config:
    """From the JSON form; keys that begin with _ are notes."""
    settings = dict(filter(lambda kv: kv[0][:1] != "_", obj.items())) | over
    settings.pop("lang", None)
    for theirs, ours in (("missing_value_policy", "missing"), ("shuffle_seed", "seed")):
        if theirs in settings:
            settings[ours] = settings.pop(theirs)
    unknown = set(settings) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown setting: {min(unknown)}")
    return Config(**settings)


def anonymize(df: DataFrame, cfg: Config, order: list[str] | None = None, norm=nfc_strip) -> Result:
    """order: columns that fix the rows' order, which the shuffle starts from (default: all, as they are).

    All passes over rows are one collapse to classes with every level's label, one join-free projection of the output and its
    measurement; the search runs on the classes.
    """
    missing_columns = [c for c in df.columns if c not in cfg.columns]
    if missing_columns or set(cfg.columns) - set(df.columns):
        raise ValueError("the roles must name every column of the table and no other")
    header, qi, sens = df.columns, [c for c in df.columns if cfg.columns[c]["role"] == "qi"], [c for c in df.columns if cfg.columns[c]["role"] == "sensitive"]
    df = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in header))
    keyed = df.select("*", *(norm(F.col(c)).alias(f"__q{i}") for i, c in enumerate(qi))).persist(StorageLevel.MEMORY_AND_DISK)
    n = keyed.count()
    if n == 0:
        return Result("refused", "no_records")
    if n > cfg.max_rows:
        return Result("refused", "resource_limit_rows", report={"records": n})
    budget = min(n - 1, math.floor(cfg.max_suppression * n))
    work, missing = keyed, 0
    if cfg.missing == "suppress":
        blank = F.lit(False)
        for i in range(len(qi)):
            blank = blank | (F.col(f"__q{i}") == "")
        work = keyed.where(~blank)
        missing = n - work.count()
        if missing > budget:
            return Result("refused", "missing_exceeds_budget", report={"records": n, "missing": missing, "budget": budget})
        budget -= missing
    gens = [make(cfg.columns[c].get("gen") or {}) for c in qi]
    resolve(gens, [F.col(f"__q{i}") for i in range(len(qi))], work)
    tops = [g.levels for g in gens]
    # Collapse to different values first: labels are made once for each.
    keys = [f"__q{i}" for i in range(len(qi))] + [f"__s{j}" for j in range(len(sens))]
    base = work.select("*", *(norm(F.col(c)).alias(f"__s{j}") for j, c in enumerate(sens))).groupBy(*keys).agg(F.count("*").alias("n"))
    base = base.select("n", *(F.col(f"__s{j}").alias(f"l{j}") for j in range(len(sens))), *(g.label(F.col(f"__q{i}"), lv).alias(f"q{i}_{lv}") for i, g in enumerate(gens) for lv in range(g.levels)))
    lattice = Lattice(base.persist(StorageLevel.MEMORY_AND_DISK), tops, cfg.k, cfg.l, len(sens), budget, cfg.max_evals)
    try:
        found = lattice.run()
    except Infeasible:
        return Result("refused", "infeasible", report={"records": n, "k": cfg.k, "l": cfg.l})
    except SearchLimit:
        return Result("refused", "resource_limit_search", report={"evaluations": len(lattice.known), "max_evals": cfg.max_evals})

    labels = [g.label(F.col(f"__q{i}"), lv).alias(f"__g{i}") for i, (g, lv) in enumerate(zip(gens, found.levels))]
    rows = work.select(*header, *labels)
    # Sizes of classes are joined back; a class is small or lacks diversity, so it goes whole. Constant labels need no key.
    names = [f"__g{i}" for i in range(len(qi))]
    sizes = rows.groupBy(*names).agg(F.count("*").alias("n"), *(F.count_distinct(norm(F.col(c))).alias(f"d{j}") for j, c in enumerate(sens)))
    bad = sizes.where(lattice.bad()).select(*names)
    rows = rows.join(bad, names, "left_anti")
    out_columns = [c for c in header if cfg.columns[c]["role"] != "drop" and not (cfg.columns[c]["role"] == "id" and cfg.columns[c].get("action", "drop") == "drop")]
    shown = []
    for c in out_columns:
        role = cfg.columns[c]["role"]
        shown.append(F.col(f"__g{qi.index(c)}").alias(c) if role == "qi" else pseudonym(F.col(c), c, cfg.key, norm).alias(c) if role == "id" else F.col(c))
    if cfg.shuffle:
        rows = shuffled(rows, order or header, cfg.seed)
        table = rows.orderBy("place").select(*shown)
    else:
        table = rows.select(*shown)
    m = measure(table, qi, sens, norm).first().asDict()
    if m["k"] < cfg.k or any(m[f"l_{c}"] < cfg.l for c in sens) or not m["records"]:
        return Result("refused", "verification_failed", report={"diagnosis": [r.asDict() for r in diagnose(table, qi, sens, cfg.k, cfg.l, norm).collect()], "levels": found.levels})
    before = measure(df, qi, [], norm).first().asDict()
    report = {
        "records_in": n, "records_out": m["records"], "suppressed": n - m["records"], "missing_suppressed": missing,
        "quasi_identifiers": qi, "k": m["k"], "crowds": m["crowds"], "alone": m["records_in_crowd_of_1"], "diversity": {c: m[f"l_{c}"] for c in sens},
        "alone_before": before["records_in_crowd_of_1"], "k_before": before["k"],
        "height": sum(found.levels), "of_height": sum(tops), "precision_loss": sum(v / t for v, t in zip(found.levels, tops)) / len(tops),
        "levels": dict(zip(qi, found.levels)), "evaluations": found.evaluations, "truncated": found.truncated,
    }
    return Result("anonymized", None, table, report)
