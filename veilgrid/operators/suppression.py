"""Why rows were suppressed, in sizes and counts only, and whom one more level of generalization would have saved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.operators.risk import HISTOGRAM_BINS


def suppression(base: DataFrame, levels: tuple[int, ...], tops: list[int], qi: list[str], sensitive: list[str], k: int, l: int) -> DataFrame:
    """metric, key, value over the lattice's collapsed base (columns q{i}_{level}, n, l{j}).

    dropped_crowds, dropped_records; crowd_size:<size> (20 at most); below_k and below_l crowds and records; short columns by name;
    rescued rows by quasi-identifier: dropped rows whose class is large and diverse enough with that column a level further.
    """
    def keyed(vec):
        return [F.col(f"q{i}_{v}") if v < t else F.lit("*") for i, (v, t) in enumerate(zip(vec, tops))]

    def classes(vec, names):
        rows = base.select(*(c.alias(x) for c, x in zip(keyed(vec), names)), "n", *(f"l{j}" for j in range(len(sensitive))))
        return rows.groupBy(*names).agg(F.sum("n").alias("size"), *(F.count_distinct(f"l{j}").alias(f"d{j}") for j in range(len(sensitive))))

    short = F.lit(False)
    for j in range(len(sensitive)):
        short = short | (F.col(f"d{j}") < l)
    few = F.col("size") < k
    names = [f"k{i}" for i in range(len(qi))]
    gone = classes(levels, names).where(few | short).persist()
    cell = lambda metric, key, value: F.struct(F.lit(metric).alias("metric"), F.lit(key).alias("key"), F.coalesce(value, F.lit(0)).cast("long").alias("value"))
    rows = lambda test: F.sum(F.when(test, F.col("size")))
    out = gone.agg(F.array(
        cell("dropped_crowds", "", F.count("*")), cell("dropped_records", "", F.sum("size")),
        cell("below_k_crowds", "", F.count_if(few)), cell("below_k_records", "", rows(few)), cell("below_l_crowds", "", F.count_if(~few)), cell("below_l_records", "", rows(~few)),
        *(cell("short_crowds", s, F.count_if(~few & (F.col(f"d{j}") < l))) for j, s in enumerate(sensitive)),
        *(cell("short_records", s, rows(~few & (F.col(f"d{j}") < l))) for j, s in enumerate(sensitive)),
    ).alias("r")).select(F.inline("r"))
    sizes = gone.groupBy("size").count().orderBy("size").limit(HISTOGRAM_BINS)
    out = out.union(sizes.select(F.lit("crowd_size"), F.col("size").cast("string"), "count"))
    lost = base.select(*(c.alias(x) for c, x in zip(keyed(levels), names)), "n", *(c for c in base.columns if c.startswith("q"))).join(gone.select(*names), names, "left_semi")
    for j, c in enumerate(qi):
        if levels[j] < tops[j]:
            vec = (*levels[:j], levels[j] + 1, *levels[j + 1 :])
            further = [f"f{i}" for i in range(len(qi))]
            bad = classes(vec, further).where(few | short).select(*further)
            saved = lost.select("n", *(x.alias(y) for x, y in zip(keyed(vec), further))).join(bad, further, "left_anti")
            out = out.union(saved.agg(F.lit("rescued"), F.lit(c), F.coalesce(F.sum("n"), F.lit(0))))
    return out
