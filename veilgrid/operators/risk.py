"""Re-identification risk of a table: equivalence classes, k-anonymity, l-diversity, repeated subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions.text import nfc_strip

SIZE_BUCKETS = ((1, 1, "1"), (2, 2, "2"), (3, 3, "3"), (4, 4, "4"), (5, 9, "5-9"), (10, 49, "10-49"), (50, None, "50+"))
SUBJECT_BUCKETS = ((1, 1, "1"), (2, 2, "2"), (3, 4, "3-4"), (5, 9, "5-9"), (10, None, "10+"))
HISTOGRAM_BINS = 20


def bucket(n: Column, buckets) -> Column:
    out = None
    for low, high, label in buckets:
        test = n >= low if high is None else n.between(low, high)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def classes(df: DataFrame, qi: list[str], norm=nfc_strip, extra: list[Column] = ()) -> DataFrame:
    """One row per equivalence class: the normal values q0, q1, ..., size, and extra aggregates."""
    keyed = df.select(*(norm(F.col(c)).alias(f"q{i}") for i, c in enumerate(qi)), "*")
    return keyed.groupBy(*(f"q{i}" for i in range(len(qi)))).agg(F.count("*").alias("size"), *extra)


def measure(df: DataFrame, qi: list[str], sensitive: list[str] = (), norm=nfc_strip) -> DataFrame:
    """One row: records, crowds, k, smallest_crowds, records_in_crowd_of_1, max_risk, average_risk, and l_<column> per sensitive column."""
    extra = [F.count_distinct(norm(F.col(c))).alias(f"l{i}") for i, c in enumerate(sensitive)]
    c = classes(df, qi, norm, extra)
    by_size = c.groupBy("size").agg(F.count("*").alias("n"), *(F.min(f"l{i}").alias(f"l{i}") for i in range(len(sensitive))))
    # Different sizes are few (at most the root of twice the rows), the five smallest crowds lie in the five smallest of them.
    least = by_size.orderBy("size").limit(5).agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat("size", F.least(F.col("n"), F.lit(5)).cast("int"))))).alias("s"))
    total = by_size.agg(
        F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("records"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("crowds"),
        F.coalesce(F.min("size"), F.lit(0)).alias("k"),
        F.coalesce(F.sum(F.when(F.col("size") == 1, F.col("n"))), F.lit(0)).alias("records_in_crowd_of_1"),
        *(F.coalesce(F.min(f"l{i}"), F.lit(0)).alias(f"l_{c}") for i, c in enumerate(sensitive)),
    )
    return total.crossJoin(least).select(
        "records", "crowds", "k", F.slice("s", 1, 5).alias("smallest_crowds"), "records_in_crowd_of_1",
        F.when(F.col("k") > 0, 1 / F.col("k")).otherwise(0.0).alias("max_risk"),
        F.when(F.col("records") > 0, F.col("crowds") / F.col("records")).otherwise(0.0).alias("average_risk"),
        *(f"l_{c}" for c in sensitive),
    )


def diagnose(df: DataFrame, qi: list[str], sensitive: list[str], k: int, l: int, norm=nfc_strip) -> DataFrame:
    """metric, key, value: why rows fail k or l, in sizes and counts only."""
    extra = [F.count_distinct(norm(F.col(c))).alias(f"l{i}") for i, c in enumerate(sensitive)]
    c = classes(df, qi, norm, extra).persist()
    row = lambda metric, value, key="": F.struct(F.lit(metric).alias("metric"), F.lit(key).alias("key"), F.coalesce(value, F.lit(0)).cast("long").alias("value"))
    below = F.col("size") < k
    totals = c.agg(
        F.array(
            row("records", F.sum("size")), row("crowds", F.count("*")),
            row("records_below_k", F.sum(F.when(below, F.col("size")))), row("records_alone", F.count_if(F.col("size") == 1)),
            row("histogram_truncated", (F.count_distinct(F.when(below, F.col("size"))) > HISTOGRAM_BINS).cast("int")),
            *(row("l_short_crowds", F.count_if(F.col(f"l{i}") < l), s) for i, s in enumerate(sensitive)),
            *(row("l_short_records", F.sum(F.when(F.col(f"l{i}") < l, F.col("size"))), s) for i, s in enumerate(sensitive)),
        ).alias("r")
    ).select(F.inline("r"))
    histogram = c.where(below).groupBy("size").count().orderBy("size").limit(HISTOGRAM_BINS)
    return totals.union(histogram.select(F.lit("crowd_size"), F.col("size").cast("string"), "count"))


def audit(df: DataFrame, qi: list[str], k: int, subject: str | None = None, norm=nfc_strip) -> DataFrame:
    """section, name, metric, value: classes, each QI column (and rows below k without it), and repeated subjects.

    The rows are grouped once, to classes; the all-but-one regroupings are GROUPING SETS over the classes.
    """
    m = len(qi)
    keys = [f"q{i}" for i in range(m)]
    s = norm(F.col(subject)) if subject else F.lit("")
    distinct = (F.count_distinct(F.when(s != "", s)) + F.count_if(s == "")) if subject else F.lit(0)
    c = classes(df, qi, norm, [distinct.alias("people")]).persist()
    fields = lambda section, name, metric, value: F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), F.lit(metric).alias("metric"), F.coalesce(value, F.lit(0)).cast("long").alias("value"))
    size, n = F.col("size"), F.sum("size")
    alone, few = F.count_if(size == 1), F.coalesce(F.sum(F.when(size < k, size)), F.lit(0))
    rate = lambda x: F.when(n > 0, F.floor(1000 * x / n)).otherwise(0)
    parts = [
        c.agg(F.array(
            fields("classes", "", "count", F.count("*")), fields("classes", "", "min_size", F.min("size")), fields("classes", "", "unique_rows", alone),
            fields("classes", "", "rows_below_k", few), fields("classes", "", "unique_permille", rate(alone)), fields("classes", "", "below_k_permille", rate(few)),
            *(fields("size_bucket", label, "rows", F.sum(F.when(bucket(size, SIZE_BUCKETS) == label, size))) for *_, label in SIZE_BUCKETS),
        ).alias("r")).select(F.inline("r"))
    ]
    # Column by column: values of the classes, with the rows they hold.
    values = c.select(F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(q).alias("v"), "size") for name, q in zip(qi, keys)))).alias("x")).select("x.*")
    values = values.where("v <> ''").groupBy("name", "v").agg(F.sum("size").alias("rows")).groupBy("name").agg(F.count("*").alias("distinct"), F.count_if(F.col("rows") == 1).alias("unique_rows"))
    names = c.sparkSession.createDataFrame([(x,) for x in qi], "name string")
    values = names.join(F.broadcast(values), "name", "left")  # a row a QI column
    parts.append(values.select(F.inline(F.array(*(F.struct(F.lit("qi").alias("section"), F.col("name").alias("name"), F.lit(x).alias("metric"), F.coalesce(F.col(x), F.lit(0)).alias("value")) for x in ("distinct", "unique_rows"))))))
    if m > 1:
        without = c.groupingSets([[q for q in keys if q != out] for out in keys], *keys).agg(F.grouping_id(*keys).alias("g"), F.sum("size").alias("rows"))
        label = F.element_at(F.create_map(*(x for i, name in enumerate(qi) for x in (F.lit(1 << m - 1 - i).cast("long"), F.lit(name)))), F.col("g"))
    else:
        without, label = c.agg(F.lit(1).alias("g"), F.sum("size").alias("rows")), F.lit(qi[0])
    without = without.groupBy(label.alias("name")).agg(F.coalesce(F.sum(F.when(F.col("rows") < k, F.col("rows"))), F.lit(0)).alias("value"))
    parts.append(without.select(F.lit("qi"), "name", F.lit("rows_below_k_without"), "value"))
    if subject:
        each = df.select(s.alias("s")).groupBy("s").agg(F.count("*").alias("n"))
        known = F.col("s") != ""
        buckets = [
            fields("subject_bucket", label, "subjects", F.count_if(known & (bucket(F.col("n"), SUBJECT_BUCKETS) == label)) + (F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)) if label == "1" else F.lit(0)))
            for *_, label in SUBJECT_BUCKETS
        ]
        missing = F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0))
        parts.append(each.agg(F.array(
            fields("subject", subject, "rows_with_subject", F.sum(F.when(known, F.col("n")))), fields("subject", subject, "rows_missing_subject", missing),
            fields("subject", subject, "subjects", F.count_if(known) + missing), fields("subject", subject, "repeated_subjects", F.count_if(known & (F.col("n") >= 2))),
            fields("subject", subject, "rows_in_repeated_subjects", F.sum(F.when(known & (F.col("n") >= 2), F.col("n")))),
            fields("subject", subject, "max_rows_per_subject", F.coalesce(F.max(F.when(known, F.col("n"))), F.when(missing > 0, 1))), *buckets,
        ).alias("r")).select(F.inline("r")))
        people = F.col("people")
        parts.append(c.agg(F.array(
            fields("subject", subject, "class_min_distinct", F.min("people")), fields("subject", subject, "class_rows_below_k", F.sum(F.when(people < k, size))),
            fields("subject", subject, "class_rows_overstated", F.sum(F.when((people < k) & (size >= k), size))),
        ).alias("r")).select(F.inline("r")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def plan_warnings(df: DataFrame, qi: list[str], sensitive: list[str], tops: list[int], k: int, l: int, max_suppression: float, max_rows: int = 200_000, max_evals: int = 20_000, norm=nfc_strip) -> DataFrame:
    """code: what may stand in the way of a run: rows_over_limit, k_unreachable, l_unreachable, budget_zero, missing_over_budget, lattice_large, evals_tight, many_singletons."""
    import math

    blank = F.lit(False)
    for c in qi:
        blank = blank | (norm(F.col(c)) == "")
    facts = df.agg(F.count("*").alias("n"), F.count_if(blank).alias("missing"), *(F.count_distinct(norm(F.col(c))).alias(f"l{i}") for i, c in enumerate(sensitive)))
    alone = classes(df, qi, norm).agg(F.count_if(F.col("size") == 1).alias("alone"))
    budget = F.least(F.col("n") - 1, F.floor(F.col("n") * max_suppression))
    nodes = math.prod(t + 1 for t in tops)
    short = F.lit(False)
    for i in range(len(sensitive)):
        short = short | (F.col(f"l{i}") < l)
    tests = {
        "rows_over_limit": F.col("n") > max_rows, "k_unreachable": F.col("n") < k, "l_unreachable": short, "budget_zero": budget <= 0,
        "missing_over_budget": F.col("missing") > budget, "lattice_large": F.lit(nodes > 200_000), "evals_tight": F.lit(nodes > max_evals),
        "many_singletons": F.col("alone") * 2 > F.col("n"),
    }
    found = F.filter(F.array(*(F.when(t, F.lit(c)) for c, t in tests.items())), lambda x: x.isNotNull())
    return facts.crossJoin(alone).select(F.explode(found).alias("code"))
