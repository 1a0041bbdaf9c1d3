import itertools
import math
import random
from collections import Counter

import pytest

from veilgrid.functions.text import strip
from veilgrid.operators import generalize, profile, risk
from veilgrid.operators.anonymize import Config, anonymize, parse_config
from veilgrid.operators.draw import SplitMix64, draw, permutation
from veilgrid.plans.lattice import nodes_at

FIVE = [("Alice", "30", "Osaka"), ("Bob", "30", "Osaka"), ("Carol", "40", "Kyoto"), ("Dave", "40", "Kyoto"), ("Eve", "25", "Nara")]
ROLES = {"city": {"role": "qi"}, "name": {"role": "drop"}} | {"age": {"gen": {"widths": [10], "type": "numeric"}, "role": "qi"}}


def people(spark, rows=FIVE):
    return spark.createDataFrame(rows, "name string, age string, city string")


def test_anonymize_five_rows(spark):
    r = anonymize(people(spark), Config(ROLES, k=2, max_suppression=0.2))
    assert r.status == "anonymized" and r.table.columns == ["age", "city"] and r.table.count() == 4
    assert r.report["suppressed"] == 1 and r.report["k"] == 2
    assert r.report["alone_before"] == 1 and r.report["alone"] == 0


@pytest.mark.parametrize(
    "rows, over, reason",
    [(FIVE[:3], {"k": 5}, "infeasible"), ([], {}, "no_records"), (FIVE, {"max_rows": 4}, "resource_limit_rows"), ([("a", "", "x")] * 3 + [("b", "1", "x")], {"missing": "suppress", "k": 2, "max_suppression": 0.1}, "missing_exceeds_budget"), (FIVE, {"max_evals": 1, "k": 2}, "resource_limit_search")],
)
def test_refusals(spark, rows, over, reason):
    r = anonymize(people(spark, rows), Config(ROLES, **over))
    assert (r.status, r.reason, r.table) == ("refused", reason, None)


def test_config_is_strict():
    with pytest.raises(ValueError):
        Config(ROLES, k=1)
    with pytest.raises(ValueError):
        parse_config({"columns": ROLES, "nonsense": 1})
    assert parse_config({"columns": ROLES, "_note": "x", "shuffle_seed": 4}).seed == 4
    with pytest.raises(ValueError):
        Config({"a": {"role": "keep"}})


def test_search_is_the_optimum(spark):
    """Against all nodes, evaluated by hand."""
    rng = random.Random(2)
    rows = [(str(i), str(rng.randrange(60)), rng.choice("abc"), rng.choice("xyz")) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, age string, city string, ill string")
    roles = {"ill": {"role": "sensitive"}, "city": {"role": "qi"}} | {"age": {"gen": {"widths": [5, 20], "type": "numeric"}, "role": "qi"}} | {"id": {"role": "drop"}}
    r = anonymize(df, Config(roles, k=4, l=2, max_suppression=0.1, shuffle=False))

    def label(age, level):
        return age if level == 0 else "*" if level == 3 else str(int(age) // (5, 20)[level - 1])

    best = None
    for v in itertools.product(range(4), range(2)):
        groups: dict = {}
        for _, age, city, ill in rows:
            groups.setdefault((label(age, v[0]), city if v[1] == 0 else "*"), []).append(ill)
        gone = sum(len(g) for g in groups.values() if len(g) < 4 or len(set(g)) < 2)
        if gone <= math.floor(0.1 * 120):
            key = (v[0] + 3 * v[1], gone, v)
            best = min(best or key, key)
    assert tuple(r.report["levels"].values()) == best[2] and r.report["suppressed"] == best[1]
    assert risk.measure(r.table, ["age", "city"], ["ill"], strip).first()["k"] >= 4


def test_nodes_at():
    assert sorted(v for h in range(6) for v in nodes_at(h, [2, 3])) == sorted(itertools.product(range(3), range(4)))


@pytest.mark.parametrize(
    "gen, values",
    [
        (generalize.Numeric((5, 10), True), {"-7": ["-7", "-10--6", "-10--1", "*"], "12": ["12", "10-14", "10-19", "*"], "": ["", "*", "*", "*"]}),
        (generalize.Numeric((5,), False), {"1.5": ["1.5", "[0,5)", "*"], "x": ["x", "*", "*"]}),
        (generalize.Bins([10, 20], True), {"3": ["3", "<10", "*"], "10": ["10", "10-19", "*"], "99": ["99", "20+", "*"]}),
        (generalize.Date(), {"2024-02-30": ["2024-02-30", "*", "*", "*", "*"], "2024-02-29": ["2024-02-29", "2024-02", "2024", "2020s", "*"]}),
        (generalize.Prefix(4), {"1234": ["1234", "123*", "12**", "1***", "****", "*"], "12": ["12", "1*", "**", "**", "**", "*"]}),
        (generalize.Exact({"Osaka": ["Kansai", "Japan"], "Paris": ["France"]}), {"Osaka": ["Osaka", "Kansai", "Japan", "*"], "Paris": ["Paris", "France", "France", "*"], "?": ["?", "*", "*", "*"]}),
    ],
)
def test_labels(spark, gen, values):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r["v"]: [r[f"l{i}"] for i in range(gen.levels + 1)] for r in df.select("v", *(gen.label(F.col("v"), i).alias(f"l{i}") for i in range(gen.levels + 1))).collect()}
    assert got == values


def test_known_draws(spark):
    got = draw(spark.createDataFrame([(x,) for x in ("alice", "bob", "carol")], "n string"), "n", "2026-08-demo", groups=2)
    rows = sorted(got.collect(), key=lambda r: r.position)
    assert [r.item for r in rows] == ["alice", "carol", "bob"] and [r.group for r in rows] == [0, 1, 0]
    got = draw(spark.createDataFrame([(x,) for x in "alice bob carol dave erin".split()], "n string"), "n", "2026-winter-demo", size=2)
    rows = sorted(got.collect(), key=lambda r: r.position)
    assert " ".join(r.item for r in rows) == "erin dave alice bob carol" and [r.group for r in rows] == [0, 1, 2, 0, 1]


def test_permutation():
    assert sorted(permutation(50, 3)) == list(range(50)) and permutation(50, 3) != permutation(50, 4)
    assert SplitMix64(0).next() == 0xE220A8397B1DCDAF  # the published first value


def test_audit_against_counter(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab "), rng.choice("xyz"), rng.choice(["", "s1", "s2", "s3"])) for _ in range(80)]
    got = {(r.section, r.name, r.metric): r.value for r in risk.audit(spark.createDataFrame(rows, "a string, b string, s string"), ["a", "b"], 12, "s").collect()}
    sizes = Counter((a.strip(), b) for a, b, _ in rows)
    assert got["classes", "", "count"] == len(sizes) and got["classes", "", "rows_below_k"] == sum(n for n in sizes.values() if n < 12)
    assert got["qi", "a", "rows_below_k_without"] == sum(n for n in Counter(b for _, b, _ in rows).values() if n < 12)
    assert got["qi", "a", "distinct"] == 2
    missing = sum(s == "" for *_, s in rows)
    assert got["subject", "s", "subjects"] == 3 + missing and got["subject_bucket", "1", "subjects"] == missing


def test_derived_accounts_for_all_pairs(spark):
    rows = [(str(i % 5), str(i % 5 * 2), str(i)) for i in range(100)]
    got = profile.derived(spark.createDataFrame(rows, "k string, q string, u string"), ["k", "u"], ["q"]).collect()
    assert Counter(r.verdict for r in got) == Counter(flagged=2, trivial=1, clear=0) + Counter(r.verdict for r in got if r.keep == "u" and r.relation == "implied_by_qi")
    assert len(got) == 4


def test_empty_tables(spark):
    none = people(spark, [])
    assert risk.measure(none, ["age"], []).first()["records"] == 0
    assert {r.value for r in risk.audit(none, ["age", "city"], 5).collect()} == {0}
    assert profile.inspect(none).collect() == []
