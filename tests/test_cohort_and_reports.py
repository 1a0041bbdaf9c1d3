from veilgrid.operators import cohort, reports
from veilgrid.operators.suppression import suppression

ESSAY = "We argue that careful reading of old letters shows how trade moved along the river in the dry years. "
JS = "function area(w, h) { const size = w * h; return size > 10 ? size : 0; }\n"


def items(spark):
    rows = [
        ("a/essay.txt", ESSAY + "First ending."), ("b/essay.txt", ESSAY + "Second ending."), ("c/essay.txt", 'It says "' + ESSAY + '" but we disagree with all of it and say why at length.'),
        ("a/f.py", "def f(a):\n    return a + 1\n"), ("b/f.py", "def g(x):\n    return x + 1\n"), ("c/f.py", "def ("), ("a/app.js", JS * 2 + "start(1);"), ("b/app.js", JS + "var k = [1, 2];"), ("a/pic.png", "x"), ("b/blank.txt", "  "), ("c/none.txt", None),
    ]
    return spark.createDataFrame(rows, "path string, text string")


def test_lanes_pairs_and_summary(spark):
    df = items(spark)
    found = cohort.pairs(df)
    flagged = {(r.a, r.b, r.lane) for r in found.where("flagged").collect()}
    assert flagged == {("a/essay.txt", "b/essay.txt", "text"), ("a/f.py", "b/f.py", "python"), ("a/app.js", "b/app.js", "code")}
    kept = {(r.a, r.b) for r in cohort.pairs(df, quotes=False).where("lane = 'text'").collect()}
    assert ("a/essay.txt", "c/essay.txt") in kept
    base = spark.createDataFrame([("base", JS * 2 + "start(1); var k = [1, 2];")], "path string, text string")
    assert cohort.pairs(df, base).where("lane = 'code'").count() == 0
    s = {r.key: r.n for r in cohort.summary(df, found).collect()}
    assert s["items"] == 11 and s["compared"] == 7 and s["not_compared:parse_failed"] == 1 and s["not_compared:empty_input"] == 1 and s["not_compared:undecodable"] == 1 and s["not_compared:not_applicable"] == 1
    assert s["flagged:text"] == 1 and s["pairs:python"] == 1


def test_suppression_reasons(spark):
    rows = [("x", "s1")] * 3 + [("y", "s1")] * 5 + [("z", "s1"), ("z", "s2")] * 2
    base = spark.createDataFrame([(q, s) for q, s in rows], "q0_0 string, l0 string").groupBy("q0_0", "l0").count().withColumnRenamed("count", "n")
    got = {(r.metric, r.key): r.value for r in suppression(base, (0,), [1], ["q"], ["s"], 4, 2).collect()}
    assert got["dropped_crowds", ""] == 2 and got["dropped_records", ""] == 8
    assert got["below_k_records", ""] == 3 and got["below_l_records", ""] == 5 and got["short_crowds", "s"] == 1
    assert got["crowd_size", "3"] == 1 and got["rescued", "q"] == 8


def test_reports(spark):
    df = spark.createDataFrame([(f"p/{i}", "a|<b>​") for i in range(60)], "path string, note string")
    md, page = reports.markdown("T", {"n": df}, hide=("path",)), reports.page("T", {"n": df})
    assert "p/1" not in md and "a\\|<b><U+200B>" in md and "The first 50 rows." in md and page.count("<tr>") == 51 and "&lt;b&gt;" in page
    assert reports.marked("a<b>c", [(1, 3)]) == "a<mark>&lt;b</mark>&gt;c"
