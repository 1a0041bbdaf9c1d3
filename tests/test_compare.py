"""Pairs, classes and components against brute force; nothing is lost to blocks or prefixes."""

import random

import pytest

from veilgrid.operators import compare, diff, history
from veilgrid.plans import storage


def texts(n=60):
    r = random.Random(3)
    base = [" ".join(f"w{r.randrange(200)}" for _ in range(r.randrange(3, 60))) for _ in range(12)]
    out = []
    for i in range(n):
        words = r.choice(base).split()
        for _ in range(r.randrange(0, 12)):
            words[r.randrange(len(words))] = f"w{r.randrange(200)}"
        out.append((i, " ".join(["the", "same", "words", "here", *words])))
    return [*out, (200, out[0][1].upper()), (201, ""), (202, None), (203, "one two")]


def grams(text):
    w = (text or "").lower().split()
    return frozenset([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else [])


@pytest.mark.parametrize("block", [256, 4])
@pytest.mark.parametrize("least", [0.3, 0.8])
def test_text_pairs(spark, monkeypatch, block, least):
    monkeypatch.setattr(compare, "BLOCK", block)
    rows = texts()
    df = spark.createDataFrame(rows, "id long, text string")
    first = {}
    for i, t in rows:
        if grams(t):
            first.setdefault(grams(t), i)
    want = {(a, b): len(x & y) / len(x | y) for x, a in first.items() for y, b in first.items() if a < b and len(x & y) >= least * len(x | y) - 1e-12}
    got = {(r.a, r.b): r.similarity for r in compare.text_pairs(df, "id", "text", least=least).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 1
    found = {r.id: (r["class"], r.copies, r.links) for r in compare.text_classes(df, "id", "text", least=least).collect()}
    for i, t in rows:
        c = first.get(grams(t), i)
        assert found[i] == (c, max(1, sum(grams(y) == grams(t) for _, y in rows) if grams(t) else 1), sum(c in k for k in want))
    every = {(r.a, r.b) for r in compare.text_pairs(df, "id", "text", least=least, copies=True).collect()}
    assert every == {(a, b) for a, x in rows for b, y in rows if a < b and grams(x) and grams(y) and len(grams(x) & grams(y)) >= least * len(grams(x) | grams(y)) - 1e-12}


@pytest.mark.parametrize("block", [256, 4])
def test_containment_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(compare, "BLOCK", block)
    rows = texts(40) + [(300, texts()[5][1] + " and then much more text that the other one has not " * 3)]
    df = spark.createDataFrame(rows, "id long, text string")
    sets = {r.id: frozenset(r.f) for r in df.select("id", compare.fingerprints(df.text).alias("f")).collect()}
    first = {}
    for i in sorted(sets):
        if sets[i]:
            first.setdefault(sets[i], i)
    want = {(a, b) for x, a in first.items() for y, b in first.items() if a < b and (10 * len(x & y) >= 7 * len(x) or 10 * len(x & y) >= 7 * len(y))}
    got = {(r.a, r.b) for r in compare.containment_pairs(df, "id", "text").collect()}
    assert got == want and len(want) > 2


def test_components_of_hubs_and_paths(spark):
    links = [(0, -k) for k in range(1, 80)] + [(k, k + 1) for k in range(100, 140)] + [(500, 500)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.group for r in compare.groups(df.select("a").union(df.select("b")), df).collect()}
    assert got == {-k: -79 for k in range(80)} | {k: 100 for k in range(100, 141)} | {500: 500}


def test_base_text_is_left_out(spark):
    base = spark.createDataFrame([("a b c d e f",)], "t string")
    items = spark.createDataFrame([(1, "x a b c d e f y"), (2, "a b c d"), (3, None), (4, "own, text")], "id long, t string")
    got = {r.id: (r.total, r.removed, r.per_mille, r.text) for r in compare.exclude_base(items, base, "id", "t").collect()}
    assert got == {1: (8, 6, 750, "x y"), 2: (4, 0, 0, "a b c d"), 3: (0, 0, 0, None), 4: (3, 0, 0, "own, text")}


def test_table_diff_of_repeated_keys(spark):
    """A key of many rows on both sides is one row of the join, and leaves the comparison."""
    a = spark.createDataFrame([("1", "x")] * 300 + [("2", "z"), ("3", "s")], "id string, v string")
    b = spark.createDataFrame([("1", "w")] * 300 + [("9", "q"), ("3", "s")], "id string, v string")
    assert sorted((r.id, r.state) for r in diff.table_diff(a, b, ["id"]).collect()) == [("2", "removed"), ("3", "same"), ("9", "added")]
    assert [r.id for r in diff.duplicate_keys(a, b, ["id"]).collect()] == ["1"]


def test_history_survives_a_crash_before_the_pointer(spark, tmp_path, monkeypatch):
    h = history.History(spark, f"file://{tmp_path}/h")
    for k in range(3):
        h.append("runs", {"kind": f"k{k}"})
    h.prune("runs", 2)
    assert [r.kind for r in h.table("runs").collect()] == ["k2", "k1"] and h.append("runs", {"kind": "k3"}) == 4
    monkeypatch.setattr(h, "_fs", lambda path: (_ for _ in ()).throw(OSError("lost")) if path.endswith(".pointer") else history.History._fs(h, path))
    with pytest.raises(OSError):
        h.clear("runs")
    monkeypatch.undo()
    assert h.table("runs").count() == 3


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        storage.shared_folder(Session(), "x")


@pytest.mark.parametrize("lane", ["text", "code"])
def test_grams_take_little_disk(spark, tmp_path, monkeypatch, lane):
    """Grams are kept as numbers, and once their pairs are known only those that more than one class has."""
    r = random.Random(5)
    rows = [(i, " ".join(["all", "of", "them", "begin", "with", "these", "words", *(f"word{r.randrange(10**6)}" for _ in range(400))])) for i in range(100)] + [(1000, "one more")]
    rows.append((2000, rows[0][1] + " and more"))
    monkeypatch.setattr(compare, "shared_folder", lambda *_: f"file://{tmp_path}/{lane}")
    df = spark.createDataFrame(rows, "id long, text string")
    pairs = compare.text_pairs(df, "id", "text") if lane == "text" else compare.containment_pairs(df, "id", "text")
    assert [(p.a, p.b) for p in pairs.collect()] == [(0, 2000)]
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < sum(len(t) for _, t in rows) / 8


def test_grams_in_python_are_those_of_spark(spark):
    texts = ["Straße ΑΒΓ x_y Ⅷ ½ 中文字 áb 10th  λόγος، नमस्ते İzmir ǅ", "one", "a b", "", "x = f(a_1, 22) # ünï\n\tif (x) { y }", "a a a a a a a a"]
    low = spark.createDataFrame([(t,) for t in texts], "t string").select("t", compare.F.lower("t").alias("l"), compare.words(compare.F.col("t")).alias("w"), compare.fingerprints(compare.F.col("t")).alias("f"), compare.tokens(compare.F.col("t")).alias("k"))
    for r in low.collect():
        grams_ = {tuple(r.w[i : i + 3]) for i in range(max(1, len(r.w) - 2))} if r.w else set()
        assert len(compare.word_grams(r.l, 3)) == len(grams_)
        assert compare.word_grams(r.l, 3).tolist() == compare.word_grams(" ".join(r.w), 3).tolist()
        assert compare.code_tokens(r.t) == r.k and {f"{x & (1 << 64) - 1:016x}" for x in compare.code_grams(r.t, compare.K).tolist()} == set(r.f)


def test_little_containment_is_counted_in_full(spark):
    rows = texts(30)
    df = spark.createDataFrame(rows, "id long, text string")
    sets = {r.id: frozenset(r.f) for r in df.select("id", compare.fingerprints(df.text).alias("f")).collect()}
    share = lambda x, y: 1000 * len(x & y) // len(x)
    want = {(a, b, share(x, y), share(y, x)) for a, x in sets.items() for b, y in sets.items() if a < b and x & y}
    assert {tuple(r)[:4] for r in compare.containment_pairs(df, "id", "text", least=1, copies=True).collect()} == want


def test_base_grams_are_sent_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(compare, "KNOWN", 1)
    base = spark.createDataFrame([("a b c d e f",), ("q r s t u",), (None,)], "t string")
    items = spark.createDataFrame([(1, "x a b c d e f y q r s t u"), (2, "a b c d"), (3, None), (3, "a b c d e")], "id long, t string")
    out = compare.exclude_base(items, base, "id", "t")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.total, r.removed, r.per_mille, r.text) for r in out.collect()} == {(1, 13, 11, 846, "x y"), (2, 4, 0, 0, "a b c d"), (3, 0, 0, 0, None), (3, 5, 5, 1000, "")}
