from veilgrid.operators.draw import shuffled
from veilgrid.plans.numbering import number_rows


def test_numbers_are_a_total_order(spark):
    rows = [((i * 37) % 101, f"x{i}") for i in range(101)]
    for parts in (1, 7):
        got = number_rows(spark.createDataFrame(rows, "k int, v string").repartition(parts), ["k"]).collect()
        assert [r.k for r in sorted(got, key=lambda r: r.n)] == sorted(k for k, _ in rows)
        assert sorted(r.n for r in got) == list(range(1, 102))


def test_both_shuffles_are_permutations(spark):
    df = spark.createDataFrame([(i,) for i in range(40)], "k int")
    for exact in (True, False):
        a, b = ({r.k: r.place for r in shuffled(df.repartition(p), ["k"], 5, exact).collect()} for p in (1, 5))
        assert a == b and sorted(a.values()) == list(range(1, 41)) and a != {k: k + 1 for k in range(40)}
