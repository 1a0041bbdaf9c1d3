import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from veilgrid.llm import exact_dedup as ed
from veilgrid.llm import simhash_anchors as sa
from veilgrid.llm.components import components

ODD = [(1, "Same Text", "x", 1), (2, "same text", "x", 2), (3, None, "y", None), (4, "", None, 4), (4, "", None, 4), (None, "same TEXT", "z", 0), (None, "lonely", "z", 0), (None, "lonely", "q", 0), (7, "É", "x", 1), (8, "é", "x", 1), (9, "w " * 30000, "x", 1)]
#: Extra columns named as the operators' own.
SCHEMA = "doc_id long, text string, digest string, salt int"


def lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")


def test_exact_dedup_cases(spark):
    rows = ed.exact_dedup(spark.createDataFrame(ODD, SCHEMA)).collect()
    assert len(rows) == len(ODD)
    groups = {}
    for i, t, *_ in ODD:
        groups.setdefault(lower(t), []).append(i)
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        own = [r for r in rows if r.text_sha256 == sha]
        top = max((i for i in ids if i is not None), default=None)
        assert len(own) == len(ids) and all(r.keep_id == top and r.group_size == len(ids) for r in own)
        assert [r.doc_id for r in own if r.kept] == [top]


def test_exact_dedup_empty(spark):
    assert ed.exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ed.drop_exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_exact_dedup_compares_content_not_digests(spark):
    weak = lambda data: b"same"
    rows = ed.exact_dedup(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string"), digest=weak).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in rows} == {(1, 3, 2), (3, 3, 2), (2, 2, 1)}


def test_drop_exact_duplicates_keeps_whole_rows(spark):
    got = ed.drop_exact_duplicates(spark.createDataFrame(ODD, SCHEMA))
    assert got.columns == ["doc_id", "text", "digest", "salt"]
    rows = got.collect()
    assert sorted((r.doc_id or 0, lower(r.text)[:9]) for r in rows) == sorted([(2, "same text"), (4, ""), (0, "lonely"), (7, "É"), (8, "é"), (9, ("w " * 5)[:9])])


def test_drop_exact_duplicates_keeps_the_rows_marked_kept(spark):
    """Ids that repeat with another text."""
    rows = [(5, "A"), (5, "B"), (9, "B"), (6, "Ab"), (6, "AB"), (7, None), (7, ""), (None, "B"), (None, "c"), (None, "C"), (8, "c2"), (8, "c2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda i, t: (str(i), hashlib.sha256(lower(t).encode()).hexdigest())
    marked = sorted((str(r.doc_id), r.text_sha256) for r in ed.exact_dedup(df).where("kept").collect())
    assert sorted(key(r.doc_id, r.text) for r in ed.drop_exact_duplicates(df).collect()) == marked


def brute_print(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", ["", " \t\n", "one", "one two three", "A b\x0bC d e", "x y " * 700, "é É z w v" * 3])
def test_fingerprint(text):
    assert int(sa.simhash([sa.shingle_hashes(text, 4)])[0]) & (1 << 64) - 1 == brute_print(text, 4)


def test_anchors_meet_within_radius(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        a, flips = rng.getrandbits(64), rng.sample(range(64), 4)
        b = a
        for f in flips[: k % 5]:
            b ^= 1 << f
        rows.append([x - (1 << 64) if x >> 63 else x for x in (a, b)])
    df = spark.createDataFrame(rows, "a long, b long")
    met = df.select(sa.F.arrays_overlap(sa.anchors(df.a, 4, 3), sa.anchors(df.b, 4, 3)).alias("m")).collect()
    assert all(r.m for r in met)


@pytest.mark.parametrize("hot", [4096, 8])
def test_links_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(sa, "HOT", hot)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 9), replace=False)) for b in base for _ in range(60)]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in near} | {0})
    links = sa.fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    got = {r.v: r.m for r in components(links).collect()}
    a = np.array(fps, np.int64).view(np.uint64)
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4).tolist():
            x, y = find(i), find(j)
            label[max(x, y)] = min(x, y)
    assert {x: got.get(x, x) for x in fps} == {x: fps[find(i)] for i, x in enumerate(fps)}


@pytest.mark.parametrize("dense", [4096, 50])
@pytest.mark.parametrize("short", [48, 3])
def test_long_runs_are_linked_as_all_pairs_are(monkeypatch, dense, short):
    monkeypatch.setattr(sa, "DENSE", dense)
    monkeypatch.setattr(sa, "SHORT", short)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = np.unique(np.array([int(b) ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(80)], np.uint64))
    ((u, v),) = sa._links_of_long(fps, 4)
    at = {f: i for i, f in enumerate(fps.tolist())}
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4).tolist():
            x, y = find(i), find(j)
            label[max(x, y)] = min(x, y)
    assert {at[a]: at[b] for a, b in zip(u.tolist(), v.tolist())} == {i: find(i) for i in range(len(fps)) if find(i) != i}


def test_simhash_groups_cases(spark):
    rows = [(5, "a b c d e f", 0), (3, "A B c d e f", 0), (None, "a b c d e f", 1), (9, None, 1), (8, " ", 2), (9, None, 1), (None, "q r s t u", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in sa.simhash_groups(df).collect())
    f, g = f"{brute_print('a b c d e f', 4):016x}", f"{brute_print('q r s t u', 4):016x}"
    assert got == sorted([(5, f, 3), (3, f, 3), (0, f, 3), (9, "0" * 16, 8), (8, "0" * 16, 8), (9, "0" * 16, 8), (0, g, None)], key=lambda r: (r[0], r[1]))
    kept = sa.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 8]
    assert sa.simhash_groups(spark.createDataFrame([], df.schema)).collect() == []


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100)]
    got = {r.v: r.m for r in components(spark.createDataFrame(path + [(None, 3)], "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
