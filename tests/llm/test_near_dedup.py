"""The pipeline's near-duplicate stage against all pairs, on copies planted at similarities from 0.8 to 0.95."""

import random

import pytest

from veilgrid.llm import near_dedup as nd

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(docs, least=0.8):
    sets, label = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return {i for i in sets if label[i] == i}


def planted():
    r, docs, copies = random.Random(5), [], {}
    for k in range(60):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randrange(120, 400))]
        docs.append((k, " ".join(words)))
        for copy in range(2):
            new = list(words)
            for at in r.sample(range(len(words)), 1 + len(words) // r.choice([45, 60, 100, 200])):
                new[at] = f"x{r.randrange(10**6)}"
            docs.append((1000 + 2 * k + copy, " ".join(new)))
            a, b = shingles(docs[k * 3][1]), shingles(docs[-1][1])
            copies[docs[-1][0]] = len(a & b) / len(a | b)
    return docs, copies


def test_stage_drops_copies_from_080_to_095(spark):
    docs, copies = planted()
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.near(spark, frame, "").collect()}
    assert kept == brute(docs)
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.96)):
        some = {i for i, s in copies.items() if low <= s < high}
        assert len(some) >= 5 and not some & kept
    assert {i for i, s in copies.items() if s < 0.8} & kept


def test_anchors_link_close_fingerprints(spark, tmp_path):
    """The pairs connect what brute force over all fingerprints does, and those that are similar are links of the stage."""
    docs, _ = planted()
    docs += [(5000 + i, t.replace(" ", "  ")) for i, t in docs[:20]] + [(9000, ""), (9001, None)]
    frame = spark.createDataFrame(docs, "rid long, t string")
    pairs = [(r.u, r.v) for r in nd.anchor_pairs(frame, 5, 4, 3, f"file://{tmp_path}").collect()]
    ids, fps = [i for i, _ in docs], nd.column_prints(nd.pa.array([t for _, t in docs], nd.pa.string()), 5).tolist()
    close = [(a, b) for a, x in zip(ids, fps) for b, y in zip(ids, fps) if a < b and ((x ^ y) & (1 << 64) - 1).bit_count() <= 4]

    def groups(links):
        label, changed = {i: i for i in ids}, True
        while changed:
            changed = False
            for a, b in links:
                if label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
        return label

    assert all(u < v for u, v in pairs) and len(close) > 40 and groups(pairs) == groups(close)
    links = {(r.u, r.v) for r in nd.similar_links(frame, 5, 0.8, f"file://{tmp_path}/all").collect()}
    sets = {i: nd.shingle_set(t, 5) for i, t in docs}
    assert {p for p in pairs if nd.similar(sets[p[0]], sets[p[1]], 0.8)} <= links and all(nd.similar(sets[u], sets[v], 0.8) for u, v in links)


def test_map_of_common_shingles(spark, monkeypatch):
    """It has all it is made of, few others, and changes no result however full it is."""
    some = nd.shingle_set(" ".join(map(str, range(3000))), 5)
    common = nd.map_of(spark.createDataFrame([(int(x),) for x in some], "shingle long"), 16)
    assert nd._mapped(some, common).all() and nd._mapped(nd.shingle_set(" ".join(map(str, range(5000, 8000))), 5), common).mean() < 0.1
    docs = planted()[0][:90]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], SCHEMA)
    for bits in (9, 27):
        monkeypatch.setattr(nd, "MAP_BITS", bits)
        assert {r.doc_id for r in nd.drop_similar(frame).collect()} == brute(docs)


def test_long_runs_short_texts_and_nulls(spark):
    """A template that all rows share, hundreds of copies, and texts of fewer words than a shingle."""
    r = random.Random(6)
    page = [f"p{i}" for i in range(60)]
    docs = [(k, " ".join(page + [f"u{r.randrange(8)}" for _ in range(r.randrange(4, 22))])) for k in range(120)]
    docs += [(500 + k, "  ".join(page) + " " * k) for k in range(200)] + [(800, "one two"), (801, "one  two"), (802, "one three"), (803, ""), (804, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs] + [(None, " ".join(page), "en", "s", 1), (None, "a null id of its own", "en", "s", 1), (800, "one two", "en", "s", 1)], SCHEMA)
    got = [(r.doc_id, r.text) for r in nd.drop_similar(frame).collect()]
    assert sorted(i for i, _ in got if i is not None) == sorted(brute(docs))
    assert [t for i, t in got if i is None] == ["a null id of its own"]
    assert nd.drop_similar(frame.limit(0)).collect() == []
