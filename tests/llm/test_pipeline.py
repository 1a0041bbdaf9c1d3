"""The pipeline's stages against brute force on a small fixture."""

import re
import zlib

import pytest
import xxhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    t = lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet")
    docs = t("documents")
    long = docs.orderBy("n_chars", ascending=False).limit(1)
    passage = " ".join(t("benchmark").orderBy("item_id").first()["text"].split())
    extra = [(9001, "Plain words of a text that holds this: " + passage + " and then goes on for a while.", "en", "src1", 1), (9002, docs.first()["text"].upper(), "en", "src1", 1)]
    near = long.selectExpr("9003L AS doc_id", "concat(text, ' end') AS text", "lang", "source", "n_chars")
    docs.union(spark.createDataFrame(extra, docs.schema)).union(near).write.parquet(f"{d}/documents.parquet")
    for n in ("labels", "benchmark"):
        t(n).write.parquet(f"{d}/{n}.parquet")
    return str(d)


def test_stages(spark, fixture):
    docs = spark.read.parquet(f"{fixture}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{fixture}/labels.parquet").collect()}
    rows, kept = {r.doc_id: r for r in docs.collect()}, []
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        frame = stage(spark, frame, fixture)
        assert frame.columns == docs.columns
        frame.write.parquet(f"{fixture}/{name.replace(' ', '_')}")
        frame = spark.read.parquet(f"{fixture}/{name.replace(' ', '_')}")
        kept.append({r.doc_id for r in frame.collect()})
        assert frame.count() == len(kept[-1])
    quality, exact, near, clean = kept
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((i in quality) == labels[i] for i in held) >= 0.9 * len(held)

    groups = {}
    for i in quality:
        groups.setdefault(lower(rows[i].text), []).append(i)
    assert exact == {max(g) for g in groups.values()}

    fp, label = {i: fingerprint(rows[i].text) for i in exact}, {i: i for i in exact}
    changed = True
    while changed:
        changed = False
        for a in exact:
            for b in exact:
                if (fp[a] ^ fp[b]).bit_count() <= 4 and label[a] > label[b]:
                    label[a], changed = label[b], True
    assert near == {i for i in exact if label[i] == i} and 9003 not in near

    from veilgrid.llm.decontaminate import words_of

    items = [b" ".join(words_of(r.text)) for r in spark.read.parquet(f"{fixture}/benchmark.parquet").collect()]
    leaks = {i for i in near if any(b" " + x + b" " in b" " + b" ".join(words_of(rows[i].text)) + b" " for x in items)}
    assert not leaks & clean and 9001 not in clean and len(near - leaks - clean) <= 0.02 * len(near)

    out = corpus_pipeline.run(spark, fixture).collect()
    assert {r.doc_id for r in out} == clean and all(r.decodes for r in out)
    assert all(1 <= sum(x.doc_id == i for x in out) <= 2 for i in clean)
