"""The pipeline's stages on nulls, empty and long texts, repeated rows, empty tables, and further columns with the stages' own names."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, fp int, __rid long, key string, salt int, score double, rid string"
MORE = (1, "d", 2, 3, "k", 4, 0.5, "r")


def rows():
    texts = [(1, "Plain words of a text that goes on for a while, as texts do."), (1, "Plain words of a text that goes on for a while, as texts do."), (2, "PLAIN words of a text that goes on for a while, as texts do."), (3, None), (4, ""), (None, "a text of no id at all here"), (None, None), (5, "long words " * 20000), (1, "Another text under the same id, which is its own."), (6, None)]
    return [(i, t, "en", None, None, *MORE) for i, t in texts] + [(7, "nulls all over", *[None] * 11)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cases")
    spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "no such passage as this one is anywhere"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_take_all_cases(spark, folder):
    docs = spark.createDataFrame(rows(), SCHEMA)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        found = out.collect()
        assert all(tuple(r) in {tuple(x) for x in rows()} for r in found)
        kept[name] = sorted((r.doc_id or 0, (r.text or "")[:13]) for r in found)
    # Labels of one kind only: all stay.
    assert len(kept["quality"]) == len(kept["decontamination"]) == len(rows())
    assert kept["exact dedup"] == sorted([(2, "PLAIN words o"), (6, ""), (0, "a text of no "), (5, "long words lo"), (1, "Another text "), (7, "nulls all ove")])
    assert kept["near dedup"] == sorted([(1, "Plain words o"), (3, ""), (0, "a text of no "), (5, "long words lo"), (1, "Another text "), (7, "nulls all ove")])
    last = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert all(r.decodes for r in last) and sum(r.doc_id == 1 for r in last) == 6 and [r.n_pieces for r in last if r.doc_id in (3, 4, 6)] == [0, 0, 0]


def test_stages_of_empty_tables(spark, folder, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.createDataFrame(rows(), SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    for name, stage in (corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[3]):
        assert stage(spark, docs, str(tmp_path)).count() == len(rows())
