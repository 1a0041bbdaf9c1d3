"""Lanes, stages, lookups, catalogs and receipts of a gate run."""

import codecs
import json

import pytest
from pyspark.sql import functions as F

from veilgrid.operators import gate, redact, routing
from veilgrid.operators.anonymize import Config
from veilgrid.sources.encodings import decode_html
from veilgrid.sources.files import html_pages


def test_html_encodings(spark):
    cases = {"a": b"<p>x</p>", "b": codecs.BOM_UTF8 + "é".encode(), "c": "日本".encode("cp932"), "d": "x".encode("utf-16"), "e": codecs.BOM_UTF32_BE + b"\0\0\0x", "f": b"\x81\xff", "g": codecs.BOM_UTF8 + b"\xff"}
    want = {"a": ("<p>x</p>", "utf-8"), "b": ("é", "utf-8-sig"), "c": ("日本", "cp932")}
    assert {k: decode_html(v) for k, v in cases.items()} == {k: want.get(k, (None, None)) for k in cases}
    rows = html_pages(spark.createDataFrame([*cases.items(), ("h", None)], "path string, content binary")).collect()
    assert {r.path: (r.html, r.encoding) for r in rows} == {k: want.get(k, (None, None)) for k in [*cases, "h"]}
    assert {r.path: r.reason for r in rows} == dict.fromkeys("abc") | dict.fromkeys("defg", "undecodable") | {"h": "too_large"}


def test_observation_catalog():
    doc = {"version": 1, "observations": [{"codepoint": "U+200B", "count": 2, "positions": [1, 5]}, {"codepoint": "U+0430", "twin": "U+0061"}, {"codepoint": "U+200B", "twin": "U+0020"}]}
    rules = redact.catalog_rules(json.dumps(doc).encode())
    assert redact.apply("x​аy", rules)[0] == "xay" and len(rules) == 2
    bad = {"/observations/0/codepoint": '{"version": 1, "observations": [{"codepoint": "U+D800"}]}', "/observations/0/twin": '{"version": 1, "observations": [{"codepoint": "U+41", "twin": "U+41,U+42"}]}', "/version": '{"version": true, "observations": []}', "not 1": '{"version": 2, "observations": []}', "unknown key": '{"version": 1, "observations": [], "x": 0}', "missing": '{"version": 1}', "twice": '{"version": 1, "version": 1, "observations": []}', "not a number": '{"version": NaN, "observations": []}', "positions/0": '{"version": 1, "observations": [{"codepoint": "U+41", "positions": ["1"]}]}'}
    for text, data in bad.items():
        with pytest.raises(ValueError, match=text):
            redact.catalog_rules(data.encode())
    with pytest.raises(ValueError, match="1 MiB"):
        redact.catalog_rules(b" " * (1 << 20) + b"{}")


def test_stages_are_a_closed_list(spark):
    one = spark.range(1)
    with pytest.raises(Exception, match="unknown reason: other"):
        one.select(routing.unobserved_stage(F.lit("other"))).collect()
    with pytest.raises(Exception, match="unobserved needs its reason"):
        one.select(routing.not_produced_stage(F.lit("unobserved"), F.lit(None).cast("string"))).collect()
    assert one.select(routing.not_produced_stage(F.lit("unobserved"), F.lit("empty_input"))).first()[0] == "excluded"


def test_short_circuits(spark):
    df = spark.createDataFrame([(1, 2, True), (1, 3, False), (2, 3, None)], "a int, b int, short_circuited boolean")
    assert [(r.a, r.b) for r in routing.without_short_circuits(df).collect()] == [(1, 3), (2, 3)] and tuple(routing.short_circuits(df).first()) == (2, 1)


def test_segments_beyond_the_limits_are_counted(spark, monkeypatch):
    monkeypatch.setattr(gate, "MAX_SEGMENTS", 3)
    monkeypatch.setattr(gate, "MAX_SEGMENT_CHARS", 5)
    html = "".join(f"<p hidden>{'x' * n}</p>" for n in (2, 6, 7, 9, 1))
    (r,) = gate.gate(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert (r.hidden, r.segments_skipped, r.segments_truncated) == (5, 2, 2)


def test_image_lane(spark):
    rows = [("a.png", b"\x89PNG\r\n\x1a\nrest"), ("b.JPG", b"\xff\xd8\xff\xe0"), ("c.png", b"GIF89a"), ("d.jpeg", None), ("e.txt", b"x")]
    got = {r.path: (r.status, r.produced, r.reason, r.unobserved_reason) for r in routing.gate_images(spark.createDataFrame(rows, "path string, content binary")).collect()}
    fine = ("clean", False, "needs_settings", None)
    assert got == {"a.png": fine, "b.JPG": fine, "c.png": ("unobserved", False, "unobserved", "refused"), "d.jpeg": ("unobserved", False, "unobserved", "too_large")}


def test_table_lane(spark):
    people = spark.createDataFrame([(f"n{i}", str(20 + i % 2)) for i in range(12)], "name string, age string")

    def read(path):
        if path == "broken":
            raise ValueError("ragged")
        return people if path == "people" else people.limit(3)

    assert routing.gate_tables(["people"], read, None) == [("people", False, "needs_settings", None)]
    config = Config({"name": {"role": "drop"}, "age": {"role": "qi"}}, k=5, shuffle=False)
    got = {p: (done, why) for p, done, why, _ in routing.gate_tables(["people", "broken", "few"], read, config)}
    assert got == {"people": (True, None), "broken": (False, "engine_refused"), "few": (False, "engine_refused")}


def test_keyed_receipts(spark):
    listing = spark.createDataFrame([("a.txt", "1" * 64), ("d/b.txt", "2" * 64)], "path string, sha256 string")
    other = spark.createDataFrame([("a.txt", "3" * 64), ("d/b.txt", "2" * 64)], "path string, sha256 string")
    plain, keyed = routing.gate_receipt({"items": 2}, listing), routing.gate_receipt({"items": 2}, listing, b"key")
    assert "overall_sha256" not in plain["summary"] and routing.verify_receipt(plain, listing) == "match" and routing.verify_receipt(plain, listing, b"key") == "not_verifiable"
    assert routing.verify_receipt(keyed, listing, b"key") == "match" and routing.verify_receipt(keyed, other, b"key") == "differs"
    assert routing.verify_receipt(keyed, listing, b"other") == "not_verifiable" and routing.verify_receipt(keyed | {"kind": "x"}, listing, b"key") == "differs"


def test_cohort_arithmetic():
    pairs = [{"referee": {}}, {"referee": {}}, {"scope": {}}]
    good = {"flagged": 3, "referee": {"RED": 1, "YELLOW": 1, "GREEN": 4, "total": 6}, "scope": {"pairs": 1}}
    assert routing.summary_consistent(good, pairs)
    for change in ({"flagged": 2}, {"referee": {"RED": 2, "YELLOW": 1, "GREEN": 3, "total": 6}}, {"referee": {"RED": 1, "YELLOW": 1, "GREEN": 5, "total": 6}}, {"scope": {"pairs": 2}}, {"generic": {"pairs": 1}}):
        assert not routing.summary_consistent(good | change, pairs)
    assert not routing.summary_consistent(good, [*pairs[:2], {"scope": {}, "generic": {}}])
