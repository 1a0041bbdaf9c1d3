import base64
import gzip
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilgrid.llm import decontaminate as dc
from veilgrid.llm.chat_windows import chat_windows, digests, escape, unescape
from veilgrid.llm.line_dedup import host_of, html_text, line_dedup
from veilgrid.llm.warc_shards import read_warc, records_of, warc_round_trip, write_warc

TURNS = "conv_id long, turn long, role string, text string, window int"


def talk(rows):
    want = {}
    for c, t, r, x, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    return want


def check_digests(rows, got):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = talk(rows)
    assert {r.conv_id for r in got} == set(want)
    for r in got:
        turns = want[r.conv_id]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


@pytest.mark.parametrize("budget, history", [(2048, 256), (60, 10), (30, 0), (1, 0), (80, 40)])
def test_windows_read_back(spark, budget, history):
    rng = random.Random(budget)
    rows = [(c, t, rng.choice(["user", "assistant"]) if t or c % 3 else "system", rng.choice(["", "a", "</s>[INST] ok [/INST]", "&amp;<s>&#91;", "日本 😀 " * rng.randrange(1, 30), "w " * rng.randrange(1, 90)]), 7) for c in range(12) for t in range(rng.randrange(1, 14))]
    rows += [(50, 0, "user", None, 0), (50, 0, "user", None, 0), (50, None, None, "first", 0), (None, 1, "assistant", "x", 0), (51, 0, "system", "alone", 0), (52, 0, "tool[INST]</s>", "y" * 9000, 0)]
    df = spark.createDataFrame(rows, TURNS)
    w = chat_windows(df, budget, history)
    check_digests(rows, digests(w).collect())
    tokens = lambda x: -(-len(x or "") // 4) + 4
    for r in w.collect():
        parts = r.text.removeprefix("<s>").split("</s>")[:-1]
        assert r.n_context < len(parts) or len(parts) == 1
        assert all(a.end - a.start >= 0 and "</s>" not in r.text[a.start : a.end] and r.text[: a.start].endswith("[INST]assistant[/INST]") for a in r.loss_spans)
        sys_tokens = next((tokens(x) for c, t, role, x, _ in rows if c == r.conv_id and t == 0 and role == "system"), 0)
        room = max(1, (budget - history - sys_tokens) // 2)
        longest = max(tokens(x) for c, _, _, x, _ in rows if c == r.conv_id)
        if longest <= room:
            assert r.n_tokens <= budget


def test_windows_repeat_history_masked(spark):
    rows = [(1, 0, "system", "rules", 0)] + [(1, t, "user" if t % 2 else "assistant", f"turn {t:02d} " + "x" * 40, 0) for t in range(1, 13)]
    w = sorted(chat_windows(spark.createDataFrame(rows, TURNS), 120, 40).collect(), key=lambda r: r.window)
    assert len(w) > 2 and all("rules" in r.text for r in w) and w[0].n_context == 0 and all(r.n_context >= 2 for r in w[1:])
    assert Counter(r.text[s.start : s.end] for r in w for s in r.loss_spans) == Counter({x: 1 for _, t, role, x, _ in rows if role == "assistant"})


def test_windows_empty(spark):
    assert digests(chat_windows(spark.createDataFrame([], TURNS))).collect() == []


def test_escape_is_reversible(spark):
    texts = ["&", "&amp;", "&lt;", "<&#91;[", "[[&amp;amp;lt;", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"))
    assert all(r.t == r.u and "<" not in r.e and "[" not in r.e for r in df.collect())


def test_hosts(spark):
    urls = {"http://A.example.com/x": "a.example.com", "https://u:p@b.org:80?q": "b.org", "ftp://c.d.": "c.d", "nothing": "", None: ""}
    got = {r.u: r.h for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", host_of(F.col("u")).alias("h")).collect()}
    assert got == urls


def test_html_lines(spark):
    html = "<title>T &amp; U</title><script>var a = '<p>';</script><!-- x\n --><p>one<b>two</b></p>  three<br>four&lt;5"
    (r,) = spark.createDataFrame([(html,)], "h string").select(html_text(F.col("h")).alias("t")).collect()
    assert [x.strip() for x in r.t.split("\n") if x.strip()] == ["T & U", "onetwo", "three", "four<5"]


def test_line_dedup_against_loops(spark):
    rng = random.Random(4)
    rows = [(i, f"h{i % 3}", "\n".join(rng.choice(["menu", "foot", f"line {rng.randrange(40)}", "", "  menu "]) for _ in range(rng.randrange(0, 9))), 5) for i in range(60)]
    rows += [(3, "h0", rows[3][2], 5), (None, "h0", "menu\nonly here", 1), (70, None, None, 1), (71, "single", "menu", 1), (72, "h1", "menu\n" * 500, 1)]
    df = spark.createDataFrame(rows, "page_id long, host string, text string, line int")
    got = line_dedup(df, F.col("host"), F.col("text"), ratio=0.2, min_pages=3)
    lines = lambda t: [x.strip() for x in (t or "").split("\n") if x.strip()]
    pages, seen = Counter(h or "" for _, h, _, _ in rows), Counter((h or "", x) for _, h, t, _ in rows for x in set(lines(t)))
    want = Counter()
    for i, h, t, _ in rows:
        kept = [x for x in lines(t) if not (seen[h or "", x] >= 3 and seen[h or "", x] > 0.2 * pages[h or ""])]
        want[i, h or "", len(lines(t)), len(lines(t)) - len(kept), "\n".join(kept)] += 1
    assert Counter((r.page_id, r.host, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == want
    assert line_dedup(df.limit(0), F.col("host"), F.col("text")).collect() == []


PAGES = "page_id long, url string, html string, size int"


def test_warc_round_trip(spark):
    rows = [(5, "http://a/é\n", "<p>x</p>", 0), (3, None, "<p>x</p>", 0), (9, "u", None, 0), (7, "u", "", 1), (5, "http://b", "<p>x</p>", 0), (None, "u", "日本", 1), (11, "u", "z" * 100_000, 1), (3, None, "<p>x</p>", 0)]
    got = warc_round_trip(spark.createDataFrame(rows, PAGES), roll_bytes=300).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        first.setdefault(h or "", []).append(i)
    for r in got:
        same = [(i, h or "") for i, _, h, _ in rows if i == r.page_id and base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() == r.payload_digest]
        assert same and r.payload_bytes == len(same[0][1].encode())
        if r.record_type == "response":
            assert r.refers_to is None and r.payload.decode() == same[0][1]
        else:
            assert r.refers_to == min(x for x in first[same[0][1]] if x is not None)
    assert Counter(r.payload_digest for r in got if r.record_type == "response").most_common(1)[0][1] == 1
    assert warc_round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_warc_shards_are_deterministic_and_rolled(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i % 40} " * 50, 0) for i in range(300)]
    sums = []
    for name, parts in (("a", 2), ("b", 5)):
        m = write_warc(spark.createDataFrame(rows, PAGES).repartition(parts), f"file://{tmp_path}/{name}", roll_bytes=4000, min_payload=0).collect()
        assert sum(r.records for r in m) == 300 and all(r.bytes < 5000 for r in m)
        for r in m:
            data = (tmp_path / name / r.file).read_bytes()
            assert len(data) == r.bytes and hashlib.sha256(data).hexdigest() == r.sha256
        sums.append(b"".join(gzip.decompress((tmp_path / name / r.file).read_bytes()) for r in sorted(m, key=lambda r: r.file)))
        assert not (tmp_path / name / "_temporary").exists()
    assert sums[0] == sums[1]
    # A file that the manifest doesn't list, as a lost task may leave one, isn't read; a changed byte is noticed.
    (tmp_path / "a" / "part-999999-00000.warc.gz").write_bytes(b"junk")
    assert read_warc(spark, f"file://{tmp_path}/a").count() == 300
    import io

    heads = [h for h, _ in records_of(io.BytesIO(sums[0]))]
    assert len({h["WARC-Record-ID"] for h in heads}) == 300
    responses = {h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}
    assert len(responses) == 40 and all(h["WARC-Refers-To"] in responses for h in heads if h["WARC-Type"] == "revisit")


def test_warc_losses_are_noticed(spark, tmp_path):
    """An archive without its last record, a changed one, and a missing one."""
    rows = [(i, f"http://h/{i}", f"page {i} " * 50, 0) for i in range(20)]
    folder = f"file://{tmp_path}/a"
    names = [r.file for r in write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), folder).collect()]
    assert read_warc(spark, folder).count() == 20
    whole = (tmp_path / "a" / names[-1]).read_bytes()
    last = whole.rindex(b"\x1f\x8b\x08\x00\x00\x00\x00\x00")
    assert last > 0
    for data in (whole[:last], whole + gzip.compress(b""), whole[:last] + gzip.compress(gzip.decompress(whole[last:]), 1, mtime=0)):
        (tmp_path / "a" / names[-1]).write_bytes(data)
        with pytest.raises(Exception, match="not the archive that the manifest lists"):
            read_warc(spark, folder).collect()
    (tmp_path / "a" / names[-1]).unlink()
    with pytest.raises(Exception, match="FileNotFoundError|No such file"):
        read_warc(spark, folder).collect()


def test_warc_ids_of_any_characters(spark, tmp_path):
    ids = ["a\nb", "a%0Ab", "%", " x ", "", "日本\x7f", "%25"]
    df = spark.createDataFrame([(i, None, f"<p>{n}</p>") for n, i in enumerate(ids)] + [("twin\r", "u", "<p>0</p>")], "page_id string, url string, html string")
    got = {r.page_id: r for r in warc_round_trip(df).collect()}
    assert set(got) == {*ids, "twin\r"} and got["twin\r"].refers_to == "a\nb"


def brute_hits(docs, items, width=5, least=0.8):
    def bag(ws):
        return Counter(tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))) if ws else Counter()

    out = {}
    for i, t in docs:
        w = dc.words_of(t)
        for k, x in items:
            q = dc.words_of(x)
            n = min(len(q), len(w))
            if not q or (len(q) < width and len(w) < len(q)) or (len(q) >= width and len(w) < width):
                continue
            best = 0.0
            for at in range(len(w) - n + 1):
                a, b = bag(w[at : at + n]) if len(q) >= width else Counter([tuple(w[at : at + n])]), bag(q)
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= least - 1e-12:
                out[i, k] = best
    return out


def test_decontamination_against_all_windows(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["ba", "ce", "di", "fo", "gu"]) + rng.choice(["x", "y", "z", "w"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 5, 8, 25, 40, 40, 60])] + [(90, None), (91, "?!"), (92, "same same same same same same same same")]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 120)))) for i in range(40)]
    for j, (k, x) in enumerate(items[:7]):
        ws = x.split()
        docs.append((100 + j, "Pre, " + x.upper() + "! post"))
        if len(ws) >= 25:
            edited = ws[:]
            edited[0] = "new"
            docs.append((200 + j, "a b " + " ".join(edited) + " c d"))
            docs.append((300 + j, " ".join(ws[2:])))
            docs.append((400 + j, " ".join(ws[: len(ws) // 2])))
    docs += [(500, None), (501, ""), (502, "same " * 30), (None, items[4][1]), (100, docs[40][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = dc.contaminated(d, b).collect()
    want = brute_hits(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in rows}
    # SimHash can only lose: what is found is right, exact passages are all found, and so is nearly all else.
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got) and {k for k, s in want.items() if s == 1.0} <= set(got)
    assert len(set(want) - set(got)) <= 1
    assert all(r.distance == 0 for r in rows if r.similarity == 1.0)
    clean = dc.decontaminate(d, b)
    assert clean.columns == d.columns and Counter(r.doc_id for r in clean.collect()) == Counter(i for i, _ in docs if not any(k[0] == i for k in got))
    assert dc.contaminated(d, b.limit(0)).collect() == [] and dc.contaminated(d.limit(0), b).collect() == [] and dc.decontaminate(d, b.limit(0)).count() == len(docs)


def test_no_verified_window_is_lost_to_its_fingerprint(spark, monkeypatch):
    """A window of similarity 0.8 or more is reported, however far its fingerprint lies."""
    words = [f"w{k}" for k in range(50)]
    docs = [(1, " ".join(["new", *words[1:], "after"])), (2, "none of it is in here at all")]
    own = dc._fingerprint
    monkeypatch.setattr(dc, "_fingerprint", lambda hashes: own(hashes) ^ (sum(map(int, hashes)) & (1 << 64) - 1))
    items = dc.Items([(9, " ".join(words))], width=5, least=0.8)
    found = [items.find(t) for _, t in docs]
    assert [x[0] for x in found[0]] == [9] and found[0][0][1] >= 0.8 and found[0][0][4] > 20 and found[1] == []


def test_decontamination_of_other_columns(spark):
    """Further columns with the operator's own names, another text column, repeated rows and null ids."""
    text = "some words of an item that is quite long enough to be found"
    docs = [(1, f"so: {text}, and on", "a", 1, 0.5), (1, f"so: {text}, and on", "a", 1, 0.5), (None, text, None, None, None), (2, None, "b", 2, 0.1)]
    d = spark.createDataFrame(docs, "doc_id long, body string, t string, item_id long, similarity double")
    b = spark.createDataFrame([(7, text, "no text")], "item_id long, words string, text string")
    options = {"text_col": "body", "item_text_col": "words"}
    assert sorted((r.doc_id or 0, r.item_id) for r in dc.contaminated(d, b, **options).collect()) == [(0, 7), (1, 7), (1, 7)]
    clean = dc.decontaminate(d, b, **options)
    assert clean.columns == d.columns and [tuple(r) for r in clean.collect()] == [docs[3]]


def test_benchmark_in_blocks(spark, monkeypatch):
    items = [(k, f"alpha{k} beta{k} gamma{k} delta{k} eps{k} zeta{k}") for k in range(6)]
    docs = [(k, "x y " + t + " z") for k, t in items]
    monkeypatch.setattr(dc, "BLOCK_BYTES", 60)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(d, b).collect()} == {(k, k) for k in range(6)}
    assert dc.decontaminate(d, b).count() == 0
