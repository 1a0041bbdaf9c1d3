import math
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from veilgrid.llm import hpylm, piece_sampling, quality_pairs, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [(i, " ".join("the cat sat on the mat . a dog ran to the park ; it's no fun".split()[(i * k) % 13 : (i * k) % 13 + 5 + i % 4]) + " end.") for k in (3, 5) for i in range(60)]
TEXTS = [(n, t) for n, (_, t) in enumerate(TEXTS)]


def brute(rows):
    words = {i: [*(t or "").lower().split(), ""] for i, t in rows}
    train = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    return {i: (len(ws), sum(w in train for w in ws), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in words.items()}


def test_language_model_counts_and_gain(spark):
    rows = [*TEXTS, (1000, None), (1001, "zebra"), (1002, "The " * 500)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in hpylm.score_texts(df, contexts=8, shards=3).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, (n, known, total, base) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0 and r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in got.values() if r.held_out and r.doc_id < 1000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_every_word_is_a_context(spark):
    """Words of one last character, each with a successor of its own, are told apart, whether their totals are sent to all tasks or added up by buckets."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"a{k}x b{k}y" for k in rng.integers(0, 60, 12).tolist())) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    mean = lambda **more: np.mean([r.score / r.n_tokens for r in hpylm.score_texts(df, shards=5, **more).collect() if r.held_out])
    none, all_ = mean(contexts=0), mean(share=1e-9)
    assert abs(none - all_) < 0.02 and none > -1.1  # half the tokens follow from the one before, the others are one in 60: -0.9 or so


@pytest.mark.parametrize("split, cut", [(8_000_000, 2_000_000), (40, 25), (1, 1)])
def test_chunks_hold_all_words(monkeypatch, split, cut):
    """Against Python's own split, whatever the batches, slices of them and chunks; nulls, empty and blank texts."""
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(hpylm, "SPLIT_BYTES", split)
    monkeypatch.setattr(hpylm, "CHUNK_TOKENS", cut)
    texts = ["The cat\x0b\x0cSAT ", None, "", " \n\t ", "\u00c4\u00df \u2003x \x1cy\u00a0Z", "  a\r\nb", *(f"Word{i % 7} b{i} " * (i % 5) for i in range(60)), None]
    table = hpylm.pa.table({"id": range(len(texts)), "t": texts}).slice(1)
    found, cuts = [], []
    for size in (7, 1000):
        found.clear()
        for c in hpylm._chunks(7, 2, 1e-4)(table.to_batches(max_chunksize=size)):
            x = hpylm._unpack(c["texts"][0].as_py())
            words = np.array([*hpylm._split(x["words"], int(x["n"][0])), None], object)[x["flat"]]
            assert len(words) == c["tokens"][0].as_py() and x["train"].tolist() == [zlib.crc32(str(i).encode()) % 7 != 2 for i in c["ids"][0].as_py()]
            found += [(i, w.tolist()) for i, w in zip(c["ids"][0].as_py(), np.split(words, np.cumsum(x["lens"])[:-1]))]
            cuts.append(len(x["lens"]))
        lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
        assert found == [(i, [*(texts[i] or "").encode().translate(lower).split(), b""]) for i in range(1, len(texts))]
    assert (max(cuts) == 1) == (cut == 1)


def test_little_is_kept(spark):
    """Of a sweep the state keeps tables by pair, not each table's customers; requests and texts are stored once and not shuffled for scoring."""
    rng = np.random.default_rng(5)
    words = [b"w%d" % i for i in range(300)]
    w, r = (np.sort(rng.choice(300 * hpylm.CLASSES, 4000, False)) // hpylm.CLASSES, None)
    r = np.concatenate([np.sort(rng.choice(hpylm.CLASSES, n, False)) for n in np.bincount(w)[np.bincount(w) > 0]])
    c = rng.integers(1, 9, 4000)
    assert all((hpylm._unpack(hpylm._pack(w=w, r=r, c=c))[k] == x).all() for k, x in (("w", w), ("r", r), ("c", c)))
    shard = hpylm.Shard.merged([{"words": hpylm._joined(words), "n": np.array([300]), "w": w, "r": r, "c": c}], np.zeros(0, np.int64))
    before = len(shard.packed())
    sums = shard.sweep(hpylm.Totals([], shard.first_sums(0)), np.random.default_rng(1))
    assert int(sums[0]) > 0 and len(shard.packed()) < before + 4000  # a byte a pair at most
    plan = hpylm.score_texts(spark.createDataFrame(TEXTS, "doc_id long, text string"), shards=2)._jdf.queryExecution().executedPlan().toString()
    assert "answer" in plan and "texts" not in plan


def test_the_rest_is_a_distribution():
    """Contexts that are not in the inventory, in two shards: probabilities of all words add up to one, totals to the shards' parts."""
    contexts, parents = {b"the": 0}, np.array([hpylm._class_of(b"the")])
    number: dict = {b"": 0}
    flat, lens = [], []
    for _, t in TEXTS:
        ws = t.encode().split()
        flat += [number.setdefault(w, len(number)) for w in [*ws, b""]]
        lens.append(len(ws) + 1)
    chunk = hpylm._pack(words=hpylm._joined(list(number)), n=np.array([len(number)]), flat=np.array(flat), lens=np.array(lens), train=np.ones(len(lens), bool))
    (made,) = hpylm._requests(contexts, 1)([hpylm.pa.RecordBatch.from_arrays([hpylm.pa.array([0]), hpylm.pa.array([chunk])], ["chunk", "texts"])])
    asked = hpylm._unpack(made.column(2)[0].as_py())
    shard = hpylm.Shard.merged([asked], parents)
    sums, (x, _) = shard.first_sums(1), hpylm.rest_contexts([asked])
    assert len(x) == len(number) - 2  # all but the end and the one in the inventory
    backs = []
    for n in range(4):
        told = [hpylm._unpack(d) for d in shard.told(3, x if not n else None) if d]
        shard.hear([{"t": d["t"], "c": d["c"], "i": np.arange(len(d["t"]))} for d in told])
        t = hpylm.Totals(list(parents), sums)
        assert int(t.c[t.row(2)].sum() + shard.s["xc"].sum()) == int(shard.s["c2"].sum()) == len(flat) - len(lens)
        if n:
            shard.keep_sample(t)
            backs.append([t.back(level) for level in range(3)])
        if n < 3:
            sums = shard.sweep(t, np.random.default_rng(n))
    words = hpylm._split(asked["words"], int(asked["n"][0]))
    every = [*words, b"never seen"]
    for k in range(-1, len(x)):
        q = {"words": hpylm._joined(every), "n": np.array([len(every)]), "w": np.arange(len(every)), "r": np.full(len(every), hpylm.CLASSES + 1 + max(k, 0) if k >= 0 else hpylm.CLASSES), "x": x}
        _, p = shard.answer(q, parents, [np.array([b[level] for b in backs]) for level in range(3)], len(words), x)
        assert math.isclose(p.sum(), 1.0, rel_tol=1e-5) and (p > 0).all()


def test_language_model_is_a_distribution():
    """Over all training words and the unknown one, in a context seen, a class seen and a class unseen."""
    contexts = {b"the": 0, b"a": 1}
    parents = np.array([hpylm._class_of(w) for w in contexts])
    texts = [t.encode().split() for _, t in TEXTS]
    number: dict = {b"": 0}
    flat, lens = [], []
    for ws in texts:
        flat += [number.setdefault(w, len(number)) for w in [*ws, b""]]
        lens.append(len(ws) + 1)
    chunk = {"words": hpylm._joined(list(number)), "n": np.array([len(number)]), "flat": np.array(flat), "lens": np.array(lens), "train": np.ones(len(lens), bool)}
    words, _, order, _, w, r, c, _ = hpylm._pairs(chunk, contexts, 1)
    asked = {"words": hpylm._joined([words[i] for i in order]), "n": np.array([len(words)]), "w": w, "r": r, "c": c}
    shard = hpylm.Shard.merged([asked], parents)
    sums, backs = shard.first_sums(2), []
    for n in range(4):
        t = hpylm.Totals(list(parents), sums)
        if n:
            shard.keep_sample(t)
            backs.append([t.back(level) for level in range(3)])
        sums = shard.sweep(t, np.random.default_rng(n))
    t = hpylm.Totals(list(parents), sums)
    shard.keep_sample(t)
    backs.append([t.back(level) for level in range(3)])
    stacked = [np.array([b[level] for b in backs]) for level in range(3)]
    every = [*words, b"never seen"]
    for room in (hpylm.CLASSES, hpylm.CLASSES + 1, hpylm._class_of(b"cat"), hpylm._class_of(b"7")):
        q = {"words": hpylm._joined(every), "n": np.array([len(every)]), "w": np.arange(len(every)), "r": np.full(len(every), room)}
        counts, p = shard.answer(q, parents, stacked, len(words))
        assert math.isclose(p.sum(), 1.0, rel_tol=1e-5) and (p > 0).all() and counts[-1] == 0
    # Seating: every pair has its customers, every table one at least, tables are the parent's customers.
    seats = shard.seats(t)
    assert (seats[2].c == shard.s["c2"]).all() and all((s.sizes > 0).all() for s in seats)
    assert (seats[1].c == shard.s["direct"] + np.bincount(shard.s["up2"], weights=seats[2].tables(), minlength=len(seats[1].c))).all()


def test_seating_matches_the_exact_posterior():
    """Tables of one pair of five customers: the chain's frequencies against all seatings, weighed one by one."""
    d, q, n = 0.5, 0.7, 5
    weights = {1: 0.0}
    del weights[next(iter(weights))]

    def seatings(sizes, left, p):
        if not left:
            weights[len(sizes)] = weights.get(len(sizes), 0.0) + p
            return
        for i, s in enumerate(sizes):
            seatings([*sizes[:i], s + 1, *sizes[i + 1 :]], left - 1, p * (s - d))
        seatings([*sizes, 1], left - 1, p * q)

    seatings([], n, 1.0)
    total = sum(weights.values())
    rng, copies = np.random.default_rng(0), 4000
    s = hpylm.Seats(np.full(copies, n), np.full(copies, n), np.arange(copies), d)
    for _ in range(12):
        s.gibbs(np.full(copies, q), rng)
    found = Counter(s.tables().tolist())
    for k, w in weights.items():
        assert abs(found[k] / copies - w / total) < 0.03


def test_follow_reaches_its_target():
    rng = np.random.default_rng(1)
    s = hpylm.Seats(np.zeros(3, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0.5)
    for target in ([5, 1000, 0], [2, 10, 3], [0, 500, 1]):
        s.follow(np.array(target), np.full(3, 2.0), rng)
        assert s.c.tolist() == target and np.bincount(s.own, weights=s.sizes, minlength=3).tolist() == target


def log_stirling(n, d):
    """log S(n, t): the sum over seatings of n customers at t tables of the product of (1 - d)(2 - d)... per table."""
    row = [-math.inf, 0.0]
    for k in range(1, n):
        new = [-math.inf] * (k + 2)
        for t in range(1, k + 2):
            a = row[t - 1]
            b = row[t] + math.log(k - d * t) if t <= k else -math.inf
            new[t] = np.logaddexp(a, b)
        row = new
    return np.array(row)


@pytest.mark.parametrize("d", [0.1, 0.4, 0.8])
@pytest.mark.parametrize("n, q", [(2, 0.5), (20, 0.5), (64, 9.0), (65, 0.3), (90, 0.05), (400, 3.0), (2000, 0.7), (2000, 400.0), (1000, 30.0)])
def test_seatings_as_a_whole(n, q, d):
    """Tables of pairs of few and of many customers against the exact distribution, p(t) ~ S(n, t) q^t."""
    copies, rng = 3000, np.random.default_rng(6)
    w = log_stirling(n, d) + np.arange(n + 1) * math.log(q)
    p = np.exp(w - w.max())
    p /= p.sum()
    mean = float((p * np.arange(n + 1)).sum())
    sd = math.sqrt(float((p * (np.arange(n + 1) - mean) ** 2).sum()))
    s = hpylm.Seats(np.full(copies, n), np.zeros(0, np.int64), np.zeros(0, np.int64), d)
    s.gibbs(np.full(copies, q), rng)
    t = s.tables()
    assert (np.bincount(s.own, weights=s.sizes) == n).all() and (s.c == n).all()
    assert abs(t.mean() - mean) < 4.5 * sd / math.sqrt(copies) + 0.004 * mean and 0.9 < (t.std() + 1e-9) / (sd + 1e-9) < 1.1


def test_discount_and_strength_are_found():
    """Of restaurants seated with known values, the posterior draws lie near them."""
    rng, d, a = np.random.default_rng(9), 0.6, 2.0
    sizes, c, t = [], [], []
    for _ in range(200):
        own = []
        for n in range(400):
            weights = np.array([*(x - d for x in own), a + d * len(own)])
            k = int(rng.choice(len(weights), p=weights / weights.sum()))
            own[k : k + 1] = [own[k] + 1] if k < len(own) else [1]
        sizes += own
        c.append(400)
        t.append(len(own))
    totals = hpylm.Totals([0] * 200)
    totals.c[1 + hpylm.CLASSES :], totals.t[1 + hpylm.CLASSES :] = c, t
    z, drawn = np.array(sizes), []
    tables = np.zeros((3, hpylm.EXACT - 1), np.int64)
    tables[2] = [(z > j).sum() for j in range(1, hpylm.EXACT)]
    for k in range(60):
        big = z[z > hpylm.EXACT]
        tails = np.array([0, 0, np.log((big - totals.discount[2]) / (hpylm.EXACT - totals.discount[2])).sum()])
        totals.redraw(tables, tails, rng)
        drawn.append((totals.discount[2], totals.strength[2]))
    found = np.mean(drawn[20:], 0)
    assert abs(found[0] - d) < 0.03 and abs(found[1] - a) < 0.5


def test_language_model_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "the cat sat"), (1, "the cat sat"), (None, "the cat sat"), (None, None)]
    got = hpylm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), shards=2).collect()
    assert len(got) == 4 and sorted(r.n_tokens for r in got) == [1, 4, 4, 4] and len({(r.held_out, r.score) for r in got if r.doc_id == 1}) == 1


def test_language_model_edge_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert hpylm.score_texts(none, shards=2).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = hpylm.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), shards=2).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == 0


def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["", "a", "it's we'll 'S  x\n\n  y \t", "é日本語😀 १२", "<|endoftext|>a<|endoftext|>  ", "-" * 700, "aB1!" * 900, "\0 \0", "word " * 3000, " 　x\xa0", None]
    got = token_counts.token_counts(spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id int, text string, n_tokens int"), path).collect()
    for r, x in zip(sorted(got, key=lambda r: r.doc_id), texts):
        want = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len((x or "").encode()), want > 512)
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id int, text string"), path).collect() == []


def test_piece_state_maps_compose(monkeypatch):
    """Long pieces, in chunks of any length, with wrong first guesses, and with transitions forgotten on the way."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), np.random.default_rng(2)
    c = token_counts.Counter(path)
    texts = ["a" * 5000, "".join(rng.choice(list("abcdefghinorstxyz"), 7000)), "the" * 3000, "é" * 2500, "=-" * 4000, "".join(rng.choice(list("aAbBé日"), 3001))]
    want = [len(library.encode(x, add_special_tokens=False).ids) for x in texts]
    assert c.counts(texts) == want
    for chunk, overlap, maps, kept in ((7, 3, 5, 10**9), (100, 0, 3, 10**9), (64, 20, 8, 50), (1, 1, 64, 0)):
        for name, n in (("PIECE_CHUNK", chunk), ("OVERLAP", overlap), ("MAPS", maps), ("MAX_TRANSITIONS", kept)):
            monkeypatch.setattr(token_counts, name, n)
        c._forget()
        assert c.counts(texts) == want


def test_token_counts_of_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], "doc_id int, text string")
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(df, public_tokenizers.path("byte_bpe_50k.json")).collect())
    assert got == {(1, 2): 2, (None, 2): 1, (None, 0): 1}


def test_splitter_state_maps_compose(monkeypatch):
    """Chunks of any length give the same beginnings."""
    c = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["it's  a 'll test\n\n 12 ab's", "x" * 30, " '  've"]
    want = c.counts(texts)
    for n in (1, 2, 3, 7):
        monkeypatch.setattr(token_counts, "CHUNK", n)
        c._forget()
        assert c.counts(texts) == want


def test_samples_without_replacement():
    v = piece_sampling.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    n = 3000
    out = piece_sampling.sample_group(["the on"] * n, list(range(n)), 3, v)
    piece = {p: i for i, p in enumerate(v.pieces)}

    def every(u):
        return [((), 0.0)] if not u else [((piece[u[:k]], *rest), v.log_p[piece[u[:k]]] + p) for k in range(1, len(u) + 1) if piece.get(u[:k]) in v.log_p for rest, p in every(u[k:])]

    p = {s: w for s, w in every("▁the▁on")}
    z = math.log(sum(map(math.exp, p.values())))
    p = {s: math.exp(w - z) for s, w in p.items()}
    first = Counter(tuple(o[0][0].tolist()) for o in out)
    best = max(p, key=p.get)
    assert abs(first[best] / n - p[best]) < 0.02
    for o in out:
        keys = [tuple(s[0].tolist()) for s in o]
        assert len(set(keys)) == 3 and [s[2] for s in o] == sorted((s[2] for s in o), reverse=True)
        assert all(math.isclose(math.exp(s[1]), p[k], rel_tol=1e-6) for s, k in zip(o, keys))
    # Inclusion scores: the estimate of the total probability has no bias.
    assert abs(np.mean([sum(math.exp(s[1]) / s[3] for s in o) for o in out]) - 1) < 1e-3


def test_samples_of_texts_that_end_where_they_branch():
    v = piece_sampling.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    for out in piece_sampling.sample_group(["a", "the", "no", "x\n"] * 100, list(range(400)), 4, v):
        assert len({tuple(s[0].tolist()) for s in out}) == len(out) and all(0 < s[3] <= 1 for s in out)


def test_kept_lattices_change_nothing(monkeypatch):
    """Samples are the same to the last bit with lattices kept, made anew, and in other groups."""
    v = piece_sampling.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["the cat sat", "a dog\tran  far 日本 é", "Thlyre onding " * 300, "", "zq"]
    show = lambda out: [[(s[0].tolist(), *s[1:]) for s in o] for o in out]
    want = show(piece_sampling.sample_group(texts, list(range(5)), 3, v))
    known = piece_sampling.Units(v)
    for edges in (10**9, 0):
        monkeypatch.setattr(piece_sampling, "MAX_EDGES", edges)
        for part in ([4], [2, 0], [3, 1], [0, 1, 2, 3, 4]):
            assert show(piece_sampling.sample_group([texts[i] for i in part], part, 3, v, known)) == [want[i] for i in part]


def test_full_lattices_are_not_made_anew(monkeypatch):
    """What is kept stays when no more is taken; it gives way only to texts that have little of it."""
    v, made = piece_sampling.vocabulary(public_tokenizers.path("piece_bpe_32k.model")), []

    class Counted(piece_sampling.Lattice):
        def __init__(self, units, v):
            made.extend(units)
            super().__init__(units, v)

    monkeypatch.setattr(piece_sampling, "Lattice", Counted)
    monkeypatch.setattr(piece_sampling, "MAX_EDGES", 10)
    known = piece_sampling.Units(v)
    known.first(["▁the", "▁cat", "▁sat", "▁here"])
    for k in range(3):
        known.first(["▁the", "▁cat", "▁sat", f"▁other{k}"])
    assert Counter(made)["▁the"] == 1 and len(made) == 7 and len(known.node) == 4
    known.first(["▁new", "▁words", "▁the"])
    assert set(known.node) == {"▁new", "▁words", "▁the"}


def test_decoding_cases(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    v = piece_sampling.vocabulary(path)
    rows = [(1, [99999, v.byte_ids[65].item(), None], "x"), (2, [], "x"), (3, None, "x"), (4, [v.byte_ids[0xE6].item()], None), (1, [-1], "x")]
    got = piece_sampling.decode_pieces(spark.createDataFrame(rows, "i int, ids array<int>, decoded string"), path)
    assert got.columns == ["i", "ids", "decoded", "decoded_"]
    assert [r.decoded_ for r in got.collect()] == ["\ufffdA\ufffd", "", None, "\ufffd", "\ufffd"]


def test_segmentation_of_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "the cat"), (1, "the cat"), (None, "the cat"), (None, None)], "doc_id int, text string")
    rows = piece_sampling.sample_segmentations(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    by = Counter((r.doc_id, r["sample"], tuple(r.ids), r.perturbed) for r in rows)
    assert len(rows) == 7 and sorted(by.values()) == [1, 1, 1, 2, 2] and all(r.decodes for r in rows)


def test_segmentation_cases(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["", None, " ", "\n", "a b  c\t", "日本語😀\x00é", "x" * 5000, "the cat " * 2000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id int, text string, ids int")
    rows = piece_sampling.sample_segmentations(df, path, k=3).collect()
    assert all(r.decodes for r in rows) and {r.doc_id for r in rows} == set(range(len(texts)))
    assert [r.n_pieces for r in rows if r.doc_id < 2] == [0, 0]
    again = piece_sampling.sample_segmentations(df.where("doc_id > 4").repartition(3), path, k=3).collect()
    assert {(r.doc_id, r["sample"], tuple(r.ids)) for r in again} == {(r.doc_id, r["sample"], tuple(r.ids)) for r in rows if r.doc_id > 4}
    back = piece_sampling.decode_pieces(spark.createDataFrame([(1, [259 + 2, 3]), (2, None)], "i int, ids array<int>"), path).collect()
    assert back[1].decoded is None and back[0].decoded is not None
    assert piece_sampling.sample_segmentations(df.limit(0), path).collect() == []


def test_ranking_is_the_least_loss():
    """Newton's weights against a plain descent on the same pairs."""
    rng = np.random.default_rng(4)
    d = rng.normal(size=(400, 6)) + np.array([0.8, 0, -0.5, 0.1, 0, 0])
    loss = lambda v: np.logaddexp(0, -(d @ v)).mean() + 0.005 * v @ v
    v = quality_pairs.newton(d, 0.01)
    w = np.zeros(6)
    for _ in range(20000):
        w += 0.3 * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - 0.01 * w)
    assert np.allclose(v, w, atol=1e-4) and all(loss(v) <= loss(v + 0.01 * rng.normal(size=6)) for _ in range(50))


def test_ranking_takes_all_pairs_of_all_labels(spark):
    """The fit against explicit differences of all pairs, and the threshold against numpy's quantile."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma.", "of", "the", "###"], 30, p=[0.2, 0.2, 0.2, 0.2, 0.2 - q, q])), int(q < 0.08)) for i, q in enumerate(rng.uniform(0, 0.2, 150).tolist())]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality_pairs.fit(docs, labels, F.lit(True))
    x, y = np.stack([quality_pairs.features(t) for _, t, _ in rows]).astype(np.float64), np.array([y for _, _, y in rows])
    spread = x.std(0)
    scale = np.where(spread > 1e-6, 1 / np.maximum(spread, 1e-6), 0.0)
    want = quality_pairs.newton(((x[y == 1][:, None] - x[y == 0][None]) * scale).reshape(-1, x.shape[1]), 1e-3) * scale
    worth = (x - x.mean(0)) @ want
    assert np.allclose(model.worth(x), worth, atol=2e-3) and abs(model.threshold - np.quantile(worth, (y == 0).mean())) < 2e-3


def test_ranking_cases(spark):
    """Repeated ids and rows, null ids and texts, empty tables, and a score of just the threshold."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "good words here."), (1, "good words here."), (2, "### $$$"), (2, "other ###"), (None, None), (None, "good words here."), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 1)], "doc_id long, quality int")
    model = quality_pairs.fit(docs, labels, F.lit(True))
    rows = quality_pairs.quality_scores(docs, model).collect()
    assert len(rows) == 7 and len({r.score for r in rows if r.doc_id == 1}) == 1 and sum(r.doc_id is None for r in rows) == 2
    assert quality_pairs.quality_scores(docs.limit(0), model).collect() == [] and quality_pairs.keep_good(docs.limit(0), model).collect() == []
    assert all(r.predicted for r in quality_pairs.quality_scores(docs, quality_pairs.fit(docs.limit(0), labels, F.lit(True))).collect())
    flat = quality_pairs.Ranking(np.zeros(quality_pairs.N_FEATURES), np.zeros(quality_pairs.N_FEATURES), 0.0)
    assert {(round(r.score, 12), r.predicted) for r in quality_pairs.quality_scores(docs, flat).collect()} == {(0.3, 1)} and quality_pairs.keep_good(docs, flat).count() == 7


def test_ranking_separates_and_thresholds(spark):
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"], 40)) + "." for _ in range(300)]
    bad = [" ".join(x + "###" for x in rng.choice(["alpha", "beta", "of"], 40)) for _ in range(60)]
    rows = [(i, t, int(t in good)) for i, t in enumerate([*good, *bad])]
    docs = spark.createDataFrame([(i, t, "q") for i, t, _ in rows] + [(9999, None, "q")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    from pyspark.sql import functions as F

    model = quality_pairs.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in quality_pairs.quality_scores(docs, model).collect()}
    assert len(got) == len(rows) + 1 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert np.mean([got[i].predicted == y for i, _, y in rows if i % 5 == 0]) > 0.97
    kept = quality_pairs.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    none = quality_pairs.fit(docs, labels.limit(0), F.lit(True))
    assert all(r.predicted for r in quality_pairs.quality_scores(docs, none).collect())
