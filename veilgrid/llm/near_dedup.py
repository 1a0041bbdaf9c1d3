"""Near-duplicates by SimHash anchors, and by a prefix filter what SimHash can't see; the exact Jaccard similarity decides.

First rows whose fingerprints (of the same shingles) differ in few bits are linked through the anchors of a covering code, as in
simhash_anchors.py. Fingerprints of texts of similarity 0.8 lie within about 20 of 64 bits, for which blocks are 3 bits wide (nearly
all pairs meet, and some are still missed), so the radius stays small and the pairs beyond it come by a prefix filter.

That loses nothing: sets x and y of similarity `least` share at least least * |x| shingles, so in any one order of all shingles the
first |x| - ceil(least * |x|) + 1 of x and the same of y have one in common. Rows meet by those shingles; where two meet first,
their sizes and positions bound what they can share. Shingles that recur in a sample of the rows come last in the
order, so that the common ones rarely bring rows together; the sample and the map of them decide on speed only.

Where rows meet, each is first paired with the first and the next by size, which joins copies by a link each. Of the rest, only
pairs that those links have not joined are candidates, and only those whose histograms of shingle hashes allow the similarity
(the histograms' distance is a lower bound of the number of shingles that just one of the two has).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import drop_folder, fresh, shared_folder, stored
from veilgrid.llm.components import components
from veilgrid.llm.simhash_anchors import column_prints, fingerprint_links, shingle_hashes

#: Runs of up to so many rows are paired by shifts, all runs at once; longer ones a row at a time.
SHORT = 64
#: One row in SAMPLE is looked at for common shingles: those of two or more of these rows. A map of bits by hash tells them, of
#: 2 ** MAP_BITS bits (16 MB) at most and four a shingle at least; a shingle that it takes for common by mistake comes late, too.
SAMPLE, MAP_BITS = 8, 27
#: The map is made in so many (a power of two) parts.
PARTS = 64
BUCKETS = 256
_ROWS = "shingle bigint, rid bigint, n int, pos int"


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The different shingles, sorted; texts without words share one of their own."""
    return np.unique(np.array(shingle_hashes(text, width) or [0], np.uint64).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Jaccard similarity of two sets, sorted, of at least `least`."""
    both = int(_in(a, b).sum()) if len(a) < len(b) else int(_in(b, a).sum())
    return both + 1e-9 >= least * (len(a) + len(b) - both)


def histogram(s: np.ndarray) -> np.ndarray:
    """How many shingles are in each of BUCKETS classes of the hash, up to 255."""
    return np.minimum(np.bincount(s & BUCKETS - 1, minlength=BUCKETS), 255).astype(np.uint8)


def _in(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _slots(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - bits)).view(np.int64)


def _mapped(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which shingles the map of common ones has."""
    at = _slots(shingles, (8 * len(common)).bit_length() - 1)
    return (common[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def map_of(shingles: DataFrame, bits: int) -> np.ndarray:
    """The map of 2 ** bits bits with those of shingles (column shingle) set: its parts are made where the shingles are."""
    size = (1 << bits) // PARTS

    def part(key, rows):
        out = np.zeros(size, bool)
        out[_slots(rows["shingle"].to_numpy(), bits) % size] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    parts = shingles.select("shingle", F.shiftrightunsigned("shingle", 64 - PARTS.bit_length() + 1).alias("part"))
    out = np.zeros((PARTS, size // 8), np.uint8)
    for r in parts.groupBy("part").applyInArrow(part, "part bigint, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _sampled(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), width))], ["shingle"])

    return run


def _prefixes(sent, width: int, least: float):
    """rid, text -> the rows of each text's prefix: shingles outside the map of common ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                held, sizes = [], []
                for t in b.column(1).slice(at, 1000):
                    s = shingle_set(t.as_py(), width)
                    late = _mapped(s, common)
                    held.append(np.r_[s[~late], s[late]][: len(s) - math.ceil(least * len(s) - 1e-9) + 1])
                    sizes.append(len(s))
                lens = [len(h) for h in held]
                pos = np.concatenate([np.arange(n, dtype=np.int32) for n in lens])
                rids = np.repeat(b.column(0).slice(at, 1000).to_numpy(), lens)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(rids), pa.array(np.repeat(np.array(sizes, np.int32), lens)), pa.array(pos)], ["shingle", "rid", "n", "pos"])

    return run


def _may(i: np.ndarray, j: np.ndarray, n: np.ndarray, pos: np.ndarray, least: float) -> np.ndarray:
    """Rows that meet here first can reach the similarity: this shingle and what comes after in both is enough."""
    return np.minimum(n[i] - pos[i], n[j] - pos[j]) + 1e-9 >= least / (1 + least) * (n[i].astype(np.int64) + n[j])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first, cut where it changes."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        held.append([c.to_numpy() for c in b.columns])
        if sum(len(h[0]) for h in held) > 200_000:
            cols = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.argmax(cols[0] == cols[0][-1]))
            if cut:
                yield [c[:cut] for c in cols]
            held = [[c[cut:] for c in cols]]
    if held and sum(len(h[0]) for h in held):
        yield [np.concatenate(c) for c in zip(*held)]


def _meet(least: float):
    """Rows sorted by shingle, n and rid -> the first candidates (u, v, null ...), and the rows of runs of three or more with u and v null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rid, n, pos in _runs(batches):
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            lens = np.diff(np.r_[starts, len(key)])
            nth, first = np.arange(len(key)) - np.repeat(starts, lens), np.repeat(starts, lens)
            after, later = np.flatnonzero(nth > 0), np.flatnonzero(nth > 1)
            i, j = np.r_[first[after], later - 1], np.r_[after, later]
            ok = _may(i, j, n, pos, least)
            u, v = rid[i[ok]], rid[j[ok]]
            if len(u):
                pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
                e = pa.nulls(pairs.shape[1], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), e, e, e.cast(pa.int32()), e.cast(pa.int32())], ["u", "v", "shingle", "rid", "n", "pos"])
            long = np.repeat(lens > 2, lens)
            if long.any():
                e = pa.nulls(int(long.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([e, e, *(pa.array(c[long]) for c in (key, rid, n, pos))], ["u", "v", "shingle", "rid", "n", "pos"])

    return run


def _rest(least: float):
    """Rows of runs of three or more, sorted by shingle, n and rid, with their roots -> pairs that no link joins so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rid, n, pos, root in _runs(batches):
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            lens = np.diff(np.r_[starts, len(key)])
            mixed = np.maximum.reduceat(root, starts) != np.minimum.reduceat(root, starts)
            found, held = [], 0
            which = np.repeat(np.arange(len(starts)), lens)
            short = np.flatnonzero(np.repeat(mixed & (lens <= SHORT), lens))
            for k in range(1, SHORT):
                short = short[short + k < len(key)]
                short = short[which[short] == which[short + k]]
                if not len(short):
                    break
                found.append((short, short + k))
            for a, m in zip(starts[mixed & (lens > SHORT)].tolist(), lens[mixed & (lens > SHORT)].tolist()):
                for i in range(a, a + m - 1):
                    end = a + int(np.searchsorted(n[a : a + m], n[i] / least + 1e-9, "right"))
                    found.append((np.full(max(0, end - i - 1), i), np.arange(i + 1, end)))
                    held += len(found[-1][0])
                    if held > 1_000_000:
                        yield from _pairs(found, rid, n, pos, root, least)
                        found, held = [], 0
            yield from _pairs(found, rid, n, pos, root, least)

    return run


def _pairs(found: list[tuple], rid, n, pos, root, least: float) -> Iterator[pa.RecordBatch]:
    if not found:
        return
    i, j = (np.concatenate(x) for x in zip(*found))
    ok = (root[i] != root[j]) & _may(i, j, n, pos, least)
    u, v = rid[i[ok]], rid[j[ok]]
    if len(u):
        pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])


def _sets(width: int):
    """rid, text -> rid, n, the set and its histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                sets = [shingle_set(t.as_py(), width) for t in b.column(1).slice(at, 1000)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, 1000), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([histogram(s).tobytes() for s in sets], pa.binary())],
                    ["rid", "n", "s", "h"],
                )

    return run


def _possible(least: float):
    """u, v, sizes and histograms -> the pairs whose histograms allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for k in (4, 5))
            apart = np.abs(a - z).sum(1, dtype=np.int64)
            both = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            yield b.select(["u", "v"]).filter(pa.array(apart <= (1 - least) / (1 + least) * both + 1e-6))

    return run


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64), least) for x, y in zip(b.column(2), b.column(3))]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))
            pa.default_memory_pool().release_unused()

    return run


def anchor_pairs(rows: DataFrame, width: int, radius: int, blocks: int, folder: str) -> DataFrame:
    """rows (rid, t) -> pairs u < v that connect all rows whose fingerprints differ in `radius` or fewer bits; most of them do so themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(column_prints(b.column(1), width))], ["rid", "fp"])

    prints = stored(rows.select("rid", "t").mapInArrow(run, "rid bigint, fp bigint"), "prints", folder)
    first = stored(prints.groupBy("fp").agg(F.min("rid").alias("first")), "fingerprints", folder)
    copies = prints.join(first, "fp").where("rid <> first").select(F.col("first").alias("u"), F.col("rid").alias("v"))
    near = fingerprint_links(first, radius, blocks).where("u <> v").distinct()
    for end in ("u", "v"):
        near = near.join(first.select(F.col("fp").alias(end), F.col("first").alias(end + "r")), end)
    return copies.union(near.select(F.least("ur", "vr").alias("u"), F.greatest("ur", "vr").alias("v")).distinct())


def similar_links(rows: DataFrame, width: int, least: float, folder: str, radius: int = 4, blocks: int = 3) -> DataFrame:
    """rows (rid: bigint, t: string; read several times) -> links (u, v) that connect all rows of that similarity."""
    spark = rows.sparkSession
    anchored = stored(anchor_pairs(rows, width, radius, blocks, folder), "anchored", folder)
    sample = rows.where(F.pmod(F.xxhash64("rid"), F.lit(SAMPLE)) == 0).select("t").mapInArrow(_sampled(width), "shingle bigint")
    counts = stored(sample.groupBy("shingle").count().where("count > 1"), "counts", folder)
    # The counts from a power of two on: so many that the map has four bits a shingle at least.
    bits, least_bits, many = F.length(F.bin("count")), 64, 0
    for r in sorted(counts.groupBy(bits.alias("bits")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["bits"]):
        if 4 * (many + r["n"]) > 1 << MAP_BITS:
            break
        many += r["n"]
        least_bits = r["bits"]
    common = map_of(counts.where(bits >= least_bits), min(MAP_BITS, max(16, (16 * many).bit_length())))
    sent = spark.sparkContext.broadcast(common)

    met = rows.select("rid", "t").mapInArrow(_prefixes(sent, width, least), _ROWS)
    met = met.repartition("shingle").sortWithinPartitions("shingle", "n", "rid").mapInArrow(_meet(least), f"u bigint, v bigint, {_ROWS}")
    met = stored(met, "met", folder)
    first = stored(met.where("u IS NOT NULL").select("u", "v").distinct().join(anchored, ["u", "v"], "left_anti"), "first", folder)
    shared = met.where("u IS NULL").drop("u", "v")
    ends = first.union(anchored).select(F.explode(F.array("u", "v")).alias("rid")).union(shared.select("rid")).distinct()
    sets = stored(rows.join(ends, "rid", "left_semi").select("rid", "t").mapInArrow(_sets(width), "rid bigint, n int, s binary, h binary"), "sets", folder)

    def of(pairs: DataFrame, *columns: str) -> DataFrame:
        """pairs with both rows' columns of sets."""
        for end in ("u", "v"):
            pairs = pairs.join(sets.select(F.col("rid").alias(end), *(F.col(c).alias(c + end) for c in columns)), end)
        return pairs.select("u", "v", *(c + end for c in columns for end in ("u", "v")))

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        pairs = stored(of(pairs, "n", "h").mapInArrow(_possible(least), "u bigint, v bigint"), f"possible_{name}", folder)
        return stored(of(pairs, "s").mapInArrow(_verified(least), "u bigint, v bigint"), f"links_{name}", folder)

    links = verify(anchored, "anchored").union(verify(first, "first"))
    if not shared.isEmpty():
        roots = components(links).select(F.col("v").alias("rid"), F.col("m").alias("root"))
        shared = shared.join(roots, "rid", "left").select("shingle", "rid", "n", "pos", F.coalesce("root", "rid").alias("root"))
        shared = shared.repartition("shingle").sortWithinPartitions("shingle", "n", "rid")
        rest = stored(shared.mapInArrow(_rest(least), "u bigint, v bigint").distinct().join(first.union(anchored), ["u", "v"], "left_anti"), "rest", folder)
        links = links.union(verify(rest, "rest"))
    drop_folder(spark, f"{folder}/met")
    drop_folder(spark, f"{folder}/sets")
    return links


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """Of each group of rows that links of Jaccard similarity `least` or more connect the one with the smallest id, with docs' columns.

    Words are runs without blanks after lower-casing A-Z, shingles the different runs of `width` words (a shorter text is one);
    null and wordless texts are copies of each other. Null ids are never smallest; of equal smallest ids one row stays.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "similar")
    rid = fresh(docs, "__rid")
    whole = stored(docs.withColumn(rid, F.monotonically_increasing_id()), "docs", folder)
    links = similar_links(whole.select(F.col(rid).alias("rid"), F.col(text_col).cast("string").alias("t")), width, least, folder)
    roots = components(links).select(F.col("v").alias("rid"), F.col("m").alias("root"))
    roots = stored(roots.union(roots.select("root", "root").distinct()), "roots", folder)
    ids = whole.select(F.col(rid).alias("rid"), F.col(id_col).alias("id"))
    named = roots.join(ids, "rid").withColumn("order", F.struct(F.col("id").isNull(), F.col("id"), F.col("rid")))
    first = named.groupBy("root").agg(F.min("order").getField("rid").alias("first"))
    gone = named.join(first, "root").where("rid <> first").select(F.col("rid").alias(rid))
    return whole.join(gone, rid, "left_anti").select(docs.columns)
