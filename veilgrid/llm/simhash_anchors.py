"""Near-duplicates by SimHash, linked through the anchors of a covering code.

Two 64-bit fingerprints that differ in at most `radius` bits agree up to d = radius // blocks bits in at least one of `blocks`
bit ranges. In each range the anchors are the words whose first 15 bits are in the Hamming(15,11) code, which covers every
word within 1 bit: a word has an anchor at distance 1 or less, and a word within d of it is within 1 + d of that anchor. So
every fingerprint is sent to all anchors within 1 + d of it, and any two to be linked meet at one anchor at least; they are
compared there in full. Copies are merged before, so only different fingerprints are compared.

Anchors are 3 * 2^17 or so; of those where more than HOT fingerprints meet, the list is broadcast (it can't be longer than
that) and their rows are split further by the five 13-bit parts of the fingerprint, one of which two linked ones share.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType, StructField, StructType

from veilgrid.llm.common import LOWER_BYTES, fresh, salts, shared_folder, stored
from veilgrid.llm.components import components

HOT = 4096
CODE = 15
#: Runs of up to so many fingerprints are compared by shifts, all runs at once.
SHORT = 48
#: Longer runs of up to so many are all compared with each other.
DENSE = 4096


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 (seed 42) of every run of `width` words, lower-cased A-Z and joined by spaces; the whole text if it is shorter; none if empty."""
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, 42)]
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    h = xxhash.xxh64_intdigest
    return [h(joined[a : b - 1], 42) for a, b in zip(starts, starts[width:])]


def simhash(groups: list[list[int]]) -> np.ndarray:
    """Per group of hashes the 64-bit word of the bits that over half of them have (no hashes: 0), as int64."""
    lens = np.array([len(g) for g in groups], np.int64)
    out = np.zeros(len(groups), np.uint64)
    some = np.flatnonzero(lens)
    if not len(some):
        return out.view(np.int64)
    flat = np.fromiter((h for g in groups for h in g), np.uint64, int(lens.sum()))
    lens = lens[some]
    starts = np.cumsum(lens) - lens
    # Eight 8-bit counters a word hold sums of up to 255 rows: cut each group in pieces of that length.
    pieces = -(-lens // 255)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(starts - 255 * first, pieces) + 255 * np.arange(pieces.sum())
    ones = np.uint64(0x0101010101010101)
    half = np.zeros(len(some), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(k)) & ones, at)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first)
        for j in range(8):
            half |= (counts[:, j] * 2 > lens).astype(np.uint64) << np.uint64(8 * j + k)
    out[some] = half
    return out.view(np.int64)


def column_prints(texts, width: int) -> np.ndarray:
    """Fingerprints of an Arrow column of texts, in groups of about half a million shingles."""
    fps, held, size = [np.zeros(0, np.int64)], [], 0
    for text in texts:
        held.append(shingle_hashes(text.as_py(), width))
        size += len(held[-1])
        if size > 500_000:
            fps.append(simhash(held))
            held, size = [], 0
    return np.concatenate([*fps, simhash(held)])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, fp (the fingerprint's bits as a bigint), salt (by id)."""
    parts = salts(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            own = [xxhash.xxh32_intdigest(repr(i).encode()) % parts for i in ids.to_pylist()]
            fps = column_prints(b.column(1), width)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps), pa.array(own, pa.int32())], ["id", "fp", "salt"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, fp bigint, salt int")


def _syndrome_py(e: int) -> int:
    s = 0
    for i in range(CODE):
        if e >> i & 1:
            s ^= i + 1
    return s


def anchor_masks(width: int, d: int) -> list[list[int]]:
    """By syndrome: the bit changes of up to 1 + d bits that lead from a word of that syndrome to an anchor."""
    out: list[list[int]] = [[] for _ in range(CODE + 1)]
    for weight in range(d + 2):
        for bits in combinations(range(width), weight):
            e = sum(1 << b for b in bits)
            out[_syndrome_py(e)].append(e)
    return out


def ranges(blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of each range."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _moved(masks: Column, v: Column, plus: int) -> Column:
    return F.transform(masks, lambda m: v.bitwiseXOR(m) + F.lit(plus))


def anchors(fp: Column, radius: int, blocks: int) -> Column:
    """All anchors, as bigints, that a fingerprint is sent to."""
    found = []
    for k, (at, width) in enumerate(ranges(blocks)):
        v = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))
        s = F.lit(0)
        for r in range(4):
            row = sum(1 << i for i in range(CODE) if (i + 1) >> r & 1)
            s = s + F.shiftleft(F.bit_count(v.bitwiseAND(F.lit(row))) % 2, r)
        masks = F.element_at(F.array(*(F.array(*(F.lit(m).cast("long") for m in ms)) for ms in anchor_masks(width, radius // blocks))), s + 1)
        found.append(_moved(masks, v, k << 40))
    return F.concat(*found)


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give all that pairs i, j connect the least label among them (label[x] is x's root or a step to it)."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _near(fps: np.ndarray, at: np.ndarray, radius: int, label: np.ndarray) -> None:
    """Join all of the fingerprints at `at` that lie within radius of each other, each with all."""
    for a in range(0, len(at), 512):
        i, j = np.nonzero(np.bitwise_count(fps[at[a : a + 512], None] ^ fps[at][None, :]) <= radius)
        _join(label, at[a + i], at[j])


def _links_of_long(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect a long run of different fingerprints as all its links do: each with the first of its local component.

    Up to DENSE of them are all compared. Of more, two within radius agree in at least four of radius + 4 bit ranges: for each
    choice of four the run is sorted by those bits, and only fingerprints that agree there are compared.
    """
    n = len(fps)
    label = np.arange(n)
    if n <= DENSE:
        _near(fps, label.copy(), radius, label)
    else:
        for four in combinations(ranges(radius + 4), 4):
            mask = np.uint64(sum((1 << w) - 1 << at for at, w in four))
            order = np.argsort(fps & mask, kind="stable")
            key = (fps & mask)[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            lens = np.diff(np.r_[starts, n])
            run = np.repeat(np.arange(len(starts)), lens)
            short = np.flatnonzero(np.repeat((lens > 1) & (lens <= SHORT), lens))
            for k in range(1, SHORT):
                short = short[short + k < n]
                short = short[run[short] == run[short + k]]
                if not len(short):
                    break
                hit = short[np.bitwise_count(fps[order[short]] ^ fps[order[short + k]]) <= radius]
                _join(label, order[hit], order[hit + k])
            for a, m in zip(starts[lens > SHORT].tolist(), lens[lens > SHORT].tolist()):
                _near(fps, order[a : a + m], radius, label)
    i = np.flatnonzero(label != np.arange(n))
    return [(fps[i], fps[label[i]])]


def _compare(radius: int):
    """Sorted rows (anchor, part, fp) -> links (u, v) of fingerprints within radius; a run is held whole only as 8-byte words."""

    def links(key: np.ndarray, part: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
        starts = np.flatnonzero(new)
        lens = np.diff(np.r_[starts, len(key)])
        found = []
        for a, n in zip(starts[lens > SHORT].tolist(), lens[lens > SHORT].tolist()):
            found += _links_of_long(np.unique(fps[a : a + n]), radius)
        run = np.repeat(np.arange(len(starts)), lens)
        short = np.flatnonzero(np.repeat((lens > 1) & (lens <= SHORT), lens))
        for k in range(1, SHORT):
            short = short[short + k < len(fps)]
            short = short[run[short] == run[short + k]]
            if not len(short):
                break
            hit = short[np.bitwise_count(fps[short] ^ fps[short + k]) <= radius]
            found.append((fps[hit], fps[hit + k]))
        if found:
            u, v = (np.concatenate(x).view(np.int64) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        for b in batches:
            for h, c in zip(held, b.columns):
                h.append(c.to_numpy())
            if sum(map(len, held[0])) > 200_000:
                key, part, fps = (np.concatenate(h) for h in held)
                same = (key == key[-1]) & (part == part[-1])  # the last run may go on
                cut = int(np.argmax(same))
                if cut:
                    yield from links(key[:cut], part[:cut], fps[:cut].view(np.uint64))
                held = [[x[cut:]] for x in (key, part, fps)]
        if held[0]:
            key, part, fps = (np.concatenate(h) for h in held)
            if len(key):
                yield from links(key, part, fps.view(np.uint64))

    return run


def fingerprint_links(words: DataFrame, radius: int = 4, blocks: int = 3) -> DataFrame:
    """Links (u, v) between the different fingerprints in words.fp that connect whatever lies within radius of each other."""
    at = words.select(F.explode(anchors(F.col("fp"), radius, blocks)).alias("anchor"), "fp")
    hot = at.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot"))
    at = at.join(F.broadcast(hot), "anchor", "left")  # at most one row an anchor, of which there are 3 * 2^17 or so
    cuts = [(64 * i // (radius + 1), 64 * (i + 1) // (radius + 1)) for i in range(radius + 1)]
    parts = F.array(*(F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << b - a) - 1)) * 64 + i for i, (a, b) in enumerate(cuts)))
    at = at.select("anchor", F.explode(F.when(F.col("hot"), parts).otherwise(F.array(F.lit(-1).cast("long")))).alias("part"), "fp")
    at = at.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return at.mapInArrow(_compare(radius), "u bigint, v bigint")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, blocks: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (the smallest id that links reach, its own included).

    Words are runs without blanks after lower-casing A-Z; shingles are `width` words, repeats included; a shorter text is one
    shingle; null and wordless texts have fingerprint 0, linked like any other. Rows link at `radius` or fewer differing bits.
    Repeated rows share all they have; null ids are never smallest (component_id is null where a component has no other). An
    empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "simhash")
    rows = stored(fingerprints(docs, id_col, text_col, width), "rows", folder)
    some = rows.groupBy("fp", "salt").agg(F.min("id").alias("least"))
    words = stored(some.groupBy("fp").agg(F.min("least").alias("least"), F.collect_set("salt").alias("salts")), "words", folder)
    roots = components(fingerprint_links(words, radius, blocks)).select(F.col("v").alias("fp"), F.col("m").alias("root"))
    words = words.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    words = words.withColumn("spread", F.pmod(F.xxhash64("fp"), F.lit(salts(spark))).cast("int"))
    least = words.groupBy("root", "spread").agg(F.min("least").alias("first"))
    least = least.groupBy("root").agg(F.min("first").alias("component_id"), F.collect_set("spread").alias("spreads"))
    least = least.select("root", "component_id", F.explode("spreads").alias("spread"))
    words = words.join(least, ["root", "spread"]).select("fp", "component_id", F.explode("salts").alias("salt"))
    out = rows.join(words, ["fp", "salt"])
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, blocks: int = 3) -> DataFrame:
    """The rows of docs whose id is their group's component_id, whole, with docs' columns; of repeated rows one.

    Rows with a null id stay, one a fingerprint, where no row with an id is in reach.
    """
    name, nth = fresh(docs, "__key"), fresh(docs, "__n")
    key = lambda i, fp: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), fp)
    groups = simhash_groups(docs, id_col, text_col, width, radius, blocks)
    heads = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(key(F.col(id_col), F.col("fingerprint")).alias(name))
    at, ids = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = column_prints(b.column(at), width).view(np.uint64).tolist()
            keys = [f"{'null' if i is None else i}:{fp:016x}" for i, fp in zip(b.column(ids).to_pylist(), fps)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.string())], [*b.schema.names, name])

    keyed = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StringType())]))
    kept = keyed.join(heads, name, "left_semi")
    # The join leaves rows hashed and sorted by key, so that this needs no exchange of its own.
    return kept.withColumn(nth, F.row_number().over(W.partitionBy(name).orderBy(F.lit(1)))).where(F.col(nth) == 1).select(docs.columns)
