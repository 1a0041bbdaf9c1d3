"""Benchmark decontamination by the shingles of item-sized windows.

The benchmark is the stated query set: it is read in blocks of bounded bytes, each of which is searched for in all documents.
Both sides are words after lower-casing A-Z and turning ASCII punctuation to blanks; a shingle is `width` words (a shorter
item is one shingle), weighted by how often it occurs. A window of an item's length (or the whole document, if shorter) can
only reach the similarity if it shares shingles with the item: of m window and m' item shingles at least s/(1+s) * (m + m')
occurrences. So the documents' words are read once as benchmark word numbers, and an inverted index of the items' shingles gives
the windows that share that many; all others are below the similarity for certain. Of those the exact weighted similarity (sum
of minima over sum of maxima) decides alone: nothing that reaches it is lost. The SimHash distance of the best window is
reported, and drops nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b for b in range(256))
BLOCK_BYTES = 8 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


def _fingerprint(hashes: np.ndarray) -> int:
    """The bits that over half of the shingle occurrences have."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def similarity(a: dict[int, int], b: dict[int, int]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class Items:
    """One block of the benchmark, ready to be searched for."""

    def __init__(self, items: list[tuple], width: int, least: float):
        self.width, self.least = width, least
        self.word: dict[bytes, int] = {}
        self.items = []
        for item_id, text in items:
            ws = words_of(text)
            if not ws:
                continue
            ids = [self.word.setdefault(w, len(self.word) + 1) for w in ws]
            self.items.append((item_id, len(ws), self._shingles(np.array(ids, np.int64))))
        # Items by length and shingle: where each shingle of an item can occur.
        self.where: dict[int, dict[int, list[int]]] = {}
        self.prints, self.bags = [], []
        for k, (_, n, sh) in enumerate(self.items):
            by = self.where.setdefault(min(n, width), {})
            for s in set(sh.tolist()):
                by.setdefault(s, []).append(k)
            self.prints.append(_fingerprint(self._spread(sh)))
            self.bags.append(self._bag(sh))
        self.keys = {w: np.array(sorted(by), np.int64) for w, by in self.where.items()}

    def _shingles(self, ids: np.ndarray, width: int | None = None) -> np.ndarray:
        """A 63-bit number per run of width words; equal runs have equal numbers, and a run with a word outside the benchmark has -1."""
        width = min(len(ids), width or self.width)
        n = len(ids) - width + 1
        out, bad = np.zeros(n, np.uint64), np.zeros(n, bool)
        for j in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            out ^= out >> np.uint64(29)
            bad |= ids[j : j + n] <= 0
        out = (out >> np.uint64(1)).view(np.int64)
        out[bad] = -1
        return out

    @staticmethod
    def _spread(shingles: np.ndarray) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(int(s).to_bytes(8, "little", signed=True), 42) for s in shingles], np.uint64)

    @staticmethod
    def _bag(shingles: np.ndarray) -> dict[int, int]:
        keys, n = np.unique(shingles, return_counts=True)
        return dict(zip(keys.tolist(), n.tolist()))

    def find(self, text: str | None) -> list[tuple]:
        """(item_id, similarity, first word, words, distance) of each item in the text, at its best window."""
        words = words_of(text)
        if not words:
            return []
        get = self.word.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        if not ids.any():
            return []
        out = []
        for width, by in self.where.items():
            if len(ids) < width:
                continue
            sh = self._shingles(ids, width)
            keys = self.keys[width]
            spots = np.flatnonzero(sh >= 0)
            spots = spots[keys[np.minimum(np.searchsorted(keys, sh[spots]), len(keys) - 1)] == sh[spots]]
            if not len(spots):
                continue
            hits: dict[int, list[int]] = {}
            for p, s in zip(spots.tolist(), sh[spots].tolist()):
                for k in by[s]:
                    hits.setdefault(k, []).append(p)
            full = None
            for k, at in hits.items():
                item_id, n, own = self.items[k]
                span = min(n, len(ids)) - width + 1  # shingles of a window
                need = self.least / (1 + self.least) * (span + len(own)) - 1e-9
                if len(at) < need:
                    continue
                at = np.array(at)
                starts = np.unique(np.clip(at[:, None] - np.arange(span)[None, :], 0, len(sh) - span).ravel()) if len(at) * span < 200_000 else np.arange(len(sh) - span + 1)
                shared = np.searchsorted(at, starts + span) - np.searchsorted(at, starts)
                best = None
                for start in starts[shared >= need].tolist():
                    window = sh[start : start + span]
                    sim = similarity(self._bag(window), self.bags[k])
                    if sim + 1e-12 < self.least or (best and sim <= best[1]):
                        continue
                    best = (start, sim)
                if best is None:
                    continue
                if full is None:
                    # A shingle outside the benchmark is a number of its own: its words' hash.
                    full = sh.copy()
                    for p in np.flatnonzero(sh < 0).tolist():
                        full[p] = xxhash.xxh64_intdigest(b" ".join(words[p : p + width]), 7) >> 1
                start, sim = best
                distance = self.prints[k] ^ _fingerprint(self._spread(full[start : start + span]))
                out.append((item_id, sim, start, span + width - 1, distance.bit_count()))
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The query set, a bounded block at a time."""
    held, size = [], 0
    for r in benchmark.select(item_col, text_col).toLocalIterator():
        held.append((r[0], r[1]))
        size += len((r[1] or "").encode()) + 16
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """Pairs (id, item_id, similarity, first_word, n_words, distance): a document and an item that it holds, at the best window.

    Nothing is shuffled: each block of the benchmark is broadcast (BLOCK_BYTES at most) and searched for in all documents.
    Null and wordless texts and items match nothing; repeated rows give their pairs again; of windows of equal similarity the
    first is reported; null ids are kept; empty tables give no pairs; other columns are not read.
    """
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = f"id {kind}, item_id {item_kind}, similarity double, first_word bigint, n_words bigint, distance int"
    out = None
    for block in _blocks(benchmark, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(block)
        found = src.mapInArrow(_search(sent, width, least, schema), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col)


def _search(sent, width: int, least: float, schema: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value, width, least)
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for i, text in zip(ids, b.column(1)):
                rows += [(i, *found) for found in items.find(text.as_py())]
            if rows:
                cols = list(zip(*rows))
                kinds = [b.schema.field(0).type, None, pa.float64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) if k is not None else pa.array(c) for c, k in zip(cols, kinds)], ["id", "item_id", "similarity", "first_word", "n_words", "distance"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs in which no item is found, whole and in their own columns; nothing is shuffled. Cases as in contaminated()."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(block), width, least, at), docs.schema)
    return docs


def _clean(sent, width: int, least: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value, width, least)
        for b in batches:
            yield b.filter(pa.array([not items.find(t.as_py()) for t in b.column(at)], pa.bool_()))

    return run
