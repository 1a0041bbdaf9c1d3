"""A hierarchical Pitman-Yor language model over words, sampled by Gibbs and spread over word shards.

Restaurants, and who shares a parent: the root serves words by themselves; a class restaurant, one for each last character
class of the word before (and one for the start of a text), has the root as parent; a context restaurant, one for each word
as the word before, has the class restaurant of that word as parent. Every token is a customer of the context restaurant of the
word before, or, at the start of a text, of that class restaurant. Dishes (words), restaurants, their counts and tables grow
with the corpus. The base is uniform over the V training tokens and one unknown.

All of a word's customers and tables, at all levels, lie in the shard of that word, so only the totals of the restaurants (two
numbers each) couple shards; they are summed between sweeps (approximate distributed Gibbs: within a sweep a shard sees the
totals and the parents' probabilities of the sweep before). The totals of the root, the classes and the contexts that make up
`share` or more of the training tokens (1 / share at most) are sent to all tasks. Those of all other contexts are added up by
buckets of their hashes (64 bits; words of one hash would share a restaurant): a shard tells its part of each context that any of
its words was asked for in, and gets the totals back, as a file of its own. A customer sits down at a table in proportion to its customers less
the discount, or at a new one in proportion to q = (strength + discount * tables) times the parent's probability; a table more
or less is a customer more or less of the parent. Reseated one by one, customers change the number of a word's tables slowly
(hundreds of sweeps would not do for frequent words), so a sweep is a blocked Gibbs step: level by level from below, it seats
all customers of a word in a restaurant anew at once. c customers take t tables with probability in proportion to S(c, t) q^t,
S being generalized Stirling numbers: exact up to SMALL customers, as are the tables' sizes; of more customers, from a grid of
Stirling numbers for few tables, and from the normal law of their mean and variance for FEW tables or so and more. Discount and strength of each level are drawn
anew after each sweep, from their posterior given the seating (with auxiliary variables, as Teh has them; priors Beta(1, 1)
and Gamma(1, 1)). After the burn-in each round's state is a sample; the probability of a token is the mean over the samples.

Texts are read once, in chunks of about CHUNK_TOKENS tokens, which are kept as word numbers with the chunk's own vocabulary. A
chunk asks each shard for just the (word, restaurant) pairs that occur in it, and gets counts and probabilities back in the
order asked. Everything that passes between chunks and shards is one binary per chunk and shard.
"""

from __future__ import annotations

import ctypes
import gc
import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.llm.common import LOWER_BYTES, crc_mod_py, drop_folder, shared_folder, stored

CHUNK_TOKENS, SHARD_TOKENS = 2_000_000, 8_000_000
#: Customers up to which seatings are exact.
SMALL = 64
#: Tables up to which a grid of Stirling numbers serves pairs of more customers.
FEW = 128
#: Places from which on sums of small probabilities are drawn as Poisson numbers.
EXACT = 64
#: Class restaurants: the start of a text, a-z, digits, sentence ends, other ASCII, all else.
CLASSES = 31
_START = 0
_LIBC = ctypes.CDLL(None)
#: Arrays that rise, by name.
_SORTED = {"w", "w1", "w2", "x", "i", "xi"}
#: Arrays that rise within the runs of another that is packed before them.
_WITHIN = {"r": "w", "r1": "w1", "r2": "w2"}
#: Bytes of text that are split at once.
SPLIT_BYTES = 8_000_000


def _class_of(word: bytes) -> int:
    b = word[-1] if word else 0
    if 97 <= b < 123:
        return 1 + b - 97
    if 48 <= b < 58:
        return 27
    if b in b".!?":
        return 28
    return 29 if b < 128 else 30


_CLASS = np.array([_class_of(bytes([b])) for b in range(256)], np.int8)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]])[: len(x)]


def _pack(**arrays) -> bytes:
    """Arrays by name, compressed: bytes of equal weight lie together (small numbers' high bytes are alike), and sorted ones as steps."""
    head, body = [], []
    for name, x in arrays.items():
        x = np.ascontiguousarray(x)
        if name in _SORTED and x.size:
            x = np.diff(x, prepend=x.dtype.type(0))
        elif _WITHIN.get(name) in arrays and x.size:
            first = _runs(arrays[_WITHIN[name]])
            steps = np.diff(x, prepend=x.dtype.type(0))
            steps[first] = x[first]
            x = steps
        head.append([name, x.dtype.str, x.shape])
        body.append(x.view(np.uint8).reshape(x.size, x.itemsize).T.tobytes() if x.size else b"")
    names = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=3).compress(b"".join([len(names).to_bytes(4, "little"), names, *body]))


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    at = 4 + int.from_bytes(data[:4], "little")
    out = {}
    for name, kind, shape in json.loads(data[4:at]):
        kind, size = np.dtype(kind), math.prod(shape)
        x = np.frombuffer(data, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        at += x.size
        x = np.ascontiguousarray(x.T).view(kind).reshape(shape) if size else np.zeros(shape, kind)
        if name in _SORTED:
            x = np.cumsum(x, dtype=kind)
        elif _WITHIN.get(name) in out and size:
            first, total = _runs(out[_WITHIN[name]]), np.cumsum(x, dtype=kind)
            x = total - np.repeat(total[first] - x[first], np.diff(first, append=size))
        out[name] = x
    return out


def _joined(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"\n".join(words), np.uint8)


def _split(data: np.ndarray, n: int) -> list[bytes]:
    return data.tobytes().split(b"\n") if n else []


def _binary(datas: list[np.ndarray], counts: list[int]) -> pa.Array:
    """The words of several _joined(), one after another."""
    ends, parts, n = [np.zeros(1, np.int64)], [], 0
    for data, count in zip(datas, counts):
        if count:
            ends.append(n + np.r_[np.flatnonzero(data == 10), len(data)] - np.arange(count))
            parts.append(data[data != 10])
            n += len(parts[-1])
    offsets, data = np.concatenate(ends), np.concatenate([*parts, np.zeros(0, np.uint8)])
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _classes(joined: np.ndarray, n: int) -> np.ndarray:
    """_class_of() each of n words."""
    last = np.r_[np.flatnonzero(joined == 10), len(joined)][:n] - 1
    empty = last < np.r_[0, last[:-1] + 2] if n else np.zeros(0, bool)
    return np.where(empty, _class_of(b""), _CLASS[joined[np.maximum(last, 0)]]) if len(joined) else np.full(n, _class_of(b""), np.int8)


def _give_back() -> None:
    """Memory that shards before took, to the system: a worker's next one may be larger."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def _let_go(spark: SparkSession) -> None:
    """Shuffle files of what was written: Spark deletes them once the driver's JVM has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# Chunks


def _chunks(folds: int, held: int, share: float):
    """Texts -> per chunk: its vocabulary (word 0 is the end of a text), word numbers, and the counts of training tokens of a tenth of share or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        kind, ids, lens, parts, have = pa.int64(), [], [], [], 0

        def close():
            nonlocal seq, ids, lens, parts, have
            coded, sizes = pa.concat_arrays(parts).dictionary_encode(), np.concatenate(lens)
            words = [b"", *coded.dictionary.cast(pa.large_binary()).to_pylist()]
            flat = np.zeros(have, np.int32)
            within = np.ones(have, bool)
            within[np.cumsum(sizes) - 1] = False
            flat[within] = coded.indices.to_numpy() + 1
            train = np.array([crc_mod_py(i, folds) != held for i in ids], bool)
            counts = np.bincount(flat[np.repeat(train, sizes)], minlength=len(words))
            top = np.flatnonzero(counts >= max(1, share / 10 * counts.sum()))
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part * (1 << 20) + seq], pa.int64()),
                    pa.array([ids], pa.list_(kind)),
                    pa.array([_pack(words=_joined(words), n=np.array([len(words)]), flat=flat, lens=sizes, train=train)], pa.binary()),
                    pa.array([len(flat)], pa.int64()),
                    pa.array([int(counts.sum())], pa.int64()),
                    pa.array([[words[i] for i in top.tolist()]], pa.list_(pa.binary())),
                    pa.array([counts[top].tolist()], pa.list_(pa.int64())),
                ],
                ["chunk", "ids", "texts", "tokens", "trained", "top", "top_n"],
            )
            seq += 1
            ids, lens, parts, have = [], [], [], 0
            return row

        for b in batches:
            kind = b.schema.field(0).type
            keys, texts = b.column(0).to_pylist(), b.column(1).fill_null("")
            _, cuts, data = texts.buffers()
            cuts = np.frombuffer(cuts, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + SPLIT_BYTES, "right")) - 1)
                # Lowered here: ascii_lower() loses text where the buffers' first offset isn't 0.
                low = bytes(memoryview(data or b"")[cuts[at] : cuts[to]]).translate(LOWER_BYTES)
                split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), to - at, [None, pa.py_buffer(cuts[at : to + 1] - cuts[at]), pa.py_buffer(low)]))
                words = split.flatten()
                some = pc.binary_length(words).to_numpy() > 0  # blanks at an end of a text leave an empty word there
                words = words.filter(pa.array(some))
                until = np.r_[0, np.cumsum(some)][np.cumsum(pc.list_value_length(split).to_numpy())]  # the words up to each text's end
                first, ends = 0, until + np.arange(1, len(until) + 1)  # and its tokens
                while first < len(ends):
                    done = int(ends[first - 1]) if first else 0
                    last = min(len(ends), first + int(np.searchsorted(ends[first:] - done, CHUNK_TOKENS - have)) + 1)
                    parts.append(words[done - first : int(until[last - 1])])
                    lens.append(np.diff(ends[first:last], prepend=done).astype(np.int64))
                    ids += keys[at + first : at + last]
                    have += int(ends[last - 1]) - done
                    first = last
                    if have >= CHUNK_TOKENS:
                        yield close()
                at = to
        if ids:
            yield close()

    return run


def _pairs(texts: dict[str, np.ndarray], contexts: dict[bytes, int], shards: int, rest: bool = False, hashes: np.ndarray | None = None):
    """What a chunk asks: words in shard order, and its distinct (word, restaurant) pairs in the order of those words.

    Words that are not in contexts have restaurants by the order of their hashes in the chunk, behind those, if rest is set, and else none.
    """
    n, flat, lens = int(texts["n"][0]), texts["flat"], texts["lens"]
    words, kinds = _split(texts["words"], n), _classes(texts["words"], n)
    room = CLASSES + len(contexts) + n * rest
    known = np.array([contexts.get(w, -1) for w in words], np.int64)
    hashes = _hashes(words) if hashes is None else hashes
    seat = np.where(known >= 0, CLASSES + known, CLASSES + len(contexts) + np.unique(hashes, return_inverse=True)[1] if rest else kinds)
    shard = (hashes % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    prev = np.empty(len(flat), np.int64)
    prev[1:] = seat[flat[:-1]]
    prev[np.cumsum(lens) - lens] = _START
    keys, where = np.unique(place[flat] * room + prev, return_inverse=True)
    train = np.bincount(where, weights=np.repeat(texts["train"], lens), minlength=len(keys)).astype(np.int64)
    return words, shard, order, place, keys // room, keys % room, train, where


def _requests(contexts: dict[bytes, int], shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1)):
                texts = _unpack(data.as_py())
                hashes = _hashes(_split(texts["words"], int(texts["n"][0])))
                words, shard, order, _, w, r, train, _ = _pairs(texts, contexts, shards, True, hashes)
                hashes, which = np.unique(hashes, return_index=True)
                kinds = _classes(texts["words"], len(words))[which]
                first = CLASSES + len(contexts)
                cut = np.searchsorted(shard[order], np.arange(shards + 1))
                pair_cut = np.searchsorted(w, cut)
                rows = []
                for k in range(shards):
                    a, z = int(cut[k]), int(cut[k + 1])
                    if a < z:
                        p, q = int(pair_cut[k]), int(pair_cut[k + 1])
                        own = [words[i] for i in order[a:z].tolist()]
                        at, deep = r[p:q].astype(np.int32), np.flatnonzero(r[p:q] >= first)
                        x, where = np.unique(at[deep] - first, return_inverse=True)
                        x, xk = hashes[x], kinds[x]
                        at[deep] = first + where
                        rows.append((k, chunk, _pack(words=_joined(own), n=np.array([len(own)]), w=(w[p:q] - a).astype(np.int32), r=at, c=train[p:q].astype(np.int32), x=x, xk=xk)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["shard", "chunk", "asked"])

    return run


# Seating


@lru_cache(8)
def _stirling(d: float) -> tuple[np.ndarray, np.ndarray]:
    """log S[n, t], n and t up to SMALL: the sum over seatings of n customers at t tables of the product of (1 - d)(2 - d)...(s - 1 - d)
    over tables of s; and [n, s]: log of the ways to choose a table of s with a given one of n customers, times that product."""
    log_s = np.full((SMALL + 1, SMALL + 1), -np.inf)
    log_s[0, 0] = 0.0
    t = np.arange(1, SMALL + 1)
    for n in range(SMALL):
        with np.errstate(divide="ignore", invalid="ignore"):
            join = np.where(n - d * t > 0, np.log(np.maximum(n - d * t, 1e-300)), -np.inf)
        log_s[n + 1, 1:] = np.logaddexp(log_s[n, :-1], log_s[n, 1:] + join)
    rise = np.r_[0.0, 0.0, np.cumsum(np.log(np.arange(1, SMALL) - d))]
    fact = np.r_[0.0, np.cumsum(np.log(np.arange(1, SMALL + 1)))]
    n, s = np.arange(SMALL + 1)[:, None], np.arange(SMALL + 1)[None, :]
    ok = (s >= 1) & (s <= n)
    table = np.where(ok, fact[np.maximum(n - 1, 0)] - fact[np.maximum(s - 1, 0)] - fact[np.maximum(n - s, 0)] + rise[s], -np.inf)
    return log_s, table


def _pick(logs: np.ndarray, rng) -> np.ndarray:
    """A column of each row, with probability in proportion to exp."""
    cum = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), 1)
    return np.minimum((cum < rng.random((len(cum), 1)) * cum[:, -1:]).sum(1), logs.shape[1] - 1)


@lru_cache(8)
def _stirling_large(d: float) -> tuple[np.ndarray, np.ndarray]:
    """n on a grid from SMALL to 10^12, and log (S[n, t] / Gamma(n)) for t up to FEW there, each n less a constant.

    S(n + 1, t) / n! = (S(n, t) + (S(n, t - 1) - d t S(n, t)) / n) / (n - 1)!: by that up to 8192, beyond as a differential equation.
    """
    t = np.arange(1, FEW + 1)
    x = np.zeros(FEW)
    x[:SMALL] = np.exp(_stirling(d)[0][SMALL, 1:] - _stirling(d)[0][SMALL, 1:].max())
    rate, work = d * t, np.empty(FEW)

    def move(x, out=None):
        out = np.multiply(rate, x, out)
        np.subtract(x[:-1], out[1:], out[1:])
        out[0] = -out[0]
        return out

    grid, rows, n = [SMALL], [x], SMALL
    while n < 8192:
        x = x + np.divide(move(x, work), n, work)
        n += 1
        if n >= 1.02 * grid[-1] or n == 8192:
            x = x / x.max()
            grid.append(n)
            rows.append(x)
    slope = lambda x, n: move(x - move(x) / (2 * n))
    while n < 1e12:
        h = 0.01
        a = slope(x, n)
        b = slope(x + h / 2 * a, n)
        c = slope(x + h / 2 * b, n)
        x = np.maximum(x + h / 6 * (a + 2 * b + 2 * c + slope(x + h * c, n)), 1e-300)
        x, n = x / x.max(), n * math.exp(h)
        grid.append(n)
        rows.append(x)
    return np.array(grid, float), np.log(np.maximum(np.array(rows), 1e-300))


def _moments(c: np.ndarray, log_q: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the tables that c customers take if new tables weigh q: of p(t) ~ S(c, t) q^t.

    The sum of S(c, t) q^t over t is c! times the coefficient of z^c in exp(q f(z)), f(z) = (1 - (1 - z)^d) / d: its logarithm, by
    the saddle point q z f'(z) = c (found by bisection), is the cumulant function, differentiated by differences in log q.
    """

    def cumulant(log_q):
        low, high = np.full(len(c), -60.0), np.full(len(c), np.log(700.0 / max(d, 1 - d)))
        for _ in range(70):
            w = np.exp((low + high) / 2)  # z = 1 - exp(-w)
            over = log_q + np.log(-np.expm1(-w)) + (1 - d) * w > np.log(c)
            low, high = np.where(over, low, (low + high) / 2), np.where(over, (low + high) / 2, high)
        w = np.exp((low + high) / 2)
        z, q = -np.expm1(-w), np.exp(log_q)
        bend = z * np.exp((1 - d) * w) * (1 + z * (1 - d) * np.exp(w))
        return q * -np.expm1(-d * w) / d - c * np.log(z) - 0.5 * (log_q + np.log(bend))

    h = 0.05
    less, here, more = (cumulant(log_q + x) for x in (-h, 0.0, h))
    return (more - less) / (2 * h), np.maximum((more - 2 * here + less) / h**2, 0.0)


class Seats:
    """Tables of many (restaurant, word) pairs: c customers a pair; sizes of all tables, in order of their pairs (own)."""

    def __init__(self, c, sizes, own, discount: float):
        self.c, self.sizes, self.own, self.d = c.astype(np.int64), sizes.astype(np.int64), own.astype(np.int64), discount

    def tables(self) -> np.ndarray:
        return np.bincount(self.own[self.sizes > 0], minlength=len(self.c)).astype(np.int64)

    def _bounds(self, pairs):
        return np.searchsorted(self.own, pairs), np.searchsorted(self.own, pairs, "right")

    def take(self, pairs: np.ndarray, rng) -> None:
        """A random customer of each pair leaves."""
        cum = np.cumsum(self.sizes)
        at, _ = self._bounds(pairs)
        r = cum[at] - self.sizes[at] + (rng.random(len(pairs)) * self.c[pairs]).astype(np.int64)
        np.subtract.at(self.sizes, np.searchsorted(cum, r, "right"), 1)
        self.c[pairs] -= 1

    def seat(self, pairs: np.ndarray, new_weight: np.ndarray, rng) -> None:
        """A customer of each pair comes: new_weight is that of a new table, by pair."""
        weight = self.sizes - self.d * (self.sizes > 0)
        cum = np.r_[0.0, np.cumsum(weight)]
        at, to = self._bounds(pairs)
        had = cum[to] - cum[at]
        u = rng.random(len(pairs)) * (had + new_weight[pairs])
        fresh = (u >= had) | (self.c[pairs] == 0)
        pick = np.minimum(np.searchsorted(cum, cum[at[~fresh]] + u[~fresh], "right") - 1, to[~fresh] - 1)
        self.sizes[pick] += 1
        self.c[pairs] += 1
        self.sizes = np.insert(self.sizes, to[fresh], 1)
        self.own = np.insert(self.own, to[fresh], pairs[fresh])

    def tidy(self) -> None:
        keep = self.sizes > 0
        self.sizes, self.own = self.sizes[keep], self.own[keep]

    def follow(self, target: np.ndarray, new_weight: np.ndarray, rng) -> None:
        """Customers come or leave, one by one while they are few, until each pair has as many as target says (a sweep seats whole pairs instead)."""
        for _ in range(16):
            less, more = np.flatnonzero(self.c > target), np.flatnonzero(self.c < target)
            if len(less):
                self.take(less, rng)
            if len(more):
                self.seat(more, new_weight, rng)
            if not len(less) and not len(more):
                break
        self.tidy()
        left = np.flatnonzero(self.c != target)
        if len(left):  # the few pairs with far to go, each by whole groups of customers
            at, to = self._bounds(left)
            new_sizes, new_own = [], []
            gone = np.zeros(len(self.sizes), bool)
            for p, a, z in zip(left.tolist(), at.tolist(), to.tolist()):
                s, n = self.sizes[a:z].copy(), int(target[p] - self.c[p])
                gone[a:z] = True
                if n < 0:
                    s = s - rng.multivariate_hypergeometric(s, -n, method="marginals")
                while n > 0:
                    total = int(s.sum())
                    b = min(n, max(1, total // 2))
                    k = b if not total else int(rng.binomial(b, new_weight[p] / (new_weight[p] + total - self.d * len(s))))
                    if b > k:
                        weight = s - self.d
                        s = s + rng.multinomial(b - k, weight / weight.sum())
                    s, n = np.r_[s, np.ones(k, np.int64)], n - b
                s = s[s > 0]
                new_sizes.append(s)
                new_own.append(np.full(len(s), p))
            own = np.concatenate([self.own[~gone], *new_own])
            order = np.argsort(own, kind="stable")
            self.own, self.sizes = own[order], np.concatenate([self.sizes[~gone], *new_sizes])[order]
            self.c = target.astype(np.int64).copy()

    def gibbs(self, new_weight: np.ndarray, rng) -> None:
        """Seat each pair's customers anew as a whole, given the weight of a new table."""
        self.anew(new_weight, rng)
        order = np.argsort(self.own, kind="stable")
        self.own, self.sizes = self.own[order], self.sizes[order]

    def anew(self, new_weight: np.ndarray, rng) -> None:
        """gibbs(), but the tables stay out of order."""
        sizes, own = [], []
        alone = np.flatnonzero(self.c == 1)  # a lone customer has a lone table
        sizes.append(np.ones(len(alone), np.int64))
        own.append(alone)
        log_s, table = _stirling(self.d)
        for low, high in ((2, 4), (5, 8), (9, 16), (17, 32), (33, SMALL)):
            every = np.flatnonzero((self.c >= low) & (self.c <= high))
            for at in range(0, len(every), 400_000 // high):
                pairs = every[at : at + 400_000 // high]
                n = self.c[pairs]
                t = 1 + _pick(log_s[n, 1 : high + 1] + np.arange(1, high + 1) * np.log(np.maximum(new_weight[pairs], 1e-300))[:, None], rng)
                while len(pairs):
                    last = t == 1
                    sizes.append(n[last])
                    own.append(pairs[last])
                    pairs, n, t = pairs[~last], n[~last], t[~last]
                    if not len(pairs):
                        break
                    # The table of the first of the n customers left, given that t tables are.
                    s = np.arange(1, high)
                    rest = n[:, None] - s
                    logs = np.where(rest >= 1, table[n[:, None], s] + log_s[np.maximum(rest, 0), (t - 1)[:, None]], -np.inf)
                    s = 1 + _pick(logs, rng)
                    sizes.append(s)
                    own.append(pairs)
                    n, t = n - s, t - 1
        pairs = np.flatnonzero(self.c > SMALL)
        if len(pairs):
            c, q = self.c[pairs], np.maximum(new_weight[pairs], 1e-300)
            mean, spread = _moments(c, np.log(q), self.d)
            t = np.rint(mean + np.sqrt(spread) * rng.standard_normal(len(c)))
            few = np.flatnonzero(mean + 8 * np.sqrt(spread) < FEW)
            grid, log_s = _stirling_large(self.d)
            at = np.minimum(np.searchsorted(grid, c[few]), len(grid) - 1)
            for k in range(0, len(few), 10_000):
                f, g = few[k : k + 10_000], at[k : k + 10_000]
                part = ((np.log(c[f]) - np.log(grid[g - 1])) / (np.log(grid[g]) - np.log(grid[g - 1])))[:, None]
                t[f] = 1 + _pick(log_s[g - 1] * (1 - part) + log_s[g] * part + np.arange(1, FEW + 1) * np.log(q[f])[:, None], rng)
            for p, n, m in zip(pairs.tolist(), c.tolist(), np.clip(t, 1, c).astype(np.int64).tolist()):
                x = np.ones(m, np.int64)
                while n > (have := int(x.sum())):  # the others join the tables by turns, the more the fuller
                    free = x - self.d
                    x = x + rng.multinomial(min(n - have, have), free / free.sum())
                sizes.append(x)
                own.append(np.full(m, p))
        self.own, self.sizes = np.concatenate(own), np.concatenate(sizes)


class Totals:
    """Customers and tables of every restaurant, and what else is fixed: sizes that no corpus changes."""

    def __init__(self, parents: list[int], sums: np.ndarray | None = None):
        self.parents = np.array(parents, np.int64)  # class of each context restaurant
        self.room = 1 + CLASSES + len(parents)
        self.c, self.t = (np.zeros(self.room), np.zeros(self.room)) if sums is None else (sums[: self.room].astype(float), sums[self.room : 2 * self.room].astype(float))
        self.n, self.v = (0, 0) if sums is None else (int(sums[2 * self.room]), int(sums[2 * self.room + 1]))
        self.discount, self.strength = [0.5, 0.5, 0.5], [1.0, 1.0, 1.0]

    def row(self, level: int) -> slice:
        return (slice(0, 1), slice(1, 1 + CLASSES), slice(1 + CLASSES, None))[level]

    def back(self, level: int) -> np.ndarray:
        """The weight of the parent's probability, by restaurant of a level."""
        c, t = self.c[self.row(level)], self.t[self.row(level)]
        return (self.strength[level] + self.discount[level] * t) / (self.strength[level] + c)

    def redraw(self, sizes: np.ndarray, tails: np.ndarray, rng, rest: np.ndarray | None = None) -> None:
        """New discounts and strengths. sizes: by level, tables of more than 1, 2, ... EXACT - 1 customers; tails: by level, the sum
        over larger tables of log((customers - d) / (EXACT - d)); rest: what rest_of() tells of contexts that are not in parents."""
        for level in range(3):
            c, t = (x[self.row(level)] for x in (self.c, self.t))
            c, t = c[t >= 1], t[t >= 1]
            more = rest if level == 2 else None
            if not len(t) and (more is None or not more[0]):
                continue
            d, a = self.discount[level], self.strength[level]
            i = np.arange(1, EXACT)
            y = (rng.random((len(t), EXACT - 1)) < a / (a + d * i))[i[None, :] < t[:, None]].sum()
            y = y + rng.poisson(a / d * np.log(np.maximum(1, (t + a / d) / (EXACT + a / d)))).sum()
            joins = rng.binomial(sizes[level], np.minimum(1, (1 - d) / (i - d))).sum() + rng.poisson((1 - d) * tails[level])
            big = c[c >= 2]
            log_x = np.log(np.maximum(rng.beta(a + 1, big - 1), 1e-300)).sum()
            tables = (t - 1).sum()
            if more is not None:
                y += rng.binomial(more[4:].astype(np.int64), a / (a + d * i)).sum() + rng.poisson(a / d * more[2])
                tables, log_x = tables + more[1], log_x + more[3]
            self.discount[level] = float(np.clip(rng.beta(1 + max(0, tables - y), 1 + joins), 0.01, 0.99))
            self.strength[level] = float(np.clip(rng.gamma(1 + y, 1 / (1 - log_x)), 1e-3, 1e6))


def rest_of(c: np.ndarray, t: np.ndarray, d: float, a: float, rng) -> np.ndarray:
    """For Totals.redraw, of restaurants with c customers at t tables: how many have any; the sum of tables less one; of log((t + a / d) /
    (EXACT + a / d)) where that is above 0; of log x, x ~ Beta(a + 1, c - 1); how many have more than 1, 2, ... EXACT - 1 tables."""
    c, t = c[t >= 1], t[t >= 1]
    big = c[c >= 2]
    more = np.bincount(np.minimum(t, EXACT), minlength=EXACT + 1)[::-1].cumsum()[::-1][2:]
    tail = np.log(np.maximum(1, (t + a / d) / (EXACT + a / d))).sum()
    return np.r_[len(t), (t - 1).sum(), tail, np.log(np.maximum(rng.beta(a + 1, big - 1), 1e-300)).sum(), more].astype(float)


class Shard:
    """All words of one shard with their pairs at the three levels.

    Contexts that are not in the inventory follow it, in the order of their hashes: xk has their classes, xc and xt their customers
    and tables in all shards, xi their numbers in their buckets (which end at xcut), xs the xt of the samples. Of a sweep's seating
    the state keeps how many tables each pair has (t0, t1, t2), all that the next sweep and a sample need.
    """

    def __init__(self, state: dict[str, np.ndarray]):
        self.s, self.sampled, self.seated = state, [], None

    @staticmethod
    def loaded(data: bytes, parents: np.ndarray) -> "Shard":
        """The shard of packed(); parents: the classes of the inventory."""
        s = _unpack(data)
        s["up2"] = np.searchsorted(s["w1"] * CLASSES + s["r1"], s["w2"] * CLASSES + np.concatenate([parents, s["xk"]]).astype(np.int64)[s["r2"]])
        return Shard(s)

    def packed(self) -> bytes:
        return _pack(**{k: x for k, x in self.s.items() if k != "up2"})

    @staticmethod
    def merged(asked: list[dict[str, np.ndarray]], parents: np.ndarray) -> "Shard":
        w, r, c = [], [], []
        first = CLASSES + len(parents)
        x, which = rest_contexts(asked)
        xk = np.concatenate([a["xk"] for a in asked if "x" in a] or [np.zeros(0, np.int8)])[which]
        sizes = [int(a["n"][0]) for a in asked]
        coded = _binary([a["words"] for a in asked], sizes).dictionary_encode()
        for a, local in zip(asked, np.split(coded.indices.to_numpy(), np.cumsum(sizes)[:-1])):
            some = a["c"] > 0
            w.append(local[a["w"][some]].astype(np.int64))
            r.append(_renumbered(a, x, first)[some])
            c.append(a["c"][some].astype(np.int64))
        w, r, c = np.concatenate(w), np.concatenate(r), np.concatenate(c)
        seen = np.flatnonzero(np.bincount(w, minlength=len(coded.dictionary)))  # held-out words alone aren't kept: they are unknown
        names = coded.dictionary.take(pa.array(seen))
        order = pc.array_sort_indices(names)
        names = names.take(order).to_pylist()
        rank = np.zeros(len(coded.dictionary), np.int64)
        rank[seen[order.to_numpy()]] = np.arange(len(names))
        w = rank[w]
        parents = np.concatenate([parents, xk]).astype(np.int64)
        room = CLASSES + len(parents)
        key, where = np.unique(w * room + r, return_inverse=True)
        count = np.bincount(where, weights=c, minlength=len(key)).astype(np.int64) if len(key) else np.zeros(0, np.int64)
        w, r = key // room, key % room
        deep = r >= CLASSES
        w2, r2, c2 = w[deep], r[deep] - CLASSES, count[deep]
        up = w2 * CLASSES + parents[r2] if len(w2) else np.zeros(0, np.int64)
        key1 = np.unique(np.r_[up, w[~deep] * CLASSES + r[~deep]])
        direct = np.zeros(len(key1), np.int64)
        direct[np.searchsorted(key1, w[~deep] * CLASSES + r[~deep])] = count[~deep]
        return Shard(
            {
                "words": _joined(names), "n": np.array([len(names)]),
                "count": np.bincount(w, weights=count, minlength=len(names)).astype(np.int64),
                "w2": w2, "r2": r2, "c2": c2, "up2": np.searchsorted(key1, up),
                "w1": key1 // CLASSES, "r1": key1 % CLASSES, "direct": direct,
                "xk": xk, **{k: np.zeros(len(x), np.int32) for k in ("xc", "xt", "xi")},
            }
        )

    def first_sums(self, n_contexts: int) -> np.ndarray:
        """Before any seating: customers as if every pair had one table."""
        s = self.s
        c1 = s["direct"] + np.bincount(s["up2"], minlength=len(s["w1"]))
        c0 = np.bincount(s["w1"], minlength=int(s["n"][0]))
        return self._sums(n_contexts, c0, np.ones_like(c0), c1, np.ones_like(c1), s["c2"], np.ones_like(s["c2"]))

    def _sums(self, n_contexts, c0, t0, c1, t1, c2, t2, tables=()) -> np.ndarray:
        s = self.s
        by1 = lambda x: np.bincount(s["r1"], weights=x, minlength=CLASSES)
        by2 = lambda x: np.bincount(s["r2"], weights=x, minlength=n_contexts)[:n_contexts]
        self.rest = [np.bincount(s["r2"], weights=x, minlength=n_contexts + len(s["xk"]))[n_contexts:].astype(np.int32) for x in (c2, t2)]
        ones = [[(c == k).sum() for k in (1, 2)] for c in (c0, c1, c2)]
        return np.concatenate([[c0.sum()], by1(c1), by2(c2), [t0.sum()], by1(t1), by2(t2), [s["count"].sum(), len(c0)], *ones, *tables]).astype(np.int64)

    def told(self, buckets: int, x: np.ndarray | None = None) -> list[bytes]:
        """To each bucket: this shard's customers and tables of its contexts (after a sweep, or first_sums), which x has the hashes of the first time."""
        s = self.s
        if x is not None:
            ends = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
            s["xcut"] = np.r_[0, np.searchsorted(x, ends), len(x)]
        name, keys = ("i", s["xi"]) if x is None else ("x", x)
        return [_pack(**{name: keys[a:z], "c": self.rest[0][a:z], "t": self.rest[1][a:z]}) if a < z else None for a, z in zip(s["xcut"].tolist(), s["xcut"][1:].tolist())]

    def hear(self, replies: list[dict[str, np.ndarray]]) -> None:
        """The totals, in order of buckets."""
        if replies:
            self.s["xt"] = np.concatenate([x["t"] for x in replies])
            if "i" in replies[0]:
                self.s["xi"], self.s["xc"] = (np.concatenate([x[k] for x in replies]) for k in ("i", "c"))

    def seats(self, totals: Totals) -> list[Seats]:
        """The seating of the sweep that was made here, if any."""
        none = np.zeros(0, np.int64)
        return self.seated or [Seats(np.zeros(len(self.s[k]), np.int64), none, none, d) for k, d in zip(("count", "w1", "w2"), totals.discount)]

    def probabilities(self, tables: list[np.ndarray], xt: np.ndarray, totals: Totals) -> list[np.ndarray]:
        """Of words at the root, and of the pairs at the other two levels, given their tables, those of the contexts beyond the inventory, and the totals."""
        s, d, a = self.s, totals.discount, totals.strength
        c1 = s["direct"] + np.bincount(s["up2"], weights=tables[2], minlength=len(s["w1"]))
        c0 = np.bincount(s["w1"], weights=tables[1], minlength=int(s["n"][0]))
        c, t = (np.concatenate([x[totals.row(2)], y]) for x, y in ((totals.c, s["xc"]), (totals.t, xt)))
        p0 = (c0 - d[0] * tables[0]) / (a[0] + totals.c[0]) + totals.back(0)[0] / (totals.v + 1)
        p1 = (c1 - d[1] * tables[1]) / (a[1] + totals.c[totals.row(1)][s["r1"]]) + totals.back(1)[s["r1"]] * p0[s["w1"]]
        p2 = (s["c2"] - d[2] * tables[2]) / (a[2] + c[s["r2"]]) + ((a[2] + d[2] * t) / (a[2] + c))[s["r2"]] * p1[s["up2"]]
        return [p0, p1, p2]

    def sweep(self, totals: Totals, rng) -> np.ndarray:
        """One sweep; returns the shard's part of the new totals."""
        s, d = self.s, totals.discount
        self.seated = None
        seats = self.seats(totals)
        if "t0" in s:
            p0, p1, _ = self.probabilities([s[f"t{k}"] for k in range(3)], s["xt"], totals)
        else:
            p0 = (s["count"] + 1) / (totals.n + totals.v + 1)
            p1 = p0[s["w1"]]
        weight = lambda k, t, p: (totals.strength[k] + d[k] * t) * p
        q2, q1 = weight(2, np.concatenate([totals.t[totals.row(2)], s["xt"]])[s["r2"]], p1[s["up2"]]), weight(1, totals.t[totals.row(1)][s["r1"]], p0[s["w1"]])
        q0 = np.full(len(p0), (totals.strength[0] + d[0] * totals.t[0]) / (totals.v + 1))
        seats[2].c = s["c2"].astype(np.int64)
        seats[2].anew(q2, rng)
        t2 = seats[2].tables()
        seats[1].c = s["direct"] + np.bincount(s["up2"], weights=t2, minlength=len(s["w1"])).astype(np.int64)
        seats[1].anew(q1, rng)
        t1 = seats[1].tables()
        seats[0].c = np.bincount(s["w1"], weights=t1, minlength=len(p0)).astype(np.int64)
        seats[0].anew(q0, rng)
        t0 = seats[0].tables()
        self.seated, flat = seats, []
        for k, t in enumerate((t0, t1, t2)):
            s[f"t{k}"] = t.astype(np.int32)
            flat += [seats[k].c, t]
        # For Totals.redraw: tables by size, and the logarithms of the larger ones' in millionths.
        tables = []
        for k in range(3):
            z = seats[k].sizes
            tables.append(np.bincount(np.minimum(z, EXACT), minlength=EXACT + 1)[::-1].cumsum()[::-1][2:])
            big = z[z > EXACT]
            tables.append([round(1e6 * float(np.log((big - d[k]) / (EXACT - d[k])).sum()))])
        return self._sums(len(totals.parents), *flat, tables)

    def keep_sample(self, totals: Totals) -> None:
        """Of a sample the shard keeps the tables (small numbers), from which and the totals the probabilities follow."""
        self.sampled.append(totals)
        for name, x in [*((f"t{k}s", self.s[f"t{k}"]) for k in range(3)), ("xs", self.s["xt"])]:
            self.s[name] = np.concatenate([self.s[name], x[None]]) if name in self.s else x[None]

    def _finish(self, parents: np.ndarray, back: np.ndarray) -> None:
        """Means and samples that answers are taken from."""
        s = self.s
        self._parents, self._back = np.concatenate([parents, s["xk"]]).astype(np.int64), back
        if len(s["xk"]):
            self._back = np.concatenate([back, np.array([(t.strength[2] + t.discount[2] * x) / (t.strength[2] + s["xc"]) for t, x in zip(self.sampled, s["xs"])])], 1)
        self._keys = s["w1"] * CLASSES + s["r1"], s["w2"] * max(1, len(self._parents)) + s["r2"]
        p0, p1, self._p2 = [], [], np.zeros(len(s["w2"]))
        for n, t in enumerate(self.sampled):
            p = self.probabilities([s[f"t{k}s"][n] for k in range(3)], s["xs"][n], t)
            p0.append(p[0].astype(np.float32))
            p1.append(p[1].astype(np.float32))
            self._p2 += p[2] / len(self.sampled)
        self._p0, self._p1 = np.array(p0), np.array(p1)

    def places(self, asked: list[dict[str, np.ndarray]]) -> list[np.ndarray]:
        """Of the words of each request, their numbers here, -1 where they are unknown."""
        sizes = [int(a["n"][0]) for a in asked]
        found = pc.index_in(_binary([a["words"] for a in asked], sizes), value_set=_binary([self.s["words"]], [int(self.s["n"][0])]))
        return np.split(found.fill_null(-1).to_numpy().astype(np.int64), np.cumsum(sizes)[:-1])

    def answer(self, asked: dict[str, np.ndarray], parents: np.ndarray, backs: list[np.ndarray], v: int, x: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the words asked about, and mean probabilities of the pairs; backs: by level, (samples, restaurants).

        x: the hashes of contexts beyond parents. asked may have its places(), as "at".
        """
        s = self.s
        if not hasattr(self, "_keys"):
            self._finish(parents, backs[2])
        asked = asked | {"r": _renumbered(asked, x, CLASSES + len(parents))}
        parents, backs, (key1, key2) = self._parents, [*backs[:2], self._back], self._keys
        local = asked["at"] if "at" in asked else self.places([asked])[0]
        w, r = local[asked["w"]], asked["r"].astype(np.int64)
        out, deep = np.empty(len(w)), r >= CLASSES
        d = np.flatnonzero(deep)
        d = d[np.argsort(w[d], kind="stable")]  # rising keys are found faster
        i, hit = _find(key2, np.where(w[d] >= 0, w[d] * max(1, len(parents)) + r[d] - CLASSES, -1))
        out[d[hit]] = self._p2[i[hit]]
        left = np.r_[np.flatnonzero(~deep), d[~hit]]  # those that the levels above answer
        w, r, deep = w[left], r[left], deep[left]
        root = np.where(w >= 0, self._p0[:, w], backs[0] / (v + 1)) if len(s["count"]) else np.repeat(backs[0] / (v + 1), len(w), 1)
        kind = np.where(deep, parents[np.where(deep, r - CLASSES, 0)] if len(parents) else 0, r)
        i, hit = _find(key1, np.where(w >= 0, w * CLASSES + kind, -1))
        p = backs[1][:, kind] * root
        p[:, hit] = self._p1[:, i[hit]] if len(key1) else 0
        if deep.any():
            p[:, deep] = backs[2][:, r[deep] - CLASSES] * p[:, deep]
        out[left] = p.mean(0)
        return np.where(local >= 0, s["count"][np.maximum(local, 0)], 0) if len(s["count"]) else np.zeros(len(local), np.int64), out


def rest_contexts(asked: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all contexts in requests that are not in the inventory, and where each is first."""
    return np.unique(np.concatenate([a["x"] for a in asked if "x" in a] or [np.zeros(0, np.uint64)]), return_index=True)


def _renumbered(asked: dict[str, np.ndarray], x: np.ndarray | None, first: int) -> np.ndarray:
    """Restaurants asked about, those beyond the inventory (from first on) by their place in x."""
    r = asked["r"].astype(np.int64)
    if "x" in asked and len(asked["x"]):
        deep = r >= first
        r[deep] = first + np.searchsorted(x, asked["x"])[r[deep] - first]
    return r


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return i, keys[i] == wanted


# Rounds

_STATE = "shard int, state binary, sums array<bigint>, told array<binary>"
_REPLY = "bucket int, data binary, rest array<double>, shard int"


def _state_row(shard: int, state: Shard, sums: np.ndarray, told: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([state.packed()], pa.binary()), pa.array([sums.tolist()], pa.list_(pa.int64())), pa.array([told], pa.list_(pa.binary()))], ["shard", "state", "sums", "told"])


def _replied(states: DataFrame, path: str, discount: float, strength: float, seed: list[int]) -> np.ndarray | None:
    """Add up what shards told the buckets, write the totals by shard to path; the sum of rest_of()."""

    def add(key, rows):
        k = key[0].as_py()
        got = sorted(zip(rows["shard"].to_pylist(), rows["data"].to_pylist()))
        shards, parts = [x for x, _ in got], [_unpack(x) for _, x in got]
        if first := "x" in parts[0]:
            _, where = np.unique(np.concatenate([x["x"] for x in parts]), return_inverse=True)
        else:
            where = np.concatenate([x["i"] for x in parts]).astype(np.int64)
        c, t = (np.bincount(where, weights=np.concatenate([x[n] for x in parts])).astype(np.int32) for n in ("c", "t"))
        rest = rest_of(c.astype(np.int64), t.astype(np.int64), discount, strength, np.random.default_rng([*seed, k]))
        own = np.split(where, np.cumsum([len(x["t"]) for x in parts])[:-1])
        del parts, got
        data = [_pack(t=t[w], **({"i": w.astype(np.uint32), "c": c[w]} if first else {})) for w in own]
        return pa.table({"bucket": pa.array([k] * (len(own) + 1), pa.int32()), "data": pa.array([*data, None], pa.binary()), "rest": pa.array([*[None] * len(own), rest.tolist()], pa.list_(pa.float64())), "shard": pa.array([*shards, -1], pa.int32())})

    told = states.select("shard", F.posexplode("told").alias("bucket", "data")).where("data IS NOT NULL")
    told.groupBy("bucket").applyInArrow(add, _REPLY).repartition("shard").write.partitionBy("shard").parquet(path)
    rest = [r["rest"] for r in states.sparkSession.read.schema(_REPLY).parquet(path).where("shard = -1").orderBy("bucket").collect()]
    return np.sum(rest, 0) if rest else None


def _written(path: str, k: int, key: str, data: str, of: str = "shard") -> list[tuple[int, bytes]]:
    """What was written for a shard, by key."""
    files, at = pafs.FileSystem.from_uri(f"{path}/{of}={k}")
    if files.get_file_info(at).type == pafs.FileType.NotFound:
        return []
    rows = pq.read_table(at, filesystem=files, columns=[key, data], partitioning=None).sort_by(key)
    return list(zip(rows[key].to_pylist(), rows[data].to_pylist()))


def _heard(path: str, shard: Shard, k: int) -> Shard:
    """The shard with the totals that were written for it."""
    shard.hear([_unpack(x) for _, x in _written(path, k, "bucket", "data")])
    return shard


def _summed(states: DataFrame) -> np.ndarray:
    """The shards' sums, added up by restaurant: as many numbers as the inventory has."""
    rows = states.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(rows), np.int64)
    for r in rows:
        out[r["i"]] = r["x"]
    return out


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2,
    share: float = 5e-5, contexts: int | None = None, burn: int = 2, samples: int = 4, shards: int | None = None, seed: int = 11,
) -> DataFrame:
    """Learn from the rows whose crc32(id as text) mod folds is not held, score all of them.

    One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram), score (log10 probability),
    perplexity (10 ^ (-score / n_tokens)). Tokens: words after lower-casing A-Z, then the end. Null texts: empty (one token, the
    end); a null id hashes as the empty text; repeated rows are learned and scored each; with no training rows every token is
    unknown; an empty table gives no rows; other columns are not read. share: the totals of words of at least that share of the training
    tokens as contexts are sent to all tasks (in a word's count, chunks in which its share is under a tenth of that are left out);
    contexts: if given, only so many of them, the most frequent; the others' are added up by buckets, to the same model. shards: a
    shard is held in one task's memory; the default is the session's number of shuffle partitions, or more, so that a shard has
    SHARD_TOKENS tokens or so.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "hpylm")
    kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    made = src.mapInArrow(_chunks(folds, held, share), f"chunk bigint, ids array<{kind}>, texts binary, tokens bigint, trained bigint, top array<binary>, top_n array<bigint>")
    kept = f"{folder}/chunks"
    made.write.partitionBy("chunk").parquet(kept)
    chunks = spark.read.schema(made.schema).parquet(kept)
    tokens, trained = (x or 0 for x in chunks.agg(F.sum("tokens"), F.sum("trained")).first())
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // SHARD_TOKENS))
    buckets, sampled = -(-shards // 2), []

    # The inventory: words of `share` of the tokens or more, so 1 / share of them at most.
    top = chunks.select(F.explode(F.arrays_zip("top", "top_n")).alias("x")).groupBy(F.col("x.top").alias("word")).agg(F.sum("x.top_n").alias("n"))
    top = top.where(F.col("n") >= max(2, share * trained))
    chosen = sorted(bytes(r["word"]) for r in (top if contexts is None else top.orderBy(F.desc("n"), "word").limit(contexts)).select("word").collect())
    inventory = {w: i for i, w in enumerate(chosen)}
    parents = [_class_of(w) for w in chosen]

    asked, up = f"{folder}/asked", np.array(parents, np.int64)
    made = chunks.select("chunk", "texts").mapInArrow(_requests(inventory, shards), "shard int, chunk bigint, asked binary")
    made.repartition("shard").write.partitionBy("shard").parquet(asked)

    def merge(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                if told := [_unpack(x) for _, x in _written(asked, k, "chunk", "asked")]:
                    shard = Shard.merged(told, up)
                    sums = shard.first_sums(len(parents))
                    row = _state_row(k, shard, sums, shard.told(buckets, rest_contexts(told)[0]))
                    del shard, told
                    _give_back()
                    yield row

    states = stored(spark.range(0, shards, 1, shards).select(F.col("id").cast("int")).mapInArrow(merge, _STATE), "state0", folder)
    sums = _summed(states)
    _let_go(spark)  # not before: the last job's plan is still held
    backs: list[list[np.ndarray]] = [[], [], []]

    # Discounts by level at first, as in Kneser-Ney smoothing: n1 / (n1 + 2 n2), of pairs with one and two customers.
    head = 2 * (1 + CLASSES + len(parents)) + 2
    ones = (sums[head : head + 6] if len(sums) else np.zeros(6)).reshape(3, 2)
    discount, strength = [float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a + b else 0.5 for a, b in ones], [1.0, 1.0, 1.0]

    rest = _replied(states, f"{folder}/reply0", discount[2], strength[2], [seed, 0])

    def totals_of(sums: np.ndarray, n: int) -> Totals:
        nonlocal discount, strength
        t = Totals(parents, sums if len(sums) else np.zeros(head + 6, np.int64))
        t.discount, t.strength = discount, strength
        if len(sums) > head + 6:  # a sweep was made
            tables = sums[head + 6 :].reshape(3, EXACT)
            t.redraw(tables[:, :-1], tables[:, -1] / 1e6, np.random.default_rng([seed, n]), rest)
            discount, strength = t.discount, t.strength
        return t

    for n in range(burn + samples - 1):
        totals, sample = totals_of(sums, n), n >= burn

        def sweep(batches, totals=totals, sample=sample, n=n):
            for b in batches:
                for k, data in zip(b.column(0).to_pylist(), b.column(1)):
                    shard = _heard(f"{folder}/reply{n}", Shard.loaded(data.as_py(), up), k)
                    if sample:
                        shard.keep_sample(totals)
                    new = shard.sweep(totals, np.random.default_rng([seed, n, k]))
                    row = _state_row(k, shard, new, shard.told(buckets))
                    del shard
                    _give_back()
                    yield row

        if sample:
            sampled.append(totals)
            for level in range(3):
                backs[level].append(totals.back(level))
        states = stored(states.select("shard", "state").mapInArrow(sweep, _STATE), f"state{n + 1}", folder)
        rest = _replied(states, f"{folder}/reply{n + 1}", discount[2], strength[2], [seed, n + 1])
        drop_folder(spark, f"{folder}/state{n}")
        drop_folder(spark, f"{folder}/reply{n}")
        sums = _summed(states)

    last, heard = totals_of(sums, burn + samples), f"{folder}/reply{burn + samples - 1}"
    for level in range(3):
        backs[level].append(last.back(level))
    stacked = [np.array(b) for b in backs]
    _let_go(spark)

    def answer(batches):
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1)):
                shard = _heard(heard, Shard.loaded(data.as_py(), up), k)
                shard.sampled = list(sampled)
                shard.keep_sample(last)
                every = [(chunk, _unpack(a)) for chunk, a in _written(asked, k, "chunk", "asked")]
                x, _ = rest_contexts([a for _, a in every])
                for (chunk, a), at in zip(every, shard.places([a for _, a in every]) if every else []):
                    c, p = shard.answer(a | {"at": at}, up, stacked, last.v, x)
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([k], pa.int32()), pa.array([_pack(c=c.astype(np.int64), p=p.astype(np.float32))], pa.binary())], ["chunk", "shard", "answer"])
                del shard, every
                _give_back()

    answers = states.select("shard", "state").mapInArrow(answer, "chunk bigint, shard int, answer binary")
    n_train, v = last.n, last.v

    def score(key, left, right):
        ids, texts = left["ids"][0], _unpack(_written(kept, key[0].as_py(), "tokens", "texts", "chunk")[0][1])
        got = [_unpack(a.as_py()) for _, a in sorted(zip(right["shard"].to_pylist(), right["answer"]), key=lambda x: x[0])]
        counts, p = np.concatenate([g["c"] for g in got]), np.concatenate([g["p"] for g in got])
        _, _, _, place, _, _, _, where = _pairs(texts, inventory, shards, True)
        flat, lens = texts["flat"], texts["lens"]
        c = counts[place[flat]]
        starts = np.cumsum(lens) - lens
        base = np.log10((c + 1) / (n_train + 1 * (v + 1)))
        total = lambda x: np.add.reduceat(x, starts)
        logs = total(np.log10(p.astype(np.float64))[where])
        return pa.Table.from_arrays(
            [
                pa.array(ids.as_py(), ids.type.value_type), pa.array(~texts["train"]), pa.array(lens, pa.int64()), pa.array(total((c > 0).astype(np.int64))),
                pa.array(np.full(len(lens), n_train, np.int64)), pa.array(total(base)), pa.array(logs), pa.array(10 ** (-logs / lens)),
            ],
            ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
        )

    out = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    scored = chunks.select("chunk", "ids").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, out)
    return scored.withColumnRenamed("id", id_col)
