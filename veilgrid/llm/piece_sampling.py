"""Segmentations of SentencePiece sampled without replacement: Gumbel top-k by A* search over the lattice, and decoding.

A text is cut in units that no piece crosses (blanks with the word after them; tabs and new lines). The lattice of a unit has
a node per character border and an edge per vocabulary piece (a character that is no piece is one edge of its bytes). A
piece's log probability is Zipf's for its rank in the vocabulary file, whose own merge ranks are no probabilities; backward
sums over the lattice turn them into exact conditional probabilities of the next piece at each node. Lattices are built once
per different unit, those of a batch in lock step, and kept by the task up to MAX_EDGES, which affects speed alone.

The search tree branches at each piece of the whole text. Perturbed values go down the tree: a node hands its value to the
child that is drawn, and the other children together get a Gumbel value for their mass, cut off at the node's. So a drawn
path leaves one bound at each of its pieces, and each bound is exactly the best value behind it; A* takes the largest bound
next, draws one of the children behind it (a different segmentation, for certain), completes it, and leaves its bounds. The
k largest perturbed values of all segmentations of the text come out in order, with the inclusion probability
1 - exp(-exp(log_prob - kappa)), kappa being the largest bound left. All draws are hashes of the row key, the sample's number
and the place in the text, so batches and partitions don't matter.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from veilgrid.llm.common import fresh

#: Texts are sampled in groups of about so many characters (a longer text is a group of its own).
GROUP_CHARS = 600_000
#: Lattice edges that a task keeps (about 30 bytes each).
MAX_EDGES = 1_500_000
#: Values along a path are made so many at a time; none of the uniform numbers has a Gumbel value above TOP.
STEP, TOP = 128, 37.5
SPACE = "▁"
_UNITS = re.compile(f"{SPACE}+[^{SPACE}\n\t]*|[\n\t]|[^{SPACE}\n\t]+")
_U = np.uint64
_WORD = (1 << 64) - 1
_NONE = np.zeros(0, np.int32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _uniform(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """In (0, 1), from a key and a place number."""
    return ((_mix(key + place.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


class Vocabulary:
    """Pieces of a SentencePiece model with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id, self.trie_key, normal = {}, {}, []
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(self.pieces[i][3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append(i)
        if len(self.byte_id) != 256 or sp.encode(" a", out_type=str)[:1] != [SPACE]:
            raise ValueError("the model has no byte fallback or no dummy prefix")
        for i in normal:
            p = self.pieces[i]
            if SPACE in p.lstrip(SPACE) or "\n" in p or "\t" in p:
                raise ValueError(f"a piece crosses units: {p!r}")
        norm = np.log(np.sum(1 / (np.arange(1, len(normal) + 1) + 1.7)))
        self.log_p = {i: -float(np.log(r + 2.7) + norm) for r, i in enumerate(normal)}
        self.byte_log_p = -float(np.log(len(normal) + 2.7) + norm)
        children: dict[tuple[int, int], int] = {}
        token = [-1]
        for i in normal:
            node = 0
            for c in self.pieces[i]:
                node = children.setdefault((node, ord(c)), len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = i
        # The trie's other edges (node, character) -> node, in a table of at most 1/8 full: a key lies at its hash or in one of the next slots.
        self.bits = max(10, (8 * len(children)).bit_length())
        self.keys, self.to = np.full((1 << self.bits) + 64, -1, np.int64), np.zeros((1 << self.bits) + 64, np.int32)
        self.probes = 1
        for (a, c), to in children.items():
            key = a << 21 | c
            at = slot = key * 0x9E3779B97F4A7C15 % (1 << 64) >> 64 - self.bits
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.to[at] = key, to
            self.probes = max(self.probes, at - slot + 1)
        self.token = np.array(token, np.int32)
        self.first = np.full(0x110000, -1, np.int32)  # children of the root, by character
        for (a, c), to in children.items():
            if a == 0:
                self.first[c] = to
        self.byte_ids = np.array([self.byte_id[b] for b in range(256)], np.int32)
        # What a piece stands for, as bytes.
        raw = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.shown = pa.array([raw.get(i, p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)], pa.binary())
        self.piece_log_p = np.full(n, np.nan)
        for i, x in self.log_p.items():
            self.piece_log_p[i] = x

    def children(self, node: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which (node, character) pairs have a child, and those children."""
        key = node.astype(np.int64) << 21 | char
        slot = (key.view(_U) * _U(0x9E3779B97F4A7C15) >> _U(64 - self.bits)).view(np.int64)
        hit = self.keys[slot] == key
        open_ = np.flatnonzero(~hit & (self.keys[slot] >= 0))
        for _ in range(self.probes - 1):  # the few that another key's slot holds
            slot[open_] += 1
            there = self.keys[slot[open_]]
            found = there == key[open_]
            hit[open_[found]] = True
            open_ = open_[~found & (there >= 0)]
        hit = np.flatnonzero(hit)
        return hit, self.to[slot[hit]]

    def decode(self, lists: pa.ListArray) -> list[bytes]:
        """The bytes of each list of piece ids: bytes joined, SPACE as a blank, the dummy prefix off."""
        flat = lists.flatten()
        data = self.shown.take(flat)
        ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int32)
        raw = memoryview(data.buffers()[2] or b"") if len(data) else memoryview(b"")
        cuts = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        return [bytes(raw[a:z]).removeprefix(b" ") for a, z in zip(cuts, cuts[1:])]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """The lattices of many units: edges in order of their node, each with its conditional probability there.

    All numbers of a unit depend on that unit alone, to the last bit, whatever else is in the lattice.
    """

    def __init__(self, units: list[str], v: Vocabulary):
        lens = np.array([len(u) for u in units], np.int64)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        n = len(codes)
        self.first = np.cumsum(lens) - lens  # of each unit; its last node is first + len, which is no node of its own here
        stop = np.repeat((self.first + lens).astype(np.int32), lens)  # a node's unit ends before
        src, size, tok = [], [], []
        at, node, k = np.arange(n, dtype=np.int32), v.first[codes], 1
        at, node = at[node >= 0], node[node >= 0]
        while True:
            t = v.token[node]
            ends = t >= 0
            src.append(at[ends])
            size.append(k)
            tok.append(t[ends])
            on = at + k < stop[at]
            at, node = at[on], node[on]
            if not len(at):
                break
            hit, node = v.children(node, codes[at + k])
            at = at[hit]
            k += 1
        single = np.zeros(n, bool)
        single[src[0]] = True
        raw = np.flatnonzero(~single).astype(np.int32)  # characters that are no piece: an edge of their bytes, numbered below 0
        src.append(raw)
        size.append(1)
        tok.append(-1 - codes[raw])
        # Edges by node, the shorter before the longer.
        begin = np.zeros(n + 1, np.int32)
        for s in src:
            begin[1:][s] += 1
        begin = np.cumsum(begin, dtype=np.int32)
        free, m = begin[:-1].copy(), int(begin[-1])
        at_src, at_to, at_tok = np.empty(m, np.int32), np.empty(m, np.int32), np.empty(m, np.int32)
        for s, d, t in zip(src, size, tok):
            e = free[s]
            at_src[e], at_to[e], at_tok[e] = s, s + d, t
            free[s] += 1
        src, to, tok = at_src, at_to, at_tok
        log_p = v.piece_log_p[np.maximum(tok, 0)]
        under = tok < 0
        c = -1 - tok[under]
        log_p[under] = v.byte_log_p * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))
        # Backward sums, by distance from the unit's end.
        left = stop - np.arange(n) if n else np.zeros(0, np.int64)
        beta = np.zeros(n + 1)
        by = np.argsort(left, kind="stable")
        counts = np.bincount(left)
        pos = 0
        ends_unit = to == stop[src] if n else np.zeros(0, bool)
        for d in range(1, len(counts)):
            nodes = by[pos : pos + counts[d]]
            pos += counts[d]
            a, z = begin[nodes], begin[nodes + 1]
            width = z - a
            offs = np.cumsum(width) - width
            e = np.repeat(a - offs, width) + np.arange(int(width.sum()))
            x = log_p[e] + np.where(ends_unit[e], 0.0, beta[to[e]])
            top = np.maximum.reduceat(x, offs)
            beta[nodes] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, width)), offs))
        log_q = log_p + np.where(ends_unit, 0.0, beta[to]) - beta[src]
        log_q[begin[:-1][np.diff(begin) == 1]] = 0.0
        share, width, nth = np.exp(log_q), np.diff(begin), 1
        more = begin[:-1][width > nth]
        while len(more):  # sums along each node's edges
            share[more + nth] += share[more + nth - 1]
            nth += 1
            more = begin[:-1][width > nth]
        share[begin[1:] - 1] = 1.0
        self.begin, self.to, self.token, self.ends, self.log_q, self.share = begin, to, tok, ends_unit, log_q, share
        self.widest = int(width.max(initial=1))

    def join(self, more: "Lattice") -> np.ndarray:
        """Put another lattice's units behind these; returns their first nodes."""
        nodes, edges = np.int32(len(self.begin) - 1), self.begin[-1]
        self.begin = np.concatenate([self.begin, more.begin[1:] + edges])
        self.to = np.concatenate([self.to, more.to + nodes])
        for name in ("token", "ends", "log_q", "share"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(more, name)]))
        self.widest = max(self.widest, more.widest)
        return more.first + nodes

    def cut(self, nodes: int, edges: int) -> None:
        """Leave just the units of the first so many nodes and edges."""
        if edges < len(self.to):
            self.begin = self.begin[: nodes + 1]
            for name in ("to", "token", "ends", "log_q", "share"):
                setattr(self, name, getattr(self, name)[:edges])

    def draw(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node at which its edges' shares pass u."""
        lo, hi = self.begin[nodes], self.begin[nodes + 1] - 1
        for _ in range((self.widest - 1).bit_length()):
            mid = (lo + hi) >> 1
            up = self.share[mid] <= u
            lo, hi = np.where(up, np.minimum(mid + 1, hi), lo), np.where(up, hi, mid)
        return lo

    def walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a path from each node to its unit's end: edges of all paths one after the other, and their numbers."""
        n = len(nodes)
        live = np.argsort(nodes, kind="stable")  # neighbours in memory one after the other
        at, step, taken = nodes[live], 0, []
        count = np.zeros(n, np.int32)
        while len(live):
            e = self.draw(at, _uniform(keys[live], np.full(1, step)))
            taken.append((live, e))
            count[live] += 1
            on = np.flatnonzero(~self.ends[e])
            live, at, step = live[on], self.to[e[on]], step + 1
        start = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for k, (who, e) in enumerate(taken):
            out[start[who] + k] = e
        return out, count


class Units:
    """Numbers of the first nodes of units, and the lattices of the units met first, up to MAX_EDGES; what goes beyond is made for its group alone.

    Where over half of a group's units are not among those kept, they are forgotten and the group's are kept instead.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self._clear()

    def _clear(self) -> None:
        self.node, self.lattice = {}, Lattice([], self.v)
        self.kept = (0, 0)

    def first(self, units: list[str]) -> np.ndarray:
        self.lattice.cut(*self.kept)
        found = list(map(self.node.get, units))
        full = self.kept[1] > MAX_EDGES
        if full and 2 * found.count(None) > len(found):
            self._clear()
            found, full = [None] * len(units), False
        new = dict.fromkeys(u for u, at in zip(units, found) if at is None)
        if new:
            new.update(zip(new, self.lattice.join(Lattice(list(new), self.v)).tolist()))
            if not full:
                self.node.update(new)
                self.kept = (len(self.lattice.begin) - 1, len(self.lattice.to))
            found = [new[u] if at is None else at for u, at in zip(units, found)]
        return np.array(found, np.int32)


def _cut_off(limit: float, value: float) -> float:
    """A Gumbel value, cut off at limit."""
    if value == -np.inf:
        return value
    low, high = sorted((-limit, -value))
    return -(high + math.log1p(math.exp(low - high)))


def _gumbel(u: float) -> float:
    return -math.log(-math.log(u))


def _uniform_py(key: int, place: int) -> float:
    """As _uniform, of one number."""
    x = key + place * 0x9E3779B97F4A7C15 & _WORD
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _WORD
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _WORD
    return (((x ^ x >> 31) >> 11) + 0.5) * 2.0**-53


class _Path:
    """One drawn segmentation of a text, with the bounds that it leaves behind its own places (all from `done` on).

    A bound is a cut-off Gumbel value of the mass behind a place. No Gumbel value is above TOP, and the mass falls along the path,
    so places far along can't hold the largest bound: values are made from the front, as far as the largest one needs.
    """

    __slots__ = ("edges", "done", "value", "key", "values", "before", "own", "out")

    def __init__(self, edges, done, value, key, before):
        self.edges, self.done, self.value, self.key, self.values, self.before = edges, done, value, key, np.zeros(0), before
        self.own: dict[int, float] = {}  # place -> the bound left there after a draw
        self.out: dict[int, list[int]] = {}  # place -> edges that are taken there

    def top(self) -> tuple[float, int]:
        """The largest bound among the values made, and its place."""
        if not len(self.values):  # a draw at the text's last place
            return -np.inf, -1
        place = int(self.values.argmax())
        found = (_cut_off(self.value, float(self.values[place])), self.done + place)
        return max([found, *((b, p) for p, b in self.own.items())]) if self.own else found

    def short(self) -> bool:
        """Whether a value still to be made may be behind the largest bound."""
        n = self.done + len(self.values)
        return n < len(self.edges) and (n == self.done or _cut_off(self.value, self.before + TOP) > self.top()[0])

    def leave(self, place: int, bound: float) -> None:
        self.values[place - self.done] = -np.inf
        self.own[place] = bound


def _make_values(paths: list[_Path], lattice: Lattice) -> None:
    """Gumbel values of the masses behind the places of each path, up to where top() is the largest of all."""
    step = STEP
    while paths := [p for p in paths if p.short()]:
        at = np.array([p.done + len(p.values) for p in paths])
        edges = np.full((len(paths), step), -1, np.int32)
        for row, p, n in zip(edges, paths, at.tolist()):
            e = p.edges[n : n + step]
            row[: len(e)] = e
        some = edges >= 0
        log_q = np.where(some, lattice.log_q[edges], 0.0)
        along = np.cumsum(np.concatenate([np.array([p.before for p in paths])[:, None], log_q], 1), 1)
        noise = _uniform(np.array([p.key for p in paths], _U)[:, None], at[:, None] + np.arange(step))
        with np.errstate(divide="ignore"):
            values = np.where(some, along[:, :-1] + np.log(-np.expm1(np.minimum(log_q, 0.0))) - np.log(-np.log(noise)), -np.inf)
        for p, new, before, n in zip(paths, values, along[:, -1].tolist(), some.sum(1).tolist()):
            p.values, p.before = np.concatenate([p.values, new[:n]]), before
        step = min(4 * step, max(STEP, 400_000 // len(paths)))


def _units(text: str) -> list[str]:
    if not text:
        return []
    if text[0] == " " or "  " in text or "\t" in text or SPACE in text:
        return _UNITS.findall(SPACE + text.replace(" ", SPACE))
    return list(filter(None, (SPACE + text.replace(" ", " " + SPACE)).replace("\n", " \n ").split(" ")))  # the same, sooner


def sample_group(texts: list[str], keys: list[int], k: int, v: Vocabulary, known: Units | None = None) -> list[list[tuple]]:
    """Per text its samples in order: (ids, log_prob, perturbed, inclusion); fewer than k if it has no more segmentations."""
    units, per = [], []
    for t in texts:
        own = _units(t)
        units += own
        per.append(len(own))
    known = known or Units(v)
    first = known.first(units)
    lattice = known.lattice
    del units
    per = np.array(per, np.int64)
    starts = np.cumsum(per) - per
    place = np.arange(len(first)) - np.repeat(starts, per)
    doc_key = _mix(np.array(keys, _U))
    paths: list[list[_Path]] = [[] for _ in texts]
    # What is still to be drawn this round: texts, their edges so far, and the value that the draw starts from.
    todo = [(i, _NONE, None) for i in range(len(texts)) if per[i]]
    for sample in range(k):
        if not todo:
            break
        who = np.array([x[0] for x in todo], np.int64)
        key = _mix(doc_key[who] + _U((sample + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
        # The units from the one on in which a head ends, or after it if it ends with it.
        from_, inside = starts[who].copy(), np.full(len(todo), -1, np.int64)
        for j, (_, head, _) in enumerate(todo):
            if len(head):
                from_[j] += int(lattice.ends[head].sum())
                if not lattice.ends[head[-1]]:
                    inside[j] = lattice.to[head[-1]]
        lens = starts[who] + per[who] - from_
        owner = np.repeat(np.arange(len(todo)), lens)
        at = np.repeat(from_ - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))
        nodes = first[at]
        some = np.flatnonzero(inside >= 0)
        nodes[(np.cumsum(lens) - lens)[some]] = inside[some]
        edges, count = lattice.walk(nodes, _mix(key[owner] + place[at].astype(_U) * _U(0x8CB92BA72F3D8DD7)))
        each = np.bincount(owner, weights=count, minlength=len(todo)).astype(np.int64)
        cut = np.cumsum(each) - each
        del owner, at, nodes, count
        drawn = [edges[a : a + n] if not len(x[1]) else np.concatenate([x[1], edges[a : a + n]]) for a, n, x in zip(cut.tolist(), each.tolist(), todo)]
        done = np.array([len(x[1]) for x in todo], np.int64)
        noise = key ^ _U(0x5851F42D4C957F2D)
        value = np.array([x[2] if x[2] is not None else _gumbel(_uniform_py(int(n), len(p))) for x, n, p in zip(todo, noise.tolist(), drawn)])
        for (i, head, _), new, n, x, noise_key in zip(todo, drawn, done.tolist(), value.tolist(), noise.tolist()):
            paths[i].append(_Path(new, n, x, noise_key, float(lattice.log_q[head].sum()) if n else 0.0))
        _make_values([p for i in who.tolist() for p in paths[i]], lattice)
        if sample == k - 1:
            break
        todo = []
        for i in who.tolist():
            limit, where, p = max(((*x.top(), x) for x in paths[i]), key=lambda x: x[0])
            if limit == -np.inf:
                continue
            e = int(p.edges[where])
            node = int(np.searchsorted(lattice.begin, np.int32(e), "right")) - 1
            out = p.out.setdefault(where, [e])
            rest = [x for x in range(int(lattice.begin[node]), int(lattice.begin[node + 1])) if x not in out]
            sums = list(accumulate(math.exp(x) for x in lattice.log_q[rest].tolist()))
            own = int(doc_key[i])
            pick = rest[min(bisect.bisect_right(sums, _uniform_py(own, 0x10000001 + 2 * sample) * sums[-1]), len(rest) - 1)]
            out.append(pick)
            others = [x for x in rest if x != pick]
            mass = float(lattice.log_q[p.edges[:where]].sum()) + math.log(sum(math.exp(x) for x in lattice.log_q[others].tolist())) if others else -np.inf
            p.leave(where, _cut_off(limit, mass + _gumbel(_uniform_py(own, 0x10000002 + 2 * sample))))
            todo.append((i, np.append(p.edges[:where], np.int32(pick)), limit))
        _make_values([p for i in who.tolist() for p in paths[i]], lattice)
    result: list[list[tuple]] = []
    every = [p for own in paths for p in own]
    ids = _ids([lattice.token[p.edges] for p in every], v)
    at = 0
    for i, own in enumerate(paths):
        if not per[i]:
            result.append([(np.zeros(0, np.int32), 0.0, _gumbel(_uniform_py(int(doc_key[i]), 0)), 1.0)])
            continue
        kappa = max(p.top()[0] for p in own)
        rows = []
        for p in own:
            total = float(lattice.log_q[p.edges].sum())
            rows.append((ids[at], total, p.value, 1.0 if kappa == -np.inf else -math.expm1(-math.exp(min(total - kappa, 700.0)))))
            at += 1
        result.append(rows)
    return result


def _ids(paths: list[np.ndarray], v: Vocabulary) -> list[np.ndarray]:
    """Piece ids of paths: an edge of bytes becomes theirs."""
    if not paths:
        return []
    lens = np.array([len(p) for p in paths])
    tok = np.concatenate(paths)
    under = tok < 0
    code = np.where(under, -1 - tok, 0)
    size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    ends = np.cumsum(size)
    if under.any():
        nth = np.arange(int(ends[-1])) - np.repeat(ends - size, size)
        code, under, size = np.repeat(code, size), np.repeat(under, size), np.repeat(size, size)
        tok = np.repeat(tok, np.diff(ends, prepend=0))
        code, size, nth = code[under], size[under], nth[under]
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
        bits = code >> 6 * (size - 1 - nth)
        tok[under] = v.byte_ids[np.where(nth == 0, bits | lead, 0x80 | bits & 0x3F)]
    return np.split(tok.astype(np.int32), ends[np.cumsum(lens)[:-1] - 1]) if len(lens) > 1 else [tok.astype(np.int32)]


def sample_segmentations(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", k: int = 2, seed: int = 5) -> DataFrame:
    """Up to k rows per input row: id, sample (1 the largest perturbed value), n_pieces, log_prob, perturbed, inclusion, ids, decodes.

    log_prob is the segmentation's log probability among all of its text; inclusion that of being among the k. decodes: whether
    decoding the ids gives the text back (U+2581 comes back as a blank). A null or empty text has one segmentation, of no pieces,
    as has any text with just one: it gives one row. Draws depend on seed and id only: repeated rows repeat their samples; null
    ids are a key like others. An empty table gives no rows; other columns are not read. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Units(vocabulary(path))
        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= GROUP_CHARS:
                    yield rows(b.schema.field(0).type, ids, texts, known)
                    ids, texts, size = [], [], 0
            if ids:
                yield rows(b.schema.field(0).type, ids, texts, known)
            pa.default_memory_pool().release_unused()

    def rows(kind, ids, texts, known):
        found = sample_group(texts, [xxhash.xxh64_intdigest(f"{seed}:{i!r}".encode()) for i in ids], k, known.v, known)
        cols: list[list] = [[] for _ in range(5)]
        flat, want = [], []
        for i, text, samples in zip(ids, texts, found):
            same = text.replace(SPACE, " ").encode()
            for n, (pieces, log_prob, value, inclusion) in enumerate(samples, 1):
                for c, x in zip(cols, (i, n, log_prob, value, inclusion)):
                    c.append(x)
                flat.append(pieces)
                want.append(same)
        lens = np.array([len(x) for x in flat])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)], pa.int32()), pa.array(np.concatenate(flat), pa.int32()))
        decodes = [a == b for a, b in zip(known.v.decode(lists), want)]
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], kind), pa.array(cols[1], pa.int32()), pa.array(lens, pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.float64()), lists, pa.array(decodes, pa.bool_())],
            ["id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "ids", "decodes"],
        )

    kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    out = src.mapInArrow(run, f"id {kind}, sample int, n_pieces bigint, log_prob double, perturbed double, inclusion double, ids array<int>, decodes boolean")
    return out.withColumnRenamed("id", id_col)


def decode_pieces(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """rows with a column decoded (decoded_ if they have that, and so on): the text of each row's piece ids.

    Null lists give null; null ids and ids outside the vocabulary stand for nothing but U+FFFD, as do bytes that make no
    character. Control pieces show as they are written. An empty table gives no rows. Nothing is shuffled.
    """
    at, name = rows.columns.index(ids_col), fresh(rows, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        n = len(v.pieces)
        for b in batches:
            lists = [x or [] for x in b.column(at).to_pylist()]
            odd = [any(i is None or not 0 <= i < n for i in x) for x in lists]
            plain = v.decode(pa.array([[] if bad else x for x, bad in zip(lists, odd)], pa.list_(pa.int32())))
            texts = []
            for x, bad, data, valid in zip(lists, odd, plain, b.column(at).is_valid().to_pylist()):
                if bad:
                    data = b"".join(v.shown[i].as_py() if i is not None and 0 <= i < n else "\ufffd".encode() for i in x).removeprefix(b" ")
                texts.append(data.decode("utf-8", "replace") if valid else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, StringType())]))
