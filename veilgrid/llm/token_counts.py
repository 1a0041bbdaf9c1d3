"""Token counts of a byte-level BPE by deterministic transducers whose transitions carry the number of emitted tokens.

Two machines are compiled from the tokenizer's file:

* The splitter reads symbols (character classes with one or two characters of look-ahead) in 10 states; a transition says
  whether a piece begins. A batch of texts is one symbol array, cut in chunks; each chunk's state map (the state it ends in
  for each state it may begin in) is made in lock step, the maps compose by a parallel prefix scan, and with every chunk's
  first state known all chunks are read at once again for the beginnings.
* The counter reads a piece's bytes. Its state is what greedy merging can still depend on: for each suffix of the bytes so
  far that begins a vocabulary entry, that entry's trie node, the last token before the suffix, and how many tokens ago
  that was. States are numbered and transitions (next state, tokens emitted) kept as they are met; the sum of emissions
  along a piece is its token count. A piece of more than PIECE_CHUNK bytes is cut in chunks of that length. A chunk's map
  (from the states it may begin in to the state it ends in and the tokens emitted) begins with one state, that to which the
  OVERLAP bytes before it lead, as states soon forget what is far back; the maps compose by a parallel prefix scan, which
  runs a chunk again for a state that its map has not.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the kept transitions and piece counts of one worker; what goes is computed again when met again.
MAX_TRANSITIONS, MAX_PIECES = 600_000, 400_000
CHUNK = 256
#: Bytes of a piece that one state map covers, bytes before it that guess its first state, and maps composed at once.
PIECE_CHUNK, OVERLAP, MAPS = 1024, 48, 64
#: Texts are read in batches of about so many characters.
BATCH_CHARS = 2_000_000

# Symbols: a blank is "last" if a non-blank follows it; an apostrophe before [stmd] is Q2, before re, ve or ll Q3.
_SP, _SPL, _WS, _WSL, _L, _N, _O, _Q2, _Q3, _END = range(10)
# States: fresh (a piece must begin), after U+0020, after another blank, in letters, in numbers, in others, in a contraction with 1 or 2 to come.
_FRESH, _AFTER_SP, _AFTER_WS, _IN_L, _IN_N, _IN_O, _TO1, _TO2 = range(8)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    nxt, begins = np.zeros((8, 10), np.uint8), np.zeros((8, 10), np.uint8)
    for state in range(8):
        for sym in range(10):
            if sym == _END:
                to, b = _FRESH, 0
            elif state == _TO2:
                to, b = _TO1, 0
            elif state == _TO1:
                to, b = _FRESH, 0
            elif sym in (_SP, _SPL, _WS, _WSL):
                to = _AFTER_SP if sym in (_SP, _SPL) else _AFTER_WS
                b = sym in (_SPL, _WSL) if state in (_AFTER_SP, _AFTER_WS) else 1
            else:
                to = {_L: _IN_L, _N: _IN_N}.get(sym, _IN_O)
                b = state not in (_AFTER_SP, to)
                if sym in (_Q2, _Q3) and b:
                    to = _TO1 if sym == _Q2 else _TO2
            nxt[state, sym], begins[state, sym] = to, b
    return nxt, begins


@lru_cache(1)
def _classes() -> np.ndarray:
    """Per code point _WS, _L, _N or _O; U+0020 is _SP."""
    out = np.full(0x110000, _O, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for pattern, kind in ((r"\p{L}+", _L), (r"\p{N}+", _N), (r"\s+", _WS)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind
    # One match may run across the surrogates' gap; nothing on its two sides is of one class, but keep the gap plain.
    out[0xD800:0xE000] = _O
    out[0x20] = _SP
    return out


def _symbols(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """codes: code points, with a separator after each text, where end is true."""
    sym = _classes()[codes]
    sym[end] = _END
    blank = (sym == _SP) | (sym == _WS)
    follows = np.zeros(len(sym), bool)
    follows[:-1] = ~blank[1:] & (sym[1:] != _END)
    sym[blank & follows] += 1
    q = np.flatnonzero(codes[: max(0, len(codes) - 2)] == 39)
    a, b = codes[q + 1], codes[q + 2]
    sym[q[np.isin(a, (115, 116, 109, 100))]] = _Q2
    sym[q[((b == 101) & ((a == 114) | (a == 118))) | ((a == 108) & (b == 108))]] = _Q3
    return sym


def _beginnings(sym: np.ndarray) -> np.ndarray:
    """Where pieces begin, by chunk state maps and their prefix composition."""
    nxt, begins = _splitter()
    n = -(-len(sym) // CHUNK)
    grid = np.full(n * CHUNK, _END, np.uint8)
    grid[: len(sym)] = sym
    grid = np.ascontiguousarray(grid.reshape(n, CHUNK).T)
    flat = nxt.ravel()
    maps = np.tile(np.arange(8, dtype=np.uint8), (n, 1))
    for row in grid:
        maps = flat[maps * 10 + row[:, None]]
    step = 1
    while step < n:  # maps[i] becomes the map of chunks 0 to i
        maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)])
        step *= 2
    state = np.empty(n, np.uint8)
    state[:1] = _FRESH
    state[1:] = maps[:-1, _FRESH]
    out, emit = np.empty((CHUNK, n), np.uint8), begins.ravel()
    for k, row in enumerate(grid):
        at = state * 10 + row
        out[k], state = emit[at], flat[at]
    return np.flatnonzero(out.T.ravel()[: len(sym)])


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts the tokens of texts as the library does for the tokenizer file at path (byte-level BPE with the usual split)."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or odd:
            raise ValueError(f"not a plain byte-level BPE: {odd}")
        letters = _byte_letters()
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that strip or need word ends")
        self._cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # Tokens numbered by the order in which merging can make them: bytes first, then one a merge.
        number = {c: i for i, c in enumerate(letters)}
        self.halves = [(i, i) for i in range(len(letters))]
        self.pairs: dict[tuple[int, int], int] = {}
        spelled = [bytes([letters[c]]) for c in letters]
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair = (number[a], number[b])
            if a + b in number:
                self.pairs.setdefault(pair, number[a + b])
                continue
            self.pairs[pair] = number[a + b] = len(spelled)
            self.halves.append(pair)
            spelled.append(bytes(letters[c] for c in a + b))
        # Trie: (node << 8 | byte) -> node; the token that ends at a node, or -1.
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        for token, word in enumerate(spelled):
            node = 0
            for b in word:
                key = node << 8 | b
                if (to := self.child.get(key)) is None:
                    to = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = to
            self.token_at[node] = token
        self.whole = [self._whole(t) for t in range(len(spelled))]
        self._forget()

    def _whole(self, token: int) -> bool:
        """Whether merging a token's own bytes gives that token."""
        a, b = self.halves[token]
        return a == token or self._may_follow(a, b, token)

    def _may_follow(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether merging the bytes of tokens a and b makes just these two: no merge over the border, numbered under limit, comes before theirs.

        The two tokens' merges are undone from the last to the first; a merge of the two parts that then meet must not be earlier.
        """
        while True:
            made = self.pairs.get((a, b))
            if made is not None and made < limit:
                return False
            if a > b:
                limit, a = a, self.halves[a][1]
                if a == limit:
                    limit, b = b + 1, self.halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.halves[b][0]
                if b + 1 == limit:
                    limit, a = a, self.halves[a][1]
                    if a == limit:
                        return True

    def _forget(self) -> None:
        """Start anew with no states but the first."""
        first = ((0, -1, 0),)
        self.states, self.number = [first], {first: 0}
        self.moves: dict[int, tuple[int, int]] = {}
        self.seen_pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, int] = {}

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """Compile a transition: the next state and the tokens emitted (the count of the longer prefix less the shorter's)."""
        live, best = [], None
        for node, last, ago in self.states[state]:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            live.append((to, last, ago))
            token = self.token_at[to]
            if best is None and token >= 0 and self._ends(last, token):
                best = (token, 1 - ago)
        token, emitted = best
        key = (*((n, l, a + emitted) for n, l, a in live), (0, token, 0))
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        return to, emitted

    def _ends(self, last: int, token: int) -> bool:
        if last < 0:
            return self.whole[token]
        if (known := self.seen_pairs.get((last, token))) is None:
            known = self.seen_pairs[last, token] = self.whole[token] and self._may_follow(last, token)
        return known

    def _run(self, state: int, data: bytes) -> tuple[int, int]:
        """The state that bytes lead to, and the tokens emitted."""
        moves, total = self.moves, 0
        for byte in data:
            key = state << 8 | byte
            if (move := moves.get(key)) is None:
                move = moves[key] = self._move(state, byte)
            state, emitted = move
            total += emitted
        return state, total

    def piece(self, text: str) -> int:
        if len(self.moves) > MAX_TRANSITIONS:
            self._forget()
        data = text.encode("utf-8", "surrogatepass")
        return self._run(0, data)[1] if len(data) <= PIECE_CHUNK else self._long(data)

    def _long(self, data: bytes) -> int:
        """A piece's count by the state maps of its chunks, MAPS of them at a time; between them transitions may be forgotten."""
        state, total = 0, 0
        for at in range(0, len(data), MAPS * PIECE_CHUNK):
            if len(self.moves) > MAX_TRANSITIONS:
                kept = self.states[state]
                self._forget()
                if (state := self.number.get(kept, -1)) < 0:
                    state = self.number[kept] = len(self.states)
                    self.states.append(kept)
            cuts = range(at, min(len(data), at + MAPS * PIECE_CHUNK), PIECE_CHUNK)
            first = [state, *(self._run(0, data[c - OVERLAP : c])[0] for c in cuts[1:])]
            maps = [{e: self._run(e, data[c : c + PIECE_CHUNK])} for e, c in zip(first, cuts)]
            step = 1
            while step < len(maps):  # maps[i] becomes the map of the 2 * step chunks up to i
                maps = [m if i < step else {e: self._then(x, m, data[cuts[max(0, i - step + 1)] : cuts[i] + PIECE_CHUNK]) for e, x in maps[i - step].items()} for i, m in enumerate(maps)]
                step *= 2
            state, emitted = maps[-1][state]
            total += emitted
        return total

    def _then(self, before: tuple[int, int], after: dict[int, tuple[int, int]], data: bytes) -> tuple[int, int]:
        """What a map entry leads to through the next map, that of data."""
        state, total = before
        if state not in after:
            after[state] = self._run(state, data)
        to, emitted = after[state]
        return to, total + emitted

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts; special strings count as one token and separate what is around them."""
        parts, owner, extra = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            if self._cut is not None and self._cut.search(text):
                pieces = self._cut.split(text)
                extra[i] = len(pieces) - 1
            else:
                pieces = (text,)
            parts.extend(pieces)
            owner.extend([i] * len(pieces))
        out = np.array(extra, np.int64)
        at = 0
        while at < len(parts):
            size, upto = 0, at
            while upto < len(parts) and (upto == at or size + len(parts[upto]) <= BATCH_CHARS):
                size += len(parts[upto])
                upto += 1
            np.add.at(out, owner[at:upto], self._batch(parts[at:upto]))
            at = upto
        return out.tolist()

    def _batch(self, parts: list[str]) -> np.ndarray:
        text = "\0".join(parts) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        is_end = np.zeros(len(codes), bool)
        is_end[ends] = True
        begins = _beginnings(_symbols(codes, is_end))
        stops = np.append(begins[1:], len(codes))
        which = np.searchsorted(ends, begins)
        stops = np.minimum(stops, ends[which])
        known = self.pieces
        if len(known) > MAX_PIECES:
            known = self.pieces = {}
        found = [text[a:b] for a, b in zip(begins.tolist(), stops.tolist())]
        for piece in set(found).difference(known):
            known[piece] = self.piece(piece)
            known = self.pieces  # piece() may have begun anew
        get = known.get
        each = np.array([n if (n := get(p)) is not None else self.piece(p) for p in found], np.int64)
        return np.bincount(which, weights=each, minlength=len(parts)).astype(np.int64)


@lru_cache(2)
def counter(path: str) -> Counter:
    """One a worker and file."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). Nothing is shuffled.

    Rows repeat as they come; a null text counts as empty (0 bytes, 0 tokens), a null id stays null, an empty table gives no
    rows, other columns are not read. The file must lie at path on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).counts
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = batch.column(2)
            tokens = count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.octet_length(text).cast("long").alias("n_bytes"))
    return src.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
