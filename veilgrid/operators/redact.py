"""Masking of personal data in texts by ordered rules, with spans and a byte-integrity check.

Matching depends on all spans before it (an earlier rule wins wherever its match lies), so a text is folded as a whole, in
Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import text as T

MODES = "alias decor delete label mosaic noise replace".split()
_VIEW = {0xFF01 + i: 0x21 + i for i in range(94)} | {ord(c): "-" for c in "‐‑‒–—―−"}
_LONG = re.compile("(?<=[0-9])[ーｰ](?=[0-9])")
_POOLS = {
    "hiragana": "あいうえおかきくけこ", "katakana": "アイウエオカキクケコ", "kanji": "山川田中村木林森石原",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789", "other": "*",
}


def _class(c: str) -> str:
    n = ord(c)
    if 0x3041 <= n <= 0x309F:
        return "hiragana"
    if 0x30A0 <= n <= 0x30FF:
        return "katakana"
    if 0x4E00 <= n <= 0x9FFF:
        return "kanji"
    if c.isascii() and c.isalnum():
        return "upper" if c.isupper() else "lower" if c.islower() else "digit"
    return "other"


@dataclass(frozen=True)
class Rule:
    """kind: literal, chars or a built-in's name; mode and its argument; word: not within a word; ci: ASCII case ignored."""

    kind: str
    pattern: str = ""
    mode: str = "label"
    arg: str = ""
    word: bool = False
    ci: bool = False

    def __post_init__(self):
        if self.mode not in MODES or self.kind not in ("literal", "chars", *BUILTINS):
            raise ValueError("unknown mode or kind")
        if self.mode == "alias" and self.kind != "literal":
            raise ValueError("an alias is of literals only")
        if self.kind in ("literal", "chars") and not self.pattern:
            raise ValueError("nothing to look for")


def _my_number(s: str) -> bool:
    *front, last = map(int, s)
    rest = sum(a * int(b) for a, b in zip(front, "65432765432")) % 11
    return last == (0 if rest < 2 else 11 - rest)


def _corporate(s: str) -> bool:
    return int(s[0]) == 9 - sum(int(d) * (1 + i % 2) for i, d in enumerate(reversed(s[1:]))) % 9


def _luhn(s: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(s))) % 10 == 0


def _runs(lengths, ok):
    rx = re.compile("[0-9]+")
    return lambda text: [m.span() for m in rx.finditer(text) if len(m[0]) in lengths and ok(m[0])]


def _regex(pattern: str):
    rx = re.compile(pattern)
    return lambda text: [m.span() for m in rx.finditer(text)]


#: name: (view, finder)
BUILTINS = {
    "email": ("view", _regex(T.EMAIL)), "postal-jp": ("view", _regex(T.POSTAL)), "phone-jp": ("digits", _regex(T.PHONE)),
    "my-number": ("view", _runs((12,), _my_number)), "corporate-number": ("view", _runs((13,), _corporate)), "card": ("view", _runs(range(13, 20), _luhn)),
}
_SIGNS = re.compile("[0-9@\uff10-\uff19\uff20]")
#: Texts that a task has in hand as Python objects: a batch is 10,000 rows, which fills up as tables grow.
ROWS = 200
DEFAULT = (Rule("email"), Rule("phone-jp"), Rule("postal-jp"))


def parse_rules(lines: str) -> list[Rule]:
    """One rule a line: `rule PATTERN:mode[:arg]` or `builtin NAME[:mode[:arg]]`; # begins a comment line; a pattern begins with + to stand as a word and ~ to ignore case."""
    out = []
    for line in lines.splitlines():
        verb, _, spec = line.strip().partition(" ")
        if verb[:1] in ("", "#"):
            continue
        parts = spec.strip().split(":")
        if verb == "rule" and len(parts) >= 2:
            p, word, ci = parts[0], False, False
            while p[:1] in ("+", "~"):
                word, ci, p = word or p[0] == "+", ci or p[0] == "~", p[1:]
            out.append(Rule("literal", p, parts[1], ":".join(parts[2:]), word, ci))
        elif verb == "builtin" and parts[0]:
            out.append(Rule(parts[0], mode=parts[1] if len(parts) > 1 else "label", arg=":".join(parts[2:])))
        else:
            raise ValueError(f"not a rule: {line}")
    return out


#: An observation catalog: what each key must be; True marks keys that may be absent.
_CATALOG = {"lens": (str, True), "version": (int, False), "observations": (list, False)}
_OBSERVATION = {"kind": (str, True), "codepoint": (str, False), "count": (int, True), "positions": (list, True), "twin": (str, True)}
CATALOG_LIMIT = 1 << 20


def _checked(obj, spec: dict, at: str) -> dict:
    """obj, if it is an object with the keys of spec alone; errors name the place by JSON Pointer."""
    if not isinstance(obj, dict):
        raise ValueError(f"{at or '/'}: not an object")
    if extra := sorted(set(obj) - set(spec)):
        raise ValueError(f"{at or '/'}: unknown key {extra[0]}")
    for key, (kind, optional) in spec.items():
        if key not in obj:
            if not optional:
                raise ValueError(f"{at}/{key}: missing")
        elif type(obj[key]) is not kind:
            raise ValueError(f"{at}/{key}: not of type {kind.__name__}")
    return obj


def _one_char(name: str, at: str) -> str:
    """U+XXXX -> the character."""
    if not re.fullmatch(r"[Uu]\+[0-9A-Fa-f]{1,6}", name) or (n := int(name[2:], 16)) > 0x10FFFF or 0xD800 <= n < 0xE000:
        raise ValueError(f"{at}: not one code point")
    return chr(n)


def catalog_rules(data: bytes) -> list[Rule]:
    """The rules of an observation catalog (JSON, 1 MiB at most): each code point once, in order; with a twin it is replaced by that, else deleted.

    Unknown keys, repeated keys, numbers that JSON has not and wrong types are refused; nothing is coerced.
    """
    if len(data) > CATALOG_LIMIT:
        raise ValueError("the catalog is larger than 1 MiB")

    def unique(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key occurs twice")
        return dict(pairs)

    def no_number(x):
        raise ValueError(f"not a number of JSON: {x}")

    doc = _checked(json.loads(data.decode(), object_pairs_hook=unique, parse_constant=no_number), _CATALOG, "")
    if doc["version"] != 1:
        raise ValueError("/version: not 1")
    found: dict[str, Rule] = {}
    for i, item in enumerate(doc["observations"]):
        at = f"/observations/{i}"
        _checked(item, _OBSERVATION, at)
        for k, place in enumerate(item.get("positions", [])):
            if type(place) is not int:
                raise ValueError(f"{at}/positions/{k}: not of type int")
        c = _one_char(item["codepoint"], f"{at}/codepoint")
        twin = _one_char(item["twin"], f"{at}/twin") if "twin" in item else None
        found.setdefault(c, Rule("chars", c, "delete") if twin is None else Rule("chars", c, "replace", twin))
    return list(found.values())


def _lower(s: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in s)


def _find(text: str, rule: Rule) -> list[tuple[int, int]]:
    if rule.kind in BUILTINS:
        how, finder = BUILTINS[rule.kind]
        seen = text.translate(_VIEW)
        return finder(_LONG.sub("-", seen) if how == "digits" else seen)
    hay, needle = (_lower(text), _lower(rule.pattern)) if rule.ci else (text, rule.pattern)
    if rule.mode == "alias":
        hay, needle = hay.translate(_VIEW), needle.translate(_VIEW)
    if rule.kind == "chars":
        return [(i, i + 1) for i, c in enumerate(hay) if c in needle]
    out, at = [], hay.find(needle)
    while at >= 0:
        end = at + len(needle)
        if not (rule.word and (_joined(text, at) or _joined(text, end))):
            out.append((at, end))
            at = hay.find(needle, end)
        else:
            at = hay.find(needle, at + 1)
    return out


def _joined(text: str, border: int) -> bool:
    """Whether the characters at both sides of a border make one word."""
    if not 0 < border < len(text):
        return False
    a, b = text[border - 1], text[border]
    x, y = _class(a), _class(b)
    return (x == y and x != "other") or (x in ("upper", "lower", "digit") and y in ("upper", "lower", "digit"))


def resolve(text: str, rules) -> list[tuple[int, int, int]]:
    """start, end, rule number: rules in order, a match that overlaps one already taken is dropped, touching is allowed; by place."""
    if not _SIGNS.search(text):  # every built-in needs one of these
        rules = [rule if rule.kind not in BUILTINS else None for rule in rules]
    taken: list[tuple[int, int, int]] = []
    for k, rule in enumerate(rules):
        if rule is None:
            continue
        new = []
        for a, z in _find(text, rule):
            i = bisect.bisect_left(taken, (a, a, -1))
            if not ((i < len(taken) and taken[i][0] < z) or (i and taken[i - 1][1] > a)):
                new.append((a, z, k))
        taken = sorted(taken + new)
    return taken


def _noise(rule: Rule, text: str, a: int, z: int, offset: int) -> str:
    seed, out = rule.pattern if rule.kind == "literal" else rule.kind if rule.kind != "chars" else f"chars:{rule.pattern}", []
    for c in text[a:z]:
        pool = _POOLS[_class(c)]
        out.append(pool[hashlib.sha256(f"{seed}:{offset}:{c}".encode()).digest()[0] % len(pool)])
        offset += len(c.encode())
    return "".join(out)


def apply(text: str, rules=DEFAULT) -> tuple[str, list[dict]]:
    """The masked text and its spans: rule, kind, mode, start and end as UTF-8 byte offsets, sha256 of what was there, replacement."""
    spans, out, at, n, names = [], [], 0, 0, {}
    offset = 0
    for a, z, k in resolve(text, rules):
        rule = rules[k]
        gap = text[at:a]
        offset += len(gap.encode())
        what = text[a:z]
        if rule.mode in ("label", "alias"):
            mark = (rule.arg or "[REDACTED]", what if rule.mode == "alias" else a)
            if rule.mode == "label" or mark not in names:
                n += 1
                names[mark] = n
            new = f"{mark[0]}{names[mark]}"
        else:
            new = {"delete": "", "mosaic": "█" * (z - a), "replace": rule.arg, "decor": f"{rule.arg or '...'}{what}{rule.arg or '...'}"}[rule.mode] if rule.mode != "noise" else _noise(rule, text, a, z, offset)
        size = len(what.encode())
        spans.append({"rule": k, "kind": rule.kind, "mode": rule.mode, "start": offset, "end": offset + size, "sha256": hashlib.sha256(what.encode()).hexdigest(), "replacement": new})
        out += [gap, new]
        at, offset = z, offset + size
    return "".join([*out, text[at:]]), spans


def intact(before: bytes, after: bytes, spans: list[dict]) -> bool:
    """Whether all bytes outside the spans are those of the text before."""
    at = to = 0
    for s in spans:
        gap = before[at : s["start"]]
        if after[to : to + len(gap)] != gap:
            return False
        to += len(gap)
        new = s["replacement"].encode()
        if after[to : to + len(new)] != new:
            return False
        at, to = s["end"], to + len(new)
    return after[to:] == before[at:]


_SPAN = "array<struct<rule:int,kind:string,mode:string,start:int,end:int,sha256:string,replacement_length:int>>"


def redact(docs: DataFrame, id_col: str, text_col: str, rules=DEFAULT) -> DataFrame:
    """id, masked, spans, intact; null texts count as empty."""
    kind = dict(docs.dtypes)[id_col]
    struct = pa.list_(pa.struct([("rule", pa.int32()), ("kind", pa.string()), ("mode", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("sha256", pa.string()), ("replacement_length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            masked, spans, ok = [], [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                new, found = apply(t, rules)
                masked.append(new)
                ok.append(intact(t.encode(), new.encode(), found))
                spans.append([{**{k: s[k] for k in ("rule", "kind", "mode", "start", "end", "sha256")}, "replacement_length": len(s["replacement"].encode())} for s in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(masked, pa.string()), pa.array(spans, struct), pa.array(ok, pa.bool_())], ["id", "masked", "spans", "intact"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, f"id {kind}, masked string, spans {_SPAN}, intact boolean").withColumnRenamed("id", id_col)


def mode_counts(redacted: DataFrame) -> DataFrame:
    """mode, n over all spans."""
    return redacted.select(F.explode("spans").alias("s")).groupBy(F.col("s.mode").alias("mode")).agg(F.count("*").alias("n"))


def residue(redacted: DataFrame, patterns: list[str], id_col: str) -> DataFrame:
    """id, found: whether a masked text still shows any of the patterns."""
    some = F.lit(False)
    for p in patterns:
        some = some | F.contains("masked", F.lit(p))
    return redacted.select(id_col, some.alias("found"))
