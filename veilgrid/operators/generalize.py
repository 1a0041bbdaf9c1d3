"""Generalization hierarchies: per quasi-identifier one label Column per level, 0 the value, the last '*'."""

from __future__ import annotations

import bisect

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTHS = (5, 10, 50, 100)
_INT = r"^[+-]?[0-9]+\z"


def _plain(x) -> str:
    return str(int(x)) if float(x) == int(x) else repr(float(x))


class Exact:
    """Any value, or a category tree: chains value -> ancestors; a short chain repeats its last ancestor; unknown: '*'."""

    def __init__(self, hierarchy: dict[str, list[str]] | None = None):
        self.chains = hierarchy or {}
        self.depth = max(map(len, self.chains.values()), default=0)
        parent: dict[tuple[int, str], str] = {}
        for value, chain in self.chains.items():
            steps = [value, *chain]
            for i, (a, b) in enumerate(zip(steps[1:], steps[2:])):
                if parent.setdefault((i, a), b) != b:
                    raise ValueError(f"{a!r} has two parents")
        self.levels = self.depth + 1

    def label(self, v: Column, level: int) -> Column:
        if level == 0:
            return v
        if level == self.levels:
            return F.lit("*")
        pairs = [x for value, chain in self.chains.items() if chain for x in (F.lit(value), F.lit(chain[min(level, len(chain)) - 1]))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), v), F.lit("*")) if pairs else F.lit("*")


class Prefix:
    """Strings of up to length characters: level n hides the last n; all of them if the string is that short."""

    def __init__(self, length: int):
        self.length, self.levels = length, length + 1

    def label(self, v: Column, level: int) -> Column:
        if level == 0:
            return v
        if level == self.levels:
            return F.lit("*")
        n = F.char_length(v)
        return F.when(v == "", "*").when(n <= level, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(v, n - level), F.lit("*" * level)))


class Date:
    """YYYY-MM-DD, then month, year, decade, '*'; anything that is no date of the calendar: '*'."""

    levels = 4

    def label(self, v: Column, level: int) -> Column:
        if level == 0:
            return v
        if level == self.levels:
            return F.lit("*")
        valid = F.when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(v, "yyyy-MM-dd")).isNotNull()
        text = {1: F.left(v, F.lit(7)), 2: F.left(v, F.lit(4)), 3: F.concat(F.left(v, F.lit(3)), F.lit("0s"))}[level]
        return F.when(valid, text).otherwise("*")


class Numeric:
    """Widths, each a larger multiple of the one before: lo-hi where all values of the column are integers or blank, else [lo,hi).

    integers: whether they are; resolve() of a column finds out.
    """

    def __init__(self, widths=WIDTHS, integers: bool | None = None):
        if any(b <= a or b % a for a, b in zip(widths, widths[1:])):
            raise ValueError("each width must be a larger multiple of the one before")
        self.widths, self.levels, self.integers = tuple(widths), len(widths) + 1, integers

    def label(self, v: Column, level: int) -> Column:
        if level == 0:
            return v
        if level == self.levels:
            return F.lit("*")
        w = self.widths[level - 1]
        if self.integers:
            x = v.try_cast("decimal(38,0)")
            lo = x - F.pmod(x, F.lit(w).cast("decimal(38,0)"))
            return F.when(v.rlike(_INT) & x.isNotNull(), F.concat(lo.cast("decimal(38,0)").cast("string"), F.lit("-"), (lo + w - 1).cast("decimal(38,0)").cast("string"))).otherwise("*")
        x = v.try_cast("double")
        lo = F.floor(x / w) * w
        good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e18)
        return F.when(good, F.concat(F.lit("["), lo.cast("string"), F.lit(","), (lo + w).cast("string"), F.lit(")"))).otherwise("*")


class Bins:
    """Own edges: below the first, between two, from the last on; '*' above."""

    levels = 2

    def __init__(self, edges, integers: bool | None = None):
        if list(edges) != sorted(set(edges)) or not edges:
            raise ValueError("edges must rise")
        self.edges, self.integers = list(edges), integers

    def label(self, v: Column, level: int) -> Column:
        if level == 0:
            return v
        if level == 2:
            return F.lit("*")
        x, e = v.try_cast("double"), self.edges
        out = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "*").when(x < e[0], f"<{_plain(e[0])}")
        for a, b in zip(e, e[1:]):
            out = out.when(x < b, f"{_plain(a)}-{_plain(b - 1)}" if self.integers else f"[{_plain(a)},{_plain(b)})")
        return out.otherwise(f"{_plain(e[-1])}+" if self.integers else f">={_plain(e[-1])}")

    def bin_of(self, x: float) -> int:
        return bisect.bisect_right(self.edges, x)


def make(settings: dict):
    """From {'type': numeric | bins | date | prefix | category | exact, ...}."""
    kind = settings.get("type", "exact")
    if kind == "numeric" and "bins" in settings:
        if "widths" in settings:
            raise ValueError("widths or bins, not both")
        return Bins(settings["bins"])
    if kind == "numeric":
        return Numeric(settings.get("widths", WIDTHS))
    if kind == "bins":
        return Bins(settings["edges"])
    if kind == "date":
        return Date()
    if kind == "prefix":
        return Prefix(settings["length"])
    if kind == "category":
        return Exact(settings["hierarchy"])
    if kind == "exact":
        return Exact()
    raise ValueError(f"unknown generalizer: {kind}")


def resolve(generalizers: list, values: list[Column], df) -> None:
    """Decide integer or decimal labels for numeric columns, all in one pass."""
    open_ = [i for i, g in enumerate(generalizers) if getattr(g, "integers", True) is None]
    if open_:
        row = df.agg(*(F.coalesce(F.bool_and((values[i] == "") | values[i].rlike(_INT)), F.lit(True)).alias(f"i{i}") for i in open_)).first()
        for i in open_:
            generalizers[i].integers = row[f"i{i}"]
