"""The generalization lattice: nodes are level vectors, evaluated in batches as GROUPING SETS over the collapsed classes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: GROUPING SETS take at most 64 columns.
MAX_COLUMNS, MAX_SETS = 60, 24


class Infeasible(Exception):
    pass


class SearchLimit(Exception):
    pass


@dataclass(frozen=True)
class Found:
    levels: tuple[int, ...]
    suppressed: int
    evaluations: int
    truncated: bool


def nodes_at(height: int, tops: list[int]) -> Iterator[tuple[int, ...]]:
    """All vectors of a height, in ascending order."""
    if not tops:
        if height == 0:
            yield ()
        return
    rest = sum(tops[1:])
    for v in range(max(0, height - rest), min(tops[0], height) + 1):
        for tail in nodes_at(height - v, tops[1:]):
            yield (v, *tail)


class Lattice:
    """base: columns q{i}_{level}, n (rows), and l{j} (a sensitive value) where l > 1; already collapsed, so a node costs no pass over rows."""

    def __init__(self, base: DataFrame, tops: list[int], k: int, l: int, sensitive: int, budget: int, max_evals: int = 20_000):
        self.base, self.tops, self.k, self.l, self.sensitive, self.budget, self.max_evals = base, tops, k, l, sensitive, budget, max_evals
        self.known: dict[tuple[int, ...], int] = {}
        self.lcm = math.lcm(*tops)

    def weight(self, v) -> int:
        return sum(x * (self.lcm // t) for x, t in zip(v, self.tops))

    def bad(self):
        test = F.col("n") < self.k
        if self.l > 1:
            for j in range(self.sensitive):
                test = test | (F.col(f"d{j}") < self.l)
        return test

    def evaluate(self, nodes: list[tuple[int, ...]]) -> None:
        """Suppressed rows of each node not known yet."""
        todo = [v for v in dict.fromkeys(nodes) if v not in self.known]
        if len(self.known) + len(todo) > self.max_evals:
            raise SearchLimit()
        while todo:
            batch, columns = [], []
            while todo and len(batch) < MAX_SETS:
                more = [c for c in self._columns(todo[0]) if c not in columns]
                if batch and len(columns) + len(more) > MAX_COLUMNS:
                    break
                columns += more
                batch.append(todo.pop(0))
            distinct = [F.count_distinct(f"l{j}").alias(f"d{j}") for j in range(self.sensitive)] if self.l > 1 else []
            # A constant '*' column leaves a set, so the set of a node names its other columns; the top's is empty.
            sets = [self._columns(v) for v in batch]
            if columns:
                g = self.base.groupingSets(sets, *columns).agg(F.grouping_id(*columns).alias("g"), F.sum("n").alias("n"), *distinct)
            else:
                g = self.base.agg(F.sum("n").alias("n"), *distinct).withColumn("g", F.lit(0))
            rows = {r["g"]: r["s"] for r in g.groupBy("g").agg(F.coalesce(F.sum(F.when(self.bad(), F.col("n"))), F.lit(0)).alias("s")).collect()}
            for v, own in zip(batch, sets):
                gid = sum(1 << len(columns) - 1 - i for i, c in enumerate(columns) if c not in own)
                self.known[v] = int(rows.get(gid, 0))

    def _columns(self, v) -> list[str]:
        return [f"q{i}_{x}" for i, (x, t) in enumerate(zip(v, self.tops)) if x < t]

    def acceptable(self, v) -> bool:
        return self.known[v] <= self.budget

    def run(self) -> Found:
        """Least (weight, suppressed rows, vector) among acceptable nodes.

        The least height with an acceptable node comes by bisection (less detail never suppresses more). From there, nodes up
        to the weight of that height's best are taken by weight, lightest first, leaving out all at or below a refused node.
        """
        top = tuple(self.tops)
        self.evaluate([top])
        if not self.acceptable(top):
            raise Infeasible()
        lo, hi = 0, sum(self.tops)
        while lo < hi:
            mid = (lo + hi) // 2
            level = list(nodes_at(mid, self.tops))
            self.evaluate(level)
            lo, hi = (lo, mid) if any(map(self.acceptable, level)) else (mid + 1, hi)
        level = list(nodes_at(lo, self.tops))
        self.evaluate(level)
        key = lambda v: (self.weight(v), self.known[v], v)
        best = min(filter(self.acceptable, level), key=key)
        truncated = False
        if math.prod(t + 1 for t in self.tops) <= 200_000:
            limit = self.weight(best)
            by_weight: dict[int, list] = {}
            for h in range(lo, sum(self.tops) + 1):
                for v in nodes_at(h, self.tops):
                    if self.weight(v) <= limit:
                        by_weight.setdefault(self.weight(v), []).append(v)
            try:
                for w in sorted(by_weight):
                    refused = [v for v, s in self.known.items() if s > self.budget]
                    open_ = [v for v in by_weight[w] if not any(all(a <= b for a, b in zip(v, r)) for r in refused)]
                    self.evaluate(open_)
                    fits = [v for v in open_ if self.acceptable(v)]
                    if fits:
                        best = min([*fits, best], key=key)
                        break
            except SearchLimit:
                truncated = True
        return Found(best, self.known[best], len(self.known), truncated)
