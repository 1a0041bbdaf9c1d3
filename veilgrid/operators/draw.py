"""Reproducible draws and shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.plans.numbering import number_rows

_MASK = (1 << 64) - 1


def draw(items: DataFrame, column: str, seed: str, groups: int | None = None, size: int | None = None) -> DataFrame:
    """item, position (1 first), group (0 first): items ordered by SHA-256(seed NUL item), dealt round robin.

    With size, there are as many groups as hold all items at that size. No item may be blank.
    """
    item = F.col(column).cast("string")
    rows = items.select(item.alias("item"), F.sha2(F.concat(F.lit(bytearray(seed.encode() + b"\0")), item.cast("binary")), 256).alias("key"))
    rows = number_rows(rows, ["key", "item"], "position").drop("key")
    if size is not None:
        groups = -(-rows.count() // size)
    out = rows.select("item", "position")
    return out if groups is None else out.withColumn("group", (F.col("position") - 1) % max(1, groups))


class SplitMix64:
    """The published generator; used on the driver only."""

    def __init__(self, seed: int):
        self.state = seed & _MASK

    def next(self) -> int:
        self.state = self.state + 0x9E3779B97F4A7C15 & _MASK
        z = (self.state ^ self.state >> 30) * 0xBF58476D1CE4E5B9 & _MASK
        z = (z ^ z >> 27) * 0x94D049BB133111EB & _MASK
        return z ^ z >> 31

    def below(self, n: int) -> int:
        bound = (1 << 64) - (1 << 64) % n
        x = self.next()
        while x >= bound:
            x = self.next()
        return x % n


def permutation(n: int, seed: int) -> list[int]:
    """Of n rows, the row that each place gets (Fisher-Yates). It depends on n and seed alone."""
    order, rng = list(range(n)), SplitMix64(seed)
    for i in range(n - 1, 0, -1):
        j = rng.below(i + 1)
        order[i], order[j] = order[j], order[i]
    return order


def shuffled(rows: DataFrame, order: list, seed: int, exact: bool = True) -> DataFrame:
    """rows with place. exact: the generator's permutation, made on the driver - for outputs of up to max_rows rows, as anonymize has them.
    Otherwise places follow a keyed hash of the row's number, which scales."""
    numbered = number_rows(rows, order, "__n")
    if not exact:
        keyed = numbered.withColumn("__k", F.xxhash64(F.lit(seed), "__n"))
        return number_rows(keyed, ["__k", "__n"], "place").drop("__k", "__n")
    n = rows.count()
    places = rows.sparkSession.createDataFrame([(src + 1, at + 1) for at, src in enumerate(permutation(n, seed))], "__n bigint, place bigint")
    return numbered.join(places, "__n").drop("__n")
