"""Quality scores by Bradley-Terry ranking.

A document's worth is linear in features of its whole text; of a preferred and a rejected document the first wins with the
logistic probability of the difference of their worths. The weights are fitted by Newton's method on the logistic loss of all
pairs of a preferred and a rejected labelled row. A row's part in the loss of its pairs depends on its worth and the other
kind's worths alone, so no pair is made: those worths are counted in bins of about 1/128, each taken at its mean (which changes
the sums by some 1e-6 of them), and rows are weighed by the sums over bins. The pairs' cross terms in the second derivatives,
which decide on the number of steps alone, come from COARSE bins. The threshold is the quantile of all labelled rows' worths at
the rejected share; the score is the logistic value of worth less threshold, moved so that the threshold scores CUT.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import drop_folder, shared_folder, stored

CUT = 0.3
#: Bins of worths for the cross terms; parts in which sums pass between tasks; labels (16 bytes each) up to which they are broadcast.
COARSE, PARTS, SENT = 128, 64, 1_000_000
_STATS = 14
N_FEATURES = 256 + _STATS


def features(text: str | None) -> np.ndarray:
    """Byte frequencies (log-scaled) and shape statistics of a whole text; an empty text has its own, constant, features."""
    data = (text or "").encode()
    n = len(data)
    out = np.zeros(N_FEATURES, np.float32)
    if not n:
        return out
    freq = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    out[:256] = np.log1p(freq * 1000)
    words = data.split()
    lines = [x for x in (y.strip() for y in data.split(b"\n")) if x]
    w, k = max(1, len(words)), max(1, len(lines))
    upper, digit = freq[65:91].sum(), freq[48:58].sum()
    letter = upper + freq[97:123].sum() + freq[128:].sum()
    mark = freq[33:48].sum() + freq[58:65].sum() + freq[91:97].sum() + freq[123:127].sum()
    seen = len(set(words)) / w
    kinds = len({x.lower() for x in lines}) / k
    ends = sum(x[-1:] in b".!?" for x in lines) / k
    mean = n / w
    short = sum(map(len, lines)) / k
    out[256:] = (np.log1p(n), np.log1p(w), mean / 10, seen, kinds, ends, np.log1p(short), upper, digit, letter, mark, upper / (letter + 1e-3), np.log1p(1000 * mark), mark * mark)
    return out


def feature_rows(column) -> np.ndarray:
    return np.stack([features(t.as_py()) for t in column]) if len(column) else np.zeros((0, N_FEATURES), np.float32)


@dataclass(frozen=True)
class Ranking:
    """Fixed-size: two numbers a feature and a threshold."""

    weights: np.ndarray
    middle: np.ndarray
    threshold: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return (x - self.middle) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.worth(x) - self.threshold + np.log(CUT / (1 - CUT)), -500, 500)))


def _minimum(of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], k: int, ridge: float) -> np.ndarray:
    """Newton's method: of gives the first and second derivatives of a loss of k weights, to which ridge / 2 * v v is added."""
    v = np.zeros(k)
    for _ in range(25):
        first, second = of(v)
        step = np.linalg.solve(second + ridge * np.eye(k), -first - ridge * v)
        v += step
        if np.abs(step).max() < 1e-4:
            break
    return v


def newton(d: np.ndarray, ridge: float) -> np.ndarray:
    """The weights of least logistic loss over rows of feature differences, log(1 + exp(-d v)) on average and ridge / 2 * v v."""

    def of(v):
        p = 1 / (1 + np.exp(np.clip(d @ v, -500, 500)))
        return -d.T @ p / len(d), (d.T * (p * (1 - p))) @ d / len(d)

    return _minimum(of, d.shape[1], ridge)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def _summed(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of the vectors that of gives for each batch of (x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            if b.num_rows:
                part = of(_matrix(b.column(0)), b.column(1).to_numpy())
                out = part if out is None else out + part
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in np.array_split(out, PARTS)], pa.binary())], ["part", "sum"])

    def add(key, t):
        total = np.sum([np.frombuffer(x) for x in sorted(t["sum"].to_pylist())], 0)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sum": pa.array([total.tobytes()], pa.binary())})

    found = rows.select("x", "y").mapInArrow(run, "part int, sum binary").groupBy("part").applyInArrow(add, "part int, sum binary").collect()
    return np.concatenate([np.frombuffer(r["sum"]) for r in sorted(found, key=lambda r: r["part"])]) if found else np.zeros(0)


def _bin_of(worth: np.ndarray) -> np.ndarray:
    """Bins of 1/128 around 0, wider in proportion where worths are far above 16."""
    return np.floor(2048 * np.arcsinh(worth / 16)).astype(np.int64)


def _bins(rows: DataFrame, worth: Callable[[np.ndarray], np.ndarray]) -> dict[str, np.ndarray]:
    """By bin and y: rows, their mean worth, the least and the largest, in order of bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = worth(_matrix(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(_bin_of(s)), b.column(1), pa.array(s)], ["bin", "y", "s"])

    found = rows.select("x", "y").mapInArrow(run, "bin bigint, y int, s double").groupBy("bin", "y").agg(F.count("*").alias("n"), F.avg("s").alias("mean"), F.min("s").alias("low"), F.max("s").alias("high"))
    return {c: x.to_numpy() for c, x in zip(["bin", "y", "n", "mean", "low", "high"], found.toArrow().sort_by([("bin", "ascending"), ("y", "ascending")]).columns)}


def _pair_sums(own: np.ndarray, mean: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each worth of own: the sums over the other kind's bins of p, the probability that it loses against them, and of p (1 - p)."""
    p1, p2 = np.zeros(len(own)), np.zeros(len(own))
    for a in range(0, len(own), 256):
        p = 1 / (1 + np.exp(np.clip(own[a : a + 256, None] - mean[None, :], -500, 500)))
        p1[a : a + 256], p2[a : a + 256] = p @ n, (p * (1 - p)) @ n
    return p1, p2


def _all_pairs(rows: DataFrame, middle: np.ndarray, scale: np.ndarray):
    """The derivatives of the mean logistic loss over all pairs of a preferred and a rejected row of rows, as _minimum takes them."""
    k = len(middle)

    def of(v):
        bins = _bins(rows, lambda x: ((x - middle) * scale) @ v)
        side = [bins["y"] == y for y in (0, 1)]
        mean, n = ([bins[c][at].astype(float) for at in side] for c in ("mean", "n"))
        bad, good = _pair_sums(-mean[0], -mean[1], n[1]), _pair_sums(mean[1], mean[0], n[0])
        weights = [(mean[0], *bad), (mean[1], *good)]
        # Coarse bins of about as many fine ones each.
        cuts = np.unique(bins["mean"][np.linspace(0, len(bins["mean"]) - 1, COARSE).astype(int)])[1:]
        room = len(cuts) + 1

        def part(x, y):
            x = (x - middle) * scale
            s, first, second, groups = x @ v, np.zeros(k), np.zeros((k, k)), np.zeros((2, room, k + 2))
            for kind in (0, 1):
                own, at = x[y == kind], s[y == kind]
                order = np.argsort(weights[kind][0])
                p1, p2 = (np.interp(at, weights[kind][0][order], w[order]) for w in weights[kind][1:])
                first += (1 - 2 * kind) * (p1 @ own)
                second += (own.T * p2) @ own
                np.add.at(groups[kind], np.searchsorted(cuts, at, "right"), np.c_[own, at, np.ones(len(at))])
            return np.concatenate([first, second.ravel(), groups.ravel()])

        total, pairs = _summed(rows, part), float(n[0].sum() * n[1].sum())
        first, second, groups = total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k :].reshape(2, room, k + 2)
        at = groups[:, :, k] / np.maximum(groups[:, :, k + 1], 1)
        p = 1 / (1 + np.exp(np.clip(at[1][:, None] - at[0][None, :], -500, 500)))
        cross = groups[1][:, :k].T @ (p * (1 - p)) @ groups[0][:, :k]
        return first / pairs, (second - cross - cross.T) / pairs

    return of


def _quantile(rows: DataFrame, worth: Callable[[np.ndarray], np.ndarray], share: float) -> float:
    """The quantile of all rows' worths, as np.quantile gives it: only the bins that it lies in are looked into."""
    bins = _bins(rows, worth)
    ends = np.cumsum(bins["n"])
    place = share * (int(ends[-1]) - 1)

    def run(batches: Iterator[pa.RecordBatch], which: int = 0) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = worth(_matrix(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(s[_bin_of(s) == which])], ["s"])

    def nth(i: int) -> float:
        which = int(bins["bin"][np.searchsorted(ends, i, "right")])
        at = bins["bin"] == which
        if bins["low"][at].min() == bins["high"][at].max():
            return float(bins["low"][at][0])
        found = rows.select("x").mapInArrow(lambda batches: run(batches, which), "s double").groupBy("s").count().toArrow().sort_by("s")
        return float(found["s"].to_numpy()[np.searchsorted(np.cumsum(found["count"].to_numpy()), i - int(bins["n"][bins["bin"] < which].sum()), "right")])

    low = nth(int(place))
    return low if place == int(place) else low + (nth(int(place) + 1) - low) * (place - int(place))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", ridge: float = 1e-3) -> Ranking:
    """Fit on all labelled rows for which usable (over labels) holds, and all pairs of them; a fixed size reaches the driver.

    Labels other than 0 and 1 and null ids are left out; an id labelled both ways counts as rejected; of documents that repeat an
    id one is looked at (that of the least features). No labels or no documents: every document scores alike, as good. With one
    kind only nothing is preferred: every document scores alike, as that kind. Features of labelled rows are stored meanwhile.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "quality")
    chosen = labels.where(usable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = feature_rows(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), b.column(2)], ["id", "x", "y"])

    kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen) if chosen.count() <= SENT else chosen, "id").select("id", "t", "y")
    rows = stored(src.mapInArrow(run, f"id {kind}, x binary, y int").groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y")).select("x", "y"), "rows", folder)
    sums = _summed(rows, lambda x, y: np.r_[len(x), y.sum(), x.sum(0)])
    n, good = (int(x) for x in sums[:2]) if len(sums) else (0, 0)
    middle = sums[2:] / n if n else np.zeros(N_FEATURES)
    if good in (0, n):
        drop_folder(spark, folder)
        return Ranking(np.zeros(N_FEATURES), middle, 0.0 if good or not n else 1.0)
    spread = np.sqrt(_summed(rows, lambda x, y: ((x - middle) ** 2).sum(0)) / n)
    scale = np.where(spread > 1e-6, 1 / np.maximum(spread, 1e-6), 0.0)
    model = Ranking(_minimum(_all_pairs(rows, middle, scale), N_FEATURES, ridge) * scale, middle, 0.0)
    threshold = _quantile(rows, model.worth, (n - good) / n)
    drop_folder(spark, folder)
    return Ranking(model.weights, middle, threshold)


def quality_scores(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1), predicted (1 if score >= CUT). Nothing is shuffled.

    Null texts count as empty, and empty texts get the score of their (constant) features; repeated rows score alike; null ids
    are kept; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(feature_rows(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())], ["id", "score", "predicted"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Ranking, text_col: str = "text") -> DataFrame:
    """The rows of docs that score CUT or more, whole and in their own columns; nothing is shuffled.

    Nulls, empty texts and repeated rows count as in quality_scores; a score of just CUT stays; an empty table gives no rows.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(feature_rows(b.column(at))) >= CUT))

    return docs.mapInArrow(run, docs.schema)
