"""KMeans for many k and seeds at once.

Every pass over the points serves all configurations: a task assigns its points to the
centres of each configuration and returns moments per cluster (count, sums, sum of
squares, cost), which one aggregate adds up.  A sweep of 30 fits so scans the points once
for each round, not once for each round of each fit.

Starts are k-means++ by an exponential race: a point's key is ``-ln(u) / d^2`` with ``u``
from a hash of its coordinates, the seed and the step, and the least key wins, which draws
in proportion to ``d^2`` in one pass and is the same under any partitioning.  Equal points
share a key, so they count once in the draw.  The start of a seed for k centres is the
beginning of its start for more.

Only centres and moments reach the driver: bounded by the configurations and their k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.session import materialise


@dataclass
class Fit:
    k: int
    seed: int
    centres: np.ndarray  # (k, d); fewer rows where there are fewer distinct points
    counts: np.ndarray | None = None
    sums: np.ndarray | None = None
    squares: np.ndarray | None = None
    cost: float = 0.0
    rounds: int = 0
    settled: bool = False


@dataclass
class Sweep:
    fits: list[Fit]
    scans: int  # passes over the points
    origin: np.ndarray  # the mean, which all computing is relative to
    cols: tuple[str, ...] = ()
    points: DataFrame | None = None

    def best(self) -> list[Fit]:
        """The fit of least cost for each k (ties: the lower seed)."""
        ks = sorted({f.k for f in self.fits})
        return [min((f for f in self.fits if f.k == k), key=lambda f: (f.cost, f.seed)) for k in ks]


def _points(batch: pa.RecordBatch, origin: np.ndarray) -> np.ndarray:
    x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
    if np.isnan(x).any():
        raise ValueError("a point without a coordinate: filter such rows first")
    return x - origin


def _scan(points: DataFrame, work: Callable[[Iterator[np.ndarray]], Iterator[pa.RecordBatch]], kind: str, origin: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(_points(b, origin) for b in batches if b.num_rows)

    return points.mapInArrow(run, kind)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _uniform(x: np.ndarray, seed: int, step: int) -> np.ndarray:
    """Numbers in (0, 1) from the points' coordinates."""
    h = np.full(len(x), (seed * 1_000_003 + step) & (1 << 64) - 1, np.uint64)
    for j in range(x.shape[1]):
        h = _mixed(_mixed(h) + np.ascontiguousarray(x[:, j] + 0.0).view(np.uint64))
    return (_mixed(h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) / 2.0**53 + 2.0**-54


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None, :, :]) ** 2).sum(2)


def starts(points: DataFrame, k: int, seeds: tuple[int, ...], origin: np.ndarray) -> dict[int, np.ndarray]:
    """``k`` starting centres for each seed, one pass for each centre."""
    d = len(origin)
    found = {s: np.zeros((0, d)) for s in seeds}
    for step in range(k):
        now = dict(found)

        def race(chunks: Iterator[np.ndarray], step=step, now=now) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, list[float]]] = {}
            for x in chunks:
                for s, centres in now.items():
                    far = _distances(x, centres).min(1) if len(centres) else np.ones(len(x))
                    key = np.where(far > 0, -np.log(_uniform(x, s, step)) / np.where(far > 0, far, 1.0), np.inf)
                    i = int(np.argmin(key))  # only equal points have equal keys
                    if np.isfinite(key[i]):
                        best[s] = min(best.get(s, (np.inf, [])), (float(key[i]), x[i].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array([v[0] for v in best.values()], pa.float64()),
                                              pa.array([v[1] for v in best.values()], pa.list_(pa.float64()))], names=["seed", "key", "x"])

        drawn = _scan(points, race, "seed long, key double, x array<double>", origin)
        for row in drawn.groupBy("seed").agg(F.min(F.struct("key", "x")).alias("best")).collect():
            found[row["seed"]] = np.vstack([found[row["seed"]], row["best"]["x"]])
    return found


def moments(points: DataFrame, fits: list[Fit], origin: np.ndarray) -> list[dict[int, np.ndarray]]:
    """For each fit and cluster: count, cost, sum of squares and coordinate sums; one pass."""
    centres = [f.centres for f in fits]
    d = len(origin)

    def work(chunks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(c), 3 + d)) for c in centres]
        for x in chunks:
            square = (x**2).sum(1)
            for t, c in zip(total, centres, strict=True):
                far = _distances(x, c)
                at = far.argmin(1)
                cells = np.concatenate([np.ones((len(x), 1)), far[np.arange(len(x)), at][:, None], square[:, None], x], axis=1)
                for j in range(3 + d):
                    t[:, j] += np.bincount(at, cells[:, j], len(c))
        rows = [(i, j, t[j].tolist()) for i, t in enumerate(total) for j in range(len(t)) if t[j, 0]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                          pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["fit", "cluster", "m"])

    parts = _scan(points, work, "fit int, cluster int, m array<double>", origin)
    sums = parts.groupBy("fit", "cluster").agg(*[F.sum(F.col("m")[j]).alias(f"m{j}") for j in range(3 + d)])
    out: list[dict[int, np.ndarray]] = [{} for _ in fits]
    for row in sums.collect():
        out[row["fit"]][row["cluster"]] = np.array(row[2:], float)
    return out


def sweep(df: DataFrame, ks=(4, 5, 6, 7, 8), seeds=(1, 2, 3, 4, 5, 6), cols=("longitude", "latitude"), max_iter: int = 20,
          tolerance: float = 1e-4, given: list[Fit] | None = None) -> Sweep:
    """All fits together.  ``given`` fits (centres in the columns' own units)
    replace the drawn starts.  A cluster that loses all points keeps its centre."""
    points = materialise(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), "sweep-points")
    mean = points.agg(*[F.avg(c).alias(c) for c in cols]).collect()[0]
    if mean[0] is None:
        return Sweep([], 1, np.zeros(len(cols)), tuple(cols))
    origin, scans = np.array([float(v) for v in mean]), 1
    if given is None:
        first = starts(points, max(ks), tuple(seeds), origin)
        scans += max(ks)
        fits = [Fit(k, s, first[s][:k]) for k in ks for s in seeds]
    else:
        fits = [Fit(f.k, f.seed, np.asarray(f.centres, float) - origin) for f in given]
    for turn in range(max_iter + 1):
        active = [f for f in fits if not f.settled] if turn < max_iter else fits
        active = active or fits
        found = moments(points, active, origin)
        scans += 1
        for f, m in zip(active, found, strict=True):
            f.counts, f.sums, f.squares = np.zeros(len(f.centres)), np.zeros_like(f.centres), np.zeros(len(f.centres))
            for j, v in m.items():
                f.counts[j], f.squares[j], f.sums[j] = v[0], v[2], v[3:]
            f.cost = float(sum(v[1] for v in m.values()))
        if turn == max_iter or all(f.settled for f in fits):
            break
        for f in active:
            seen = f.counts > 0
            new = f.centres.copy()
            new[seen] = f.sums[seen] / f.counts[seen, None]
            f.settled = bool(np.sqrt(((new - f.centres) ** 2).sum(1)).max(initial=0.0) <= tolerance)
            f.centres, f.rounds = new, f.rounds + 1
    for f in fits:
        f.settled = True
    return Sweep(fits, scans, origin, tuple(cols), points)


def _silhouettes(x: np.ndarray, f: Fit) -> np.ndarray:
    """Per point, with squared distances, from the clusters' moments."""
    there = f.counts > 0
    n, centre, spread = f.counts[there], f.sums[there] / f.counts[there, None], f.squares[there] / f.counts[there]
    own = np.flatnonzero(there)
    at = np.searchsorted(own, _distances(x, f.centres)[:, own].argmin(1)) if len(own) == len(there) else _distances(x, f.centres[own]).argmin(1)
    mean = np.maximum((x**2).sum(1)[:, None] + spread[None, :] - 2.0 * x @ centre.T, 0.0)
    rows = np.arange(len(x))
    a = mean[rows, at] * n[at] / np.maximum(n[at] - 1, 1)
    mean[rows, at] = np.inf
    b = mean.min(1)
    most = np.maximum(a, b)
    return np.where((n[at] > 1) & np.isfinite(b) & (most > 0), (b - a) / np.where(most > 0, most, 1.0), 0.0)


def mean_silhouettes(result: Sweep, fits: list[Fit]) -> list[float]:
    """M16 of several fits in one more pass over the points."""
    def work(chunks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(fits)), 0
        for x in chunks:
            n += len(x)
            total += [float(_silhouettes(x, f).sum()) for f in fits]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(fits)), pa.int32()), pa.array(total), pa.array([n] * len(fits), pa.int64())], names=["fit", "s", "n"])

    parts = _scan(result.points, work, "fit int, s double, n long", result.origin)
    rows = parts.groupBy("fit").agg((F.sum("s") / F.sum("n")).alias("s")).collect()
    found = {r["fit"]: float(r["s"]) for r in rows}
    return [found.get(i, 0.0) for i in range(len(fits))]


def sweep_report(df: DataFrame, ks=(4, 5, 6, 7, 8), seeds=(1, 2, 3, 4, 5, 6), cols=("longitude", "latitude")) -> DataFrame:
    """(k, seed, cost, silhouette) of the best seed of each k."""
    done = sweep(df, ks, seeds, cols)
    best = done.best()
    values = mean_silhouettes(done, best) if best else []
    rows = [(f.k, f.seed, f.cost, s) for f, s in zip(best, values, strict=True)]
    return df.sparkSession.createDataFrame(rows, "k int, seed int, cost double, silhouette double")


def point_silhouette(assigned: DataFrame, cluster: str = "cluster_name", cols=("longitude", "latitude"), name: str = "silhouette") -> DataFrame:
    """M16 per point: ``assigned`` plus each row's own silhouette (squared distances).

    The clusters' moments are one array (a scalar subquery of k rows), so points aren't
    shuffled or paired.  Coordinates are taken relative to their mean, which keeps small
    distances exact at large coordinates."""
    rel = [F.col(c).cast("double") - assigned.agg(F.avg(c)).scalar() for c in cols]
    x = assigned.withColumn("_x", F.array(*rel))
    square = sum((F.col("_x")[j] * F.col("_x")[j] for j in range(len(cols))), F.lit(0.0))
    own = x.groupBy(F.col(cluster).alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(square).alias("q"), F.array(*[F.avg(F.col("_x")[j]) for j in range(len(cols))]).alias("m"))
    all_ = own.agg(F.collect_list(F.struct("c", "n", "q", "m"))).scalar()

    def mean(r):
        return F.greatest(square + r["q"] - 2.0 * sum((F.col("_x")[j] * r["m"][j] for j in range(len(cols))), F.lit(0.0)), F.lit(0.0))

    mine = F.filter("_all", lambda r: r["c"] == F.col(cluster))[0]
    x = x.withColumn("_all", all_).withColumn("_n", mine["n"])
    x = x.withColumn("_a", mean(mine) * F.col("_n") / F.greatest(F.col("_n") - 1, F.lit(1)))
    x = x.withColumn("_b", F.array_min(F.transform(F.filter("_all", lambda r: r["c"] != F.col(cluster)), mean)))
    most = F.greatest("_a", "_b")
    value = F.when((F.col("_n") > 1) & F.col("_b").isNotNull() & (most > 0), (F.col("_b") - F.col("_a")) / most).otherwise(F.lit(0.0))
    return x.withColumn(name, value).drop("_x", "_all", "_n", "_a", "_b")
