"""Frequent directions: a mergeable sketch of a matrix with many rows.

A sketch B of ``size`` rows stands for all rows A seen so far.  Rows go into a buffer of
twice that many; when it is full, its singular values are shrunk by the square of the
``size``-th, which frees half of the rows.  The squares taken off add up to ``lost``, and

    0 <= |A x|^2 - |B x|^2 <= lost    for every unit vector x,
    lost <= (|A|_F^2 - |B|_F^2) / size

Two sketches merge by the same step on their rows, with ``lost`` added up, so the bound
holds for any merge order.  Every task sketches its rows in one pass; the sketches are
merged as a tree of ``FAN``.  Row count, column sums and sum of squares are kept exactly.

For dense rows of a bounded width (a sketch has ``size`` times width numbers, and one is
what the driver gets).  A null row, or a null or NaN inside one, or another width, stops
the job; an empty table gives a sketch without rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 16
KIND = "node long, n long, lost double, total double, sums array<double>, rows array<double>"


@dataclass
class Sketch:
    rows: np.ndarray  # at most size x width
    lost: float  # no direction lost more than this
    n: int
    sums: np.ndarray  # column sums
    total: float  # sum of all squares

    def covariance(self) -> np.ndarray:
        """Sample covariance of the columns; off by at most ``lost / (n - 1)`` in any direction."""
        mean = self.sums / max(self.n, 1)
        return (self.rows.T @ self.rows - self.n * np.outer(mean, mean)) / max(self.n - 1, 1)

    def pca(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(variances, directions) of the ``k`` leading components."""
        values, vectors = np.linalg.eigh(self.covariance())
        return values[::-1][:k], vectors[:, ::-1][:, :k]


def shrink(rows: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """At most ``size - 1`` rows for ``rows``, and the squares taken off each direction."""
    if len(rows) < size:
        return rows, 0.0
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    if len(s) < size:
        return s[:, None] * vt, 0.0
    off = s[size - 1] ** 2
    kept = np.sqrt(np.maximum(s[:size - 1] ** 2 - off, 0.0))
    return kept[:, None] * vt[:size - 1], float(off)


def _record(node: int, n: int, lost: float, total: float, sums: np.ndarray, rows: np.ndarray) -> pa.Table:
    many = pa.list_(pa.float64())
    return pa.table([pa.array([node], pa.int64()), pa.array([n], pa.int64()), pa.array([lost]), pa.array([total]),
                     pa.array([sums.tolist()], many), pa.array([rows.reshape(-1).tolist()], many)],
                    names=["node", "n", "lost", "total", "sums", "rows"])


def task_sketches(df: DataFrame, vector: str, size: int) -> DataFrame:
    """One sketch for each task that has rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, lost, n, total, sums = None, 0.0, 0, 0.0, None
        for batch in batches:
            column = batch.column(0)
            if not batch.num_rows:
                continue
            width = len(column[0]) if column[0].is_valid else -1
            flat = column.flatten()
            if column.null_count or flat.null_count or len(flat) != width * batch.num_rows or not (np.diff(column.offsets.to_numpy()) == width).all():
                raise ValueError("sketch: a null, or rows of different widths")
            x = flat.to_numpy().astype(float).reshape(-1, width)
            if np.isnan(x).any() or held is not None and held.shape[1] != width:
                raise ValueError("sketch: a NaN, or rows of different widths")
            held = np.zeros((0, width)) if held is None else held
            n, total, sums = n + len(x), total + float((x**2).sum()), x.sum(0) + (0 if sums is None else sums)
            for at in range(0, len(x), size):
                held, off = shrink(np.concatenate([held, x[at:at + size]]), size) if len(held) + min(size, len(x) - at) >= 2 * size else (
                    np.concatenate([held, x[at:at + size]]), 0.0)
                lost += off
        if n:
            held, off = shrink(held, size)
            yield from _record(TaskContext.get().partitionId(), n, lost + off, total, sums, held).to_batches()

    return df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, KIND)


def merged(tables: list[pa.Table], size: int, node: int) -> pa.Table:
    """One sketch for several."""
    t = pa.concat_tables(tables)
    widths = {len(s) for s in t.column("sums").to_pylist()}
    if len(widths) > 1:
        raise ValueError("sketch: rows of different widths")
    width = widths.pop()
    held, lost = np.zeros((0, width)), float(sum(t.column("lost").to_pylist()))
    for flat in t.column("rows"):
        held, off = shrink(np.concatenate([held, np.asarray(flat.values, float).reshape(-1, width)]), size)
        lost += off
    sums = np.sum([np.array(s) for s in t.column("sums").to_pylist()], axis=0)
    return _record(node, sum(t.column("n").to_pylist()), lost, float(sum(t.column("total").to_pylist())), sums, held)


def frequent_directions(df: DataFrame, vector: str, size: int = 32) -> Sketch:
    """The sketch of all rows: one pass, then a tree of merges."""
    if size < 2:
        raise ValueError("a sketch needs at least two rows")
    from ratewise.session import materialise

    level = materialise(task_sketches(df, vector, size), "sketches")
    left = level.count()
    while left > 1:
        grouped = level.withColumn("node", F.expr(f"node div {FAN}")).groupBy("node")
        level = materialise(grouped.applyInArrow(lambda key, t: merged([t], size, key[0].as_py()), KIND), "sketches")
        left = level.count()
    rows = level.collect()
    if not rows:
        return Sketch(np.zeros((0, 0)), 0.0, 0, np.zeros(0), 0.0)
    r = rows[0]
    sums = np.array(r["sums"])
    return Sketch(np.array(r["rows"]).reshape(-1, len(sums)), r["lost"], r["n"], sums, r["total"])
