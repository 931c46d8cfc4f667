"""PCA and standardising of a sparse matrix in coordinate form (M26-M28): the columns are
centred and scaled implicitly, so no dense row, no dense matrix and no Gram matrix of all
columns is made, whatever their number.

With column means m, scales d and n rows, the centred matrix is B = (A - 1 m') / d.  A
product with its covariance needs the entries only:

    C v = (A'(A w) - n m (m'w)) / (d (n - 1)),   w = v / d,

because the columns of B sum to 0.  ``pca_entries`` is a block Krylov method over such
products: the blocks hold one number for each column of the matrix and of the block; only
products of b x b numbers (b = block width) reach the driver.  Rows and columns are numbered
and the entries are packed once into tiles (``operators/tiles.py``), so a row or column with
a third of all entries is spread over them and every product moves only slices of blocks
and of partial sums.  The components come from the
Gram matrices of all blocks and of their products, which are kept; no wide product is made.
"""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.operators import tiles
from ratewise.operators.matrix import _by_hash, _multiply, _names, gram, orthonormalise
from ratewise.operators.split import dense_index, join_key
from ratewise.session import materialise, one_row, remove_paths, shared_path


def column_moments(entries: DataFrame, n_rows: int) -> DataFrame:
    """(col_ix, n_entries, mean, std) of every column with an entry, absent cells as 0;
    std is the sample one.  One aggregate, combined in the tasks."""
    v, n = F.col("value"), F.lit(float(n_rows))
    s = entries.groupBy("col_ix").agg(F.count(F.lit(1)).alias("n_entries"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))
    rest = F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / n, F.lit(0.0))
    return s.select("col_ix", "n_entries", (F.col("_s") / n).alias("mean"), F.sqrt(rest / F.lit(float(max(n_rows - 1, 1)))).alias("std"))


@dataclass
class SparsePCA:
    values: np.ndarray  # variances along the components, descending
    total: float  # variance of all columns together
    components: DataFrame  # col_ix, v0 .. v{k-1}: orthonormal columns
    weights: DataFrame  # col_ix, v0 ..: components divided by the scales
    centre: np.ndarray  # mean of the rows along the components

    def shares(self) -> np.ndarray:
        return self.values / self.total if self.total else np.zeros(len(self.values))


def pca_entries(entries: DataFrame, n_rows: int, k: int, scaled: bool = False, block: int | None = None, depth: int = 8,
                seed: int = 7, tolerance: float = 1e-3) -> SparsePCA:
    """The first ``k`` principal components of the matrix (row_ix, col_ix, value) with
    ``n_rows`` rows, rows and cells without an entry counting as 0; of the correlation matrix
    with ``scaled``, where a constant column counts as 0.

    Steps go on until the leading k variances of a block change by less than ``tolerance``;
    if ``depth`` steps are not enough, a warning says so.  A matrix without entries or without
    variance has no components."""
    spark, schema = entries.sparkSession, entries.select("col_ix").schema
    scratch: list[str] = []

    def write(df: DataFrame, name: str) -> DataFrame:
        path = shared_path(spark, name)
        scratch.append(path)
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def gone(*names: str) -> None:
        """What was written under these names is not needed any more."""
        remove_paths(spark, [path for path in scratch if os.path.basename(path)[:-33] in names])

    entries = write(entries.select("row_ix", "col_ix", "value"), "pca-entries")
    moments = column_moments(entries, n_rows)
    scale = F.when(F.col("std") > 0, 1 / F.col("std")).otherwise(F.lit(0.0)) if scaled else F.lit(1.0)
    moments = materialise(moments.select("col_ix", "n_entries", "mean", scale.alias("scale"), (F.col("std") * scale).alias("std")), "moments")
    size = one_row(moments.agg(F.count(F.lit(1)).alias("d"), F.sum("n_entries").alias("e"), F.sum(F.col("std") * F.col("std")).alias("t")))
    if not size["t"]:
        none = spark.createDataFrame([], schema)
        remove_paths(spark, scratch)
        return SparsePCA(np.zeros(0), 0.0, none, none, np.zeros(0))
    b = max(1, min(block or (k + 8), int(size["d"]), n_rows))
    # A column without an id takes part in the total only; a row without one is like any other,
    # but gives nothing back to the columns.
    known = entries.where(F.col("col_ix").isNotNull())
    cols = dense_index(moments.where(F.col("col_ix").isNotNull()), "col_ix", "_c", carry=["mean", "scale"])
    rows = dense_index(known, "row_ix", "_r")
    n_cols, n_here = cols.count(), rows.count()
    nameless = 0 if not rows.where(F.col("row_ix").isNull()).isEmpty() else None  # a null comes first
    placed = join_key(join_key(known, _by_hash(rows), "row_ix"), _by_hash(cols.select("col_ix", "_c")), "col_ix")
    placed = write(placed.select(F.col("_r").alias("row_ix"), F.col("_c").alias("col_ix"), "value"), "pca-numbered")
    gone("pca-entries")
    a = tiles.pack(placed, n_here, n_cols, b)
    gone("pca-numbered")

    def weighted(v: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
        """The block divided by the scales, and the mean row along it."""
        both = write(tiles.each(tiles.beside([about, v], n_cols), lambda x: np.concatenate([x[:1], x[2:] * x[1]]), width + 2), "pca-w")
        return tiles.each(both, lambda x: x[1:], width + 1), gram(both, width + 1)[0, 1:]

    def centred(y: DataFrame, t: np.ndarray) -> np.ndarray:
        return (gram(y, len(t)) - n_rows * np.outer(t, t)) / max(n_rows - 1, 1)

    try:
        about = write(tiles.from_rows(cols, "_c", ["mean", "scale"], n_cols), "pca-about")
        start = cols.select("_c", *[((F.xxhash64("col_ix", F.lit(j), F.lit(seed)) % 2000003).cast("double") / 2000003.0).alias(x)
                                    for j, x in enumerate(_names("v", b))])
        v, b = orthonormalise(write(tiles.from_rows(start, "_c", _names("v", b), n_cols), "pca-start"), b)
        vs, ys, means, seen, settled = [], [], [], np.zeros(0), False
        for _ in range(depth):
            v = write(v, "pca-v")
            gone("pca-start", "pca-z")
            w, t = weighted(v, b)
            y = write(_multiply(a, w, "col_ix", "row_ix", "v", "y", b), "pca-y")
            gone("pca-w")
            for kept, one in ((vs, v), (ys, y), (means, t)):
                kept.append(one)
            now = np.sort(np.linalg.eigvalsh(centred(y, t)))[::-1][:k]
            settled = len(seen) == len(now) and np.allclose(seen, now, rtol=tolerance, atol=1e-12)
            if settled or sum(len(x) for x in means) >= size["d"]:
                settled = True
                break
            seen = now
            z = tiles.beside([about, _multiply(a, y, "row_ix", "col_ix", "y", "z", b, nameless)], n_cols)
            less = float(n_rows) * t[:, None]
            z = write(tiles.each(z, lambda x, less=less: (x[2:] - less * x[0]) * x[1], b + 2), "pca-z")
            v, b = orthonormalise(z, b)
        if not settled:
            warnings.warn(f"pca_entries: variances still change by more than {tolerance} after {depth} steps", stacklevel=2)
        # All blocks K; K turn has orthonormal columns, first in the span, then along the components.
        basis, t = write(tiles.beside(vs, n_cols), "pca-basis"), np.concatenate(means)
        gone("pca-v", "pca-z")
        lam, turn = np.linalg.eigh(gram(basis, len(t)))
        keep = lam > max(lam.max(), 0.0) * 1e-12
        turn = turn[:, keep] / np.sqrt(lam[keep])
        along = write(tiles.beside(ys, n_here), "pca-along")
        gone("pca-y")
        values, w = np.linalg.eigh(turn.T @ centred(along, t) @ turn)
        order = np.argsort(values)[::-1][:k]
        values, turn = np.clip(values[order], 0.0, None), turn @ w[:, order]
        names = _names("v", len(values))
        found = tiles.to_rows(tiles.combine(basis, turn), "_c", names).join(cols, "_c")
        found = materialise(found.select("col_ix", "scale", *names), "pca-components")
    finally:
        remove_paths(spark, scratch)
        a.drop()
    weights = found.select("col_ix", *[(F.col(x) * F.col("scale")).alias(x) for x in names])
    return SparsePCA(values, float(size["t"] or 0.0), found.select("col_ix", *names), weights, t @ turn)


def project_entries(entries: DataFrame, model: SparsePCA) -> DataFrame:
    """(row_ix, pc_1 .. pc_k) of every row with an entry; any other row is ``-model.centre``."""
    k = len(model.values)
    if not k:
        return entries.select("row_ix").distinct()
    p = _multiply(entries, model.weights, "col_ix", "row_ix", "v", "y", k)
    return p.select("row_ix", *[(F.col(f"y{j}") - F.lit(float(model.centre[j]))).alias(f"pc_{j + 1}") for j in range(k)])
