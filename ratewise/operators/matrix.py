"""Rating-matrix analysis.

The business x user rating matrix is kept in coordinate form
``(row_ix, col_ix, value)``: a missing cell is an implicit 0, so the dense
grid is never materialised and no cross join is planned.

Truncated SVD is a randomized block Krylov method over those entries.  One
multiplication ``A @ V`` sends the slices of the (n_cols x b) block to the tiles
of entries and adds up the slices that they return (``operators/tiles.py``);
``A.T @ Q`` is the mirror image.
Only b x b Gram matrices (b = k + oversampling) reach the driver, where the
orthonormalisation and the final Rayleigh-Ritz step are tiny eigenproblems.
Each block is checkpointed to the shared folder, so lineage stays short and a
lost executor only recomputes one step.  The last step needs no product of its own:
``A.T`` times every block was formed on the way, and its Gram matrix is enough.
"""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratewise.operators import tiles
from ratewise.operators.split import dense_index, join_key, numbered
from ratewise.session import materialise, remove_paths, shared_path

MANY_KEYS = 200_000  # keys of an index that is joined by hash, not broadcast
HEAVY = 200_000  # rows of a key whose list is numbered by a global sort


# ---------------------------------------------------------------- sparse rows and entries

def rating_entries(df: DataFrame, row_key: str = "business_id", col_key: str = "user_id",
                   value: str = "stars") -> DataFrame:
    """Coordinate entries of the rating matrix.

    Rows are businesses (index ascending), columns users with ids descending;
    a pair rated twice keeps its maximum (deterministic); absent pairs are 0.
    Null keys are a row or column of their own.  Both indices are built from the
    pairs, which are fewer than the ratings."""
    e = materialise(df.groupBy(row_key, col_key).agg(F.max(value).cast("double").alias("value")), "pairs")
    rows, cols = _by_hash(dense_index(e, row_key, "row_ix")), _by_hash(dense_index(e, col_key, "col_ix", descending=True))
    j = join_key(join_key(e, cols, col_key), rows, row_key)
    return j.select(row_key, col_key, "row_ix", "col_ix", "value")


def _by_hash(index: DataFrame) -> DataFrame:
    """An index too large to broadcast is joined by hash: one row a key, so that a task's share
    is small whatever the skew, and the entries needn't be sorted for it."""
    return index.hint("shuffle_hash") if index.count() > MANY_KEYS else index


def rows_by_item(df: DataFrame, key: str = "business_id", item: str = "user_id", value: str = "stars", among: DataFrame | None = None) -> DataFrame:
    """A10 + T3: the row list of every key as rows (key, position, item, value), items descending.

    Most keys are short: their rows meet in one task, sorted once.  The rows of a key with
    more than ``HEAVY`` of them are numbered by a global range sort, so that a key of any size
    spreads over many tasks; there the position is the number minus the key's first number.
    Rows are counted in ``among``, a stored table with at least as many of each key, if ``df``
    is costly to go through twice."""
    order = [F.col(key).asc_nulls_first(), F.col(item).desc_nulls_last(), F.col(value).desc_nulls_last()]
    every = df.select(key, item, value)
    heavy = materialise(heavy_keys(every if among is None else among, key), "heavy-rows").select(key)
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order[1:])).cast("long") - 1
    if heavy.isEmpty():
        return every.select(key, at.alias("position"), item, value)
    every = materialise(every, "rows")
    # Few keys (the rows divided by HEAVY, at most), so broadcast is safe.
    light = join_key(every, F.broadcast(heavy), key, "left_anti").select(key, at.alias("position"), item, value)
    rows = numbered(join_key(every, F.broadcast(heavy), key, "left_semi"), order, "_at")
    first = rows.groupBy(key).agg(F.min("_at").alias("_first"))
    long = join_key(rows, F.broadcast(first), key).select(key, (F.col("_at") - F.col("_first")).alias("position"), item, value)
    return light.unionByName(long)


def row_blocks(rows: DataFrame, key: str, item: str, value: str, size: int = 1000) -> DataFrame:
    """Row lists as arrays: (key, block, pairs), where block ``b`` holds positions
    ``b * size`` to ``(b + 1) * size - 1``, so no array has more than ``size`` pairs."""
    block = F.floor(F.col("position") / size).cast("long")
    packed = rows.groupBy(key, block.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("position", item, value))).alias("_p"))
    return packed.select(key, "block", F.transform("_p", lambda x: F.struct(x[item], x[value])).alias("pairs"))


def pivot_ratings(df: DataFrame, row_key: str, col_key: str, values: list, value: str = "stars",
                  agg: str = "max", fill=0) -> DataFrame:
    """One column per listed value of ``col_key``, aggregated, nulls filled.

    The list is required, so no discovery job runs; a value that isn't listed
    stops the query instead of vanishing."""
    fn = {"max": F.max, "count": F.count, "sum": F.sum, "avg": F.avg}[agg]
    c = F.col(col_key)
    listed = F.when(c.isin(values), c).otherwise(
        F.raise_error(F.concat(F.lit(f"pivot: value of {col_key} that is not listed: "), F.coalesce(c.cast("string"), F.lit("null")))))
    return df.withColumn(col_key, listed).groupBy(row_key).pivot(col_key, values).agg(fn(value)).na.fill(fill)


def matrix_size(entries: DataFrame) -> DataFrame:
    """(n_rows, n_cols, n_entries) of the coordinate matrix, from one aggregate."""
    return entries.agg((F.max("row_ix") + 1).alias("n_rows"), (F.max("col_ix") + 1).alias("n_cols"), F.count(F.lit(1)).alias("n_entries"))


def to_coordinate_matrix(entries: DataFrame):
    """MLlib ``CoordinateMatrix`` view of the entries (for MLlib interop only; no query needs it)."""
    from pyspark.mllib.linalg.distributed import CoordinateMatrix, MatrixEntry

    return CoordinateMatrix(entries.select("row_ix", "col_ix", "value").rdd.map(
        lambda r: MatrixEntry(r[0], r[1], r[2])))


# ---------------------------------------------------------------- distributed truncated SVD

def _names(prefix: str, b: int) -> list[str]:
    return [f"{prefix}{j}" for j in range(b)]


def heavy_keys(entries: DataFrame, key: str, heavy: int | None = None) -> DataFrame:
    """The values of ``key`` with more than ``heavy`` entries (few: the entries divided by that, at most)."""
    n = entries.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return n.where(F.col("_n") > F.lit(HEAVY if heavy is None else heavy)).select(key, F.lit(True).alias("_heavy"))


def _multiply(entries: DataFrame | tiles.Tiles, block: DataFrame, key_in: str, key_out: str, pin: str, pout: str, b: int,
              skip: int | None = None) -> DataFrame:
    """entries (x) block on ``key_in``, summed per ``key_out``.

    Packed entries take and give blocks of slices (the names stay out of use); ``skip`` is a
    number of the block that counts as 0 there."""
    if isinstance(entries, tiles.Tiles):
        return entries.product(block, key_in, b, skip)
    j = entries.select(key_in, key_out, "value").join(block, key_in)
    return j.groupBy(key_out).agg(*[F.sum(F.col("value") * F.col(c)).alias(o)
                                    for c, o in zip(_names(pin, b), _names(pout, b))])


def _gram_long(df: DataFrame, cols: list[str]) -> np.ndarray:
    """X^T X of the listed double columns: every partition forms its own
    b x b product with numpy over Arrow batches, then the upper-triangle
    entries are summed by a small aggregate; b(b+1)/2 numbers reach the driver."""
    b = len(cols)

    def part(batches):
        g = np.zeros((b, b))
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float, na_value=0.0)
            g += x.T @ x
        ii, jj = np.triu_indices(b)
        yield pd.DataFrame({"i": ii.astype("int32"), "j": jj.astype("int32"), "g": g[ii, jj]})

    return _square(df.select(*cols).mapInPandas(part, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")), b)


def _square(rows: DataFrame, b: int) -> np.ndarray:
    """The symmetric matrix of upper-triangle entries (i, j, g)."""
    g = np.zeros((b, b))
    for r in rows.collect():
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["g"]
    return g


def gram(block: DataFrame, b: int) -> np.ndarray:
    """The b x b products of the columns of a block of slices."""
    return _square(tiles.gram_rows(block, b), b)


def orthonormalise(block: DataFrame, b: int) -> tuple[DataFrame, int]:
    lam, w = np.linalg.eigh(gram(block, b))
    keep = lam > max(lam.max(), 0.0) * 1e-12
    return tiles.combine(block, w[:, keep] / np.sqrt(lam[keep])), int(keep.sum())


@dataclass
class SVDResult:
    u: DataFrame  # row_ix, u0..u{k-1}
    s: np.ndarray  # k singular values, descending
    v: DataFrame  # col_ix, v0..v{k-1}
    n_rows: int
    n_cols: int
    frobenius2: float  # sum of squared entries = sum of all squared singular values


def _numbers(entries: DataFrame, key: str) -> tuple[DataFrame | None, int]:
    """(index, count) of the values of ``key``: no index where they are the numbers from 0 already."""
    keys = entries.select(key).distinct()
    if dict(entries.dtypes)[key] in ("bigint", "int"):
        d = keys.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("k"), F.min(key).alias("low"), F.max(key).alias("high")).first()
        if d["n"] == d["k"] and (not d["n"] or (d["low"] == 0 and d["high"] == d["n"] - 1)):
            return None, d["n"]
    index = dense_index(entries, key, "_n")
    return index, index.count()


def truncated_svd(entries: DataFrame, k: int, block: int | None = None, depth: int = 30, seed: int = 7,
                  salts: int = 16, tolerance: float = 1e-4) -> SVDResult:
    """Top-k singular triplets of the sparse matrix given by ``entries``.

    Randomized block Krylov method: Q_0 = orth(A R), Q_i = orth(A orth(A^T Q_{i-1})),
    then Rayleigh-Ritz over the span of all blocks [Q_0 .. Q_depth].  Keeping
    every block converges much faster than plain subspace iteration when the
    spectrum has small gaps.  Steps go on until the leading k values of the
    block change by less than ``tolerance`` (relative); if ``depth`` steps are
    not enough, a warning says so.  Each product block is written to the shared
    checkpoint folder and read back, which bounds both the plan size and the
    work a lost executor can cost.

    The entries are packed once into tiles (``operators/tiles.py``); a tile that holds far
    more entries than others is dealt over several, whatever ``salts`` says."""
    spark = entries.sparkSession
    cols3 = entries.select("row_ix", "col_ix", "value")
    frob2 = float(cols3.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0)
    types = dict(cols3.dtypes)
    (row_index, n_rows), (col_index, n_cols) = (_numbers(cols3, key) for key in ("row_ix", "col_ix"))
    numbered_entries = cols3
    for key, index in (("row_ix", row_index), ("col_ix", col_index)):
        if index is not None:
            numbered_entries = join_key(numbered_entries, _by_hash(index), key).drop(key).withColumnRenamed("_n", key)
    if numbered_entries is not cols3:
        numbered_entries = materialise(numbered_entries, "svd-numbered")
    b = max(1, min(block or (k + 8), n_rows, n_cols))
    a = tiles.pack(numbered_entries, n_rows, n_cols, b)
    scratch: list[str] = []
    try:
        def write(df: DataFrame, name: str) -> DataFrame:
            """Intermediate block in the shared folder, deleted once U and V are written."""
            path = shared_path(spark, name)
            df.write.mode("overwrite").parquet(path)
            scratch.append(path)
            return spark.read.schema(tiles.BLOCK).parquet(path)

        columns = col_index if col_index is not None else spark.range(n_cols).select(F.col("id").alias("_n"), F.col("id").cast(types["col_ix"]).alias("col_ix"))
        v = tiles.from_rows(columns.select("_n", *[
            ((F.xxhash64(F.col("col_ix"), F.lit(j), F.lit(seed)) % 2000003).cast("double") / 2000003.0).alias(n)
            for j, n in enumerate(_names("v", b))
        ]), "_n", _names("v", b), n_cols)

        def left(v: DataFrame, b: int) -> DataFrame:
            return write(_multiply(a, v, "col_ix", "row_ix", "v", "y", b), "svd-y")

        def right(q: DataFrame, b: int) -> DataFrame:
            return write(_multiply(a, q, "row_ix", "col_ix", "y", "v", b), "svd-z")

        def side_by_side(parts: list[DataFrame], n: int, name: str, old: str) -> DataFrame:
            """The columns of all blocks in one written block; the ``old`` ones they come from go."""
            whole = write(tiles.beside(parts, n), name)
            remove_paths(spark, [path for path in scratch if os.path.basename(path).startswith(f"{old}-")])
            return whole

        # q = y @ t is recomputed from the written y where used (one numpy pass), not stored.
        q, b = orthonormalise(left(v, b), b)
        qs, zs, widths = [q], [], [b]
        seen, settled = np.zeros(0), False
        for _ in range(depth):
            z = right(q, b)
            zs.append(z)
            now = np.sqrt(np.clip(np.linalg.eigvalsh(gram(z, b))[::-1][:k], 0.0, None))
            settled = len(seen) == len(now) and np.allclose(seen, now, rtol=tolerance, atol=0.0)
            if settled:
                break
            seen = now
            w, b = orthonormalise(z, b)
            q, b = orthonormalise(left(w, b), b)
            qs.append(q)
            widths.append(b)
        if not settled:
            warnings.warn(f"truncated_svd: values still change by more than {tolerance} after {depth} steps", stacklevel=2)
            zs.append(right(q, b))
        # Krylov basis K: all blocks side by side; K t has orthonormal columns.
        basis, width = side_by_side(qs, n_rows, "svd-basis", "svd-y"), sum(widths)
        lam, w = np.linalg.eigh(gram(basis, width))
        keep = lam > max(lam.max(), 0.0) * 1e-12
        t = w[:, keep] / np.sqrt(lam[keep])
        # Rayleigh-Ritz: A ~ (K t) (A^T K t)^T, and A^T K are the products of the steps.
        z = side_by_side(zs, n_cols, "svd-zk", "svd-z")
        lam, w = np.linalg.eigh(t.T @ gram(z, width) @ t)
        order = np.argsort(lam)[::-1][: min(k, t.shape[1])]
        lam, w = np.clip(lam[order], 0.0, None), t @ w[:, order]
        s = np.sqrt(lam)
        inv = np.where(s > 0, 1.0 / np.where(s > 0, s, 1.0), 0.0)

        def rows(block: DataFrame, prefix: str, key: str, index: DataFrame | None) -> DataFrame:
            names = _names(prefix, len(s))
            got = tiles.to_rows(block, "_n", names)
            keyed = got.withColumn(key, F.col("_n").cast(types[key])) if index is None else got.join(index, "_n")
            return keyed.select(key, *names)

        u = materialise(rows(tiles.combine(basis, w), "u", "row_ix", row_index), "svd-u")
        vk = materialise(rows(tiles.combine(z, w * inv[None, :]), "v", "col_ix", col_index), "svd-v")
    finally:
        # U and V are in their own files; the blocks and the tiles go, also after a failure.
        remove_paths(spark, scratch)
        a.drop()
    return SVDResult(u, s, vk, n_rows, n_cols, frob2)


def scores(spark: SparkSession, svd: SVDResult, k: int | None = None) -> DataFrame:
    """Component scores U[:, :k] * s[:k] per row, ordered by row index."""
    k = k or len(svd.s)
    return svd.u.select("row_ix", *[(F.col(f"u{j}") * F.lit(float(svd.s[j]))).alias(f"pc_{j + 1}")
                                    for j in range(k)]).orderBy("row_ix")


def explained_variance(spark: SparkSession, s, n_rows: int, total: float | None = None) -> DataFrame:
    """M24 + A17: eigenvalue s^2/(n-1), share of the total variance (or of the
    kept values when ``total`` is None, as in the original report) and running
    cumulative share.  The window runs over k rows only."""
    s = np.asarray(s, dtype=float)
    eig = s ** 2 / max(n_rows - 1, 1)
    denom = (total / max(n_rows - 1, 1)) if total is not None else float(eig.sum())
    rows = [(i + 1, float(s[i]), float(eig[i]), float(eig[i] / denom) if denom else 0.0) for i in range(len(s))]
    df = spark.createDataFrame(rows, "component int, singular_value double, eigenvalue double, share double")
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("cumulative", F.sum("share").over(w))


def choose_k(shares: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Smallest component count whose cumulative share exceeds ``threshold``."""
    return shares.where(F.col("cumulative") > threshold).agg(F.min("component").alias("k"))


def project(entries: DataFrame, v: DataFrame, k: int) -> DataFrame:
    """Rows of the sparse matrix projected on right singular vectors (A @ V_k)."""
    return _multiply(entries, v, "col_ix", "row_ix", "v", "pc_", k).select(
        "row_ix", *[F.col(f"pc_{j}").alias(f"pc_{j + 1}") for j in range(k)])


def project_rows(obs: DataFrame, right: DataFrame, row_key: str, col_key: str, k: int) -> DataFrame:
    """Observed (row, column, value) cells projected on right vectors keyed by ``col_key``;
    cells whose column has no vector count as 0."""
    p = _multiply(obs, right, col_key, row_key, "v", "pc_", k)
    return p.select(row_key, *[F.col(f"pc_{j}").alias(f"pc_{j + 1}") for j in range(k)])


# ---------------------------------------------------------------- dense feature PCA (bounded width)

def vectors(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    """array column -> ml vector (JVM-side)."""
    return df.withColumn(out, array_to_vector(F.col(array_col)))


def assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def pca(df: DataFrame, k: int, features: str = "features", out: str = "projection"):
    """Centred PCA (covariance by a distributed tree aggregation)."""
    return PCA(k=k, inputCol=features, outputCol=out).fit(df)


def pca_project(model, df: DataFrame, out: str = "projection") -> DataFrame:
    """Rows times the component matrix (not centred, like the model)."""
    return model.transform(df).withColumn(out, vector_to_array(F.col(out)))


def standardise(df: DataFrame, cols, prefix: str = "z_") -> DataFrame:
    """Columns scaled to mean 0 and unit sample standard deviation."""
    v = assemble(df, cols, "_raw")
    sc = StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True).fit(v)
    out = sc.transform(v).withColumn("_za", vector_to_array(F.col("_z")))
    return out.select(*df.columns, *[F.col("_za")[i].alias(f"{prefix}{c}") for i, c in enumerate(cols)])


# ---------------------------------------------------------------- factor-form spectrum of the predicted grid

def _gram_of_array(df: DataFrame, col: str, width: int) -> np.ndarray:
    names = [f"_f{i}" for i in range(width)]
    return _gram_long(df.select(*[F.col(col)[i].cast("double").alias(n) for i, n in enumerate(names)]), names)


@dataclass
class GridSVD:
    """Singular triplets of the predicted grid M = A @ B.T in factor form: the left
    vectors are ``A @ left``, the right ones ``B @ right``."""

    s: np.ndarray
    left: np.ndarray
    right: np.ndarray
    total: float  # sum of all squared cells


def grid_svd(item_rows: DataFrame, user_rows: DataFrame, width: int) -> GridSVD:
    """M20-M23 at scale: the SVD of the full predicted grid from the two
    (width x width) Gram matrices; the grid itself is never formed.

    ``item_rows.f`` = [item factors, 1, business_mean - mu],
    ``user_rows.f`` = [user factors, user_mean, 1]."""
    ga = _gram_of_array(item_rows, "f", width)
    gb = _gram_of_array(user_rows, "f", width)
    lam, w = np.linalg.eigh(ga)
    keep = lam > max(lam.max(), 0.0) * 1e-12
    root = np.sqrt(lam[keep])
    half = w[:, keep] * root  # A = (A w / root) half.T, with orthonormal columns in brackets
    ev, r = np.linalg.eigh(half.T @ gb @ half)
    order = np.argsort(ev)[::-1]
    ev, r = np.clip(ev[order], 0.0, None), r[:, order]
    s = np.sqrt(ev)
    inv = np.where(s > s.max(initial=0.0) * 1e-9, 1.0 / np.where(s > 0, s, 1.0), 0.0)
    return GridSVD(s, (w[:, keep] / root) @ r, half @ r * inv, float(np.trace(ga @ gb)))


def grid_spectrum(item_rows: DataFrame, user_rows: DataFrame, width: int) -> tuple[np.ndarray, float]:
    """All singular values of the predicted grid and its total variance."""
    g = grid_svd(item_rows, user_rows, width)
    full = np.zeros(width)
    full[:len(g.s)] = g.s
    return full, g.total


def factor_map(rows: DataFrame, key: str, t: np.ndarray, prefix: str) -> DataFrame:
    """``f @ t`` per factor row as columns prefix0, prefix1, ...: one expression, no shuffle."""
    f = F.col("f")
    return rows.select(key, *[
        sum((f[i].cast("double") * F.lit(float(t[i, j])) for i in range(t.shape[0])), F.lit(0.0)).alias(f"{prefix}{j}")
        for j in range(t.shape[1])])


def grid_scores(item_rows: DataFrame, key: str, g: GridSVD, k: int) -> DataFrame:
    """Component scores U[:, :k] * s[:k] of every item row of the grid, as pc_1 .. pc_k."""
    t = factor_map(item_rows, key, g.left[:, :k] * g.s[:k], "pc_")
    return t.select(key, *[F.col(f"pc_{j}").alias(f"pc_{j + 1}") for j in range(k)])


def grid_right(user_rows: DataFrame, key: str, g: GridSVD, k: int) -> DataFrame:
    """Right singular vectors V[:, :k] of the grid per user, as v0 .. v{k-1}."""
    return factor_map(user_rows, key, g.right[:, :k], "v")
