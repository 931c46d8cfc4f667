"""ALS in waves: the fit of ``pyspark.ml`` for ratings whose exchange would fill the disks.

``pyspark.ml`` sends a factor to every block that needs it, all of a half iteration at once
and those of the half before still there: with many blocks that comes near to two factors a
rating on disk.  Here the entities to be solved are dealt over waves, and a wave exchanges at
most ``SENT`` bytes a rating, whatever the rank; its shuffle files go before the next one
starts.  The method is the library's: explicit ratings, regularisation times the number of an
entity's ratings, items first, random unit vectors to start with.  Start vectors come from a
hash of seed and id, not from blocks, so the result doesn't depend on cores or layout.

The ratings of an entity are sorted next to each other and summed up as a stream, so a task
holds one batch and a bounded number of normal equations, however many ratings an entity has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.session import remove_paths, shared_path

SENT = 40  # bytes of factors that a wave exchanges for each rating of the table
PART_BYTES = 32 << 20  # factors that a solving task sorts
EQUATIONS = 16 << 20  # bytes of normal equations solved in one call
FACTORS = "id int, features array<float>"


def waves(rank: int) -> int:
    return -(-(4 * rank + 16) // SENT)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what ended: it does when the driver's JVM collects."""
    spark.sparkContext._jvm.java.lang.System.gc()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def start_vectors(ids: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """A random unit vector for each id: normal numbers by Box and Muller."""
    base = _mixed(ids.astype(np.int64).view(np.uint64) ^ _mixed(np.array([seed], np.int64).view(np.uint64)))
    one, two = (_mixed(base[:, None] + np.arange(k * rank, (k + 1) * rank, dtype=np.uint64)) for k in (0, 1))
    unit = lambda x: ((x >> np.uint64(11)).astype(float) + 0.5) / 2 ** 53
    x = np.sqrt(-2 * np.log(unit(one))) * np.cos(2 * np.pi * unit(two))
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def _factors(ids: list | np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(np.ascontiguousarray(x, np.float32).ravel())
    ends = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.ListArray.from_arrays(ends, flat)], names=["id", "features"])


def solver(rank: int, reg: float):
    """Batches (dst, value, features) sorted by dst -> factors of the dst."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, EQUATIONS // (8 * rank * rank))
        ids, left, right = [], [], []
        now, a, b, n = None, None, None, 0

        def solved() -> pa.RecordBatch:
            out = _factors(ids, np.linalg.solve(np.stack(left), np.stack(right)[..., None])[..., 0])
            ids.clear(), left.clear(), right.clear()
            return out

        def end() -> None:
            a[np.diag_indices(rank)] += reg * n
            ids.append(now), left.append(a), right.append(b)

        for batch in batches:
            if not batch.num_rows:
                continue
            dst, v = np.asarray(batch.column("dst")), np.asarray(batch.column("value")).astype(float)
            x = np.asarray(batch.column("features").flatten()).reshape(-1, rank).astype(float)
            at = np.flatnonzero(np.diff(dst)) + 1
            for lo, hi in zip([0, *at.tolist()], [*at.tolist(), len(dst)], strict=True):
                rows = x[lo:hi]
                if dst[lo] != now or now is None:
                    if now is not None:
                        end()
                        if len(ids) >= most:
                            yield solved()
                    now, a, b, n = int(dst[lo]), rows.T @ rows, rows.T @ v[lo:hi], hi - lo
                else:
                    a, b, n = a + rows.T @ rows, b + rows.T @ v[lo:hi], n + hi - lo
        if now is not None:
            end()
            yield solved()

    return run


def _half(given: DataFrame, ratings: DataFrame, rank: int, reg: float, parts: int, name: str) -> tuple[DataFrame, str]:
    """Factors of the ``dst`` of ``ratings`` from the given ones of their ``src``, wave by wave."""
    spark = given.sparkSession
    path = shared_path(spark, name)
    for k in range(waves(rank)):
        some = ratings.where(F.col("wave") == k)
        rows = some.join(given.withColumnRenamed("id", "src").hint("shuffle_hash"), "src").select("dst", "value", "features")
        rows = rows.repartition(parts, "dst").sortWithinPartitions("dst")
        rows.mapInArrow(solver(rank, reg), FACTORS).write.mode("append").parquet(path)
        del some, rows
        release(spark)
    return spark.read.schema(FACTORS).parquet(path), path


def fit_in_waves(train: DataFrame, n: int, rank: int, max_iter: int, reg: float, seed: int, user_col: str, item_col: str,
                 rating_col: str, cold: str) -> ALSModel:
    """The model of ``n`` ratings; both factor tables are in the shared folder, at ``_rw_paths``."""
    spark, scratch = train.sparkSession, []

    def filled(c: str, kind: str):
        return F.coalesce(F.col(c).cast(kind), F.raise_error(F.lit(f"{c} holds a null"))).cast(kind)

    def side(dst: str, src: str) -> DataFrame:
        path = shared_path(spark, f"als-by-{dst}")
        scratch.append(path)
        rows = train.select(filled(dst, "int").alias("dst"), filled(src, "int").alias("src"), filled(rating_col, "float").alias("value"))
        rows.withColumn("wave", F.pmod(F.xxhash64("dst"), F.lit(waves(rank))).cast("int")).write.partitionBy("wave").parquet(path)
        return spark.read.schema("dst int, src int, value float, wave int").parquet(path)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = np.asarray(batch.column("id"))
                yield _factors(ids, start_vectors(ids, rank, seed))

    size = -(-n * (4 * rank + 16) // waves(rank))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    try:
        by_item, by_user = side(item_col, user_col), side(user_col, item_col)
        old = [shared_path(spark, "als-users")]
        by_user.select(F.col("dst").alias("id")).distinct().mapInArrow(start, FACTORS).write.parquet(old[0])
        users = spark.read.schema(FACTORS).parquet(old[0])
        for _ in range(max_iter):
            items, item_path = _half(users, by_item, rank, reg, parts, "als-items")
            remove_paths(spark, old)
            users, user_path = _half(items, by_user, rank, reg, parts, "als-users")
            old = [item_path, user_path]
    finally:
        remove_paths(spark, scratch)
    made = spark.sparkContext._jvm.org.apache.spark.ml.recommendation.ALSModel(f"als_{seed}_{rank}", rank, users._jdf, items._jdf)
    model = ALSModel(made).setUserCol(user_col).setItemCol(item_col).setPredictionCol("prediction").setColdStartStrategy(cold)
    model._rw_paths = old
    return model
