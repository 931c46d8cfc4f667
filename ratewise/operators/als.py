"""Alternating least squares whose entities may hold any share of the ratings.

``pyspark.ml`` keeps all ratings of a user in one block.  Here a heavy user's ratings are
dealt over salts, and every (user, salt) goes to a block of bounded size:

* the ratings are written once, bucketed by block, and are not shuffled again; each
  factor of the other side is sent once to each block that needs it (the list of
  (id, block) is made once, bucketed by id, and reused by every iteration);
* a block forms the normal equations of its users with numpy.  A user whose ratings are
  all in the block is solved there; a part of a heavy user becomes partial sums;
* partial sums are added up position by position (combined in the tasks before the
  shuffle), then solved.

The equations are those of ``pyspark.ml``: explicit ratings, and ``reg`` times the number
of ratings on the diagonal.  Ids may be of any type; rows with a null id or rating are no
ratings and are left out.  No factor reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.session import bucketed_table, drop_table, materialise, shared_path

BLOCK_RATINGS = 1_000_000  # ratings in a block, about
SPLIT_RATINGS = 50_000  # ratings of one entity in a block, at most (about)


@dataclass
class Side:
    """The ratings as one side's solver reads them: dealt to blocks, with the blocks that
    need each factor of the other side."""

    rows: DataFrame  # block, key, other, value, n (ratings of the key), bucketed by block
    links: DataFrame  # other, block, bucketed by other
    tables: list[str]  # the tables that hold both

    def drop(self) -> None:
        for name in self.tables:
            drop_table(self.rows.sparkSession, name)


@dataclass
class Factors:
    """Fitted factors: ``users`` and ``items`` are (id, f array<double>)."""

    users: DataFrame
    items: DataFrame
    rank: int
    reg: float


def deal(ratings: DataFrame, key: str, other: str, value: str, block_ratings: int = BLOCK_RATINGS,
         split_ratings: int = SPLIT_RATINGS) -> Side:
    """The ratings in blocks for solving ``key``; an entity with more than
    ``split_ratings`` is dealt over as many salts as it needs."""
    r = ratings.select(F.col(key).alias("key"), F.col(other).alias("other"), F.col(value).cast("double").alias("value"))
    r = r.where(F.col("key").isNotNull() & F.col("other").isNotNull() & F.col("value").isNotNull())
    sizes = r.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = r.count()
    blocks = max(ratings.sparkSession.sparkContext.defaultParallelism, -(-total // block_ratings))
    salt = F.pmod(F.xxhash64("other", "value"), F.ceil(F.col("n") / split_ratings))
    block = F.pmod(F.xxhash64("key", salt), F.lit(blocks)).cast("int")
    spark = ratings.sparkSession
    buckets = min(blocks, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    tables = [bucketed_table(r.join(sizes, "key").select(block.alias("block"), "key", "other", "value", "n"), "block", buckets, "als_rows")]
    rows = spark.table(tables[0])
    tables.append(bucketed_table(rows.select("other", "block").distinct(), "other", buckets, "als_links"))
    return Side(rows, spark.table(tables[1]), tables)


def start_factors(ids: DataFrame, key: str, rank: int, seed: int = 1) -> DataFrame:
    """(id, f): unit vectors of hashed normal numbers, the same under any partitioning."""
    def uniform(j: int, part: int) -> Column:
        h = F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(j), F.lit(part)), F.lit(1 << 52))
        return (h.cast("double") + 1.0) / float((1 << 52) + 1)

    normal = F.array(*[F.sqrt(-2.0 * F.log(uniform(j, 0))) * F.cos(2.0 * math.pi * uniform(j, 1)) for j in range(rank)])
    raw = ids.select(F.col(key).alias("id")).where(F.col("id").isNotNull()).distinct().withColumn("f", normal)
    size = F.sqrt(F.aggregate("f", F.lit(0.0), lambda a, x: a + x * x))
    return raw.withColumn("f", F.transform("f", lambda x: x / size))


def _solved(a: np.ndarray, b: np.ndarray, n: np.ndarray, reg: float) -> np.ndarray:
    """Solutions of many small ridge systems; a singular one gets its least-squares solution."""
    k = b.shape[1]
    a = a + (reg * n)[:, None, None] * np.eye(k)
    try:
        return np.linalg.solve(a, b[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        return np.stack([np.linalg.lstsq(x, y, rcond=None)[0] for x, y in zip(a, b, strict=True)])


def _lists(x: np.ndarray) -> pa.ListArray:
    ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).reshape(-1)))


def solve(side: Side, factors: DataFrame, rank: int, reg: float) -> DataFrame:
    """(id, f) of every entity of ``side``, given the other side's factors (id, f).
    Ratings whose other id has no factor don't count."""
    kind = next(f.dataType for f in side.rows.schema.fields if f.name == "key")
    sent = side.links.join(factors.select(F.col("id").alias("other"), "f"), "other")
    upper = np.triu_indices(rank)
    width = len(upper[0]) + rank

    def normal(ratings: pa.Table, known: pa.Table) -> pa.Table:
        key = ratings.column("key").combine_chunks().dictionary_encode()
        if isinstance(key, pa.ChunkedArray):
            key = key.combine_chunks()
        at = known.column("other").combine_chunks()
        place = pc.index_in(ratings.column("other").combine_chunks(), at).to_numpy(zero_copy_only=False)
        f = np.asarray(known.column("f").combine_chunks().flatten()).reshape(-1, rank)
        has = ~np.isnan(place.astype(float))
        code, value = key.indices.to_numpy()[has], ratings.column("value").to_numpy()[has]
        n_all = ratings.column("n").to_numpy()[has]
        rows = f[place[has].astype(np.int64)]
        order = np.argsort(code, kind="stable")
        code, value, n_all, rows = code[order], value[order], n_all[order], rows[order]
        first = np.flatnonzero(np.diff(code, prepend=-1)) if len(code) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(code))
        ids, whole, xs, sums, counts = [], [], [], [], []
        for start in range(0, len(first), 512):
            some = range(start, min(start + 512, len(first)))
            a = np.stack([rows[first[i]:last[i]].T @ rows[first[i]:last[i]] for i in some])
            b = np.stack([value[first[i]:last[i]] @ rows[first[i]:last[i]] for i in some])
            here = np.array([last[i] - first[i] for i in some])
            ids.append(code[first[some]])
            counts.append(here)
            whole.append(n_all[first[some]] <= here)
            xs.append(_solved(a, b, here, reg))
            sums.append(np.concatenate([a[:, upper[0], upper[1]], b], axis=1))
        if not ids:
            return empty
        done = np.concatenate(whole)
        x, part = np.concatenate(xs), np.concatenate(sums)
        out = np.where(done[:, None], np.pad(x, ((0, 0), (0, width - rank))), part)
        return pa.table([key.dictionary.take(pa.array(np.concatenate(ids))), pa.array(done), pa.array(np.concatenate(counts).astype(np.int64)), _lists(out)],
                        names=["id", "done", "n", "x"]).cast(empty.schema)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("id", kind), T.StructField("done", T.BooleanType()), T.StructField("n", T.LongType()),
                           T.StructField("x", T.ArrayType(T.DoubleType()))])
    empty = to_arrow_schema(schema).empty_table()
    parts = side.rows.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(normal, schema)
    parts = materialise(parts, "als-parts")
    whole = parts.where("done").select("id", F.slice("x", 1, rank).alias("f"))
    # Parts of heavy entities: sums by position, combined in the tasks first.
    heavy = parts.where("NOT done")
    counts = heavy.groupBy("id").agg(F.sum("n").alias("n"))
    cells = heavy.select("id", F.posexplode("x").alias("pos", "v")).groupBy("id", "pos").agg(F.sum("v").alias("v"))
    merged = cells.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda c: c["v"]).alias("x")).join(counts, "id")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("x").flatten()).reshape(-1, width)
                a = np.zeros((len(x), rank, rank))
                a[:, upper[0], upper[1]] = a[:, upper[1], upper[0]] = x[:, :len(upper[0])]
                yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(_solved(a, x[:, len(upper[0]):], np.asarray(batch.column("n")), reg))], names=["id", "f"])

    out = T.StructType([T.StructField("id", kind), T.StructField("f", T.ArrayType(T.DoubleType()))])
    return whole.unionByName(merged.select("id", "n", "x").mapInArrow(finish, out))


def fit(ratings: DataFrame, rank: int = 10, max_iter: int = 10, reg: float = 0.1, seed: int = 1, user: str = "user_id", item: str = "business_id",
        value: str = "residual", start: DataFrame | None = None, block_ratings: int = BLOCK_RATINGS, split_ratings: int = SPLIT_RATINGS) -> Factors:
    """M4: factors after ``max_iter`` rounds, items first, then users.  ``start`` gives user
    factors (id, f) to begin with (a warm start), else hashed unit vectors."""
    ratings = materialise(ratings.select(user, item, value), "als-ratings")  # read five times
    by_user = deal(ratings, user, item, value, block_ratings, split_ratings)
    by_item = deal(ratings, item, user, value, block_ratings, split_ratings)
    users = materialise(start if start is not None else start_factors(by_user.rows, "key", rank, seed), "als-start")
    items, spark = None, ratings.sparkSession
    for _ in range(max_iter):
        items = _step(by_item, users, rank, reg, spark)
        users = _step(by_user, items, rank, reg, spark)
    by_user.drop()
    by_item.drop()
    return Factors(users, items, rank, reg)


def _step(side: Side, factors: DataFrame, rank: int, reg: float, spark) -> DataFrame:
    """One half of a round, written to the shared folder."""
    path = shared_path(spark, "als-factors")
    solve(side, factors, rank, reg).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fold_in(ratings: DataFrame, model: Factors, user: str = "user_id", item: str = "business_id", value: str = "residual",
            block_ratings: int = BLOCK_RATINGS, split_ratings: int = SPLIT_RATINGS) -> DataFrame:
    """M5: (id, f) of users that the fit didn't see, each by one ridge solve against the
    fitted item factors, which stay as they are.  Users without a rating of a fitted item
    get no factors."""
    side = deal(materialise(ratings.select(user, item, value), "als-ratings"), user, item, value, block_ratings, split_ratings)
    folded = materialise(solve(side, model.items, model.rank, model.reg), "als-folded")
    side.drop()
    return folded


def predict(pairs: DataFrame, users: DataFrame, items: DataFrame, user: str = "user_id", item: str = "business_id",
            name: str = "prediction") -> DataFrame:
    """``pairs`` plus the product of both factors, null where one of them is missing."""
    u = users.select(F.col("id").alias(user), F.col("f").alias("_uf"))
    i = items.select(F.col("id").alias(item), F.col("f").alias("_if"))
    dot = F.aggregate(F.zip_with("_uf", "_if", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return pairs.join(u, user, "left").join(i, item, "left").withColumn(name, dot).select(*pairs.columns, name)
