"""Reproducible splits and dense integer ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.functions.columns import hash_bucket
from ratewise.session import materialise


def hash_split(df: DataFrame, key: str, test_pct: int = 20) -> tuple[DataFrame, DataFrame]:
    """80/20-style split on md5(key): reproducible, joinable, needs no shuffle."""
    b = hash_bucket(key)
    return df.where(b < 100 - test_pct), df.where(b >= 100 - test_pct)


def flag_split(df: DataFrame, flag: str = "is_test") -> tuple[DataFrame, DataFrame]:
    return df.where(~F.col(flag)), df.where(F.col(flag))


def random_split(df: DataFrame, weights=(0.8, 0.2), seed: int = 1) -> list[DataFrame]:
    """Spark's seeded row-level split; the rows are the same for the same partitioning."""
    return df.randomSplit(list(weights), seed)


DIGITS = 3  # hexadecimal digits that a round of the selection looks at


def exact_split(df: DataFrame, key: str, share: tuple[int, int] = (4, 5)) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly ``share`` of the rows in train (rounded half up), the
    same rows under any partitioning.

    Rows are ordered by md5 of the key, then md5 of the whole row.  The hash at the wanted
    rank is found by histograms of its digits: each round counts the rows by the next
    ``DIGITS`` digits below the prefix found so far (4,096 counts, combined in the tasks) and
    goes on in the bucket that holds the rank, until that bucket is one hash.  Only
    identical rows share a hash; they are counted, and as many as are wanted stay.  A null
    key is ordered like an empty one."""
    whole = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    hashed = df.withColumn("_h", F.concat(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.md5(whole)))
    prefix, left, cut = "", None, None
    while cut is None:
        at = len(prefix)
        part = hashed.where(F.col("_h").startswith(prefix)) if prefix else hashed
        rows = part.groupBy(F.substring("_h", at + 1, DIGITS).alias("d")).agg(
            F.count(F.lit(1)).alias("n"), F.min("_h").alias("low"), F.max("_h").alias("high")).collect()
        if left is None:
            total = sum(r["n"] for r in rows)
            left = (2 * share[0] * total + share[1]) // (2 * share[1])
        for r in sorted(rows, key=lambda r: r["d"]):
            if left <= r["n"]:
                if r["low"] == r["high"]:
                    cut = r["low"]
                else:
                    prefix += r["d"]
                break
            left -= r["n"]
        else:  # an empty table
            cut = ""
    train, test = hashed.where(F.col("_h") < cut), hashed.where(F.col("_h") > cut)
    same = hashed.where(F.col("_h") == cut).groupBy(*[F.col(c) for c in hashed.columns]).agg(F.count(F.lit(1)).alias("_n"))

    stay = F.lit(left or 0).cast("long")

    def copies(n) -> DataFrame:
        """``n`` of the identical rows at the cut."""
        some = same.withColumn("_i", n).where(F.col("_i") > 0)
        return some.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_i")))).select(*df.columns)

    return (train.select(*df.columns).unionByName(copies(F.least(F.col("_n"), stay))),
            test.select(*df.columns).unionByName(copies(F.col("_n") - stay)))


def numbered(df: DataFrame, order, name: str) -> DataFrame:
    """Rows of ``df`` in a total order with their long position, from 0.

    The rows are range-partitioned, sorted and written once with their partition
    number, so repeated uses agree even after executor loss; each partition counts
    its rows, and a running sum over the counts (one row per partition) gives the
    offsets."""
    rows = df.orderBy(*order).select(
        "*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
    rows = materialise(rows, "numbered")
    counts = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    # One row per partition: bounded by the partition count, so broadcast is safe.
    return rows.join(F.broadcast(offsets), "_pid").select(*df.columns, (F.col("_off") + pos).alias(name))


def dense_index(df: DataFrame, key: str, index_col: str | None = None, descending: bool = False,
                carry=None) -> DataFrame:
    """Distinct keys numbered 0..n-1 in key order (= row_number() over (order by key) - 1), as long.

    A null key is a key like any other: first in ascending order, last in
    descending order.  ``carry`` names columns of a frame that is already unique
    per key (an entity table); they are kept alongside the index, which saves the
    join back to that table."""
    index_col = index_col or f"{key}_ix"
    carry = list(carry or [])
    base = df.select(key, *carry)
    if not carry:
        base = base.distinct()
    return numbered(base, [F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first()], index_col)


def grow_index(index: DataFrame, df: DataFrame, key: str, index_col: str | None = None) -> DataFrame:
    """The next generation of an index.  Keys of ``df`` that ``index`` lacks are numbered
    after its last number, in key order; numbers once given never move.  A null key is a key
    like any other, and an empty index starts at 0.  Only the new keys are sorted."""
    index_col = index_col or f"{key}_ix"
    new = join_key(df.select(key).distinct(), index.select(key), key, "left_anti")
    after = index.agg(F.coalesce(F.max(index_col) + 1, F.lit(0).cast("long"))).scalar()
    fresh = numbered(new, [F.col(key).asc_nulls_first()], index_col)
    return index.select(key, index_col).unionByName(fresh.select(key, (F.col(index_col) + after).alias(index_col)))


def join_key(df: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` in which null keys match each other."""
    right = side.withColumnRenamed(key, f"_{key}_side")
    return df.join(right, F.col(key).eqNullSafe(F.col(f"_{key}_side")), how).drop(f"_{key}_side")


def apply_index(df: DataFrame, index: DataFrame, key: str, index_col: str, cold: int = -1) -> DataFrame:
    """Attach an index fitted elsewhere (on train); unseen keys get ``cold``."""
    return join_key(df, index, key, "left").withColumn(index_col, F.coalesce(F.col(index_col), F.lit(cold)))
