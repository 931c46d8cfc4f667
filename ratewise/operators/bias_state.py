"""Bias model from mergeable state (M1, A1-A4): new ratings are added, old ones taken back,
without reading the ratings that the state already covers.

The state of an entity is the number and the sum of its ratings.  A generation is the
state of one batch, written as a folder of its own; the model is the sum over the
generations.  Sums are decimals, so they don't depend on the order of batches or tasks
and equal a refit to the last digit.  Writing a generation again replaces it, so a failed
load is simply repeated.

A null key is an entity like any other; a null rating counts for nothing; an entity whose
ratings were all taken back is gone; an empty batch is an empty generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.operators.bias import Bias

EXACT = "decimal(28,10)"
SIDES = ("user_id", "business_id")


def batch_state(df: DataFrame, key: str, value: str = "stars", sign: int = 1) -> DataFrame:
    """(key, n, total) of a batch: partial sums in the tasks, then one row per key moves."""
    rated = df.where(F.col(value).isNotNull())
    return rated.groupBy(key).agg((F.count(F.lit(1)) * sign).alias("n"), (F.sum(F.col(value).cast("decimal(18,10)")) * sign).cast(EXACT).alias("total"))


def add_batch(df: DataFrame, path: str, generation: int, value: str = "stars", sides=SIDES, take_back: bool = False) -> str:
    """Write the state of a batch as one generation of the store at ``path``.  With
    ``take_back`` the batch's ratings are subtracted instead."""
    for key in sides:
        batch_state(df, key, value, -1 if take_back else 1).write.mode("overwrite").parquet(f"{path}/{key}/generation={generation}")
    return path


def merged(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, n, total): the sum over all generations of the store."""
    # The folder number is no part of the state; sums of equal type merge again and again.
    state = spark.read.parquet(f"{path}/{key}").groupBy(key).agg(F.sum("n").alias("n"), F.sum("total").cast(EXACT).alias("total"))
    return state.where("n > 0")


def compact(spark: SparkSession, path: str, out: str, sides=SIDES) -> str:
    """All generations as generation 0 of a new store at ``out``."""
    for key in sides:
        merged(spark, path, key).write.mode("overwrite").parquet(f"{out}/{key}/generation=0")
    return out


def load_bias(spark: SparkSession, path: str, user_col: str = "user_id", item_col: str = "business_id") -> Bias:
    """M1: the bias model of everything in the store; no rating is read."""
    def side(key: str) -> DataFrame:
        p = key.split("_")[0]
        return merged(spark, path, key).select(key, (F.col("total").cast("double") / F.col("n")).alias(f"{p}_mean"), F.col("n").alias(f"{p}_count"))

    whole = merged(spark, path, user_col).agg((F.sum("total").cast("double") / F.sum("n")).alias("mu"))
    return Bias(users=side(user_col), items=side(item_col), mu=whole.scalar(), user_col=user_col, item_col=item_col)
