"""Dataset statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """A5."""
    return df.select(key).distinct()


def dataset_stats(df: DataFrame, user_col: str = "user_id", item_col: str = "business_id") -> DataFrame:
    """Rows and distinct users / businesses (nulls don't count as keys).

    Each key is grouped on its own, so no row is expanded once per distinct count."""
    users = count_by(df, user_col).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(user_col).alias("n_users"))
    items = count_by(df, item_col).agg(F.count(item_col)).scalar()
    return users.select("n_rows", "n_users", items.alias("n_businesses"))


def density(df: DataFrame, user_col: str = "user_id", item_col: str = "business_id") -> DataFrame:
    """Reviews per user and per business over the same population."""
    s = dataset_stats(df, user_col, item_col)
    return s.select(
        "n_rows",
        "n_users",
        "n_businesses",
        (F.col("n_rows") / F.col("n_users")).alias("reviews_per_user"),
        (F.col("n_rows") / F.col("n_businesses")).alias("reviews_per_business"),
    )


def user_spread(df: DataFrame, key: str = "user_id", value: str = "stars") -> DataFrame:
    """A12 + A13: sample standard deviation and min-max range per key."""
    return df.groupBy(key).agg(
        F.stddev_samp(value).alias("stars_stddev"),
        (F.max(value) - F.min(value)).alias("stars_range"),
    )


def describe_by(df: DataFrame, key: str, value: str = "stars") -> DataFrame:
    """Mean, sample stddev and count per key."""
    return df.groupBy(key).agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("stddev"),
        F.count(F.lit(1)).alias("n"),
    )


def count_by(df: DataFrame, key: str) -> DataFrame:
    """Rows per key (partial + final aggregation, skew-safe)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
