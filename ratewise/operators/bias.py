"""Bias model: per-entity means and counts plus the global mean.

The global mean is a scalar subquery (``DataFrame.scalar()``): it is computed
once by a partial + final aggregate and folded into the consuming plan, so no
value is fetched to the driver and no cross join is planned.

Joins of the rating rows with the per-entity tables are plain equi-joins;
Catalyst / AQE choose broadcast when the runtime size of the entity table is
under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` (a checked size) and a
sort-merge join with skew splitting otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.functions.columns import final_rating, residual


def entity_mean(df: DataFrame, key: str, value: str = "stars", name: str | None = None) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias(name or f"{key.split('_')[0]}_mean"))


def entity_count(df: DataFrame, key: str, name: str | None = None) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name or f"{key.split('_')[0]}_count"))


def entity_stats(df: DataFrame, key: str, value: str = "stars") -> DataFrame:
    """Mean and count per key in one aggregation (one shuffle of partial sums)."""
    p = key.split("_")[0]
    return df.groupBy(key).agg(F.avg(value).alias(f"{p}_mean"), F.count(F.lit(1)).alias(f"{p}_count"))


def global_mean(df: DataFrame, value: str = "stars") -> Column:
    """Scalar-subquery column holding avg(value) over ``df``."""
    return df.agg(F.avg(value)).scalar()


@dataclass
class Bias:
    users: DataFrame  # user_id, user_mean, user_count
    items: DataFrame  # business_id, business_mean, business_count
    mu: Column  # scalar subquery
    user_col: str = "user_id"
    item_col: str = "business_id"


def fit_bias(train: DataFrame, user_col: str = "user_id", item_col: str = "business_id", rating: str = "stars") -> Bias:
    """M1: bias model fitted on the training split only."""
    return Bias(
        users=entity_stats(train, user_col, rating),
        items=entity_stats(train, item_col, rating),
        mu=global_mean(train, rating),
        user_col=user_col,
        item_col=item_col,
    )


def attach_means(df: DataFrame, bias: Bias, how: str = "left", fill: bool = True, counts: bool = False) -> DataFrame:
    """J1 (inner) / J2 (left): attach entity means (and counts) to rating rows.

    With ``how='left'`` unseen entities get the global mean and a zero count
    (named columns only)."""
    ucols = [bias.user_col, "user_mean"] + (["user_count"] if counts else [])
    icols = [bias.item_col, "business_mean"] + (["business_count"] if counts else [])
    out = df.join(bias.users.select(*ucols), bias.user_col, how).join(bias.items.select(*icols), bias.item_col, how)
    if how == "left" and fill:
        out = fill_means(out, ["user_mean", "business_mean"], bias.mu)
        if counts:
            out = fill_counts(out, ["user_count", "business_count"])
    return out


def fill_means(df: DataFrame, cols, value) -> DataFrame:
    """P10: replace nulls in the named columns only."""
    v = value if isinstance(value, Column) else F.lit(value)
    for c in cols:
        df = df.withColumn(c, F.coalesce(F.col(c), v))
    return df


def fill_counts(df: DataFrame, cols) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast("long")))
    return df


def with_residual(df: DataFrame, bias: Bias, rating: str = "stars", name: str = "residual") -> DataFrame:
    """M3 on rows that already carry both means."""
    return df.withColumn(name, residual(rating, "user_mean", "business_mean", bias.mu))


def with_final_rating(df: DataFrame, bias: Bias, prediction: str = "prediction", name: str = "final_rating") -> DataFrame:
    """M6: residual prediction + user mean + business mean - mu."""
    return df.withColumn(name, final_rating(prediction, "user_mean", "business_mean", bias.mu))
