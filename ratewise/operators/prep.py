"""Projections, filters and the city dataset preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_COLUMNS = ["user_id", "business_id", "stars"]

def filter_city(df: DataFrame, city: str, exclude_names=()) -> DataFrame:
    """``city == X AND name NOT IN (outliers)``."""
    cond = F.col("city") == F.lit(city)
    for n in exclude_names:
        cond = cond & (F.col("name") != F.lit(n))
    return df.where(cond)


def where_value(df: DataFrame, col: str, value) -> DataFrame:
    """P5: equality predicate."""
    return df.where(F.col(col) == F.lit(value))


def feature_columns(df: DataFrame, skip=()) -> list[str]:
    """Numeric columns of the schema, minus ``skip``."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    return [n for n, t in df.dtypes if n not in set(skip) and t in numeric]


def reviews_in_city(reviews: DataFrame, business: DataFrame, city: str, exclude_names=(), review_cols=None,
                    business_cols=("city",)) -> DataFrame:
    """Reviews of the businesses of one city, with ``business_cols`` attached.

    The business side is filtered and projected first (pushdown), in one scan.
    Whether it is broadcast is left to the measured size in bytes (adaptive
    execution); beyond the threshold the join is sort-merge, and hot businesses
    are skew-split."""
    biz = filter_city(business, city, exclude_names).select("business_id", *business_cols)
    cols = review_cols or [c for c in reviews.columns if c != "is_test"]
    return reviews.select(*cols).join(biz, "business_id", "inner")


def prepare_city(reviews: DataFrame, business: DataFrame, city: str, exclude_names=()) -> tuple[DataFrame, DataFrame]:
    """M33 as written: (all columns of the city's businesses, its reviews with ``city``)."""
    from ratewise.sources.io import BUSINESS, REVIEW

    biz = filter_city(business, city, exclude_names).select(*BUSINESS.fieldNames())
    return biz, reviews_in_city(reviews, business, city, exclude_names, REVIEW.fieldNames()).select(*REVIEW.fieldNames(), "city")


def cast_double(col) -> Column:
    """F2."""
    return (F.col(col) if isinstance(col, str) else col).cast("double")
