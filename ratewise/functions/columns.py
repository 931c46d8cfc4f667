"""Column builders (plain functions returning ``Column``), so every expression
stays JVM-side and inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash_bucket(key, buckets: int = 100) -> Column:
    """Reproducible bucket in [0, buckets): first 32 bits of md5(key)."""
    return F.conv(F.substring(F.md5(_c(key).cast("string")), 1, 8), 16, 10).cast("bigint") % buckets


def residual(stars, user_mean, item_mean, mu) -> Column:
    """Rating minus the bias model: stars - (user_mean + item_mean - mu)."""
    return _c(stars) - (_c(user_mean) + _c(item_mean) - _c(mu))


def final_rating(prediction, user_mean, item_mean, mu) -> Column:
    """Bias re-added to a residual prediction; not clipped to the star range."""
    return _c(prediction) + _c(user_mean) + _c(item_mean) - _c(mu)


def clean_prediction(prediction) -> Column:
    """ALS output for cold pairs is NaN; treat it as a zero residual."""
    return F.coalesce(F.nanvl(_c(prediction).cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def fallback_rating(final, user_mean, item_mean, mu, item_count, user_count, min_item: int, min_user: int) -> Column:
    """Activity-conditional rating: both entities active -> final rating;
    only the business -> business mean; only the user -> user mean; else mu."""
    item_ok = _c(item_count) > F.lit(min_item)
    user_ok = _c(user_count) > F.lit(min_user)
    return (
        F.when(item_ok & user_ok, _c(final))
        .when(item_ok, _c(item_mean))
        .when(user_ok, _c(user_mean))
        .otherwise(_c(mu))
    )


def squared_error(label, pred) -> Column:
    return F.pow(_c(label) - _c(pred), 2)


def strip_ws(col) -> Column:
    """Strip leading and trailing white space of every kind (not only blanks)."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def first_item(col) -> Column:
    """Element 0 of an array; null for null or empty arrays (ANSI-safe)."""
    return F.get(_c(col), 0)


def pair_values(col, field: str = "rating") -> Column:
    """Value list of an array of (key, value) structs."""
    return F.transform(_c(col), lambda x: x[field])


def pairs_to_map(col, key: str = "user_id", value: str = "rating") -> Column:
    return F.map_from_entries(F.transform(_c(col), lambda x: F.struct(x[key], x[value])))


def round6(col) -> Column:
    return F.round(_c(col), 6)
