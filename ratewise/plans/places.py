"""Registered query of the centroid grid: as many centroids as there are users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.operators.centroid_grid import nearest_centroid_indexed
from ratewise.plans.oracle import with_views
from ratewise.sources import views as V

# A user's centre is the mean place of the businesses of their ratings.
NEAREST_SQL = with_views("""
SELECT business_id, user_id, round(sqrt(d), 6) AS distance FROM (
  SELECT business_id, user_id, d, row_number() OVER (PARTITION BY business_id ORDER BY d, user_id) AS rk FROM (
    SELECT b.business_id, c.user_id,
           (b.longitude - c.longitude) * (b.longitude - c.longitude) + (b.latitude - c.latitude) * (b.latitude - c.latitude) AS d
    FROM business b CROSS JOIN centres c))
WHERE rk = 1""", """centres AS (
  SELECT user_id, round(avg(longitude), 6) AS longitude, round(avg(latitude), 6) AS latitude
  FROM ratings JOIN business USING (business_id) GROUP BY user_id)""")


def m15_nearest_user_centre(spark: SparkSession, sf: str) -> DataFrame:
    """For every business the user whose centre is nearest, through the centroid grid."""
    places = V.business(spark, sf).select("business_id", "longitude", "latitude")
    centres = V.ratings(spark, sf).join(places, "business_id").groupBy("user_id").agg(
        F.round(F.avg("longitude"), 6).alias("longitude"), F.round(F.avg("latitude"), 6).alias("latitude"))
    near = nearest_centroid_indexed(places, centres, name_col="user_id")
    at = centres.select("user_id", F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    gap = (F.col("longitude") - F.col("x")) * (F.col("longitude") - F.col("x")) + (F.col("latitude") - F.col("y")) * (F.col("latitude") - F.col("y"))
    return near.join(at, "user_id").select("business_id", "user_id", F.round(F.sqrt(gap), 6).alias("distance"))


QUERIES = {"m15_nearest_user_centre": m15_nearest_user_centre}
ORACLE = {"m15_nearest_user_centre": NEAREST_SQL}
