"""Registered queries of the growing index, the exact split, the batched KMeans sweep and point silhouettes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.operators import lloyd
from ratewise.operators.split import dense_index, exact_split, flag_split, grow_index
from ratewise.plans import catalog as C
from ratewise.plans.oracle import CITY, with_views
from ratewise.sources import views as V

EXACT_SQL = with_views("""
SELECT review_id, row_number() OVER (ORDER BY md5(review_id)) <= (4 * (SELECT count(*) FROM ratings) * 2 + 5) // 10 AS is_train FROM ratings""")

# Distances to the planted clusters from their moments, relative to the mean of all points.
_POINTS = """mid AS (SELECT avg(longitude) AS x0, avg(latitude) AS y0 FROM assigned),
rel AS (SELECT business_id, cluster_name, longitude - x0 AS x, latitude - y0 AS y FROM assigned CROSS JOIN mid),
own AS (SELECT cluster_name, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(x * x + y * y) AS q FROM rel GROUP BY cluster_name),
far AS (SELECT r.business_id, r.cluster_name, o.cluster_name AS other, o.n,
               greatest(x * x + y * y + q - 2 * (x * mx + y * my), 0) AS d FROM rel r CROSS JOIN own o),
ab AS (SELECT business_id, any_value(cluster_name) AS cluster_name, max(CASE WHEN other = cluster_name THEN d * n / greatest(n - 1, 1) END) AS a,
              min(CASE WHEN other <> cluster_name THEN d END) AS b, max(CASE WHEN other = cluster_name THEN n END) AS n FROM far GROUP BY business_id),
sil AS (SELECT business_id, cluster_name, CASE WHEN n > 1 AND b IS NOT NULL AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END AS s FROM ab)"""

POINT_SQL = with_views("SELECT business_id, cluster_name, round(s, 6) AS silhouette FROM sil", CITY, C.PLANT_NAMES, _POINTS)

PLANTED_SQL = with_views("""
SELECT (SELECT count(*) FROM plants)::INT AS k, round(sum(pow(longitude - clon, 2) + pow(latitude - clat, 2)), 6) AS cost,
       (SELECT round(avg(s), 4) FROM sil) AS silhouette FROM assigned JOIN plants USING (cluster_name)""", CITY, C.PLANT_NAMES, _POINTS)

GROWN_SQL = with_views("""
SELECT user_id, row_number() OVER (ORDER BY min(CASE WHEN is_test THEN 1 ELSE 0 END), user_id) - 1 AS user_ix FROM ratings GROUP BY user_id""")


def i1_growing_index(spark: SparkSession, sf: str) -> DataFrame:
    """The users of training, then those that only the test rows bring."""
    train, test = flag_split(V.ratings(spark, sf))
    return grow_index(dense_index(train, "user_id", "user_ix"), test, "user_id", "user_ix")


def i3_exact_split(spark: SparkSession, sf: str) -> DataFrame:
    """The exact 80/20 split of all ratings."""
    train, test = exact_split(V.ratings(spark, sf).select("review_id"), "review_id", (4, 5))
    return train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)))


def m16_point_silhouette(spark: SparkSession, sf: str) -> DataFrame:
    """Every business's own silhouette under the fitted clusters."""
    _, assigned = C._clustered(spark, sf)
    got = lloyd.point_silhouette(assigned.select("business_id", "cluster_name", "longitude", "latitude"))
    return got.select("business_id", "cluster_name", F.round("silhouette", 6).alias("silhouette"))


def m19_planted_k(spark: SparkSession, sf: str) -> DataFrame:
    """The sweep over k picks the planted number of clusters (by silhouette)."""
    swept = lloyd.sweep_report(C._city_points(spark, sf), ks=(4, 5, 6, 7, 8, 9))
    best = swept.agg(F.max_by(F.struct("k", "cost", "silhouette"), "silhouette").alias("b")).select("b.*")
    return best.select("k", F.round("cost", 6).alias("cost"), F.round("silhouette", 4).alias("silhouette"))


QUERIES = {"i1_growing_index": i1_growing_index, "i3_exact_split": i3_exact_split, "m16_point_silhouette": m16_point_silhouette, "m19_planted_k": m19_planted_k}
ORACLE = {"i1_growing_index": GROWN_SQL, "i3_exact_split": EXACT_SQL, "m16_point_silhouette": POINT_SQL, "m19_planted_k": PLANTED_SQL}
