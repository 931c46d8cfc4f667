"""Geo clustering.

KMeans is ``pyspark.ml.clustering.KMeans`` (k-means|| init, distributed Lloyd
iterations).  Several seeds are fitted and the lowest training cost wins;
cluster labels are then made canonical (centres ordered by longitude,
latitude and named A, B, ...) so results are comparable across runs.

Only k centres ever reach the driver (bounded by k); assigning points to a
given centroid table is an expression over a literal array of the centres,
not a join, so the points are never shuffled or paired.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def assemble(df: DataFrame, cols=("longitude", "latitude"), out: str = "features") -> DataFrame:
    """Feature vectors; a missing coordinate stops the job (filter such rows first)."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def cluster_name(i: int) -> str:
    """A, B, ..., Z, AA, AB, ... for canonical cluster i."""
    s, i = "", i + 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


@dataclass
class Clustering:
    model: KMeansModel
    seed: int
    cost: float
    order: list[int]  # order[canonical] = model label
    centres: list[tuple[float, ...]]  # canonical order

    def relabel(self) -> Column:
        """Model label -> canonical index, as an expression."""
        inv = [0] * len(self.order)
        for canon, lab in enumerate(self.order):
            inv[lab] = canon
        return F.element_at(F.array(*[F.lit(x) for x in inv]), F.col("prediction") + 1)


def fit_kmeans(df: DataFrame, k: int, seeds=(1, 2, 3, 4, 5, 6), features: str = "features",
               max_iter: int = 20, parallel: int = 6) -> Clustering:
    """Best of several seeds by training cost, canonical labels.

    The feature column is persisted once and the seeds are fitted as
    concurrent Spark jobs (one driver thread each)."""
    pts = df.select(features).persist(StorageLevel.MEMORY_AND_DISK)

    def one(seed):
        m = KMeans(k=k, seed=seed, featuresCol=features, maxIter=max_iter).fit(pts)
        return m, float(m.summary.trainingCost), seed

    try:
        with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(seeds)))) as ex:
            fits = list(ex.map(one, seeds))
    finally:
        pts.unpersist()
    m, cost, seed = min(fits, key=lambda f: (f[1], f[2]))
    centres = [tuple(float(x) for x in c) for c in m.clusterCenters()]
    order = sorted(range(len(centres)), key=lambda i: centres[i])
    return Clustering(m, seed, cost, order, [centres[i] for i in order])


def assign(cl: Clustering, df: DataFrame) -> DataFrame:
    """Adds ``cluster`` (canonical int) and ``cluster_name``."""
    names = F.array(*[F.lit(cluster_name(i)) for i in range(len(cl.order))])
    out = cl.model.transform(df).withColumn("cluster", cl.relabel())
    return out.withColumn("cluster_name", F.element_at(names, F.col("cluster") + 1)).drop("prediction")


def centroids(spark: SparkSession, cl: Clustering, cols=("longitude", "latitude")) -> DataFrame:
    """(cluster_name, centre coordinates); k rows."""
    rows = [(cluster_name(i),) + tuple(c) for i, c in enumerate(cl.centres)]
    schema = "cluster_name string, " + ", ".join(f"{c} double" for c in cols)
    return spark.createDataFrame(rows, schema)


def nearest_centroid(points: DataFrame, cents: DataFrame, cols=("longitude", "latitude"),
                     name_col: str = "cluster_name") -> DataFrame:
    """Assign each point to the nearest row of a centroid table.

    The table becomes one array (a scalar subquery, no driver fetch), and each point
    takes the minimum over it, so the expression is as long for 5,000 centroids as
    for 5.  Ties go to the smaller name."""
    at = F.array(*[F.col(c).cast("double") for c in cols])
    all_ = cents.agg(F.collect_list(F.struct(F.col(name_col).alias("name"), at.alias("at")))).scalar()
    dists = F.transform("_all", lambda r: F.struct(
        sum((F.pow(F.col(c) - r["at"][i], 2) for i, c in enumerate(cols)), F.lit(0.0)).alias("d"), r["name"].alias("name")))
    return points.withColumn("_all", all_).withColumn(name_col, F.array_min(dists)["name"]).drop("_all")


def silhouette(df: DataFrame, features: str = "features", prediction: str = "cluster") -> float:
    """Mean silhouette with squared Euclidean distance (O(n*k), no pairs)."""
    ev = ClusteringEvaluator(featuresCol=features, predictionCol=prediction, metricName="silhouette",
                             distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(df))


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    """Rows per cluster, largest first."""
    return assigned.groupBy("cluster_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


def category_per_cluster(assigned: DataFrame, category: str, col: str = "category") -> DataFrame:
    """Rows of one category per cluster, largest first."""
    return cluster_sizes(assigned.where(F.col(col) == F.lit(category)))


def cluster_profile(assigned: DataFrame, category: str, col: str = "category") -> DataFrame:
    """Size, category count and coordinate spread per cluster, one aggregation."""
    return assigned.groupBy("cluster_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(col) == F.lit(category)).alias("n_category"),
        F.avg("longitude").alias("mean_longitude"),
        F.avg("latitude").alias("mean_latitude"),
    )


def kmeans_sweep(df: DataFrame, ks=(4, 5, 6, 7, 8), seeds=(1, 2, 3, 4, 5, 6), cols=("longitude", "latitude")) -> DataFrame:
    """(k, seed, cost, silhouette) of the best seed per k; all fits share each pass over the points."""
    from ratewise.operators.lloyd import sweep_report

    return sweep_report(df, ks, seeds, cols)


def format_centroids(cents: DataFrame, cols=("longitude", "latitude")) -> DataFrame:
    """(name, location) with location 'lon lat' (12 decimals, so a re-read
    centre rounds like the original)."""
    return cents.select(
        F.col("cluster_name").alias("name"),
        F.format_string("%.12f %.12f", F.col(cols[0]), F.col(cols[1])).alias("location"),
    )


def write_centroids(cents: DataFrame, path: str) -> str:
    format_centroids(cents).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """Accepts 'lon  lat', 'lon lat', '[lon, lat]', trailing blanks, header 'name ,location'.
    A location without exactly two numbers stops the query."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option(
        "ignoreTrailingWhiteSpace", True).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    where = F.col("location")
    nums = F.regexp_extract_all(where, F.lit(f"({NUMBER})"), 1)
    strict = rf"^\s*\[?\s*{NUMBER}(?:\s*,\s*|\s+){NUMBER}\s*\]?\s*$"
    both = F.when(where.rlike(strict), nums).otherwise(
        F.raise_error(F.concat(F.lit("not a centroid location: "), F.coalesce(where, F.lit("null")))))
    return raw.select(F.trim(F.col("name")).alias("cluster_name"), both.alias("_n")).select(
        "cluster_name", F.get("_n", 0).cast("double").alias("longitude"), F.get("_n", 1).cast("double").alias("latitude"))
