"""Stand-in review and business tables derived from the driver's parquet tables.

``ratings`` maps each lineitem to one review: the order's customer is the user,
the part is the business, and a planted low-rank signal gives half-star ratings
(exact in binary, so sums and means agree bit for bit across engines).
``business`` places every part around one of eight planted city centroids.

``ratings_plan`` / ``business_plan`` are lazy DataFrames over the whole
tables (Catalyst prunes the scans to the handful of columns used).  Like the
original review file, the stand-ins are derived once per application and
stored as parquet in the shared checkpoint folder; every analysis then scans
that table instead of re-deriving it in each branch of its plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.functions.columns import hash_bucket
from ratewise.session import shared_path

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# The eight planted centroids (longitude, latitude) of the
# business view; they must equal the stand-in definition used by the oracle.
CENTROIDS = [
    (0, -73.56367802, 45.50491004),
    (1, -73.7983471, 45.4606171),
    (2, -73.59808861, 45.51945735),
    (3, -73.61925182, 45.46908932),
    (4, -73.68637631, 45.49730413),
    (5, -73.5579598, 45.55922568),
    (6, -73.57986258, 45.48856344),
    (7, -73.5460882, 45.3927622),
]

TEST_PCT = 20
COLD_USER_MOD = 17
COLD_PART_MOD = 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sign(c: Column) -> Column:
    return F.when(c % 6 >= 3, F.lit(-1)).otherwise(F.lit(1))


_BUILT: dict = {}


def fingerprint(spark: SparkSession, sf_dir: str, names=("lineitem", "orders", "part")) -> tuple:
    """Application, folder, and the files of the tables that the stand-ins come from with
    their sizes and times: a folder whose data changed is a new key."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = [spark.sparkContext.applicationId, sf_dir.rstrip("/")]
    for n in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{n}.parquet")
        fs = path.getFileSystem(conf)
        for f in fs.listStatus(path):
            out.append((f.getPath().getName(), f.getLen(), f.getModificationTime()))
    return tuple(out)


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Derive a stand-in table once per application and input data, in the shared
    checkpoint folder; later queries scan it instead of re-deriving it."""
    key = (fingerprint(spark, sf_dir), name)
    if key not in _BUILT:
        path = shared_path(spark, f"view-{name}")
        build(spark, sf_dir).write.mode("overwrite").parquet(path)
        _BUILT[key] = path
    return spark.read.parquet(_BUILT[key])


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``ratings`` stand-in, derived once per application (see ``ratings_plan``)."""
    # Plain parquet, not bucketed by user: under user skew a bucket would put a hot
    # user's rows in one task, while shuffled joins can be skew-split by AQE.
    return _once(spark, sf_dir, "ratings", ratings_plan)


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, business_id, stars of every rating: a table of its own, without the review id
    and the hash of it, unless the whole one is there already."""
    if (fingerprint(spark, sf_dir), "ratings") in _BUILT:
        return ratings(spark, sf_dir).select("user_id", "business_id", "stars")
    return _once(spark, sf_dir, "stars", lambda spark, sf_dir: ratings_plan(spark, sf_dir).select("user_id", "business_id", "stars"))


def business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``business`` stand-in, derived once per application (see ``business_plan``)."""
    return _once(spark, sf_dir, "business", business_plan)


def ratings_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review_id, user_id, business_id, stars, is_test over lineitem x orders."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    u, p = F.col("o_custkey"), F.col("l_partkey")
    q = F.col("l_quantity").cast("int")
    half = (
        F.lit(6) + (u % 3 - 1) + (p % 3 - 1) + F.lit(2) * _sign(u) * _sign(p) + (q % 3 - 1)
    )
    review_id = F.concat_ws(
        "-",
        F.col("l_orderkey").cast("string"),
        F.col("l_linenumber").cast("string"),
        p.cast("string"),
        F.col("l_suppkey").cast("string"),
    )
    return j.select(
        review_id.alias("review_id"),
        F.concat(F.lit("u"), u.cast("string")).alias("user_id"),
        F.concat(F.lit("b"), p.cast("string")).alias("business_id"),
        (F.greatest(F.lit(2), F.least(F.lit(10), half)).cast("double") / F.lit(2.0)).alias("stars"),
        (
            (hash_bucket(review_id) >= 100 - TEST_PCT)
            | (u % COLD_USER_MOD == 0)
            | (p % COLD_PART_MOD == 0)
        ).alias("is_test"),
    )


def business_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """business_id, name, city, category, plant, longitude, latitude over part."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    # Eight rows: a fixed-size dimension, so the broadcast is bounded.
    cents = spark.createDataFrame(CENTROIDS, "cid long, clon double, clat double")
    j = part.join(F.broadcast(cents), (F.col("p_partkey") % 8) == F.col("cid"))
    step = ((F.col("p_partkey") - F.col("p_partkey") % 8) / 8).cast("bigint")
    return j.select(
        F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("business_id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit("Toronto")).otherwise(F.lit("Montreal")).alias("city"),
        F.col("p_type").alias("category"),
        F.col("cid").alias("plant"),
        (F.col("clon") + (step % 11 - 5).cast("double") * F.lit(0.0005)).alias("longitude"),
        (F.col("clat") + (step % 7 - 3).cast("double") * F.lit(0.0005)).alias("latitude"),
    )


def business_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The business view with the nested shape of the original records:
    ``categories`` array, ``attributes`` struct and ``hours`` map."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    b = business(spark, sf_dir)
    j = b.join(part, F.concat(F.lit("b"), F.col("p_partkey").cast("string")) == F.col("business_id"))
    return j.select(
        "business_id",
        "name",
        "city",
        "longitude",
        "latitude",
        F.array(F.col("category"), F.col("p_brand")).alias("categories"),
        F.struct(
            (F.col("p_size") % 2 == 0).alias("BikeParking"),
            (F.col("p_size") % 4 + 1).alias("RestaurantsPriceRange2"),
            F.struct((F.col("p_size") % 3 == 0).alias("casual")).alias("Ambience"),
        ).alias("attributes"),
        F.create_map(F.lit("Monday"), F.lit("9:0-17:0")).alias("hours"),
    )


def reviews_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with all nine columns: the rating, the order's date, and text and votes
    made from the line item's own columns."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    j = li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
    more = j.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("rid"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.concat(F.col("o_orderpriority"), F.lit(', "'), F.col("l_returnflag"), F.lit('"\n'), F.col("l_linestatus")).alias("text"),
        F.col("l_quantity").cast("int").alias("useful"), (F.col("l_suppkey") % 7).cast("int").alias("funny"),
        F.col("l_linenumber").cast("int").alias("cool"))
    r = ratings(spark, sf_dir).select("review_id", "user_id", "business_id", "stars")
    return r.join(more, F.col("review_id") == F.col("rid")).drop("rid")


def business_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Businesses with all fifteen columns, nested ones included."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("pid"), "p_partkey", "p_size")
    b = business_nested(spark, sf_dir).join(part, F.col("business_id") == F.col("pid"))
    k = F.col("p_partkey")
    return b.select(
        "business_id", "name", F.concat(F.lit("n"), (k % 9).cast("string")).alias("neighborhood"),
        F.concat(k.cast("string"), F.lit(", Main St")).alias("address"), "city", F.lit("QC").alias("state"),
        F.concat(F.lit("H"), (k % 1000).cast("string")).alias("postal_code"), "latitude", "longitude",
        ((k % 9 + 2) / 2.0).cast("double").alias("stars"), (k % 50).cast("int").alias("review_count"),
        (k % 2).cast("int").alias("is_open"), "attributes", "categories", "hours")
