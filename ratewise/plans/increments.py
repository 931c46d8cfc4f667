"""Registered queries of loads in parts: lines in file order, records read in part, the bias
model from mergeable state, and PCA of the sparse rating matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.functions.columns import hash_bucket
from ratewise.operators.bias_state import add_batch, compact, load_bias
from ratewise.operators.sparse_pca import column_moments, pca_entries
from ratewise.plans.oracle import BUCKET, with_views
from ratewise.session import shared_path
from ratewise.sources import views as V
from ratewise.sources.io import REVIEW, partial_lines, read_reviews
from ratewise.sources.lines import chunk_lines, concat_in_order, numbered_lines

CHUNK = 500

CHUNKS_SQL = with_views(f"""
SELECT line, line // {CHUNK} AS chunk, review_id
FROM (SELECT review_id, row_number() OVER (ORDER BY stars < 3, review_id) - 1 AS line FROM ratings)""")

CONCAT_SQL = with_views("SELECT row_number() OVER (ORDER BY stars < 3, review_id) - 1 AS line, review_id FROM ratings")

PARTIAL_SQL = with_views("""
SELECT review_id, user_id, business_id, stars, CASE WHEN stars <> 1 THEN 3 END AS useful, stars = 1 AS is_partial FROM ratings""")

STATE_SQL = with_views(f"""
SELECT 'user' AS side, user_id AS key, count(*) AS n, round(avg(stars), 9) AS mean FROM held GROUP BY user_id
UNION ALL SELECT 'business', business_id, count(*), round(avg(stars), 9) FROM held GROUP BY business_id
UNION ALL SELECT 'all', '', count(*), round(avg(stars), 9) FROM held""", f"held AS (SELECT * FROM ratings WHERE {BUCKET} >= 10)")

MOMENTS_SQL = with_views("""
SELECT user_id, count(*) AS n_entries, round(sum(v) / n, 6) AS mean, round(sqrt((sum(v * v) - sum(v) * sum(v) / n) / (n - 1)), 6) AS std
FROM e CROSS JOIN (SELECT count(DISTINCT business_id) AS n FROM ratings) GROUP BY user_id, n""",
                         "e AS (SELECT business_id, user_id, max(stars) AS v FROM ratings GROUP BY ALL)")

TWO_SQL = with_views("""
SELECT scaled, component, round(value, 6) AS variance, round(value / total, 6) AS share FROM (
  SELECT FALSE AS scaled, 1 AS component, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS value, a + c AS total FROM m
  UNION ALL SELECT FALSE, 2, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b), a + c FROM m
  UNION ALL SELECT TRUE, 1, 1 + abs(b) / sqrt(a * c), 2 FROM m
  UNION ALL SELECT TRUE, 2, 1 - abs(b) / sqrt(a * c), 2 FROM m)""",
                     "g AS (SELECT business_id, count(*) FILTER (WHERE stars >= 4) AS x, count(*) FILTER (WHERE stars < 3) AS y FROM ratings GROUP BY 1)",
                     "m AS (SELECT var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM g)")


def _halves(spark: SparkSession, sf: str) -> list[str]:
    """Ids of the ratings as lines of two ordered datasets: three stars or more, then the rest."""
    out = []
    for name, part in (("high", F.col("stars") >= 3), ("low", F.col("stars") < 3)):
        path = shared_path(spark, f"lines-{name}")
        V.ratings(spark, sf).where(part).orderBy("review_id").select("review_id").write.text(path)
        out.append(path)
    return out


def s9_ordered_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk i of the concatenation holds its lines i * n to (i + 1) * n - 1, in order."""
    path = chunk_lines(numbered_lines(spark, _halves(spark, sf)), shared_path(spark, "chunks"), CHUNK)
    chunk = F.regexp_extract("file", "chunk=([0-9]+)", 1).cast("long")
    return numbered_lines(spark, path, with_file=True).select("line", chunk.alias("chunk"), F.col("value").alias("review_id"))


def s8_ordered_concat(spark: SparkSession, sf: str) -> DataFrame:
    """Two datasets one after the other, in line order."""
    path = concat_in_order(spark, _halves(spark, sf), shared_path(spark, "concat"))
    return numbered_lines(spark, path).withColumnRenamed("value", "review_id")


def s1_partial_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of one star carry a word where ``useful`` is a number; they keep all else."""
    line = F.to_json(F.struct("review_id", "user_id", "business_id", F.lit(3).alias("useful"), "stars"))
    path = shared_path(spark, "reviews-partial")
    V.ratings(spark, sf).select(F.when(F.col("stars") == 1, F.replace(line, F.lit('"useful":3'), F.lit('"useful":"many"'))).otherwise(line).alias("value")).write.text(path)
    part = partial_lines(spark, path, REVIEW).select(F.get_json_object("line", "$.review_id").alias("review_id"), F.lit(True).alias("is_partial"))
    return read_reviews(spark, path).join(part, "review_id", "left").select(
        "review_id", "user_id", "business_id", "stars", "useful", F.coalesce("is_partial", F.lit(False)).alias("is_partial"))


def m1_mergeable_bias(spark: SparkSession, sf: str) -> DataFrame:
    """M1: three batches added one by one, a part of the first taken back, and all compacted."""
    r, b = V.ratings(spark, sf), hash_bucket("review_id")
    path = shared_path(spark, "bias-state")
    for i, part in enumerate((b < 40, (b >= 40) & (b < 70), b >= 70)):
        add_batch(r.where(part), path, i)
    add_batch(r.where(b < 10), path, 3, take_back=True)
    m = load_bias(spark, compact(spark, path, shared_path(spark, "bias-compact")))

    def side(df: DataFrame, key: str, p: str) -> DataFrame:
        return df.select(F.lit(p).alias("side"), F.col(key).alias("key"), F.col(f"{p}_count").alias("n"), F.round(f"{p}_mean", 9).alias("mean"))

    whole = m.users.agg(F.sum("user_count").alias("n")).select(F.lit("all").alias("side"), F.lit("").alias("key"), "n", F.round(m.mu, 9).alias("mean"))
    return side(m.users, "user_id", "user").unionByName(side(m.items, "business_id", "business")).unionByName(whole)


def _matrix(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """The rating matrix by the ids themselves, and its number of rows."""
    r = V.stars(spark, sf)
    e = r.groupBy(F.col("business_id").alias("row_ix"), F.col("user_id").alias("col_ix")).agg(F.max("stars").alias("value"))
    return e, r.select("business_id").distinct().count()


def m28_sparse_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and deviation of every user's column of the rating matrix, absent cells as 0."""
    return column_moments(*_matrix(spark, sf)).select(
        F.col("col_ix").alias("user_id"), "n_entries", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _variances(spark: SparkSession, model, **more) -> DataFrame:
    rows = [(i + 1, float(v), float(s)) for i, (v, s) in enumerate(zip(model.values, model.shares(), strict=True))]
    df = spark.createDataFrame(rows, "component int, variance double, share double")
    return df.select(*[F.lit(v).alias(k) for k, v in more.items()], "component", F.round("variance", 6).alias("variance"), F.round("share", 6).alias("share"))


def m26_sparse_two_columns(spark: SparkSession, sf: str) -> DataFrame:
    """PCA, plain and scaled, of each business's counts of high and low ratings (zeros absent)."""
    r = V.ratings(spark, sf)
    level = F.when(F.col("stars") >= 4, "high").when(F.col("stars") < 3, "low")
    e = r.where(level.isNotNull()).groupBy(F.col("business_id").alias("row_ix"), level.alias("col_ix")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    n = r.select("business_id").distinct().count()
    return _variances(spark, pca_entries(e, n, 2), scaled=False).unionByName(_variances(spark, pca_entries(e, n, 2, scaled=True), scaled=True))


def m26_sparse_pca(spark: SparkSession, sf: str) -> DataFrame:
    """The first three components of the businesses over all users' columns."""
    e, n = _matrix(spark, sf)
    return _variances(spark, pca_entries(e, n, 3))


QUERIES = {f.__name__: f for f in (s9_ordered_chunks, s8_ordered_concat, s1_partial_records, m1_mergeable_bias, m28_sparse_columns,
                                   m26_sparse_two_columns, m26_sparse_pca)}
ORACLE = {"s9_ordered_chunks": CHUNKS_SQL, "s8_ordered_concat": CONCAT_SQL, "s1_partial_records": PARTIAL_SQL, "m1_mergeable_bias": STATE_SQL,
          "m28_sparse_columns": MOMENTS_SQL, "m26_sparse_two_columns": TWO_SQL}
