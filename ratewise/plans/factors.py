"""Registered queries of the salted ALS: values that SQL can follow.

With rank 1 and user factors that start at 1, every half round is one quotient of sums per
entity, so an SQL engine can run the same rounds and compare each predicted value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.functions.columns import hash_bucket, round6
from ratewise.operators import als
from ratewise.operators import bias as B
from ratewise.operators.split import flag_split
from ratewise.plans.oracle import BUCKET, bias_sql
from ratewise.sources import views as V

ROUNDS = 3
REG = 0.1


def _half(name: str, key: str, other: str, known: str) -> str:
    return (f"{name} AS (SELECT {key}, sum(r * f) / (sum(f * f) + {REG} * count(*)) AS f FROM tr JOIN {known} USING ({other}) GROUP BY {key})")


_ROUNDS = ["""tr AS (SELECT t.user_id, t.business_id, t.stars - (um.user_mean + bm.business_mean - g.mu) AS r
  FROM train t JOIN um USING (user_id) JOIN bm USING (business_id) CROSS JOIN g)""",
           "u0 AS (SELECT DISTINCT user_id, CAST(1 AS DOUBLE) AS f FROM tr)"]
for _i in range(1, ROUNDS + 1):
    _ROUNDS += [_half(f"v{_i}", "business_id", "user_id", f"u{_i - 1}"), _half(f"u{_i}", "user_id", "business_id", f"v{_i}")]

SALTED_SQL = bias_sql(f"""
SELECT review_id, round(u.f * v.f, 6) AS prediction FROM test JOIN u{ROUNDS} u USING (user_id) JOIN v{ROUNDS} v USING (business_id)""", *_ROUNDS)

FOLD_SQL = bias_sql(f"""
SELECT review_id, w.f IS NOT NULL AND v.f IS NOT NULL AS covered, round(w.f * v.f, 6) AS prediction
FROM cold LEFT JOIN w USING (user_id) LEFT JOIN v{ROUNDS} v USING (business_id) WHERE bucket >= 50""", *_ROUNDS,
    f"""cold AS (SELECT review_id, user_id, business_id, stars - coalesce(bm.business_mean, g.mu) AS r, {BUCKET} AS bucket
  FROM test LEFT JOIN bm USING (business_id) CROSS JOIN g WHERE user_id NOT IN (SELECT user_id FROM train))""",
    f"""w AS (SELECT user_id, sum(r * f) / (sum(f * f) + {REG} * count(*)) AS f
  FROM cold JOIN v{ROUNDS} USING (business_id) WHERE bucket < 50 GROUP BY user_id)""")


def _fitted(train: DataFrame, bias: B.Bias) -> als.Factors:
    rows = B.with_residual(B.attach_means(train.select("user_id", "business_id", "stars"), bias, "inner"), bias)
    start = train.select(F.col("user_id").alias("id")).distinct().withColumn("f", F.array(F.lit(1.0)))
    return als.fit(rows, 1, ROUNDS, REG, start=start)


def m4_salted_als(spark: SparkSession, sf: str) -> DataFrame:
    """M4 with heavy users spread: the predicted residual of every test pair that was trained."""
    train, test = flag_split(V.ratings(spark, sf))
    model = _fitted(train, B.fit_bias(train))
    got = als.predict(test.select("review_id", "user_id", "business_id"), model.users, model.items)
    return got.where(F.col("prediction").isNotNull()).select("review_id", round6("prediction").alias("prediction"))


def m5_fold_in(spark: SparkSession, sf: str) -> DataFrame:
    """M5 for users that training didn't see: half of their ratings fold them in, the other
    half is predicted; ``covered`` tells these pairs from those left to the fallback."""
    train, test = flag_split(V.ratings(spark, sf))
    bias = B.fit_bias(train)
    model = _fitted(train, bias)
    cold = test.select("review_id", "user_id", "business_id", "stars").join(train.select("user_id").distinct(), "user_id", "left_anti")
    cold = cold.join(bias.items.select("business_id", "business_mean"), "business_id", "left")
    cold = cold.withColumn("residual", F.col("stars") - F.coalesce("business_mean", bias.mu)).withColumn("bucket", hash_bucket("review_id"))
    folded = als.fold_in(cold.where("bucket < 50"), model)
    got = als.predict(cold.where("bucket >= 50").select("review_id", "user_id", "business_id"), folded, model.items)
    return got.select("review_id", F.col("prediction").isNotNull().alias("covered"), round6("prediction").alias("prediction"))


QUERIES = {"m4_salted_als": m4_salted_als, "m5_fold_in": m5_fold_in}
ORACLE = {"m4_salted_als": SALTED_SQL, "m5_fold_in": FOLD_SQL}
