"""Registered queries: one Spark callable (spark, sf_dir) -> DataFrame per operator,
and, where the operator is SQL-expressible, the DuckDB oracle text.

Keys are ``<operator id>_<name>`` after SURVEY §2.  Every query runs over the
whole driver tables (through the stand-in views); float outputs are rounded
to 6 digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.functions.columns import (
    fallback_rating,
    first_item,
    hash_bucket,
    round6,
    strip_ws,
)
from ratewise.operators import bias as B
from ratewise.operators import evaluate as E
from ratewise.operators import prep as P
from ratewise.operators import split as S
from ratewise.operators import stats as ST
from ratewise.plans.oracle import bias_sql, with_views, CITY
from ratewise.sources import views as V

MIN_BUSINESS = 0
MIN_USER = 25
CITY_NAME = "Montreal"
CITY_EXCLUDE = ("small ring",)

QUERIES: dict = {}
ORACLE: dict = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return deco


# ---------------------------------------------------------------- shared steps

def _split(spark: SparkSession, sf: str):
    r = V.ratings(spark, sf)
    train, test = S.flag_split(r)
    return r, train, test


def _scored_bias(spark: SparkSession, sf: str):
    """Test rows with means, counts and the bias-only final rating (prediction 0)."""
    _, train, test = _split(spark, sf)
    bias = B.fit_bias(train)
    t = B.attach_means(test.select("review_id", "user_id", "business_id", "stars"), bias, "left", counts=True)
    t = B.with_final_rating(t.withColumn("prediction", F.lit(0.0)), bias)
    return t, bias


def _r(df: DataFrame, *cols: str) -> DataFrame:
    """Round the named double columns to 6 digits."""
    for c in cols:
        df = df.withColumn(c, round6(c))
    return df


# ---------------------------------------------------------------- sources, projections

@register("s14_first_n", with_views(
    "SELECT review_id, user_id, business_id, stars FROM ratings ORDER BY review_id LIMIT 1000"))
def s14_first_n(spark, sf):
    from ratewise.sources.io import first_n

    return first_n(V.ratings(spark, sf).select("review_id", "user_id", "business_id", "stars"), 1000, "review_id")


@register("s17_read_table", with_views("SELECT review_id, user_id, business_id, stars FROM ratings"))
def s17_read_table(spark, sf):
    from ratewise.sources.io import read_table

    V.ratings(spark, sf).createOrReplaceTempView("ratings_view")
    return read_table(spark, "ratings_view", 8).select("review_id", "user_id", "business_id", "stars")


@register("p1_training_columns", with_views("SELECT user_id, business_id, stars FROM ratings WHERE NOT is_test"))
def p1_training_columns(spark, sf):
    _, train, _ = _split(spark, sf)
    return train.select(*P.TRAIN_COLUMNS)


@register("p1_city_review_columns", with_views("""
SELECT review_id, user_id, business_id, stars, strftime(x.date, '%Y-%m-%d') AS date, x.text, x.useful, x.funny, x.cool
FROM ratings JOIN extra x ON x.rid = review_id""", """extra AS (SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS rid,
  CAST(o_orderdate AS DATE) AS date, o_orderpriority || ', "' || l_returnflag || '"' || chr(10) || l_linestatus AS text,
  CAST(l_quantity AS INTEGER) AS useful, CAST(l_suppkey % 7 AS INTEGER) AS funny, l_linenumber AS cool
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""))
def p1_city_review_columns(spark, sf):
    """The review projection with all nine columns."""
    from ratewise.sources.io import REVIEW

    return V.reviews_full(spark, sf).select(*REVIEW.fieldNames()).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@register("i3_random_split", with_views("SELECT count(*) AS n, TRUE AS near_share, TRUE AS complete FROM ratings"))
def i3_random_split(spark, sf):
    """The row-level 80/20 split: complete, disjoint, and close to its weights."""
    r = V.ratings(spark, sf).select("review_id")
    a, b = S.random_split(r, (0.8, 0.2), seed=1)
    back = a.unionByName(b)
    lost = r.exceptAll(back).unionByName(back.exceptAll(r)).agg(F.count(F.lit(1))).scalar()
    both = a.select(F.lit(1).alias("train")).unionByName(b.select(F.lit(0).alias("train")))
    return both.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg("train") - 0.8) < 0.05).alias("near_share")).select(
        "n", "near_share", (lost == 0).alias("complete"))


@register("p2_filter_city", with_views(
    "SELECT business_id, name, city, longitude, latitude FROM city_biz", CITY))
def p2_filter_city(spark, sf):
    b = P.filter_city(V.business(spark, sf), CITY_NAME, CITY_EXCLUDE)
    return b.select("business_id", "name", "city", "longitude", "latitude")


@register("p3_star_strata", bias_sql("""
SELECT stratum, n, round(rmse, 6) AS rmse FROM (
  SELECT 'all' AS stratum, count(*) AS n, sqrt(avg(pow(stars - final_rating, 2))) AS rmse FROM scored
  UNION ALL SELECT 'high', count(*), sqrt(avg(pow(stars - final_rating, 2))) FROM scored WHERE final_rating >= 3
  UNION ALL SELECT 'low', count(*), sqrt(avg(pow(stars - final_rating, 2))) FROM scored WHERE final_rating < 3)"""))
def p3_star_strata(spark, sf):
    t, _ = _scored_bias(spark, sf)
    return _r(E.stratified_rmse(t, E.star_strata("final_rating", 3.0)), "rmse")


@register("p4_filter_active", bias_sql(f"""
SELECT review_id, user_count, business_count FROM scored
WHERE business_count > {MIN_BUSINESS} AND user_count > {MIN_USER}"""))
def p4_filter_active(spark, sf):
    t, _ = _scored_bias(spark, sf)
    return E.filter_active(t, MIN_BUSINESS, MIN_USER).select("review_id", "user_count", "business_count")


@register("p5_where_category", with_views(
    "SELECT business_id, name, category FROM business WHERE category = 'ECONOMY'"))
def p5_where_category(spark, sf):
    return P.where_value(V.business(spark, sf), "category", "ECONOMY").select("business_id", "name", "category")


@register("p6_residual", bias_sql("""
SELECT t.review_id, round(t.stars - (um.user_mean + bm.business_mean - g.mu), 6) AS residual
FROM train t JOIN um USING (user_id) JOIN bm USING (business_id) CROSS JOIN g"""))
def p6_residual(spark, sf):
    _, train, _ = _split(spark, sf)
    bias = B.fit_bias(train)
    t = B.attach_means(train, bias, "inner")
    return _r(B.with_residual(t, bias).select("review_id", "residual"), "residual")


@register("p7_rename", with_views(
    "SELECT user_id AS reviewer, business_id AS place, stars AS rating FROM ratings"))
def p7_rename(spark, sf):
    r = V.ratings(spark, sf).select("user_id", "business_id", "stars")
    return r.withColumnRenamed("user_id", "reviewer").withColumnRenamed("business_id", "place").withColumnRenamed(
        "stars", "rating")


@register("p8_drop_columns", with_views("SELECT review_id, user_id, business_id, stars FROM ratings"))
def p8_drop_columns(spark, sf):
    return V.ratings(spark, sf).drop("is_test")


@register("p9_fallback_rating", bias_sql(f"""
SELECT review_id, round(CASE WHEN business_count > {MIN_BUSINESS} AND user_count > {MIN_USER} THEN final_rating
                             WHEN business_count > {MIN_BUSINESS} THEN business_mean
                             WHEN user_count > {MIN_USER} THEN user_mean
                             ELSE mu END, 6) AS fallback_rating,
       CASE WHEN business_count > {MIN_BUSINESS} AND user_count > {MIN_USER} THEN 'both'
            WHEN business_count > {MIN_BUSINESS} THEN 'business'
            WHEN user_count > {MIN_USER} THEN 'user' ELSE 'neither' END AS branch
FROM scored"""))
def p9_fallback_rating(spark, sf):
    t, bias = _scored_bias(spark, sf)
    ok_b, ok_u = F.col("business_count") > MIN_BUSINESS, F.col("user_count") > MIN_USER
    branch = (
        F.when(ok_b & ok_u, "both").when(ok_b, "business").when(ok_u, "user").otherwise("neither")
    )
    fb = fallback_rating("final_rating", "user_mean", "business_mean", bias.mu, "business_count", "user_count",
                         MIN_BUSINESS, MIN_USER)
    return t.select("review_id", round6(fb).alias("fallback_rating"), branch.alias("branch"))


@register("p10_fill_means", bias_sql("""
SELECT review_id, round(user_mean, 6) AS user_mean, round(business_mean, 6) AS business_mean,
       user_count, business_count FROM scored"""))
def p10_fill_means(spark, sf):
    t, _ = _scored_bias(spark, sf)
    return _r(t.select("review_id", "user_mean", "business_mean", "user_count", "business_count"),
              "user_mean", "business_mean")


@register("f1_strip_ws", with_views(
    "SELECT review_id, regexp_replace(' ' || chr(9) || user_id || chr(10) || ' ', '^\\s+|\\s+$', '', 'g') AS user_id FROM ratings"))
def f1_strip_ws(spark, sf):
    r = V.ratings(spark, sf)
    padded = F.concat(F.lit(" \t"), F.col("user_id"), F.lit("\n "))
    return r.select("review_id", strip_ws(padded).alias("user_id"))


@register("f3_first_category", with_views(
    "SELECT business_id, category AS first_category FROM business"))
def f3_first_category(spark, sf):
    b = V.business_nested(spark, sf)
    return b.select("business_id", first_item("categories").alias("first_category"))


@register("f8_arithmetic", with_views("""
SELECT review_id, stars + 1 AS plus_one, stars - 1 AS minus_one, stars / 2 AS half,
       (stars >= 3 AND stars < 4.5) AS mid FROM ratings"""))
def f8_arithmetic(spark, sf):
    s = F.col("stars")
    return V.ratings(spark, sf).select(
        "review_id", (s + 1).alias("plus_one"), (s - 1).alias("minus_one"), (s / 2).alias("half"),
        ((s >= 3) & (s < 4.5)).alias("mid"))


@register("f9_pow_sqrt", with_views(
    "SELECT review_id, pow(stars, 2) AS sq, round(sqrt(stars), 6) AS root FROM ratings"))
def f9_pow_sqrt(spark, sf):
    s = F.col("stars")
    return V.ratings(spark, sf).select("review_id", F.pow(s, 2).alias("sq"), round6(F.sqrt(s)).alias("root"))


# ---------------------------------------------------------------- joins

@register("j1_attach_means_inner", bias_sql("""
SELECT t.review_id, t.user_id, t.business_id, t.stars, round(um.user_mean, 6) AS user_mean,
       round(bm.business_mean, 6) AS business_mean
FROM train t JOIN um USING (user_id) JOIN bm USING (business_id)"""))
def j1_attach_means_inner(spark, sf):
    _, train, _ = _split(spark, sf)
    bias = B.fit_bias(train)
    t = B.attach_means(train.select("review_id", "user_id", "business_id", "stars"), bias, "inner")
    return _r(t, "user_mean", "business_mean")


@register("j2_attach_means_left", bias_sql("""
SELECT t.review_id, round(um.user_mean, 6) AS user_mean, round(bm.business_mean, 6) AS business_mean
FROM test t LEFT JOIN um USING (user_id) LEFT JOIN bm USING (business_id)"""))
def j2_attach_means_left(spark, sf):
    _, train, test = _split(spark, sf)
    bias = B.fit_bias(train)
    t = B.attach_means(test.select("review_id", "user_id", "business_id"), bias, "left", fill=False)
    return _r(t.select("review_id", "user_mean", "business_mean"), "user_mean", "business_mean")


@register("j3_reviews_in_city", with_views("""
SELECT r.review_id, r.user_id, r.business_id, r.stars, b.city
FROM ratings r JOIN city_biz b ON r.business_id = b.business_id""", CITY))
def j3_reviews_in_city(spark, sf):
    return P.reviews_in_city(V.ratings(spark, sf), V.business(spark, sf), CITY_NAME, CITY_EXCLUDE,
                             ["review_id", "user_id", "business_id", "stars"])


@register("j6_join_pairs", bias_sql("""
SELECT t.review_id, t.stars AS test_stars, round(p.pair_mean, 6) AS train_pair_mean
FROM test t JOIN (SELECT user_id, business_id, avg(stars) AS pair_mean FROM train GROUP BY user_id, business_id) p
  USING (user_id, business_id)"""))
def j6_join_pairs(spark, sf):
    _, train, test = _split(spark, sf)
    pairs = train.groupBy("user_id", "business_id").agg(F.avg("stars").alias("train_pair_mean"))
    j = test.join(pairs, ["user_id", "business_id"])
    return _r(j.select("review_id", F.col("stars").alias("test_stars"), "train_pair_mean"), "train_pair_mean")


# ---------------------------------------------------------------- aggregates

@register("a1_user_mean", bias_sql("SELECT user_id, round(user_mean, 6) AS user_mean FROM um"))
def a1_user_mean(spark, sf):
    _, train, _ = _split(spark, sf)
    return _r(B.entity_mean(train, "user_id", name="user_mean"), "user_mean")


@register("a2_business_mean", bias_sql("SELECT business_id, round(business_mean, 6) AS business_mean FROM bm"))
def a2_business_mean(spark, sf):
    _, train, _ = _split(spark, sf)
    return _r(B.entity_mean(train, "business_id", name="business_mean"), "business_mean")


@register("a3_global_mean", bias_sql("SELECT round(mu, 6) AS mu FROM g"))
def a3_global_mean(spark, sf):
    _, train, _ = _split(spark, sf)
    return spark.range(1).select(round6(B.global_mean(train)).alias("mu"))


@register("a4_business_count", bias_sql("SELECT business_id, business_count FROM bm"))
def a4_business_count(spark, sf):
    _, train, _ = _split(spark, sf)
    return B.entity_count(train, "business_id", "business_count")


@register("a4_user_count", bias_sql("SELECT user_id, user_count FROM um"))
def a4_user_count(spark, sf):
    _, train, _ = _split(spark, sf)
    return B.entity_count(train, "user_id", "user_count")


@register("a5_distinct_users", with_views("SELECT DISTINCT user_id FROM ratings"))
def a5_distinct_users(spark, sf):
    return ST.distinct_keys(V.ratings(spark, sf), "user_id")


@register("a6_dataset_stats", with_views("""
SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT business_id) AS n_businesses
FROM ratings"""))
def a6_dataset_stats(spark, sf):
    return ST.dataset_stats(V.ratings(spark, sf))


@register("a7_density", with_views("""
SELECT n_rows, n_users, n_businesses, round(n_rows / n_users, 6) AS reviews_per_user,
       round(n_rows / n_businesses, 6) AS reviews_per_business
FROM (SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT business_id) AS n_businesses
      FROM ratings)"""))
def a7_density(spark, sf):
    return _r(ST.density(V.ratings(spark, sf)), "reviews_per_user", "reviews_per_business")


@register("a12_user_spread", with_views("""
SELECT user_id, round(stddev_samp(stars), 6) AS stars_stddev, max(stars) - min(stars) AS stars_range
FROM ratings GROUP BY user_id"""))
def a12_user_spread(spark, sf):
    return _r(ST.user_spread(V.ratings(spark, sf)), "stars_stddev")


@register("a14_describe_by", with_views("""
SELECT business_id, round(avg(stars), 6) AS mean, round(stddev_samp(stars), 6) AS stddev, count(*) AS n
FROM ratings GROUP BY business_id"""))
def a14_describe_by(spark, sf):
    return _r(ST.describe_by(V.ratings(spark, sf), "business_id"), "mean", "stddev")


@register("a16_mae", bias_sql("SELECT count(*) AS n, round(avg(abs(stars - final_rating)), 6) AS mae FROM scored"))
def a16_mae(spark, sf):
    t, _ = _scored_bias(spark, sf)
    return _r(E.mae(t), "mae")


# ---------------------------------------------------------------- ids and splits

@register("i1_dense_index", with_views("""
SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_ix
FROM (SELECT DISTINCT user_id FROM ratings WHERE NOT is_test)"""))
def i1_dense_index(spark, sf):
    _, train, _ = _split(spark, sf)
    return S.dense_index(train, "user_id", "user_ix")


@register("i2_row_index", with_views("""
SELECT business_id, row_number() OVER (ORDER BY business_id DESC) - 1 AS row_ix
FROM (SELECT DISTINCT business_id FROM ratings)"""))
def i2_row_index(spark, sf):
    return S.dense_index(V.ratings(spark, sf), "business_id", "row_ix", descending=True)


@register("i3_hash_split", with_views(
    "SELECT review_id, user_id FROM ratings WHERE CAST('0x' || substr(md5(user_id),1,8) AS BIGINT) % 100 >= 80"))
def i3_hash_split(spark, sf):
    _, test = S.hash_split(V.ratings(spark, sf), "user_id", 20)
    return test.select("review_id", "user_id")


@register("m2_apply_index", with_views("""
SELECT t.review_id, coalesce(u.user_ix, -1) AS user_ix, coalesce(b.business_ix, -1) AS business_ix
FROM (SELECT * FROM ratings WHERE is_test) t
LEFT JOIN (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_ix
           FROM (SELECT DISTINCT user_id FROM ratings WHERE NOT is_test)) u USING (user_id)
LEFT JOIN (SELECT business_id, row_number() OVER (ORDER BY business_id) - 1 AS business_ix
           FROM (SELECT DISTINCT business_id FROM ratings WHERE NOT is_test)) b USING (business_id)"""))
def m2_apply_index(spark, sf):
    _, train, test = _split(spark, sf)
    ui = S.dense_index(train, "user_id", "user_ix")
    bi = S.dense_index(train, "business_id", "business_ix")
    t = S.apply_index(test.select("review_id", "user_id", "business_id"), ui, "user_id", "user_ix")
    t = S.apply_index(t, bi, "business_id", "business_ix")
    return t.select("review_id", "user_ix", "business_ix")


# ---------------------------------------------------------------- bias model and evaluation

@register("m1_bias_model", bias_sql("""
SELECT 'user' AS entity, user_id AS entity_id, round(user_mean, 6) AS mean, user_count AS n FROM um
UNION ALL SELECT 'business', business_id, round(business_mean, 6), business_count FROM bm
UNION ALL SELECT 'global', '*', round(mu, 6), (SELECT count(*) FROM train) FROM g"""))
def m1_bias_model(spark, sf):
    _, train, _ = _split(spark, sf)
    bias = B.fit_bias(train)
    u = bias.users.select(F.lit("user").alias("entity"), F.col("user_id").alias("entity_id"),
                          F.col("user_mean").alias("mean"), F.col("user_count").alias("n"))
    b = bias.items.select(F.lit("business").alias("entity"), F.col("business_id").alias("entity_id"),
                          F.col("business_mean").alias("mean"), F.col("business_count").alias("n"))
    g = train.agg(F.lit("global").alias("entity"), F.lit("*").alias("entity_id"), F.avg("stars").alias("mean"),
                  F.count(F.lit(1)).alias("n"))
    return _r(u.unionByName(b).unionByName(g), "mean")


@register("m3_residual_identity", bias_sql("""
SELECT t.review_id, round(t.stars - (um.user_mean + bm.business_mean - g.mu) + (um.user_mean + bm.business_mean - g.mu), 6) AS stars_back
FROM train t JOIN um USING (user_id) JOIN bm USING (business_id) CROSS JOIN g"""))
def m3_residual_identity(spark, sf):
    """Residual plus the bias model gives the rating back (a round-trip property)."""
    _, train, _ = _split(spark, sf)
    bias = B.fit_bias(train)
    t = B.with_residual(B.attach_means(train, bias, "inner"), bias)
    t = B.with_final_rating(t, bias, prediction="residual", name="stars_back")
    return _r(t.select("review_id", "stars_back"), "stars_back")


@register("m6_final_rating", bias_sql("SELECT review_id, round(final_rating, 6) AS final_rating FROM scored"))
def m6_final_rating(spark, sf):
    t, _ = _scored_bias(spark, sf)
    return _r(t.select("review_id", "final_rating"), "final_rating")


@register("m7_rmse", bias_sql(
    "SELECT count(*) AS n, round(sqrt(avg(pow(stars - final_rating, 2))), 6) AS rmse FROM scored"))
def m7_rmse(spark, sf):
    t, _ = _scored_bias(spark, sf)
    return _r(E.rmse(t), "rmse")


@register("m8_stratified_rmse", bias_sql(f"""
SELECT stratum, n, round(rmse, 6) AS rmse FROM (
  SELECT 'all' AS stratum, count(*) AS n, sqrt(avg(pow(stars - final_rating, 2))) AS rmse FROM scored
  UNION ALL SELECT 'popular', count(*), sqrt(avg(pow(stars - final_rating, 2))) FROM scored WHERE business_count > {MIN_BUSINESS}
  UNION ALL SELECT 'power', count(*), sqrt(avg(pow(stars - final_rating, 2))) FROM scored WHERE user_count > {MIN_USER}
  UNION ALL SELECT 'popular_power', count(*), sqrt(avg(pow(stars - final_rating, 2))) FROM scored
            WHERE business_count > {MIN_BUSINESS} AND user_count > {MIN_USER})"""))
def m8_stratified_rmse(spark, sf):
    t, _ = _scored_bias(spark, sf)
    return _r(E.stratified_rmse(t, E.activity_strata(MIN_BUSINESS, MIN_USER)), "rmse")


@register("m9_baselines", bias_sql("""
SELECT baseline, n, round(rmse, 6) AS rmse FROM (
  SELECT 'business_mean' AS baseline, count(*) AS n, sqrt(avg(pow(stars - business_mean, 2))) AS rmse FROM scored
  UNION ALL SELECT 'user_mean', count(*), sqrt(avg(pow(stars - user_mean, 2))) FROM scored
  UNION ALL SELECT 'mean_of_means', count(*), sqrt(avg(pow(stars - (user_mean + business_mean) / 2, 2))) FROM scored
  UNION ALL SELECT 'bias_only', count(*), sqrt(avg(pow(stars - final_rating, 2))) FROM scored)"""))
def m9_baselines(spark, sf):
    t, _ = _scored_bias(spark, sf)
    return _r(E.baseline_rmse(t, extra={"bias_only": F.col("final_rating")}), "rmse")


@register("m10_fallback_rmse", bias_sql(f"""
SELECT branch, count(*) AS n, round(sqrt(avg(pow(stars - fb, 2))), 6) AS rmse FROM (
  SELECT stars,
         CASE WHEN business_count > {MIN_BUSINESS} AND user_count > {MIN_USER} THEN final_rating
              WHEN business_count > {MIN_BUSINESS} THEN business_mean
              WHEN user_count > {MIN_USER} THEN user_mean ELSE mu END AS fb,
         CASE WHEN business_count > {MIN_BUSINESS} AND user_count > {MIN_USER} THEN 'both'
              WHEN business_count > {MIN_BUSINESS} THEN 'business'
              WHEN user_count > {MIN_USER} THEN 'user' ELSE 'neither' END AS branch FROM scored)
GROUP BY ROLLUP (branch)"""))
def m10_fallback_rmse(spark, sf):
    t, bias = _scored_bias(spark, sf)
    ok_b, ok_u = F.col("business_count") > MIN_BUSINESS, F.col("user_count") > MIN_USER
    t = t.select(
        "stars",
        fallback_rating("final_rating", "user_mean", "business_mean", bias.mu, "business_count", "user_count",
                        MIN_BUSINESS, MIN_USER).alias("fb"),
        F.when(ok_b & ok_u, "both").when(ok_b, "business").when(ok_u, "user").otherwise("neither").alias("branch"),
    )
    return _r(t.rollup("branch").agg(F.count(F.lit(1)).alias("n"),
                                     F.sqrt(F.avg(F.pow(F.col("stars") - F.col("fb"), 2))).alias("rmse")), "rmse")


@register("m11_report", bias_sql("""
SELECT metric, n, round(value, 6) AS value, config FROM (
  SELECT 'business_mean' AS metric, count(*) AS n, sqrt(avg(pow(stars - business_mean, 2))) AS value, 'bias' AS config FROM scored
  UNION ALL SELECT 'user_mean', count(*), sqrt(avg(pow(stars - user_mean, 2))), 'bias' FROM scored
  UNION ALL SELECT 'mean_of_means', count(*), sqrt(avg(pow(stars - (user_mean + business_mean) / 2, 2))), 'bias' FROM scored
  UNION ALL SELECT 'all', count(*), sqrt(avg(pow(stars - final_rating, 2))), 'stars>=3' FROM scored
  UNION ALL SELECT 'high', count(*), sqrt(avg(pow(stars - final_rating, 2))), 'stars>=3' FROM scored WHERE final_rating >= 3
  UNION ALL SELECT 'low', count(*), sqrt(avg(pow(stars - final_rating, 2))), 'stars>=3' FROM scored WHERE final_rating < 3)"""))
def m11_report(spark, sf):
    t, _ = _scored_bias(spark, sf)
    rep = E.report([
        (E.baseline_rmse(t), "baseline", "bias"),
        (E.stratified_rmse(t, E.star_strata()), "stratum", "stars>=3"),
    ])
    return _r(rep, "value")


@register("m33_prepare_city", with_views("""
SELECT r.review_id, r.user_id, r.business_id, r.stars, b.city, b.name
FROM ratings r JOIN city_biz b ON r.business_id = b.business_id""", CITY))
def m33_prepare_city(spark, sf):
    return P.reviews_in_city(V.ratings(spark, sf), V.business(spark, sf), CITY_NAME, CITY_EXCLUDE,
                             ["review_id", "user_id", "business_id", "stars"], ["city", "name"])


REVIEW_EXTRA = """extra AS (SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS rid,
  CAST(o_orderdate AS DATE) AS date, o_orderpriority || ', "' || l_returnflag || '"' || chr(10) || l_linestatus AS text,
  CAST(l_quantity AS INTEGER) AS useful, CAST(l_suppkey % 7 AS INTEGER) AS funny, l_linenumber AS cool
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _city_files(spark, sf):
    """The city's businesses and reviews with all columns, written as JSON and CSV."""
    from ratewise.sources.io import write_csv, write_json

    biz, reviews = P.prepare_city(V.reviews_full(spark, sf), V.business_full(spark, sf), CITY_NAME, CITY_EXCLUDE)
    return write_csv(biz, _out(spark, "city-csv")), write_json(biz, _out(spark, "city-json")), write_json(reviews, _out(spark, "city-reviews"), compression="gzip")


@register("m33_city_reviews_file", with_views("""
SELECT r.review_id, r.user_id, r.business_id, r.stars, strftime(x.date, '%Y-%m-%d') AS date, x.text, x.useful, x.funny, x.cool, b.city
FROM ratings r JOIN city_biz b USING (business_id) JOIN extra x ON x.rid = r.review_id""", CITY, REVIEW_EXTRA))
def m33_city_reviews_file(spark, sf):
    """All ten review columns of a city, read back from the JSON sink."""
    from pyspark.sql import types as T

    from ratewise.sources.io import REVIEW, read_reviews

    schema = T.StructType([*REVIEW.fields, T.StructField("city", T.StringType())])
    back = read_reviews(spark, _city_files(spark, sf)[2], schema)
    return back.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@register("m33_city_business_files", with_views("""
SELECT b.business_id, b.name, 'n' || (p_partkey % 9) AS neighborhood, p_partkey || ', Main St' AS address, b.city, 'QC' AS state,
  'H' || (p_partkey % 1000) AS postal_code, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
  (p_partkey % 9 + 2) / 2.0::DOUBLE AS stars, CAST(p_partkey % 50 AS INTEGER) AS review_count, CAST(p_partkey % 2 AS INTEGER) AS is_open,
  p_size % 4 + 1 AS price, p_brand AS second_category, '9:0-17:0' AS monday, TRUE AS csv_same
FROM city_biz b JOIN part ON b.business_id = concat('b', CAST(p_partkey AS STRING))""", CITY))
def m33_city_business_files(spark, sf):
    """All fifteen business columns of a city, read back from the JSON and CSV sinks; the
    CSV holds nested columns as JSON text and must agree with the JSON."""
    from ratewise.sources.io import attribute, read_business, read_csv

    csv, json, _ = _city_files(spark, sf)
    b = read_business(spark, json)
    plain = ["name", "neighborhood", "address", "city", "state", "postal_code", "latitude", "longitude", "stars", "review_count", "is_open"]
    c = read_csv(spark, csv).select(F.col("business_id").alias("cid"), *[F.col(x).alias(f"c_{x}") for x in plain],
                                    F.col("categories").alias("c_categories"), F.col("hours").alias("c_hours"), F.col("attributes").alias("c_attributes"))
    same = F.lit(True)
    for x in plain:
        same = same & (F.col(f"c_{x}").cast(dict(b.dtypes)[x]) == F.col(x))
    same = same & (F.to_json("categories") == F.col("c_categories")) & (F.to_json("hours") == F.col("c_hours"))
    same = same & (F.get_json_object("c_attributes", "$.RestaurantsPriceRange2") == attribute("RestaurantsPriceRange2"))
    j = b.join(c, F.col("business_id") == F.col("cid"))
    return _r(j.select("business_id", *plain, attribute("RestaurantsPriceRange2").cast("int").alias("price"),
                       F.get("categories", 1).alias("second_category"), F.col("hours")["Monday"].alias("monday"), same.alias("csv_same")),
              "latitude", "longitude")


# ---------------------------------------------------------------- sort / set operations

@register("t1_sort_by_count", with_views(
    "SELECT business_id, count(*) AS n FROM ratings GROUP BY business_id ORDER BY n DESC"))
def t1_sort_by_count(spark, sf):
    return ST.count_by(V.ratings(spark, sf), "business_id").orderBy(F.desc("n"))


@register("u1_union_all", with_views("""
SELECT review_id, stars FROM ratings WHERE NOT is_test
UNION ALL SELECT review_id, stars FROM ratings WHERE is_test"""))
def u1_union_all(spark, sf):
    _, train, test = _split(spark, sf)
    from ratewise.sources.io import union_all

    return union_all(train.select("review_id", "stars"), test.select("review_id", "stars"))


# ---------------------------------------------------------------- ALS (not SQL-expressible: rows-only checks)

_ALS_MEMO: dict = {}
# The settings that the fixtures state; the library's own defaults are the original's.
FIXTURE_ALS = {"rank": 10, "reg": 0.1, "min_user": MIN_USER}


def _als(spark, sf, **kw):
    """One fit per application, scale and configuration, shared by the queries that
    read its predictions or factors (the fit is deterministic for a fixed seed)."""
    from ratewise.plans.recommender import RecommenderConfig, run_recommender

    cfg = dict(FIXTURE_ALS) | kw
    key = (V.fingerprint(spark, sf), tuple(sorted(cfg.items())))
    if key not in _ALS_MEMO:
        _, train, test = _split(spark, sf)
        _ALS_MEMO[key] = run_recommender(train, test, RecommenderConfig(**cfg))
    return _ALS_MEMO[key]


@register("m4_als_predictions", bias_sql("""
SELECT t.review_id, um.user_id IS NOT NULL AND bm.business_id IS NOT NULL AS has_prediction, TRUE AS finite
FROM test t LEFT JOIN um USING (user_id) LEFT JOIN bm USING (business_id)"""))
def m4_als_predictions(spark, sf):
    res = _als(spark, sf)
    finite = F.abs(F.col("prediction") + F.col("final_rating") + F.col("fallback_rating")) < F.lit(1e6)
    return res.scored.select("review_id", "has_prediction", finite.alias("finite"))


@register("m4_als_values")
def m4_als_values(spark, sf):
    res = _als(spark, sf)
    return res.scored.select("review_id", "prediction", "final_rating", "fallback_rating")


@register("m5_predict_drop", bias_sql(
    "SELECT t.review_id FROM test t JOIN um USING (user_id) JOIN bm USING (business_id)"))
def m5_predict_drop(spark, sf):
    from ratewise.operators.recommend import predict_als

    res = _als(spark, sf)
    return predict_als(res.model, res.test_indexed, cold="drop").select("review_id")


@register("m11_als_report")
def m11_als_report(spark, sf):
    from ratewise.plans.recommender import metrics

    return metrics(_als(spark, sf))


@register("m11_report_counts", bias_sql(f"""
SELECT metric, CAST(n AS BIGINT) AS n FROM (
  SELECT 'als_bias' AS metric, count(*) AS n FROM scored
  UNION ALL SELECT 'als_bias_predicted_pairs', count(*) FROM test t JOIN um USING (user_id) JOIN bm USING (business_id)
  UNION ALL SELECT 'als_bias_popular', count(*) FROM scored WHERE business_count > {MIN_BUSINESS}
  UNION ALL SELECT 'als_bias_power', count(*) FROM scored WHERE user_count > {MIN_USER}
  UNION ALL SELECT 'als_bias_popular_power', count(*) FROM scored WHERE business_count > {MIN_BUSINESS} AND user_count > {MIN_USER}
  UNION ALL SELECT 'bias_only', count(*) FROM scored
  UNION ALL SELECT 'business_mean', count(*) FROM scored
  UNION ALL SELECT 'user_mean', count(*) FROM scored)"""))
def m11_report_counts(spark, sf):
    """How many test rows each figure of the report covers."""
    from ratewise.plans.recommender import metrics

    names = ["als_bias", "als_bias_predicted_pairs", "als_bias_popular", "als_bias_power", "als_bias_popular_power",
             "bias_only", "business_mean", "user_mean"]
    return metrics(_als(spark, sf)).where(F.col("metric").isin(names)).select("metric", "n")


@register("m12_sweep", bias_sql("""
SELECT r AS rank, CAST(0.01 AS DOUBLE) AS reg, count(*) AS n, TRUE AS near_bias
FROM scored, (VALUES (3), (20), (70)) AS t(r) GROUP BY r"""))
def m12_sweep(spark, sf):
    """The original sweep's ranks; one bias model, index and join for all of them."""
    from ratewise.plans.recommender import sweep

    got = sweep(spark, sf, [dict(rank=r, reg=0.01) for r in (3, 20, 70)])
    return got.select("rank", "reg", "n", ((F.col("rmse") > 0.3) & (F.col("rmse") < 1.5)).alias("near_bias"))


@register("m31_item_factors", with_views("""
SELECT row_number() OVER (ORDER BY business_id) - 1 AS business_ix, business_id, 10 AS rank
FROM (SELECT DISTINCT business_id FROM ratings WHERE NOT is_test)"""))
def m31_item_factors(spark, sf):
    from ratewise.operators.recommend import item_factors

    res = _als(spark, sf)
    f = item_factors(res.model).join(res.items, F.col("id") == F.col("business_ix"))
    return f.select("business_ix", "business_id", F.size("features").alias("rank"))


@register("m31_user_factors", with_views("""
SELECT row_number() OVER (ORDER BY user_id) - 1 AS user_ix, user_id, 10 AS rank
FROM (SELECT DISTINCT user_id FROM ratings WHERE NOT is_test)"""))
def m31_user_factors(spark, sf):
    from ratewise.operators.recommend import user_factors

    res = _als(spark, sf)
    f = user_factors(res.model).join(res.users, F.col("id") == F.col("user_ix"))
    return f.select("user_ix", "user_id", F.size("features").alias("rank"))


@register("m32_als_rank10_iter10")
def m32_als_rank10_iter10(spark, sf):
    from ratewise.plans.recommender import metrics

    return metrics(_als(spark, sf, rank=10, max_iter=10))


@register("m20_predict_pairs", bias_sql("""
SELECT t.review_id, um.user_id IS NOT NULL AND bm.business_id IS NOT NULL AS known
FROM test t LEFT JOIN um USING (user_id) LEFT JOIN bm USING (business_id)"""))
def m20_predict_pairs(spark, sf):
    """Scores of a given pair table: a rating for every pair whose user and business were trained."""
    from ratewise.plans.recommender import predict_pairs

    res = _als(spark, sf)
    _, _, test = _split(spark, sf)
    got = predict_pairs(res, test.select("review_id", "user_id", "business_id"))
    return got.select("review_id", F.col("rating").isNotNull().alias("known"))


@register("s12_model_roundtrip", bias_sql("""
SELECT t.review_id, TRUE AS same FROM test t JOIN um USING (user_id) JOIN bm USING (business_id)"""))
def s12_model_roundtrip(spark, sf):
    from ratewise.operators.recommend import load_model, predict_als, save_model
    from ratewise.session import shared_path

    res = _als(spark, sf)
    path = save_model(res.model, shared_path(spark, "als-model"))
    back = load_model(path)
    # The reloaded model must reproduce the fitted model's predictions.
    again = predict_als(back, res.test_indexed, cold="drop").select(
        "review_id", F.col("prediction").alias("prediction_loaded"))
    both = res.scored.where("has_prediction").select("review_id", "prediction").join(again, "review_id")
    return both.select("review_id", (F.col("prediction") == F.col("prediction_loaded")).alias("same"))


# ---------------------------------------------------------------- clustering

_KMEANS_MEMO: dict = {}
K_CLUSTERS = 8
CLUSTER_CATEGORY = "ECONOMY"

# Planted clusters named in canonical order (by centre longitude, latitude).
PLANT_NAMES = """plants AS (
  SELECT plant, chr(64 + CAST(row_number() OVER (ORDER BY avg(longitude), avg(latitude)) AS INTEGER)) AS cluster_name,
         count(*) AS n, avg(longitude) AS clon, avg(latitude) AS clat,
         sum(longitude * longitude + latitude * latitude) AS psi
  FROM city_biz GROUP BY plant),
assigned AS (SELECT b.*, p.cluster_name FROM city_biz b JOIN plants p USING (plant))"""


def _city_points(spark, sf):
    from ratewise.operators.cluster import assemble

    return assemble(P.filter_city(V.business(spark, sf), CITY_NAME, CITY_EXCLUDE))


def _clustered(spark, sf, k=K_CLUSTERS):
    from ratewise.operators.cluster import assign, fit_kmeans

    pts = _city_points(spark, sf)
    key = (V.fingerprint(spark, sf), k)
    if key not in _KMEANS_MEMO:
        _KMEANS_MEMO[key] = fit_kmeans(pts, k)
    return _KMEANS_MEMO[key], assign(_KMEANS_MEMO[key], pts)


@register("m13_assemble", with_views(
    "SELECT business_id, round(longitude, 6) AS x, round(latitude, 6) AS y, 2 AS width FROM city_biz", CITY))
def m13_assemble(spark, sf):
    from pyspark.ml.functions import vector_to_array

    v = vector_to_array("features")
    return _r(_city_points(spark, sf).select("business_id", v[0].alias("x"), v[1].alias("y"), F.size(v).alias("width")), "x", "y")


@register("m15_assign", with_views("SELECT business_id, cluster_name FROM assigned", CITY, PLANT_NAMES))
def m15_assign(spark, sf):
    _, a = _clustered(spark, sf)
    return a.select("business_id", "cluster_name")


@register("m15_nearest_centroid", with_views("SELECT business_id, cluster_name FROM assigned", CITY, PLANT_NAMES))
def m15_nearest_centroid(spark, sf):
    from ratewise.operators.cluster import centroids, nearest_centroid

    cl, _ = _clustered(spark, sf)
    pts = P.filter_city(V.business(spark, sf), CITY_NAME, CITY_EXCLUDE)
    return nearest_centroid(pts, centroids(spark, cl)).select("business_id", "cluster_name")


@register("m14_kmeans_centres", with_views("""
SELECT cluster_name, round(clon, 6) AS longitude, round(clat, 6) AS latitude FROM plants""", CITY, PLANT_NAMES))
def m14_kmeans_centres(spark, sf):
    from ratewise.operators.cluster import centroids

    cl, _ = _clustered(spark, sf)
    return _r(centroids(spark, cl), "longitude", "latitude")


@register("m16_silhouette", with_views("""
SELECT round(avg(s), 4) AS silhouette FROM (
  SELECT a.business_id,
         CASE WHEN p.n = 1 THEN 0.0
              WHEN own.d * p.n / (p.n - 1) < o.dmin THEN 1 - (own.d * p.n / (p.n - 1)) / o.dmin
              WHEN own.d * p.n / (p.n - 1) > o.dmin THEN o.dmin / (own.d * p.n / (p.n - 1)) - 1
              ELSE 0.0 END AS s
  FROM assigned a JOIN plants p USING (cluster_name)
  JOIN (SELECT a.business_id,
               a.longitude * a.longitude + a.latitude * a.latitude + q.psi / q.n
               - 2 * (a.longitude * q.clon + a.latitude * q.clat) AS d
        FROM assigned a JOIN plants q ON a.cluster_name = q.cluster_name) own USING (business_id)
  JOIN (SELECT a.business_id,
               min(a.longitude * a.longitude + a.latitude * a.latitude + q.psi / q.n
                   - 2 * (a.longitude * q.clon + a.latitude * q.clat)) AS dmin
        FROM assigned a JOIN plants q ON a.cluster_name <> q.cluster_name GROUP BY a.business_id) o USING (business_id))
""", CITY, PLANT_NAMES))
def m16_silhouette(spark, sf):
    from ratewise.operators.cluster import silhouette

    _, a = _clustered(spark, sf)
    return spark.range(1).select(F.round(F.lit(silhouette(a)), 4).alias("silhouette"))


@register("a8_cluster_sizes", with_views(
    "SELECT cluster_name, count(*) AS n FROM assigned GROUP BY cluster_name ORDER BY n DESC", CITY, PLANT_NAMES))
def a8_cluster_sizes(spark, sf):
    from ratewise.operators.cluster import cluster_sizes

    _, a = _clustered(spark, sf)
    return cluster_sizes(a)


@register("a9_category_per_cluster", with_views(f"""
SELECT cluster_name, count(*) AS n FROM assigned WHERE category = '{CLUSTER_CATEGORY}'
GROUP BY cluster_name ORDER BY n DESC""", CITY, PLANT_NAMES))
def a9_category_per_cluster(spark, sf):
    from ratewise.operators.cluster import category_per_cluster

    _, a = _clustered(spark, sf)
    return category_per_cluster(a, CLUSTER_CATEGORY)


@register("m18_cluster_profile", with_views(f"""
SELECT cluster_name, count(*) AS n, count_if(category = '{CLUSTER_CATEGORY}') AS n_category,
       round(avg(longitude), 6) AS mean_longitude, round(avg(latitude), 6) AS mean_latitude
FROM assigned GROUP BY cluster_name""", CITY, PLANT_NAMES))
def m18_cluster_profile(spark, sf):
    from ratewise.operators.cluster import cluster_profile

    _, a = _clustered(spark, sf)
    return _r(cluster_profile(a, CLUSTER_CATEGORY), "mean_longitude", "mean_latitude")


@register("m19_kmeans_sweep")
def m19_kmeans_sweep(spark, sf):
    from ratewise.operators.cluster import kmeans_sweep

    return kmeans_sweep(_city_points(spark, sf), ks=(4, 5, 6, 7, 8))


@register("s11_centroid_roundtrip", with_views("""
SELECT cluster_name, round(clon, 6) AS longitude, round(clat, 6) AS latitude FROM plants""", CITY, PLANT_NAMES))
def s11_centroid_roundtrip(spark, sf):
    from ratewise.operators.cluster import centroids, read_centroids, write_centroids
    from ratewise.session import shared_path

    cl, _ = _clustered(spark, sf)
    path = write_centroids(centroids(spark, cl), shared_path(spark, "centroids"))
    return _r(read_centroids(spark, path), "longitude", "latitude")


# ---------------------------------------------------------------- rating matrix

BLOCK = 1000

MATRIX = """mrows AS (SELECT business_id, row_number() OVER (ORDER BY business_id) - 1 AS row_ix
          FROM (SELECT DISTINCT business_id FROM ratings)),
mcols AS (SELECT user_id, row_number() OVER (ORDER BY user_id DESC) - 1 AS col_ix
          FROM (SELECT DISTINCT user_id FROM ratings)),
entries AS (SELECT business_id, user_id, row_ix, col_ix, max(stars) AS value
            FROM ratings JOIN mrows USING (business_id) JOIN mcols USING (user_id)
            GROUP BY business_id, user_id, row_ix, col_ix)"""

POSITIONS = f"""lined AS (SELECT business_id, user_id, stars,
  row_number() OVER (PARTITION BY business_id ORDER BY user_id DESC, stars DESC) - 1 AS position FROM ratings),
blocked AS (SELECT *, CAST(floor(position / {BLOCK}) AS BIGINT) AS block FROM lined)"""

_SVD_MEMO: dict = {}


def _entries(spark, sf):
    from ratewise.operators.matrix import rating_entries

    return rating_entries(V.ratings(spark, sf))


def _svd(spark, sf, k=2):
    from ratewise.operators.matrix import rating_entries, truncated_svd
    from ratewise.session import materialise

    key = (V.fingerprint(spark, sf), k)
    if key not in _SVD_MEMO:
        e = materialise(rating_entries(V.stars(spark, sf)).select("row_ix", "col_ix", "value"), "entries")
        _SVD_MEMO[key] = (e, truncated_svd(e, k))
    return _SVD_MEMO[key]


def _rows(spark, sf):
    from ratewise.operators.matrix import rows_by_item

    return rows_by_item(V.ratings(spark, sf))


def _blocks(spark, sf):
    from ratewise.operators.matrix import row_blocks

    return row_blocks(_rows(spark, sf), "business_id", "user_id", "stars", BLOCK)


@register("m21_densify_entries", with_views(
    "SELECT business_id, user_id, row_ix, col_ix, value FROM entries", MATRIX))
def m21_densify_entries(spark, sf):
    return _entries(spark, sf)


@register("j5_align_users", with_views(
    "SELECT business_id, col_ix, value FROM entries", MATRIX))
def j5_align_users(spark, sf):
    return _entries(spark, sf).select("business_id", "col_ix", "value")


@register("f7_fill_missing_zero", with_views("""
SELECT business_id, (SELECT count(*) FROM mcols) AS row_length, count(*) AS n_rated,
       (SELECT count(*) FROM mcols) - count(*) AS n_zero
FROM entries GROUP BY business_id""", MATRIX))
def f7_fill_missing_zero(spark, sf):
    from ratewise.operators.matrix import matrix_size
    from ratewise.session import materialise

    e = materialise(_entries(spark, sf), "entries")
    n_cols = matrix_size(e).select("n_cols").scalar()
    return e.groupBy("business_id").agg(F.count(F.lit(1)).alias("n_rated")).select(
        "business_id", n_cols.alias("row_length"), "n_rated", (n_cols - F.col("n_rated")).alias("n_zero"))


@register("a10_rows_by_item", with_views("SELECT business_id, position, user_id, stars FROM lined", POSITIONS))
def a10_rows_by_item(spark, sf):
    return _rows(spark, sf)


@register("t3_sort_row", with_views("""
SELECT business_id, block, count(*) AS n_pairs,
       string_agg(user_id || ':' || CAST(stars AS VARCHAR), ',' ORDER BY position) AS pairs
FROM blocked GROUP BY business_id, block""", POSITIONS))
def t3_sort_row(spark, sf):
    """The sorted row lists as arrays of at most BLOCK pairs."""
    text = F.array_join(F.transform("pairs", lambda x: F.concat(x["user_id"], F.lit(":"), x["stars"].cast("string"))), ",")
    return _blocks(spark, sf).select("business_id", "block", F.size("pairs").cast("long").alias("n_pairs"), text.alias("pairs"))


@register("f5_explode", with_views("SELECT business_id, block, position % 1000 AS pos, user_id, stars FROM blocked", POSITIONS))
def f5_explode(spark, sf):
    """the arrays exploded back to one row per pair."""
    r = _blocks(spark, sf).select("business_id", "block", F.posexplode("pairs").alias("pos", "pair"))
    return r.select("business_id", "block", F.col("pos").cast("long").alias("pos"), "pair.user_id", "pair.stars")


@register("f6_row_values", with_views("""
SELECT business_id, block, string_agg(CAST(stars AS VARCHAR), ',' ORDER BY position) AS row_values
FROM blocked GROUP BY business_id, block""", POSITIONS))
def f6_row_values(spark, sf):
    from ratewise.functions.columns import pair_values

    vals = F.array_join(F.transform(pair_values("pairs", "stars"), lambda x: x.cast("string")), ",")
    return _blocks(spark, sf).select("business_id", "block", vals.alias("row_values"))


@register("f11_pairs_to_map", with_views("SELECT business_id, user_id, value AS rating FROM entries", MATRIX))
def f11_pairs_to_map(spark, sf):
    """User -> rating maps of every business, per block of its row list, read back key by key."""
    from ratewise.functions.columns import pairs_to_map
    from ratewise.operators.matrix import row_blocks, rows_by_item

    e = _entries(spark, sf).select("business_id", "user_id", F.col("value").alias("rating"))
    rows = rows_by_item(e, "business_id", "user_id", "rating", among=V.ratings(spark, sf))
    blocks = row_blocks(rows, "business_id", "user_id", "rating", BLOCK)
    m = blocks.select("business_id", pairs_to_map("pairs").alias("m"))
    return m.select("business_id", F.explode("m").alias("user_id", "rating"))


DIGITS = [str(d) for d in range(10)]


@register("a11_pivot_ratings", with_views(
    "SELECT business_id, " + ", ".join(f"coalesce(max(stars) FILTER (WHERE right(user_id, 1) = '{d}'), 0) AS \"{d}\"" for d in DIGITS)
    + " FROM ratings GROUP BY business_id"))
def a11_pivot_ratings(spark, sf):
    """The highest rating of every business by group of users (the last digit of their id)."""
    from ratewise.operators.matrix import pivot_ratings

    r = V.ratings(spark, sf).withColumn("user_group", F.right("user_id", F.lit(1)))
    return pivot_ratings(r, "business_id", "user_group", DIGITS)


STAR_LEVELS = [1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0]


@register("a11_pivot_star_levels", with_views(
    "SELECT business_id, " + ", ".join(f'count(*) FILTER (WHERE stars = {v}) AS "{v}"' for v in STAR_LEVELS)
    + " FROM ratings GROUP BY business_id"))
def a11_pivot_star_levels(spark, sf):
    from ratewise.operators.matrix import pivot_ratings

    return pivot_ratings(V.ratings(spark, sf), "business_id", "stars", STAR_LEVELS, agg="count", fill=0)


PCA2 = """s2 AS (SELECT var_samp(l_quantity) AS a, var_samp(l_linenumber) AS c, covar_samp(l_quantity, l_linenumber) AS b
       FROM lineitem),
e2 AS (SELECT (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l1,
              (a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l2, a + c AS t FROM s2)"""


def _lineitem_pair(spark, sf):
    from ratewise.operators.matrix import assemble

    li = V.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double"))
    return assemble(li, ["l_quantity", "l_linenumber"])


@register("m26_pca_two_columns", with_views("""
SELECT 1 AS component, round(l1 / t, 6) AS share FROM e2 UNION ALL SELECT 2, round(l2 / t, 6) FROM e2""", PCA2))
def m26_pca_two_columns(spark, sf):
    from ratewise.operators.matrix import pca

    model = pca(_lineitem_pair(spark, sf), 2)
    return _r(spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(model.explainedVariance)], "component int, share double"), "share")


@register("m27_project_two_columns", with_views("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       round(pow(l_quantity * b + l_linenumber * (l1 - a), 2) / (b * b + (l1 - a) * (l1 - a)), 4) AS pc1_squared
FROM lineitem, e2, s2""", PCA2))
def m27_project_two_columns(spark, sf):
    """First principal coordinate, squared (its sign is free)."""
    from ratewise.operators.matrix import pca, pca_project

    v = _lineitem_pair(spark, sf)
    p = pca_project(pca(v, 2), v)
    return p.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"),
                    F.round(F.pow(F.col("projection")[0], 2), 4).alias("pc1_squared"))


# The predicted grid with every residual 0 is user mean + business mean - mu: two factors a
# side, so its singular values and vectors have a closed form.
GRID2 = """ga AS (SELECT count(*) AS n, sum(business_mean - mu) AS s, sum(pow(business_mean - mu, 2)) AS q FROM bm CROSS JOIN g),
gb AS (SELECT sum(user_mean * user_mean) AS q, sum(user_mean) AS s, count(*) AS n FROM um),
gt AS (SELECT ga.n * gb.q + 2 * ga.s * gb.s + ga.q * gb.n AS t,
              (ga.n * ga.q - ga.s * ga.s) * (gb.n * gb.q - gb.s * gb.s) AS d, ga.n AS n_items FROM ga CROSS JOIN gb),
gv AS (SELECT 1 AS component, t / 2 + sqrt(t * t / 4 - d) AS l, t, n_items FROM gt
       UNION ALL SELECT 2, d / (t / 2 + sqrt(t * t / 4 - d)), t, n_items FROM gt),
shares AS (SELECT component, l, l / t AS share, sum(l / t) OVER (ORDER BY component) AS cumulative, n_items FROM gv),
kept AS (SELECT min(component) AS k FROM shares WHERE cumulative > 0.95)"""


def _bias_grid(spark, sf):
    """(item rows, user rows, number of items) of the predicted grid without residuals."""
    _, train, _ = _split(spark, sf)
    bias = B.fit_bias(train)
    items = bias.items.select("business_id", F.array(F.lit(1.0), F.col("business_mean") - bias.mu).alias("f"))
    users = bias.users.select("user_id", F.array(F.col("user_mean"), F.lit(1.0)).alias("f"))
    return items, users


def _als_grid(spark, sf):
    """(item rows, user rows) of the predicted grid: factors and bias terms."""
    res = _als(spark, sf)
    items = res.model.itemFactors.join(res.items, F.col("id") == F.col("business_ix")).select(
        "business_id", F.concat(F.col("features"), F.array(F.lit(1.0), F.col("business_mean") - res.bias.mu)).alias("f"))
    users = res.model.userFactors.join(res.users, F.col("id") == F.col("user_ix")).select(
        "user_id", F.concat(F.col("features"), F.array(F.col("user_mean"), F.lit(1.0))).alias("f"))
    return items, users, res.config.rank + 2


def _grid_shares(spark, sf):
    from ratewise.operators.matrix import explained_variance, grid_svd

    items, users = _bias_grid(spark, sf)
    g = grid_svd(items, users, 2)
    return explained_variance(spark, g.s, items.count(), total=g.total), g, items, users


def _kept(spark, sf):
    from ratewise.operators.matrix import choose_k

    shares, g, items, users = _grid_shares(spark, sf)
    return choose_k(shares, 0.95).first()["k"], g, items, users  # one number


@register("m24_explained_variance", bias_sql("""
SELECT component, round(sqrt(l), 4) AS singular_value, round(share, 6) AS share, round(cumulative, 6) AS cumulative
FROM shares""", GRID2))
def m24_explained_variance(spark, sf):
    shares = _grid_shares(spark, sf)[0]
    return _r(shares.select("component", F.round("singular_value", 4).alias("singular_value"), "share", "cumulative"), "share", "cumulative")


@register("a17_cumulative_share", bias_sql("SELECT component, round(cumulative, 6) AS cumulative FROM shares", GRID2))
def a17_cumulative_share(spark, sf):
    return _r(_grid_shares(spark, sf)[0].select("component", "cumulative"), "cumulative")


@register("t5_sorted_eigenvalues", bias_sql(
    "SELECT component, round(l / (n_items - 1), 4) AS eigenvalue FROM shares ORDER BY eigenvalue DESC", GRID2))
def t5_sorted_eigenvalues(spark, sf):
    e = _grid_shares(spark, sf)[0].select("component", F.round("eigenvalue", 4).alias("eigenvalue"))
    return e.orderBy(F.desc("eigenvalue"))


@register("m24b_choose_k", bias_sql("SELECT k FROM kept", GRID2))
def m24b_choose_k(spark, sf):
    from ratewise.operators.matrix import choose_k

    return choose_k(_grid_shares(spark, sf)[0], 0.95)


@register("m25_component_scores", bias_sql("""
SELECT business_id, component,
       round(l * pow(ga.s * gb.q + ga.q * gb.s + (business_mean - mu) * (l - gb.q * ga.n - gb.s * ga.s), 2)
             / (x1 * x1 * ga.n + 2 * x1 * x2 * ga.s + x2 * x2 * ga.q), 4) AS score_squared
FROM (SELECT shares.*, gb.q * ga.s + gb.s * ga.q AS x1, l - gb.q * ga.n - gb.s * ga.s AS x2 FROM shares CROSS JOIN ga CROSS JOIN gb) e
CROSS JOIN ga CROSS JOIN gb CROSS JOIN g CROSS JOIN bm CROSS JOIN kept WHERE component <= k""", GRID2))
def m25_component_scores(spark, sf):
    """Component scores of the predicted grid's rows, K from the 0.95 rule (squared: the sign is free)."""
    from ratewise.operators.matrix import grid_scores

    k, g, items, _ = _kept(spark, sf)
    sc = grid_scores(items, "business_id", g, k)
    return sc.select("business_id", F.posexplode(F.array(*[F.col(f"pc_{j + 1}") for j in range(k)])).alias("i", "s")).select(
        "business_id", (F.col("i") + 1).alias("component"), F.round(F.col("s") * F.col("s"), 4).alias("score_squared"))


@register("t4_scores_by_row", bias_sql("""
SELECT business_id, row_number() OVER (ORDER BY business_id) - 1 AS row_ix FROM bm""", GRID2))
def t4_scores_by_row(spark, sf):
    """T4: the score rows in row order."""
    from ratewise.operators.matrix import grid_scores

    k, g, items, _ = _kept(spark, sf)
    sc = S.dense_index(grid_scores(items, "business_id", g, k), "business_id", "row_ix", carry=["pc_1"])
    return sc.where(F.col("pc_1").isNotNull()).select("business_id", "row_ix").orderBy("row_ix")


@register("m29_project_observed", bias_sql("""
SELECT e.business_id, component,
       round(pow(sum(e.value * (um.user_mean * y1 + y2)), 2) / any_value(y1 * y1 * gb.q + 2 * y1 * y2 * gb.s + y2 * y2 * gb.n), 4) AS projection_squared
FROM (SELECT business_id, user_id, max(stars) AS value FROM train GROUP BY ALL) e JOIN um USING (user_id)
CROSS JOIN (SELECT shares.*, ga.n * gb.s + ga.s * gb.n AS y1, l - ga.n * gb.q - ga.s * gb.s AS y2 FROM shares CROSS JOIN ga CROSS JOIN gb) y
CROSS JOIN gb CROSS JOIN kept WHERE component <= k GROUP BY e.business_id, component""", GRID2))
def m29_project_observed(spark, sf):
    """Observed rows projected on the right singular vectors of the predicted grid."""
    from ratewise.operators.matrix import grid_right, project_rows

    k, g, _, users = _kept(spark, sf)
    _, train, _ = _split(spark, sf)
    obs = train.groupBy("business_id", "user_id").agg(F.max("stars").alias("value"))
    p = project_rows(obs, grid_right(users, "user_id", g, k), "business_id", "user_id", k)
    return p.select("business_id", F.posexplode(F.array(*[F.col(f"pc_{j + 1}") for j in range(k)])).alias("i", "s")).select(
        "business_id", (F.col("i") + 1).alias("component"), F.round(F.col("s") * F.col("s"), 4).alias("projection_squared"))


@register("m28_standardise", with_views("""
SELECT l_orderkey, l_linenumber,
       round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) AS z_l_quantity,
       round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER (), 6) AS z_l_extendedprice
FROM lineitem"""))
def m28_standardise(spark, sf):
    from ratewise.operators.matrix import standardise

    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    z = standardise(li, ["l_quantity", "l_extendedprice"])
    return _r(z.select("l_orderkey", "l_linenumber", "z_l_quantity", "z_l_extendedprice"),
              "z_l_quantity", "z_l_extendedprice")


@register("m22_coordinate_matrix", with_views("""
SELECT max(row_ix) + 1 AS n_rows, max(col_ix) + 1 AS n_cols, count(*) AS n_entries FROM entries""", MATRIX))
def m22_coordinate_matrix(spark, sf):
    from ratewise.operators.matrix import matrix_size

    return matrix_size(_entries(spark, sf))


@register("m23_svd_spectrum")
def m23_svd_spectrum(spark, sf):
    """Spectrum of the full predicted user x business grid, from the factors' Gram matrices."""
    from ratewise.operators.matrix import explained_variance, grid_svd

    items, users, width = _als_grid(spark, sf)
    g = grid_svd(items, users, width)
    return explained_variance(spark, g.s, items.count(), total=g.total)


@register("m24_topk_relative_share")
def m24_topk_relative_share(spark, sf):
    """The original report's figure: shares relative to the k kept values (last is 1.0)."""
    from ratewise.operators.matrix import explained_variance, grid_svd

    items, users, width = _als_grid(spark, sf)
    return explained_variance(spark, grid_svd(items, users, width).s[:2], items.count(), total=None)


@register("m23_observed_svd")
def m23_observed_svd(spark, sf):
    """Truncated SVD of the observed, zero-filled matrix (an extra beside the predicted grid)."""
    from ratewise.operators.matrix import explained_variance

    _, svd = _svd(spark, sf)
    return explained_variance(spark, svd.s, svd.n_rows, total=svd.frobenius2)


@register("m30_cluster_rows")
def m30_cluster_rows(spark, sf):
    """Businesses clustered by their rows of the predicted grid, in component scores: the
    scores keep all distances between rows, so no row is ever formed."""
    from ratewise.operators.cluster import assemble as assemble_xy, assign, cluster_sizes, fit_kmeans
    from ratewise.operators.matrix import grid_scores, grid_svd

    items, users, width = _als_grid(spark, sf)
    g = grid_svd(items, users, width)
    k = len(g.s)
    sc = assemble_xy(grid_scores(items, "business_id", g, k), [f"pc_{j + 1}" for j in range(k)])
    cl = fit_kmeans(sc, 4, seeds=(1, 2, 3))
    return cluster_sizes(assign(cl, sc))


@register("f10_array_to_vector", "SELECT vec_id, len(embedding) AS dim, embedding[1] AS first, embedding[len(embedding)] AS last FROM embeddings")
def f10_array_to_vector(spark, sf):
    from pyspark.ml.functions import vector_to_array

    from ratewise.operators.matrix import vectors

    v = vectors(V.table(spark, sf, "embeddings"), "embedding")
    a = vector_to_array("features", "float32")
    return v.select("vec_id", F.size(a).cast("long").alias("dim"), a[0].alias("first"), F.element_at(a, -1).alias("last"))


@register("m26_pca_embeddings")
def m26_pca_embeddings(spark, sf):
    from ratewise.operators.matrix import pca, vectors

    model = pca(vectors(V.table(spark, sf, "embeddings"), "embedding"), 4)
    shares = [float(x) for x in model.explainedVariance]
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(shares)], "component int, share double")


@register("m27_pca_project")
def m27_pca_project(spark, sf):
    from ratewise.operators.matrix import pca, pca_project, vectors

    emb = vectors(V.table(spark, sf, "embeddings"), "embedding")
    model = pca(emb, 4)
    return pca_project(model, emb).select("vec_id", "projection")


@register("m20_grid_spectrum")
def m20_grid_spectrum(spark, sf):
    """The five leading values of the predicted grid."""
    return m23_svd_spectrum(spark, sf).where("component <= 5")


# ---------------------------------------------------------------- file sources and sinks (write, read back)

def _out(spark, name):
    from ratewise.session import shared_path

    return shared_path(spark, name)


def _reviews(spark, sf):
    return V.ratings(spark, sf).select("review_id", "user_id", "business_id", "stars")


REVIEW_ROWS = "SELECT review_id, user_id, business_id, stars FROM ratings"


@register("s1_review_json_roundtrip", with_views(REVIEW_ROWS))
def s1_review_json_roundtrip(spark, sf):
    from ratewise.sources.io import read_reviews, write_json

    path = write_json(_reviews(spark, sf), _out(spark, "reviews-json"))
    return read_reviews(spark, path).select("review_id", "user_id", "business_id", "stars")


@register("s2_business_json_roundtrip", with_views("""
SELECT business_id, name, city, category AS first_category, round(longitude, 6) AS longitude FROM business"""))
def s2_business_json_roundtrip(spark, sf):
    from ratewise.sources.io import read_business, write_json

    path = write_json(V.business_nested(spark, sf), _out(spark, "business-json"))
    b = read_business(spark, path)
    return b.select("business_id", "name", "city", first_item("categories").alias("first_category"),
                    round6("longitude").alias("longitude"))


@register("s1_malformed_lines", with_views("""
SELECT count(*) FILTER (WHERE stars > 1) AS n_read, count(*) FILTER (WHERE stars = 1) AS n_malformed FROM ratings"""))
def s1_malformed_lines(spark, sf):
    """Records with one star are written cut short; they are counted, not turned into nulls."""
    from ratewise.sources.io import REVIEW, load_report

    line = F.to_json(F.struct("review_id", "user_id", "business_id", "stars"))
    cut = F.when(F.col("stars") == 1, F.substring(line, 1, 25)).otherwise(line)
    path = _out(spark, "reviews-cut")
    _reviews(spark, sf).select(cut.alias("value")).write.text(path)
    return load_report(spark, path, REVIEW)


@register("s2_all_attributes", with_views("""
SELECT business_id, (p_size % 2 = 0) AS bike, p_size % 4 + 1 AS price, (p_size % 3 = 0) AS casual,
       CASE WHEN p_size % 5 = 0 THEN 'free' ELSE 'no' END AS wifi, (p_size % 7 = 0) AS garage
FROM business JOIN part ON business_id = concat('b', CAST(p_partkey AS STRING))"""))
def s2_all_attributes(spark, sf):
    """Attributes of any name and depth survive the JSON round trip."""
    from ratewise.sources.io import attribute, read_business, write_json

    size = V.table(spark, sf, "part").select(F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("pid"), "p_size")
    b = V.business_nested(spark, sf).join(size, F.col("business_id") == F.col("pid"))
    more = F.struct("attributes.*", F.when(F.col("p_size") % 5 == 0, "free").otherwise("no").alias("WiFi"),
                    F.struct((F.col("p_size") % 7 == 0).alias("garage")).alias("BusinessParking"))
    path = write_json(b.withColumn("attributes", more).drop("pid", "p_size"), _out(spark, "business-attributes"))
    return read_business(spark, path).select(
        "business_id", attribute("BikeParking").cast("boolean").alias("bike"),
        attribute("RestaurantsPriceRange2").cast("int").alias("price"), attribute("Ambience", "casual").cast("boolean").alias("casual"),
        attribute("WiFi").alias("wifi"), attribute("BusinessParking", "garage").cast("boolean").alias("garage"))


@register("s6_nested_csv_roundtrip", with_views("""
SELECT business_id, name, city, '["' || category || '","' || p_brand || '"]' AS categories
FROM business JOIN part ON business_id = concat('b', CAST(p_partkey AS STRING))"""))
def s6_nested_csv_roundtrip(spark, sf):
    from ratewise.sources.io import read_csv, write_csv

    path = write_csv(V.business_nested(spark, sf), _out(spark, "business-csv"))
    return read_csv(spark, path).select("business_id", "name", "city", "categories")


@register("s8_concat_files", with_views(REVIEW_ROWS))
def s8_concat_files(spark, sf):
    from ratewise.sources.io import concat_files, read_reviews, write_json

    _, train, test = _split(spark, sf)
    cols = ["review_id", "user_id", "business_id", "stars"]
    a = write_json(train.select(*cols), _out(spark, "chunk-a"))
    b = write_json(test.select(*cols), _out(spark, "chunk-b"))
    out = concat_files(spark, [a, b], _out(spark, "concat"))
    return read_reviews(spark, out).select(*cols)


@register("s9_chunk_files", with_views(REVIEW_ROWS))
def s9_chunk_files(spark, sf):
    from ratewise.sources.io import chunk_files, read_reviews

    path = chunk_files(_reviews(spark, sf), _out(spark, "chunks"), rows_per_file=5000)
    return read_reviews(spark, path).select("review_id", "user_id", "business_id", "stars")


@register("s13_preview", with_views(
    "SELECT review_id, stars FROM ratings ORDER BY stars DESC, review_id LIMIT 20"))
def s13_preview(spark, sf):
    from ratewise.sources.io import preview

    return preview(V.ratings(spark, sf).select("review_id", "stars"), 20, [F.desc("stars"), F.asc("review_id")])


@register("s15_text_roundtrip", with_views(REVIEW_ROWS))
def s15_text_roundtrip(spark, sf):
    from ratewise.sources.io import REVIEW, read_text_json, write_text

    path = write_text(_reviews(spark, sf), _out(spark, "reviews-text"))
    return read_text_json(spark, path, REVIEW).select("review_id", "user_id", "business_id", "stars")


@register("s16_parquet_roundtrip", with_views(REVIEW_ROWS))
def s16_parquet_roundtrip(spark, sf):
    from ratewise.sources.io import write_parquet

    path = write_parquet(_reviews(spark, sf), _out(spark, "reviews-parquet"))
    return spark.read.parquet(path)


# ---------------------------------------------------------------- remaining inventory rows
# Rows of SURVEY §2 whose computation is one of the operators above, registered
# under their own id so every row has a query; where the original used a Python
# UDF or RDD lambda, the registered query is the built-in replacement.

def _alias(key: str, target: str, doc: str):
    fn = QUERIES[target]

    def q(spark, sf):
        return fn(spark, sf)

    q.__doc__ = doc
    register(key, ORACLE.get(target))(q)


_alias("s5_json_sink", "s1_review_json_roundtrip", "S5: JSON-lines sink, read back.")
_alias("s10_read_centroids", "s11_centroid_roundtrip", "S10: centroid table parsed from CSV.")
_alias("m17_centroids", "m14_kmeans_centres", "M17: cluster centres named A, B, ... in canonical order.")
_alias("v2_conditional_rating", "p9_fallback_rating", "V2: the conditional-rating UDF as a built-in CASE chain.")
_alias("v3_column_builders", "m6_final_rating", "V3: Python functions returning Columns (stay in Catalyst).")
_alias("v4_dataframe_expressions", "a10_rows_by_item",
       "V4: RDD map/reduceByKey lambdas as DataFrame grouping and array expressions.")


@register("s3_from_rows", with_views("""
SELECT cluster_name, round(clon, 6) AS longitude, round(clat, 6) AS latitude FROM plants""", CITY, PLANT_NAMES))
def s3_from_rows(spark, sf):
    """S3: a small in-memory relation built from bounded driver rows (the k fitted centres)."""
    from ratewise.operators.cluster import cluster_name
    from ratewise.sources.io import from_rows

    cl, _ = _clustered(spark, sf)
    rows = [(cluster_name(i), float(c[0]), float(c[1])) for i, c in enumerate(cl.centres)]
    return _r(from_rows(spark, rows, "cluster_name string, longitude double, latitude double"),
              "longitude", "latitude")


@register("s7_single_file", with_views("""
SELECT cluster_name, round(clon, 6) AS longitude, round(clat, 6) AS latitude FROM plants""", CITY, PLANT_NAMES))
def s7_single_file(spark, sf):
    """A bounded table (k rows) written as exactly one JSON file and read back."""
    from ratewise.operators.cluster import centroids
    from ratewise.sources.io import write_json

    cl, _ = _clustered(spark, sf)
    path = write_json(centroids(spark, cl), _out(spark, "centroids-json"), files=1)
    back = spark.read.schema("cluster_name string, longitude double, latitude double").json(path)
    assert len(back.inputFiles()) == 1
    return _r(back, "longitude", "latitude")


@register("p11_feature_columns", with_views(
    "SELECT business_id, round(longitude, 6) AS x, round(latitude, 6) AS y, 'longitude,latitude' AS names FROM city_biz", CITY))
def p11_feature_columns(spark, sf):
    """Numeric columns of the schema (minus the plant key) as the feature list."""
    from ratewise.operators.cluster import assemble

    b = P.filter_city(V.business(spark, sf), CITY_NAME, CITY_EXCLUDE)
    cols = P.feature_columns(b, skip=["plant"])
    from pyspark.ml.functions import vector_to_array

    v = vector_to_array("features")
    return _r(assemble(b, cols).select("business_id", v[0].alias("x"), v[1].alias("y"), F.lit(",".join(cols)).alias("names")), "x", "y")


@register("a13_user_range", with_views(
    "SELECT user_id, max(stars) - min(stars) AS stars_range FROM ratings GROUP BY user_id"))
def a13_user_range(spark, sf):
    return ST.user_spread(V.ratings(spark, sf)).select("user_id", "stars_range")


@register("a15_count_by_key", with_views("SELECT user_id, count(*) AS n FROM ratings GROUP BY user_id"))
def a15_count_by_key(spark, sf):
    return ST.count_by(V.ratings(spark, sf), "user_id")


@register("t2_top_businesses", with_views(
    "SELECT business_id, count(*) AS n FROM ratings GROUP BY business_id ORDER BY n DESC, business_id LIMIT 10"))
def t2_top_businesses(spark, sf):
    """A top-k report (the limit is the feature), ties broken by id."""
    return ST.count_by(V.ratings(spark, sf), "business_id").orderBy(F.desc("n"), "business_id").limit(10)


@register("f2_cast_double", with_views(
    "SELECT review_id, CAST(CAST(stars AS VARCHAR) AS DOUBLE) AS stars FROM ratings"))
def f2_cast_double(spark, sf):
    return V.ratings(spark, sf).select("review_id", P.cast_double(F.col("stars").cast("string")).alias("stars"))


@register("f4_struct_field", with_views("SELECT review_id, user_id, stars FROM ratings"))
def f4_struct_field(spark, sf):
    """tuple fields by name from a struct column."""
    r = V.ratings(spark, sf).select("review_id", F.struct("user_id", "stars").alias("pair"))
    return r.select("review_id", F.col("pair.user_id").alias("user_id"), F.col("pair.stars").alias("stars"))


@register("m9a_business_mean_rmse", bias_sql(
    "SELECT count(*) AS n, round(sqrt(avg(pow(stars - business_mean, 2))), 6) AS rmse FROM scored"))
def m9a_business_mean_rmse(spark, sf):
    t, _ = _scored_bias(spark, sf)
    return _r(E.rmse(t, pred="business_mean"), "rmse")


@register("m9b_user_mean_rmse", bias_sql(
    "SELECT count(*) AS n, round(sqrt(avg(pow(stars - user_mean, 2))), 6) AS rmse FROM scored"))
def m9b_user_mean_rmse(spark, sf):
    t, _ = _scored_bias(spark, sf)
    return _r(E.rmse(t, pred="user_mean"), "rmse")


@register("m9c_mean_of_means_rmse", bias_sql(
    "SELECT count(*) AS n, round(sqrt(avg(pow(stars - (user_mean + business_mean) / 2, 2))), 6) AS rmse FROM scored"))
def m9c_mean_of_means_rmse(spark, sf):
    t, _ = _scored_bias(spark, sf)
    return _r(E.rmse(t.withColumn("mm", (F.col("user_mean") + F.col("business_mean")) / 2), pred="mm"), "rmse")


@register("m9d_raw_als_rmse")
def m9d_raw_als_rmse(spark, sf):
    """M9d: RMSE of the residual prediction without bias re-addition."""
    return E.rmse(_als(spark, sf).scored, pred="prediction")


@register("v1_densify_sql_view", ORACLE["f7_fill_missing_zero"])
def v1_densify_sql_view(spark, sf):
    """V1: the row-merge function exposed to SQL as a temp view of sparse entries
    (built-ins only; missing cells are implicit zeros)."""
    from ratewise.session import materialise

    materialise(_entries(spark, sf), "entries").createOrReplaceTempView("rating_entries")
    return spark.sql("""
        SELECT business_id,
               (SELECT max(col_ix) + 1 FROM rating_entries) AS row_length,
               count(*) AS n_rated,
               (SELECT max(col_ix) + 1 FROM rating_entries) - count(*) AS n_zero
        FROM rating_entries GROUP BY business_id""")


# ---------------------------------------------------------------- mechanisms of their own

def _add(module) -> None:
    QUERIES.update(module.QUERIES)
    ORACLE.update(module.ORACLE)


from ratewise.plans import factors as _factors  # noqa: E402
from ratewise.plans import grouping as _grouping  # noqa: E402
from ratewise.plans import increments as _increments  # noqa: E402
from ratewise.plans import places as _places  # noqa: E402
from ratewise.plans import sketches as _sketches  # noqa: E402

for _module in (_factors, _grouping, _increments, _places, _sketches):
    _add(_module)
