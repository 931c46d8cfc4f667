"""Salted alternating least squares against numpy and pyspark.ml."""

import numpy as np
import pytest
from pyspark.ml.recommendation import ALS
from pyspark.sql import functions as F

from ratewise.operators import als


@pytest.fixture(scope="module")
def ratings(spark):
    """User 0 holds a third of all ratings."""
    rng = np.random.default_rng(3)
    rows = [(int(u), int(i), float(rng.normal())) for u in range(1, 40) for i in rng.choice(60, 10, replace=False)]
    rows += [(0, int(i % 60), float(rng.normal())) for i in range(200)]
    return spark.createDataFrame(rows, "user_id int, business_id int, residual double").repartition(5)


def brute(rows, factors, reg, key, other):
    by = {}
    for r in rows:
        if r[other] in factors:
            by.setdefault(r[key], []).append((factors[r[other]], r[2]))
    out = {}
    for k, own in by.items():
        x, y = np.array([f for f, _ in own]), np.array([v for _, v in own])
        out[k] = np.linalg.solve(x.T @ x + reg * len(y) * np.eye(x.shape[1]), x.T @ y)
    return out


def factors_of(df):
    return {r["id"]: np.array(r["f"]) for r in df.collect()}


@pytest.mark.parametrize("split", [7, 10_000])
def test_half_step_equals_numpy(spark, ratings, split):
    users = als.start_factors(ratings, "user_id", 4)
    side = als.deal(ratings, "business_id", "user_id", "residual", 60, split)
    got = factors_of(als.solve(side, users, 4, 0.1))
    want = brute(ratings.collect(), factors_of(users), 0.1, 1, 0)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_heavy_user_is_spread(ratings):
    side = als.deal(ratings, "user_id", "business_id", "residual", 60, 20)
    most = side.rows.groupBy("block").count().agg(F.max("count")).first()[0]
    assert side.rows.where("key = 0").select("block").distinct().count() > 4
    assert most < 150  # the heavy user alone has 200 of 590


def test_rounds_equal_pyspark_ml(spark, ratings):
    """From ml's item factors after two rounds, one more round gives ml's third."""
    def ml(rounds):
        return ALS(rank=5, maxIter=rounds, regParam=0.05, seed=4, userCol="user_id", itemCol="business_id", ratingCol="residual").fit(ratings)

    def table(df):
        return df.select("id", F.col("features").cast("array<double>").alias("f"))

    two, three = ml(2), ml(3)
    got = als.fit(ratings, 5, 1, 0.05, start=table(two.userFactors), block_ratings=50, split_ratings=15)
    for own, theirs in ((got.items, three.itemFactors), (got.users, three.userFactors)):
        want = factors_of(table(theirs))
        mine = factors_of(own)
        assert mine.keys() == want.keys()
        assert all(np.allclose(mine[k], want[k], atol=2e-3) for k in want)


def test_fit_from_own_start_reaches_the_error_of_pyspark_ml(ratings):
    model = als.fit(ratings, 5, 8, 0.05, block_ratings=100, split_ratings=30)
    ml = ALS(rank=5, maxIter=8, regParam=0.05, seed=4, userCol="user_id", itemCol="business_id", ratingCol="residual").fit(ratings)

    def rmse(df):
        return df.agg(F.sqrt(F.avg(F.pow(F.col("residual") - F.col("prediction"), 2)))).first()[0]

    assert rmse(als.predict(ratings, model.users, model.items)) == pytest.approx(rmse(ml.transform(ratings)), rel=0.1)


def test_fold_in_and_cold_pairs(spark, ratings):
    model = als.fit(ratings, 3, 2, 0.1)
    new = spark.createDataFrame([(900, i, 0.5 * i) for i in range(6)] + [(901, 999, 1.0), (None, 1, 1.0), (902, 1, None)], "user_id int, business_id int, residual double")
    folded = als.fold_in(new, model)
    want = brute([r for r in new.collect() if None not in tuple(r)], factors_of(model.items), 0.1, 0, 1)
    got = factors_of(folded)
    assert got.keys() == want.keys() == {900}
    assert np.allclose(got[900], want[900])
    pairs = spark.createDataFrame([(900, 3), (901, 3), (0, 999), (0, 3)], "user_id int, business_id int")
    out = {(r[0], r[1]): r[2] for r in als.predict(pairs, model.users.unionByName(folded), model.items).collect()}
    assert out[900, 3] is not None and out[0, 3] is not None and out[901, 3] is None and out[0, 999] is None


def test_string_ids_and_empty_table(spark, ratings):
    named = ratings.select(F.concat(F.lit("u"), "user_id").alias("user_id"), F.concat(F.lit("b"), "business_id").alias("business_id"), "residual")
    model = als.fit(named, 3, 1, 0.1)
    assert model.users.count() == 40
    assert als.fit(named.limit(0), 3, 1, 0.1).users.count() == 0
