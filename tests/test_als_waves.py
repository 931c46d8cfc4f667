"""ALS in waves: equal to the method in numpy, near the library, bounded in what a wave sends."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from scales import SF_SMALL

from ratewise.operators import als_waves, recommend
from ratewise.plans import recommender

RANK, REG, SEED = 4, 0.1, 3


@pytest.fixture
def always(monkeypatch):
    monkeypatch.setattr(recommend, "EXCHANGE_BYTES", 0)


@pytest.fixture(scope="module")
def rated(spark):
    """Ratings of 30 users and 20 items, some twice; user 3 rated everything."""
    rng = np.random.default_rng(1)
    rows = [(u, i, float(rng.normal())) for u in range(30) for i in range(20) if u == 3 or rng.random() < 0.4]
    rows += rows[:5]
    return rows, spark.createDataFrame(rows, "user_ix int, business_ix int, residual double")


def solve(rows, given, dst, src):
    out = {}
    for d in sorted({r[dst] for r in rows}):
        x = np.array([given[r[src]] for r in rows if r[dst] == d])
        v = np.array([np.float32(r[2]) for r in rows if r[dst] == d], float)
        out[d] = np.linalg.solve(x.T @ x + REG * len(x) * np.eye(RANK), x.T @ v).astype(np.float32).astype(float)
    return out


def factors(df):
    return {r.id: np.array(r.features) for r in df.collect()}


@pytest.mark.parametrize("batch", [7, 10_000])
def test_waves_equal_the_method_in_numpy(spark, rated, always, batch):
    rows, df = rated
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        model = recommend.fit_als(df, RANK, 2, REG, SEED)
        got = factors(recommend.user_factors(model)), factors(recommend.item_factors(model))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    users = dict(enumerate(als_waves.start_vectors(np.arange(30), RANK, SEED).astype(float)))
    for _ in range(2):
        items = solve(rows, users, 1, 0)
        users = solve(rows, items, 0, 1)
    for mine, want in zip(got, (users, items), strict=True):
        assert mine.keys() == want.keys()
        assert np.allclose([mine[k] for k in want], list(want.values()), atol=1e-4)
    pairs = recommend.predict_als(model, spark.createDataFrame([(3, 5), (99, 5)], "user_ix int, business_ix int")).orderBy("user_ix").collect()
    assert pairs[0].prediction == pytest.approx(users[3] @ items[5], abs=1e-4) and np.isnan(pairs[1].prediction)


def test_a_wave_sends_a_bounded_share(rated):
    for rank in (1, 3, 20, 70, 200):
        assert (4 * rank + 16) / als_waves.waves(rank) <= als_waves.SENT
    assert recommend.in_waves(154_000_000, 70) and not recommend.in_waves(26_000_000, 70)


def test_sweep_in_waves_has_the_same_rows_and_as_good_a_fit(spark, always, monkeypatch):
    grid = [dict(rank=20, reg=0.1, max_iter=3)]
    mine = recommender.sweep(spark, SF_SMALL, grid).collect()
    monkeypatch.setattr(recommend, "EXCHANGE_BYTES", 12 << 30)
    theirs = recommender.sweep(spark, SF_SMALL, grid).collect()
    assert [r[:4] for r in mine] == [r[:4] for r in theirs]
    assert mine[0].rmse == pytest.approx(theirs[0].rmse, rel=0.05)


def test_start_vectors_are_unit_and_differ():
    x = als_waves.start_vectors(np.arange(2000), 8, 1).astype(float)
    assert np.allclose((x * x).sum(1), 1, atol=1e-5)
    assert np.abs(x.mean(0)).max() < 0.05 and len({tuple(r) for r in x.tolist()}) == 2000
    assert not np.allclose(x, als_waves.start_vectors(np.arange(2000), 8, 2))


def test_a_null_stops_the_fit(spark, rated, always):
    with pytest.raises(Exception, match="holds a null"):
        recommend.fit_als(rated[1].withColumn("residual", F.when(F.col("user_ix") > 2, F.col("residual"))), RANK, 1, REG, SEED)
