"""The batched KMeans sweep and silhouettes against numpy and pyspark.ml."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ratewise.operators import lloyd


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    mid = rng.uniform(-3, 3, (5, 2)) + [70.0, 40.0]
    return np.concatenate([m + rng.normal(0, 0.2, (60, 2)) for m in mid])


@pytest.fixture(scope="module")
def points(spark, data):
    return spark.createDataFrame([tuple(map(float, r)) for r in data], "longitude double, latitude double").repartition(4)


def single(x, centres, rounds, tolerance=1e-4):
    """One fit by itself in numpy."""
    for _ in range(rounds):
        at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[at == j].mean(0) if (at == j).any() else centres[j] for j in range(len(centres))])
        moved = np.sqrt(((new - centres) ** 2).sum(1)).max()
        centres = new
        if moved <= tolerance:
            break
    return centres, ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


def test_all_fits_equal_single_fits(data, points):
    rng = np.random.default_rng(6)
    given = [lloyd.Fit(k, s, data[rng.choice(len(data), k, replace=False)]) for k in (2, 3, 7) for s in (1, 2)]
    done = lloyd.sweep(points, given=given)
    for g, f in zip(given, done.fits, strict=True):
        centres, cost = single(data, g.centres, 20)
        assert np.allclose(f.centres + done.origin, centres) and f.cost == pytest.approx(cost)
    assert done.scans <= 2 + 20  # one for the mean, one a round for all six fits


def test_scans_follow_rounds_not_fits(points):
    few, many = lloyd.sweep(points, (3,), (1,)), lloyd.sweep(points, (3,), (1, 2, 3, 4, 5, 6))
    assert many.scans <= 1 + 3 + max(f.rounds for f in many.fits) + 1
    assert few.fits[0].cost == pytest.approx(many.fits[0].cost)


def test_starts_are_the_same_under_any_partitioning(points):
    origin = np.array([70.0, 40.0])
    a, b = lloyd.starts(points, 6, (1, 2), origin), lloyd.starts(points.repartition(1), 6, (1, 2), origin)
    assert all((a[s] == b[s]).all() for s in (1, 2)) and not np.allclose(a[1], a[2])
    assert len(np.unique(a[1], axis=0)) == 6


def test_sweep_costs_are_those_of_pyspark_ml(points):
    done = lloyd.sweep(points, (5,), (1, 2, 3, 4, 5, 6))
    vec = VectorAssembler(inputCols=["longitude", "latitude"], outputCol="features").transform(points)
    theirs = min(KMeans(k=5, seed=s).fit(vec).summary.trainingCost for s in (1, 2, 3))
    assert done.best()[0].cost == pytest.approx(theirs, rel=1e-6)


def test_silhouettes(points):
    done = lloyd.sweep(points, (4, 5), (1, 2))
    values = lloyd.mean_silhouettes(done, done.best())
    for f, value in zip(done.best(), values, strict=True):
        at = F.array(*[sum((F.pow(F.col(c) - float(v), 2) for c, v in zip(done.cols, row, strict=True)), F.lit(0.0)) for row in f.centres + done.origin])
        own = points.withColumn("cluster", (F.array_position(at, F.array_min(at)) - 1).cast("int"))
        vec = VectorAssembler(inputCols=["longitude", "latitude"], outputCol="features").transform(own)
        theirs = ClusteringEvaluator(predictionCol="cluster", featuresCol="features").evaluate(vec)
        assert value == pytest.approx(theirs, abs=1e-9)
        each = lloyd.point_silhouette(own, "cluster")
        assert each.agg(F.avg("silhouette")).first()[0] == pytest.approx(theirs, abs=1e-9)


def test_few_points_ties_and_missing_coordinates(spark):
    two = spark.createDataFrame([(1.0, 1.0)] * 5 + [(2.0, 1.0)], "longitude double, latitude double")
    done = lloyd.sweep(two, (4,), (1,))
    assert len(done.fits[0].centres) == 2 and done.fits[0].cost == pytest.approx(0.0)
    assert lloyd.mean_silhouettes(done, done.fits) == [pytest.approx(5 / 6)]  # the lone point counts 0
    assert lloyd.sweep_report(two.limit(0)).count() == 0
    with pytest.raises(Exception, match="without a coordinate"):
        lloyd.sweep(two.unionByName(spark.createDataFrame([(None, 1.0)], two.schema)), (2,), (1,))
