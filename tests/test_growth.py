"""What grows with the data: blocks, shuffled rows, width of products, files."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from scales import SF_SMALL

from ratewise import session
from ratewise.operators import als, centroid_grid, matrix, recommend, sparse_pca
from ratewise.sources import io


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def entries(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "row_ix long, col_ix long, value double")


@pytest.fixture
def widths(monkeypatch):
    """Widths of the blocks that the entries are multiplied with."""
    seen = []

    def spy(*args, **more):
        seen.append(args[6])
        return plain(*args, **more)

    plain = matrix._multiply
    monkeypatch.setattr(matrix, "_multiply", spy)
    monkeypatch.setattr(sparse_pca, "_multiply", spy)
    return seen


def test_blocks_follow_memory_not_ratings(spark):
    cores = max(10, spark.sparkContext.defaultParallelism)
    many = spark.range(40_000_000)
    assert recommend._blocks(many, 3) <= max(3, cores)
    assert recommend._blocks(many, 10) == max(5, cores)
    assert recommend._blocks(many, 70) == max(23, cores)


def test_sweep_keeps_no_scored_rows(spark):
    from ratewise.plans.recommender import sweep

    before = len(session._WRITTEN)
    assert sweep(spark, SF_SMALL, [dict(rank=2, reg=0.1, max_iter=1)]).count() == 1
    assert not [p for p in session._WRITTEN[before:] if os.path.basename(p).startswith("scored")]


@pytest.mark.parametrize("heavy", [5, 1000])
def test_svd_multiplies_narrow_blocks_only(spark, widths, monkeypatch, heavy):
    monkeypatch.setattr(matrix, "HEAVY", heavy)
    rng = np.random.default_rng(5)
    a = rng.integers(1, 6, (30, 20)) * (rng.random((30, 20)) < 0.3)
    got = matrix.truncated_svd(entries(spark, a), 2, block=4, salts=3)
    u, s, v = np.linalg.svd(a)
    assert np.allclose(got.s, s[:2], rtol=1e-4)
    left = np.array([list(r)[1:] for r in got.u.orderBy("row_ix").collect()])
    rows = sorted({i for i in range(30) if a[i].any()})
    assert abs(left[:, 0] @ u[rows, 0]) == pytest.approx(1, abs=1e-3)
    assert max(widths) <= 4


def test_pca_multiplies_narrow_blocks_only(spark, widths, monkeypatch):
    monkeypatch.setattr(matrix, "HEAVY", 5)
    rng = np.random.default_rng(6)
    a = rng.integers(1, 6, (30, 20)) * (rng.random((30, 20)) < 0.3)
    got = sparse_pca.pca_entries(entries(spark, a), 30, 2, block=4)
    assert np.allclose(got.values, np.sort(np.linalg.eigvalsh(np.cov(a.T)))[::-1][:2], rtol=1e-2)
    assert max(widths) <= 4


def test_pca_counts_the_row_without_an_id(spark):
    rng = np.random.default_rng(8)
    a = rng.integers(1, 6, (12, 6)) * (rng.random((12, 6)) < 0.7)
    a[0] *= 4
    e = entries(spark, a).withColumn("row_ix", F.when(F.col("row_ix") > 0, F.col("row_ix")))
    got = sparse_pca.pca_entries(e, 12, 2, block=3)
    assert np.allclose(got.values, np.sort(np.linalg.eigvalsh(np.cov(a.T)))[::-1][:2], rtol=1e-6)


def test_ratings_of_a_side_are_not_shuffled_again(spark):
    df = spark.createDataFrame([(u, i, 1.0) for u in range(20) for i in range(5)], "user_id int, business_id int, residual double")
    side = als.deal(df, "user_id", "business_id", "residual", 10, 10)
    text = side.rows.groupBy("block").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text
    side.drop()


@pytest.mark.parametrize("few", [0, 4096])
def test_grid_rounds_agree(spark, monkeypatch, few):
    """Candidates dealt by cell, and those that stay where they are."""
    monkeypatch.setattr(centroid_grid, "FEW", few)
    rng = np.random.default_rng(7)
    cents, points = rng.normal(size=(200, 2)).round(3), rng.normal(size=(50, 2)).round(3)
    c = spark.createDataFrame([(f"c{i:03}", float(x), float(y)) for i, (x, y) in enumerate(cents)], "cluster_name string, longitude double, latitude double")
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id int, longitude double, latitude double")
    got = {r["id"]: r["cluster_name"] for r in centroid_grid.nearest_centroid_indexed(p, c).collect()}
    for i, at in enumerate(points):
        gap = ((cents - at) ** 2).sum(axis=1)
        assert gap[int(got[i][1:])] == pytest.approx(gap.min())


def test_json_lines_are_parsed_once(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([('{"review_id":"a","stars":2.0}',), ("no json",), ('{"review_id":"b","useful":"many","stars":3.0}',), (" ",)], "value string").write.text(path)
    df = io.read_reviews(spark, path).select("review_id", "stars")
    assert len(re.findall(r"from_json|jsontostructs", plan(df))) == 1
    assert sorted(map(tuple, df.collect())) == [("a", 2.0), ("b", 3.0)]
    assert [r[0] for r in io.malformed_lines(spark, path, io.REVIEW).collect()] == ["no json"]


def test_city_reviews_file_is_compressed(spark):
    from ratewise.plans.catalog import _city_files

    path = _city_files(spark, SF_SMALL)[2]
    names = [n for n in os.listdir(path.removeprefix("file:")) if n.startswith("part-")]
    assert names and all(n.endswith(".json.gz") for n in names)
    assert io.read_reviews(spark, path).where(F.col("review_id").isNull()).count() == 0


@pytest.mark.parametrize("heavy", [2, 1000])
def test_row_lists_join_no_row_by_key(spark, heavy, monkeypatch):
    """Short keys are numbered where they meet and heavy ones by the range sort: the same lists,
    and no row is sent to a join with its key's first number."""
    monkeypatch.setattr(matrix, "HEAVY", heavy)
    pairs = [(b, u, float(u[-1]) / 2) for b in ("b1", "b2", None) for u in ("u1", "u2", "u3", "u3")] + [("b3", "u1", 1.0), ("b3", None, 2.0)]
    df = spark.createDataFrame([(b, u, s) for b, u, s in pairs], "business_id string, user_id string, stars double").repartition(3)
    rows = matrix.rows_by_item(df)
    got = sorted(map(tuple, rows.collect()), key=repr)
    want = []
    for b in {b for b, _, _ in pairs}:
        own = sorted([(u, s) for x, u, s in pairs if x == b], key=lambda p: (p[0] is not None, p[0] or "", p[1]), reverse=True)
        want += [(b, i, u, s) for i, (u, s) in enumerate(own)]
    assert got == sorted(want, key=repr)
    assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert max(len(r.pairs) for r in matrix.row_blocks(rows, "business_id", "user_id", "stars", 2).collect()) == 2


def test_many_keys_are_joined_by_hash(spark, monkeypatch):
    monkeypatch.setattr(matrix, "MANY_KEYS", 2)
    df = spark.createDataFrame([("u1", "b1", 1.0), (None, "b2", 2.0), ("u2", None, 3.0)], "user_id string, business_id string, stars double")
    e = matrix.rating_entries(df)
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((x.row_ix, x.col_ix, x.value) for x in e.collect()) == [(0, 0, 3.0), (1, 1, 1.0), (2, 2, 2.0)]
