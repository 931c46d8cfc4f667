"""Products of a sparse matrix tile by tile, against numpy and by what they move."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from scales import SF_SMALL

from ratewise.operators import matrix, sparse_pca, tiles
from ratewise.sources import views

ROWS, COLS = 40_000, 36_000


@pytest.fixture(scope="module")
def given(spark):
    """Entries over several slices; row 7 holds a third of them."""
    rng = np.random.default_rng(3)
    r, c = rng.integers(0, ROWS, 200_000), rng.integers(0, COLS, 200_000)
    r[::3] = 7
    keys = np.unique(r * COLS + c)
    r, c, v = keys // COLS, keys % COLS, rng.normal(size=len(keys))
    return r, c, v, spark.createDataFrame(list(zip(r.tolist(), c.tolist(), v.tolist(), strict=True)), "row_ix long, col_ix long, value double").cache()


def block(spark, x):
    names = [f"k{j}" for j in range(x.shape[1])]
    rows = spark.createDataFrame([(i, *map(float, one)) for i, one in enumerate(x)], "n long, " + ", ".join(f"{c} double" for c in names))
    return tiles.from_rows(rows, "n", names, len(x))


def values(got, b):
    names = [f"k{j}" for j in range(b)]
    return np.array([list(r)[1:] for r in tiles.to_rows(got, "n", names).orderBy("n").collect()])


def test_products_equal_numpy_both_ways(spark, given):
    r, c, v, e = given
    rng = np.random.default_rng(4)
    a = tiles.pack(e, ROWS, COLS, 3)
    x, y = rng.normal(size=(COLS, 3)), rng.normal(size=(ROWS, 3))
    want, back = np.zeros((ROWS, 3)), np.zeros((COLS, 3))
    np.add.at(want, r, v[:, None] * x[c])
    np.add.at(back, c, v[:, None] * y[r])
    assert np.allclose(values(a.product(block(spark, x), "col_ix", 3), 3), want)
    assert np.allclose(values(a.product(block(spark, y), "row_ix", 3), 3), back)
    skipped = np.zeros((COLS, 3))
    np.add.at(skipped, c[r != 7], (v[:, None] * y[r])[r != 7])
    assert np.allclose(values(a.product(block(spark, y), "row_ix", 3, skip=7), 3), skipped)
    a.drop()


def test_a_product_moves_slices_and_no_entries(spark, given):
    e = given[3]
    a = tiles.pack(e, ROWS, COLS, 2)
    got = a.product(block(spark, np.ones((COLS, 2))), "col_ix", 2)
    text = got._jdf.queryExecution().executedPlan().toString()
    cogroup = text[text.index("FlatMapCoGroupsInArrow"):]
    assert cogroup.count("Exchange hashpartitioning(t") == 1  # that of the block
    assert a.route.count() * tiles.slices(ROWS) < 200 < e.count()
    a.drop()


def test_a_hot_row_is_dealt_over_tiles(spark, given, monkeypatch):
    monkeypatch.setattr(tiles, "LEAST", 1000)
    a = tiles.pack(given[3], ROWS, COLS, 2)
    sizes = [r.n for r in spark.table(a.table).groupBy("t").agg(F.sum(F.octet_length("v") / 8).alias("n")).collect()]
    assert sum(sizes) == given[3].count()
    assert max(sizes) < 3 * np.mean(sizes)
    a.drop()


def test_svd_of_ids_that_are_no_numbers(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(14, 9)) * (rng.random((14, 9)) < 0.7)
    e = spark.createDataFrame([(f"r{i}", int(j) * 1000 - 5, float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "row_ix string, col_ix int, value double")
    got = matrix.truncated_svd(e, 2)
    assert np.allclose(got.s, np.linalg.svd(a, compute_uv=False)[:2], rtol=1e-8)
    assert got.u.dtypes[0] == ("row_ix", "string") and got.v.dtypes[0] == ("col_ix", "int")
    assert {r.col_ix for r in got.v.collect()} == {j * 1000 - 5 for j in range(9) if a[:, j].any()}


def test_pca_without_rows_of_blocks_on_the_way(spark, monkeypatch):
    """Blocks are sent as slices: no product joins rows with entries."""
    seen = []
    monkeypatch.setattr(sparse_pca, "_multiply", lambda a, *more: seen.append(type(a)) or matrix._multiply(a, *more))
    rng = np.random.default_rng(2)
    a = rng.integers(1, 6, (15, 8)) * (rng.random((15, 8)) < 0.6)
    e = spark.createDataFrame([(int(i), f"c{j}", float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "row_ix long, col_ix string, value double")
    got = sparse_pca.pca_entries(e, 15, 2)
    assert np.allclose(got.values, np.sort(np.linalg.eigvalsh(np.cov(a.T)))[::-1][:2])
    assert set(seen) == {tiles.Tiles}


def test_stars_are_those_of_the_ratings(spark):
    names = ["user_id", "business_id", "stars"]
    views._BUILT.pop((views.fingerprint(spark, SF_SMALL), "ratings"), None)
    got = views.stars(spark, SF_SMALL)
    assert "md5" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.exceptAll(views.ratings(spark, SF_SMALL).select(names)).isEmpty()
    assert got.count() == views.ratings(spark, SF_SMALL).count()
