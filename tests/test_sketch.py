"""Frequent directions against numpy: the bound, merge orders, hard tables."""

import numpy as np
import pytest

from ratewise.operators import sketch


def matrix(n=3000, d=20):
    rng = np.random.default_rng(8)
    return rng.normal(size=(n, 5)) @ rng.normal(size=(5, d)) * 3 + rng.normal(size=(n, d)) + 0.5


def frame(spark, x, parts):
    return spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(parts)


def holds(b, a, size):
    """Every direction is short by at most ``lost``, and ``lost`` keeps its bound."""
    gap = np.linalg.eigvalsh(a.T @ a - b.rows.T @ b.rows)
    eps = 1e-8 * (a**2).sum()
    assert gap.min() >= -eps and gap.max() <= b.lost + eps
    assert b.lost <= ((a**2).sum() - (b.rows**2).sum()) / size + eps
    assert len(b.rows) < size


@pytest.mark.parametrize("parts", [1, 5, 40])
@pytest.mark.parametrize("size", [4, 12])
def test_bound_under_any_partitioning(spark, parts, size):
    a = matrix()
    b = sketch.frequent_directions(frame(spark, a, parts), "v", size)
    holds(b, a, size)
    assert b.n == len(a) and np.allclose(b.sums, a.sum(0)) and b.total == pytest.approx((a**2).sum())


def test_any_merge_order_keeps_the_bound():
    a, size = matrix(600), 6
    rng = np.random.default_rng(9)
    for _ in range(5):
        parts = []
        for x in np.array_split(a[rng.permutation(len(a))], 9):
            rows, off = sketch.shrink(x, size)
            parts.append(sketch._record(0, len(x), off, float((x**2).sum()), x.sum(0), rows))
        while len(parts) > 1:
            i, j = sorted(rng.choice(len(parts), 2, replace=False), reverse=True)
            parts.append(sketch.merged([parts.pop(i), parts.pop(j)], size, 0))
        r = parts[0].to_pylist()[0]
        holds(sketch.Sketch(np.array(r["rows"]).reshape(-1, 20), r["lost"], r["n"], np.array(r["sums"]), r["total"]), a, size)


def test_wide_sketch_gives_the_exact_pca(spark):
    a = matrix()
    values, vectors = sketch.frequent_directions(frame(spark, a, 4), "v", 21).pca(3)
    exact, axes = np.linalg.eigh(np.cov(a.T))
    assert np.allclose(values, exact[::-1][:3])
    assert np.allclose(np.abs((vectors * axes[:, ::-1][:, :3]).sum(0)), 1)


def test_hard_tables(spark):
    assert sketch.frequent_directions(spark.createDataFrame([], "v array<double>"), "v").n == 0
    one = sketch.frequent_directions(spark.createDataFrame([([1.0, 2.0],)], "v array<double>"), "v", 4)
    assert one.lost == 0 and np.allclose(one.rows, [[1.0, 2.0]])
    for bad in ([([1.0],), ([1.0, 2.0],)], [([1.0],), (None,)], [([1.0],), ([None],)], [([float("nan")],)]):
        with pytest.raises(Exception, match="sketch:"):
            sketch.frequent_directions(spark.createDataFrame(bad, "v array<double>").coalesce(1), "v")
    with pytest.raises(ValueError):
        sketch.frequent_directions(spark.range(1), "id", 1)
