"""The centroid grid against a comparison with all centroids: densities, ties, edges, work a point."""

import numpy as np
import pytest

from ratewise.operators import centroid_grid as G


def frame(spark, xy, name=None):
    rows = [(float(x), float(y), i if name is None else name(i)) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, f"longitude double, latitude double, {'point int' if name is None else 'cluster_name string'}")


def label(i):
    return f"c{i:06d}"


def brute(points, cents):
    """The smaller index wins a tie, as the smaller name does."""
    d = (points[:, None, 0] - cents[None, :, 0]) ** 2 + (points[:, None, 1] - cents[None, :, 1]) ** 2
    return [label(i) for i in d.argmin(1)]


def places(kind, rng):
    if kind == "even":
        return rng.uniform(-1, 1, (2000, 2))
    if kind == "lattice":  # every point between four places ties
        return np.array([(x, y) for x in range(40) for y in range(40)], float)
    if kind == "knot":  # nearly all places in a tiny spot, far from most points
        return np.concatenate([rng.normal(0, 1e-5, (1900, 2)), rng.uniform(-1, 1, (100, 2))])
    return np.concatenate([rng.normal(m, s, (500, 2)) for m, s in ((-1, 0.3), (0, 0.01), (0.5, 0.001), (1, 0.1))])


@pytest.mark.parametrize("kind", ["even", "lattice", "knot", "mixed"])
def test_equals_all_centroids(spark, kind):
    rng = np.random.default_rng(7)
    cents = places(kind, rng)
    low, high = cents.min(0), cents.max(0)
    points = np.concatenate([rng.uniform(low - 0.2, high + 0.2, (300, 2)), cents[rng.choice(len(cents), 300)],
                             np.floor(rng.uniform(low, high, (300, 2))) + 0.5])
    pts, cs = frame(spark, points), frame(spark, cents, label)
    grid = G.build_grid(pts, cs)
    got = G.nearest_in_grid(pts, grid, met_col="met").orderBy("point").collect()
    assert [r.cluster_name for r in got] == brute(points, cents)
    assert np.mean([r.met for r in got]) <= G.TARGET


def test_work_a_point_stays_flat(spark):
    rng = np.random.default_rng(3)
    points = frame(spark, rng.uniform(0, 1, (500, 2)))
    met = []
    for k in (200, 4000):
        grid = G.build_grid(points, frame(spark, rng.uniform(0, 1, (k, 2)), label))
        met.append(np.mean([r.met for r in G.nearest_in_grid(points, grid, met_col="met").collect()]))
    assert met[1] <= 1.3 * met[0] <= 1.3 * G.TARGET


def test_a_ring_of_ties_ends(spark):
    """Places at one distance from a point stay candidates there at every depth."""
    turn = np.arange(40) * (2 * np.pi / 40)
    cents = np.stack([np.cos(turn), np.sin(turn)], 1)
    points = np.array([(0.0, 0.0), (0.5, 0.1), (1e-9, 0), (-3, 2)])
    got = G.nearest_centroid_indexed(frame(spark, points), frame(spark, cents, label)).orderBy("point").collect()
    assert [r.cluster_name for r in got] == brute(points, cents)


def test_edges(spark):
    cents = spark.createDataFrame([(0.0, 0.0, "b"), (0.0, 0.0, "a"), (4.0, 0.0, "z"), (None, 1.0, "n"), (float("nan"), 1.0, "m"), (2.0, 0.0, None)],
                                  "longitude double, latitude double, cluster_name string")
    rows = [(0, 0.1, 0.0, "own"), (0, 0.1, 0.0, "own"), (1, None, 0.0, "own"), (2, float("nan"), 0.0, None), (3, 2.0, 0.0, "tie"), (4, float("inf"), 0.0, None), (5, 3.0, 1e6, None)]
    pts = spark.createDataFrame(rows, "`a.b` int, longitude double, latitude double, cluster_name string")
    got = sorted(((r["a.b"], r.cluster_name) for r in G.nearest_centroid_indexed(pts, cents).collect()), key=str)
    assert got == [(0, "a"), (0, "a"), (1, None), (2, None), (3, "a"), (4, None), (5, "z")]
    none = G.nearest_centroid_indexed(pts, cents.limit(0)).collect()
    assert len(none) == len(rows) and all(r.cluster_name is None for r in none)
    assert G.nearest_centroid_indexed(pts.limit(0), cents).count() == 0
    one = frame(spark, [(5.0, 5.0)] * 3)
    assert {r.cluster_name for r in G.nearest_centroid_indexed(one, frame(spark, [(5.0, 5.0)], label)).collect()} == {label(0)}


def test_without_broadcast(spark):
    rng = np.random.default_rng(5)
    points, cents = np.concatenate([rng.uniform(0, 1, (200, 2)), np.full((400, 2), 0.25)]), rng.uniform(0, 1, (300, 2))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = G.nearest_centroid_indexed(frame(spark, points), frame(spark, cents, label)).orderBy("point").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert [r.cluster_name for r in got] == brute(points, cents)
