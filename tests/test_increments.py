"""Lines in file order, records read in part, mergeable bias state, PCA of sparse entries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scales import SF_SMALL
from ratewise.operators import bias_state as B
from ratewise.operators.bias import fit_bias
from ratewise.operators.sparse_pca import column_moments, pca_entries, project_entries
from ratewise.plans.increments import _matrix
from ratewise.sources import io as IO
from ratewise.sources import lines as L
from ratewise.sources import views as V


def test_lines_keep_the_order_of_files_and_splits(spark, tmp_path):
    """Numbers follow paths, file names and bytes, also where a file is cut into many splits."""
    texts = {"b/2.txt": [f"b2 {i} " + "x" * (i % 90) for i in range(4000)], "b/1.txt": ["b1", "", "last without end"], "a/9.txt": [f"a {i}" for i in range(777)]}
    for name, rows in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join(rows) + ("" if name == "b/1.txt" else "\n"))
    want = texts["b/1.txt"] + texts["b/2.txt"] + texts["a/9.txt"]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        got = L.numbered_lines(spark, [str(tmp_path / "b"), str(tmp_path / "a")])
        assert [tuple(r) for r in got.orderBy("line").collect()] == list(enumerate(want))
        out = L.chunk_lines(got, str(tmp_path / "chunks"), 100)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = sorted(tmp_path.glob("chunks/chunk=*/part-*.txt"))
    assert len(files) == -(-len(want) // 100)
    for i, f in enumerate(files):
        assert f.parent.name == f"chunk={i:08d}" and f.read_text().split("\n")[:-1] == want[100 * i:100 * i + 100]
    again = L.concat_in_order(spark, [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "joined"))
    both = [x for f in sorted((tmp_path / "joined").glob("part-*.txt")) for x in f.read_text().split("\n")[:-1]]
    assert both == texts["a/9.txt"] + texts["b/1.txt"] + texts["b/2.txt"] and again


def test_no_lines(spark, tmp_path):
    (tmp_path / "empty.txt").write_text("")
    assert L.numbered_lines(spark, str(tmp_path / "empty.txt")).count() == 0


def test_a_bad_field_costs_that_field_only(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text('{"review_id":"r1","useful":"many","stars":4.5,"cool":2}\n{"review_id":"r2","useful":1,"stars":2.0}\nno json\n[1]\n{"review_id":"r3", oops\n\n')
    got = {r.review_id: r for r in IO.read_reviews(spark, str(p)).collect()}
    assert set(got) == {"r1", "r2"}
    assert (got["r1"].useful, got["r1"].stars, got["r1"].cool, got["r2"].useful) == (None, 4.5, 2, 1)
    assert tuple(IO.load_report(spark, str(p), IO.REVIEW).first()) == (2, 3)
    assert [r.line[:17] for r in IO.partial_lines(spark, str(p), IO.REVIEW).collect()] == ['{"review_id":"r1"']
    assert sorted(r.line for r in IO.malformed_lines(spark, str(p), IO.REVIEW).collect()) == ["[1]", "no json", '{"review_id":"r3", oops']


def test_state_equals_a_refit(spark, tmp_path):
    """Batches in any order, repeated loads and take-backs give the model of the rows that count."""
    r = V.ratings(spark, SF_SMALL).select("user_id", "business_id", F.when(F.col("stars") != 1.5, F.col("stars")).alias("stars"))
    r = r.withColumn("user_id", F.when(F.col("user_id") != "u7", F.col("user_id"))).withColumn("p", F.abs(F.hash("user_id", "business_id", "stars")) % 3)
    path = str(tmp_path / "state")
    for g, part in ((5, 2), (1, 0), (1, 0), (3, 1)):
        B.add_batch(r.where(F.col("p") == part), path, g)
    B.add_batch(r.where("p = 1"), path, 9, take_back=True)
    B.add_batch(r.limit(0), path, 10)
    got, want = B.load_bias(spark, B.compact(spark, path, str(tmp_path / "one"))), fit_bias(r.where("p <> 1 and stars is not null"))
    for a, b in ((got.users, want.users), (got.items, want.items)):
        assert {tuple(x) for x in a.collect()} == {tuple(x) for x in b.select(*a.columns).collect()}
    assert spark.range(1).select(got.mu.alias("a"), want.mu.alias("b")).first() == spark.range(1).select(want.mu.alias("a"), want.mu.alias("b")).first()
    plan = got.users._jdf.queryExecution().optimizedPlan().toString()
    assert "stars" not in plan  # the state is read, no rating is


def dense(entries, n_rows, scaled):
    a = np.zeros((n_rows, 1 + max(c for _, c, _ in entries)))
    for r, c, v in entries:
        a[r, c] = v
    if scaled:
        s = a.std(0, ddof=1)
        a = (a - a.mean(0)) / np.where(s > 0, s, 1)
    return a


@pytest.mark.parametrize("scaled", [False, True])
def test_pca_equals_dense_numpy_on_500_columns(spark, scaled):
    """Entries of a low-rank matrix with noise, a column and a row that hold far more than others, empty rows."""
    rng = np.random.default_rng(5)
    n, d = 300, 500
    base = rng.normal(size=(n, 4)) * [9, 6, 4, 3] @ rng.normal(size=(4, d)) + 2
    mask = rng.random((n, d)) < 0.3
    mask[:, 0] = mask[1, :] = True
    mask[280:] = False
    entries = [(int(i), int(j), float(base[i, j])) for i, j in zip(*np.nonzero(mask), strict=True)]
    df = spark.createDataFrame(entries, "row_ix long, col_ix long, value double")
    model = pca_entries(df, n, 3, scaled, block=6)
    a = dense(entries, n, scaled)
    b = a - a.mean(0)
    values, vectors = np.linalg.eigh(b.T @ b / (n - 1))
    assert np.allclose(model.values, values[::-1][:3], rtol=1e-4)
    assert np.isclose(model.total, values.sum(), rtol=1e-9)
    got = {r["col_ix"]: [r[f"v{j}"] for j in range(3)] for r in model.components.collect()}
    v = np.array([got.get(j, [0.0] * 3) for j in range(d)])
    assert np.allclose(np.abs((v * vectors[:, ::-1][:, :3]).sum(0)), 1, atol=1e-3)
    rows = {r["row_ix"]: [r[f"pc_{j + 1}"] for j in range(3)] for r in project_entries(df, model).collect()}
    assert np.allclose([rows.get(i, -model.centre) for i in range(n)], b @ v, atol=1e-6)


def test_many_columns_and_no_variance(spark):
    """100,000 columns: nothing of that size squared, or at all, reaches the driver."""
    wide = spark.range(200_000).select((F.col("id") % 50).alias("row_ix"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("col_ix"), F.lit(1.0).alias("value"))
    wide = wide.groupBy("row_ix", "col_ix").agg(F.sum(F.col("value") * (F.col("row_ix") % 2 * 3 + 1)).alias("value"))
    model = pca_entries(wide, 50, 1, block=3)
    assert model.components.count() == wide.select("col_ix").distinct().count() > 80_000
    along = project_entries(wide, model).agg(F.var_samp("pc_1").alias("v")).first().v
    assert along == pytest.approx(model.values[0], rel=1e-6) and 0 < model.shares()[0] < 1
    for none in (wide.limit(0), spark.range(5).select(F.col("id").alias("row_ix"), F.lit(3).cast("long").alias("col_ix"), F.lit(2.0).alias("value"))):
        assert len(pca_entries(none, 5, 2).values) == 0
        assert project_entries(none, pca_entries(none, 5, 2)).columns == ["row_ix"]


def test_moments_count_absent_cells(spark):
    e, n = _matrix(spark, SF_SMALL)
    row = column_moments(e, n).agg(F.sum(F.col("mean") * n).alias("s")).first()
    assert row.s == pytest.approx(e.agg(F.sum("value")).first()[0])
