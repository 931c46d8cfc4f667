"""Quality classifier: held-out accuracy, the identity against all pairs, edges."""

import numpy as np

from ratewise.llm import fm


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = fm.rate_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)
    bad = [r for r in got if r.quality == 0]
    assert sum(r.predicted == 0 for r in bad) >= 0.9 * len(bad)


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = fm.Machine(0.3, rng.normal(size=fm.SIZE), rng.normal(size=(fm.SIZE, fm.RANK)))
    at, x = fm.features(b"Some words, and some MORE words!\nAnd a line\nAnd a line", 55)
    slow = m.bias + sum(m.w[i] * a for i, a in zip(at, x, strict=True))
    for p in range(len(at)):
        for q in range(p):
            slow += m.v[at[p]] @ m.v[at[q]] * x[p] * x[q]
    assert abs(m.raw(at, x) - slow) < 1e-9


def test_learns_an_interaction():
    """Neither word tells anything alone; the pair does."""
    rows = []
    for i in range(600):
        a, b = i % 2, (i // 2) % 2
        data = (b"alpha " if a else b"beta ") + (b"gamma" if b else b"delta")
        rows.append((*fm.features(data, None), int(a == b)))
    m = fm.fit(rows * 5)
    assert all((m.score(b" ".join(p), None) > 0.5) == y for p, y in (((b"alpha", b"gamma"), 1), ((b"alpha", b"delta"), 0), ((b"beta", b"delta"), 1), ((b"beta", b"gamma"), 0)))


def test_edges(frame, spark):
    rows = [(1, None), (2, ""), (None, "x"), (3, "w " * 200_000), (4, "same"), (4, "same")]
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, None, 0), (None, 1, 1), (4, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    got = fm.rate_quality(frame(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= fm.PASS) for r in got)
    none = fm.rate_quality(frame(rows), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert fm.rate_quality(frame(rows).limit(0), labels).count() == 0
    assert fm.rate_quality(frame(rows).drop("n_chars"), labels).count() == len(rows)


def test_repeated_id_counts_once(frame, spark):
    """The sample is bounded in rows, however often a doc_id occurs."""
    ids = [1, 2, 3, 4, 5]
    rows = [(d, f"text {d} {i % 2}") for d in ids for i in range(200)]
    labels = spark.createDataFrame([(d, 1, 0) for d in ids], "doc_id long, quality int, toxic int")
    assert 0 < len(fm.training_rows(frame(rows), labels)) <= len(ids)


def test_clashing_n_chars(frame, spark):
    """A column n_chars that holds no numbers counts as null."""
    rows = [(i, f"text {i} " * 5) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    df = frame(rows).drop("n_chars")
    plain = sorted(tuple(r) for r in fm.rate_quality(df, labels).collect())
    for other in ("'many'", "array(1)", "map('a', 1)", "true", "cast(null as string)"):
        assert sorted(tuple(r) for r in fm.rate_quality(df.selectExpr("*", f"{other} AS n_chars"), labels).collect()) == plain
