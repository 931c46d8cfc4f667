"""The exact split: its count, and the same rows whatever the layout.  The index that grows."""

import hashlib
from collections import Counter

import pytest

from ratewise.operators import split


def both(df, key, share=(4, 5)):
    train, test = split.exact_split(df, key, share)
    return Counter(map(tuple, train.collect())), Counter(map(tuple, test.collect()))


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_count_by_md5(spark, n):
    df = spark.range(n).selectExpr("cast(id as string) AS k")
    train, test = both(df, "k")
    order = sorted((str(i) for i in range(n)), key=lambda k: hashlib.md5(k.encode()).hexdigest())
    want = (8 * n + 5) // 10
    assert train == Counter((k,) for k in order[:want]) and test == Counter((k,) for k in order[want:])


def test_same_rows_under_any_partitioning(spark):
    rows = [(i % 50 or None, f"text {i % 333}") for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, t string")
    one = both(df.repartition(1), "k")
    assert sum(one[0].values()) == 800 and one[0] + one[1] == Counter(rows)
    for parts in (3, 8):
        assert both(df.repartition(parts), "k") == one


@pytest.mark.parametrize("share,want", [((4, 5), 720), ((0, 1), 0), ((1, 1), 900), ((1, 3), 300)])
def test_a_hot_key_of_identical_rows(spark, share, want):
    """Two thirds of all rows are one row: as many of its copies as are wanted stay."""
    rows = [("hot", 1)] * 600 + [(f"k{i}", i) for i in range(300)]
    train, test = both(spark.createDataFrame(rows, "k string, v int").repartition(5), "k", share)
    assert sum(train.values()) == want and train + test == Counter(rows)


def test_empty_table(spark):
    train, test = both(spark.createDataFrame([], "k string"), "k")
    assert not train and not test


def test_index_grows_without_moving_numbers(spark):
    batches = [["m", "c", None, "c"], ["a", "m", "z"], [], [None, "b", "a", "aa", "b"]]
    frames = [spark.createDataFrame([(k,) for k in b], "k string") for b in batches]
    index = split.dense_index(frames[0], "k")
    before = {r[0]: r[1] for r in index.collect()}
    assert before == {None: 0, "c": 1, "m": 2}
    for batch, frame in zip(batches[1:], frames[1:], strict=True):
        index = split.grow_index(index, frame, "k")
        now = {r[0]: r[1] for r in index.collect()}
        assert {k: now[k] for k in before} == before
        fresh = sorted(k for k in set(batch) - set(before))
        assert [now[k] for k in fresh] == list(range(len(before), len(before) + len(fresh)))
        before = now
    grown = split.grow_index(index.limit(0), frames[0], "k")
    assert {r[0]: r[1] for r in grown.collect()} == {None: 0, "c": 1, "m": 2}
