"""File sources and sinks: write, read back, file layout."""

import glob
import json
import os

from pyspark.sql import functions as F

from scales import SF_SMALL
from ratewise.operators.prep import reviews_in_city
from ratewise.sources import io as IO
from ratewise.sources import views as V


def test_chunk_files_caps_rows_per_file(spark, tmp_path):
    r = V.ratings(spark, SF_SMALL).select("review_id", "stars")
    path = IO.chunk_files(r, str(tmp_path / "chunks"), rows_per_file=500)
    files = glob.glob(os.path.join(path, "*.json"))
    sizes = [sum(1 for _ in open(f)) for f in files]
    assert max(sizes) <= 500 and sum(sizes) == r.count()


def test_single_file_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    path = IO.write_json(df, str(tmp_path / "one"), files=1)
    assert len(glob.glob(os.path.join(path, "*.json"))) == 1


def test_nested_csv_keeps_structure_as_json(spark, tmp_path):
    b = V.business_nested(spark, SF_SMALL)
    path = IO.write_csv(b, str(tmp_path / "csv"))
    back = IO.read_csv(spark, path)
    row = back.where(F.col("business_id") == "b1").first()
    cats = json.loads(row.categories)
    assert isinstance(cats, list) and len(cats) == 2
    assert set(json.loads(row.attributes)) == {"BikeParking", "RestaurantsPriceRange2", "Ambience"}
    assert json.loads(row.hours) == {"Monday": "9:0-17:0"}
    assert back.count() == b.count()


def test_concat_is_bag_union(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    a = IO.write_json(df, str(tmp_path / "a"))
    b = IO.write_json(df, str(tmp_path / "b"))
    out = IO.concat_files(spark, [a, b], str(tmp_path / "c"))
    assert sorted(r.x for r in spark.read.schema("x int").json(out).collect()) == [1, 1, 2, 2, 2, 2]


def test_city_join_is_left_to_measured_sizes(spark):
    j = reviews_in_city(V.ratings(spark, SF_SMALL), V.business(spark, SF_SMALL), "Montreal", ("small ring",),
                        ["review_id", "business_id"])
    assert "ResolvedHint" not in j._jdf.queryExecution().analyzed().toString()
    assert j.count() > 0


def test_review_reader_has_fixed_schema(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text('{"review_id":"r1","user_id":"u1","business_id":"b1","stars":4.5,"extra":1}\n')
    df = IO.read_reviews(spark, str(p))
    assert df.schema == IO.REVIEW
    assert df.first().stars == 4.5 and df.first().text is None


def test_malformed_lines_are_listed_and_attributes_kept(spark, tmp_path):
    p = tmp_path / "b.json"
    p.write_text('{"business_id":"b1","attributes":{"WiFi":"free","HasTV":true,"BusinessParking":{"garage":false,"lot":true}}}\n{"business_id":"b2", oops\n')
    assert [r.business_id for r in IO.read_business(spark, str(p)).collect()] == ["b1"]
    assert [r.line for r in IO.malformed_lines(spark, str(p), IO.BUSINESS).collect()] == ['{"business_id":"b2", oops']
    row = IO.read_business(spark, str(p)).select(
        IO.attribute("WiFi").alias("w"), IO.attribute("HasTV").alias("t"), IO.attribute("BusinessParking", "lot").alias("l")).first()
    assert tuple(row) == ("free", "true", "true")


def test_checkpoint_folder_rules(spark, monkeypatch):
    """No private folder and no loopback settings away from a local master."""
    import pytest

    from ratewise import session

    assert session.is_local("local") and session.is_local("local[8]")
    assert not session.is_local("local-cluster[3,2,1024]") and not session.is_local("spark://host:7077") and not session.is_local("yarn")

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_changed_folder_is_a_new_key(spark, tmp_path):
    import shutil

    for t in ("lineitem", "orders", "part"):
        shutil.copy(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    first = V.ratings(spark, str(tmp_path)).count()
    import duckdb

    duckdb.execute(f"COPY (FROM '{SF_SMALL}/lineitem.parquet' WHERE l_linenumber = 1) TO '{tmp_path}/lineitem.parquet'")
    assert V.ratings(spark, str(tmp_path)).count() < first


def test_dataset_counts_without_expand(spark):
    from ratewise.operators.stats import density

    plan = density(V.ratings(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
