import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents of a test: rows (doc_id, text[, lang[, source]]), whole and with clashing extras."""

    def make(rows, parts=3):
        full = [(r + (None,) * (4 - len(r)))[:4] + (len(r[1]) if r[1] is not None else None, "x", 1, True) for r in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, "
                  "kept string, size int, `group.size` boolean").repartition(parts)

    return make


@pytest.fixture(scope="session")
def sample():
    """Real documents of the smallest table as (doc_id, text, lang, source)."""
    import duckdb

    return duckdb.connect().execute(
        "SELECT doc_id, text, lang, source FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY 1").fetchall()
