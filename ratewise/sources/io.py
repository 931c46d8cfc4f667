"""Readers and writers.

Reads use explicit schemas (no inference pass; filters and projections are
pushed into the scan).  Writes are distributed: one file per task, never
funnelled through the driver; a single output file is only offered for
bounded tables (``files=1`` on k-row results such as centroids).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("business_id", T.StringType()),
    T.StructField("stars", T.DoubleType()),
    T.StructField("date", T.DateType()),
    T.StructField("text", T.StringType()),
    T.StructField("useful", T.IntegerType()),
    T.StructField("funny", T.IntegerType()),
    T.StructField("cool", T.IntegerType()),
])

BUSINESS = T.StructType([
    T.StructField("business_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("neighborhood", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("postal_code", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("stars", T.DoubleType()),
    T.StructField("review_count", T.IntegerType()),
    T.StructField("is_open", T.IntegerType()),
    # Every attribute by name; nested ones as their JSON text, so no field is lost.
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("hours", T.MapType(T.StringType(), T.StringType())),
])


CORRUPT = "_corrupt_record"


def read_json(spark: SparkSession, paths, schema: T.StructType) -> DataFrame:
    """JSON lines with a fixed schema plus ``_corrupt_record``: the text of a line that
    can't be read as it is, null for all others (absent fields read as null).

    A record in which a field doesn't fit its type keeps its other fields, and the field
    reads as null; a line that is no JSON object has no field at all."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(paths).where(F.trim("value") != "")
    # A generator, because a filter on a field would otherwise be pushed below the projection
    # and parse every line a second time.
    return lines.select(F.inline(F.array(F.from_json("value", full, {"columnNameOfCorruptRecord": CORRUPT}))))


def _no_object(line: Column) -> Column:
    return line.isNotNull() & F.json_object_keys(line).isNull()


def read_reviews(spark: SparkSession, paths, schema: T.StructType = REVIEW) -> DataFrame:
    """JSON-lines reviews; lines that are no object are left out here and listed by
    ``malformed_lines``, records with an ill-typed field stay and are listed by ``partial_lines``."""
    return read_json(spark, paths, schema).where(~_no_object(F.col(CORRUPT))).drop(CORRUPT)


def read_business(spark: SparkSession, paths, schema: T.StructType = BUSINESS) -> DataFrame:
    """Nested JSON businesses; malformed lines as in ``read_reviews``."""
    return read_json(spark, paths, schema).where(~_no_object(F.col(CORRUPT))).drop(CORRUPT)


def malformed_lines(spark: SparkSession, paths, schema: T.StructType) -> DataFrame:
    """The lines that are no JSON object (count them before trusting a load)."""
    return read_json(spark, paths, schema).where(_no_object(F.col(CORRUPT))).select(F.col(CORRUPT).alias("line"))


def partial_lines(spark: SparkSession, paths, schema: T.StructType) -> DataFrame:
    """The records that were read with some field as null because its value doesn't fit its type."""
    line = F.col(CORRUPT)
    return read_json(spark, paths, schema).where(line.isNotNull() & ~_no_object(line)).select(line.alias("line"))


def load_report(spark: SparkSession, paths, schema: T.StructType) -> DataFrame:
    """(n_read, n_malformed) of a JSON-lines load, in one pass; records read in part count as read."""
    bad = _no_object(F.col(CORRUPT))
    return read_json(spark, paths, schema).agg(F.count_if(~bad).alias("n_read"), F.count_if(bad).alias("n_malformed"))


def attribute(name: str, *path: str):
    """One business attribute as text; ``path`` goes into a nested one."""
    value = F.col("attributes")[name]
    return F.get_json_object(value, "$." + ".".join(path)) if path else value


def from_rows(spark: SparkSession, rows, schema) -> DataFrame:
    """S3: small in-memory relation (bounded driver-side rows only)."""
    return spark.createDataFrame(rows, schema)


def _files(df: DataFrame, files: int | None) -> DataFrame:
    return df.coalesce(files) if files else df


def write_json(df: DataFrame, path: str, files: int | None = None, compression: str = "none") -> str:
    """JSON lines; ``files`` caps the file count (bounded tables only)."""
    _files(df, files).write.mode("overwrite").json(path, compression=compression)
    return path


def flatten_nested(df: DataFrame) -> DataFrame:
    """Struct, array and map columns as JSON text, so CSV can hold them."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, files: int | None = None) -> str:
    """CSV with header; nested columns are written as JSON text (no driver collect)."""
    w = _files(flatten_nested(df), files).write.mode("overwrite").option("header", True)
    w.option("quoteAll", True).option("escape", '"').csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return (r.schema(schema) if schema is not None else r).csv(path)


def write_parquet(df: DataFrame, path: str) -> str:
    """S16."""
    df.write.mode("overwrite").parquet(path)
    return path


def write_text(df: DataFrame, path: str) -> str:
    """One JSON document per line via ``to_json(struct(*))``."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
    return path


def read_text_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")


def concat_files(spark: SparkSession, paths: list[str], out: str) -> str:
    """Bag union of the lines of several datasets, written as one dataset."""
    spark.read.text(paths).write.mode("overwrite").text(out)
    return out


def chunk_files(df: DataFrame, path: str, rows_per_file: int = 50_000, fmt: str = "json") -> str:
    """Split output into files of at most ``rows_per_file`` rows each."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).format(fmt).save(path)
    return path


def union_all(*dfs: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def preview(df: DataFrame, n: int = 20, order_by=None) -> DataFrame:
    """First n rows (ordered when a key is given)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def first_n(df: DataFrame, n: int, order_by) -> DataFrame:
    """Deterministic first-n sample."""
    return df.orderBy(*([order_by] if isinstance(order_by, str) else order_by)).limit(n)


def read_table(spark: SparkSession, name: str, partitions: int | None = None) -> DataFrame:
    """Named table scan, optionally hash-repartitioned."""
    df = spark.table(name)
    return df.repartition(partitions) if partitions else df
