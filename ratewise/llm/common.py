"""Shared pieces of the corpus operators: table access, words, Arrow passes, row ids.

Conventions of the whole subpackage:

* A *word* is a maximal run outside ``[\\x20\\x09-\\x0D]``; Python's ``bytes.split``
  and ``bytes.lower`` use exactly that set and ASCII-only lower-casing.
* Columns that an operator adds to a caller's frame start with ``__rw_``, so any
  name a caller may use can pass through unharmed.
* Rows are told apart by ``__rw_uid``, which is only used after it has been
  written to the shared folder; doc_id may repeat or be null.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewise.session import remove_paths, shared_path

SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
UID = "__rw_uid"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def col(name: str) -> Column:
    """A column by its literal name (dots included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def only(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[col(n) for n in names])


def with_uid(df: DataFrame) -> DataFrame:
    return df.withColumn(UID, F.monotonically_increasing_id())


def words(data: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text, A-Z lower-cased."""
    return data.lower().split() if data else []


def utf8(array: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return array.cast(kind).to_pylist()


def crc_of_id(doc_id: int | None) -> int:
    """crc32 of doc_id written as text; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def crc_column(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def add_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """``df`` plus ``fields``, which ``make`` computes from each Arrow batch; the
    other columns pass through unchanged."""
    from pyspark.sql.pandas.types import to_arrow_type

    names = df.columns + [f.name for f in fields]
    # Plain names on the way: mapInArrow itself can't address names with dots.
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = T.StructType(list(plain.schema.fields) + fields)
    types = [to_arrow_type(f.dataType) for f in fields]
    given = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            named = pa.RecordBatch.from_arrays(list(batch.columns), names=given)
            new = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(make(named), types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                list(batch.columns) + new, names=list(batch.schema.names) + [f.name for f in fields])

    return plain.mapInArrow(run, schema).toDF(*names)


def one_per_id(df: DataFrame, *names: str) -> DataFrame:
    """One row for each doc_id, the one of least content hash: a bounded number of ids then
    is a bounded number of rows.  Combined in the tasks first."""
    least = F.min(F.struct(F.xxhash64(*[col(n) for n in names]).alias("h"), *[col(n) for n in names])).alias("r")
    return df.groupBy("doc_id").agg(least).select("doc_id", *[F.col("r")[n].alias(n) for n in names])


class Scratch:
    """The intermediate tables written while it is open, deleted on request."""

    open_now: list[Scratch] = []

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        Scratch.open_now.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        Scratch.open_now.remove(self)

    def clear(self, spark: SparkSession, *keep: DataFrame) -> None:
        """Delete the tables but those that ``keep`` (frames made by ``settle``) read."""
        kept = {getattr(df, "_rw_path", None) for df in keep}
        gone = [p for p in self.paths if p not in kept]
        remove_paths(spark, gone)
        self.paths = [p for p in self.paths if p in kept]


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back (row ids and layout are then fixed)."""
    path = shared_path(df.sparkSession, f"llm-{name}")
    for scratch in Scratch.open_now:
        scratch.paths.append(path)
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    back._rw_path = path
    return back
