"""Products of a sparse matrix with a narrow block, tile by tile.

The entries of a matrix with dense row and column numbers are packed once into tiles of
bounded size, three arrays each (row, column, value); a tile with far more entries than the
others is dealt over several.  A block of ``b`` columns is a table (s, x): slice ``s`` holds
the numbers ``s * SLICE`` on, as ``b`` rows of doubles.

A product sends each slice once to every tile of its range, and every tile returns slices of
partial sums.  With g x g tiles that is g times the two blocks, where a row for each key of
each task comes near to a row for each entry.  The entries themselves never move again, and
no task holds more than one tile and its part of the two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratewise.session import bucketed_table, drop_table, materialise, one_row

SLICE = 16384
TILE_BYTES = 96 << 20  # of the two blocks in one tile
TILE_ENTRIES = 3 << 20
LEAST = 1 << 16  # entries below which a tile isn't dealt out
PACK = 1 << 16  # entries of a tile that a task packs together
HELD = 1 << 21  # entries that a packing task holds at most
BLOCK = "s int, x binary"


def slices(n: int) -> int:
    return -(-n // SLICE)


def partitions(spark: SparkSession, n: int) -> int:
    """Partitions for a block of ``n`` numbers: no more than slices, a few slices each."""
    return max(1, min(slices(n), max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def _batch(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([s for s, _ in rows], pa.int32()), pa.array([np.ascontiguousarray(x).tobytes() for _, x in rows], pa.binary())], names=["s", "x"])


@dataclass
class Tiles:
    table: str
    route: DataFrame  # t, p, q: the tiles, a bounded number of entries each
    n_rows: int
    n_cols: int
    p_slices: int
    q_slices: int

    def product(self, block: DataFrame, key_in: str, b: int, skip: int | None = None) -> DataFrame:
        """The matrix times a block over its columns (``key_in`` "col_ix"), or its transpose times
        a block over its rows ("row_ix"); number ``skip`` of the block counts as 0."""
        spark = self.route.sparkSession
        sides = [("p", "r", self.n_rows, self.p_slices), ("q", "c", self.n_cols, self.q_slices)]
        (at_out, out, n_out, per_out), (at_in, into, n_in, per_in) = sides if key_in == "col_ix" else sides[::-1]
        # One row a tile, so broadcast is safe.
        sent = block.withColumn(at_in, F.floor(F.col("s") / per_in).cast("int")).join(F.broadcast(self.route), at_in).select("t", "p", "q", "s", "x")

        def run(tile: pa.Table, given: pa.Table) -> pa.Table:
            if not tile.num_rows or not given.num_rows:
                return pa.table({"s": pa.array([], pa.int32()), "x": pa.array([], pa.binary())})
            low, start = (given.column(at)[0].as_py() * per * SLICE for at, per in ((at_in, per_in), (at_out, per_out)))
            x, width = np.zeros((b, min(per_in * SLICE, n_in - low))), min(per_out * SLICE, n_out - start)
            for s, d in zip(given.column("s").to_pylist(), given.column("x"), strict=True):
                part = np.frombuffer(d.as_buffer()).reshape(b, -1)
                x[:, s * SLICE - low:s * SLICE - low + part.shape[1]] = part
            if skip is not None and low <= skip < low + x.shape[1]:
                x[:, skip - low] = 0
            whole = lambda name, kind: np.concatenate([np.frombuffer(d.as_buffer(), kind) for d in tile.column(name)])
            here, there, values = whole(into, np.int32).astype(np.intp), whole(out, np.int32).astype(np.intp), whole("v", float)
            y = np.empty((b, width))
            for j in range(b):
                y[j] = np.bincount(there, x[j][here] * values, width)
            return pa.Table.from_batches([_batch([(start // SLICE + k, y[:, k * SLICE:(k + 1) * SLICE]) for k in range(slices(width))])])

        parts = spark.table(self.table).groupBy("t").cogroup(sent.groupBy("t")).applyInArrow(run, BLOCK)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, total = None, None
            for batch in batches:
                for s, d in zip(batch.column("s").to_pylist(), batch.column("x"), strict=True):
                    x = np.frombuffer(d.as_buffer())
                    if s == now:
                        total += x
                        continue
                    if now is not None:
                        yield _batch([(now, total)])
                    now, total = s, x.copy()
            if now is not None:
                yield _batch([(now, total)])

        return parts.repartition(partitions(spark, n_out), "s").sortWithinPartitions("s").mapInArrow(add, BLOCK)

    def drop(self) -> None:
        drop_table(self.route.sparkSession, self.table)


def pack(entries: DataFrame, n_rows: int, n_cols: int, b: int) -> Tiles:
    """Tiles of entries (row_ix, col_ix, value) with row numbers below ``n_rows`` and column
    numbers below ``n_cols``, for blocks of up to ``b`` columns."""
    spark = entries.sparkSession
    cores = spark.sparkContext.defaultParallelism

    def per_tile(side: int) -> tuple[int, int]:
        return -(-slices(n_rows) // side), -(-slices(n_cols) // side)

    def placed(p_slices: int, q_slices: int) -> DataFrame:
        r, c = F.col("row_ix").cast("long"), F.col("col_ix").cast("long")
        p, q = F.floor(r / (p_slices * SLICE)).cast("int"), F.floor(c / (q_slices * SLICE)).cast("int")
        return entries.select(p.alias("p"), q.alias("q"), (r - p.cast("long") * p_slices * SLICE).cast("int").alias("r"),
                              (c - q.cast("long") * q_slices * SLICE).cast("int").alias("c"), F.col("value").cast("double").alias("v"))

    n = entries.count()
    most = max(LEAST, min(TILE_ENTRIES, -(-n // (2 * cores))))
    side = max(1, math.ceil((n_rows + n_cols) * 8 * b / TILE_BYTES), math.ceil(math.sqrt(n / most)))
    p_slices, q_slices = per_tile(side)
    sized = placed(p_slices, q_slices).groupBy("p", "q").agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) / most)).cast("int").alias("k"))
    # One row a tile, the entries divided by TILE_ENTRIES: a running sum numbers them, broadcast is safe.
    before = Window.orderBy("p", "q").rowsBetween(Window.unboundedPreceding, -1)
    given = materialise(sized.withColumn("first", F.coalesce(F.sum("k").over(before), F.lit(0)).cast("int")), "tile-sizes")
    route = given.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("k") - 1)).alias("t"), "p", "q")
    count = one_row(given.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")))["n"]
    salt = F.pmod(F.xxhash64("r", "c"), F.col("k")).cast("int")
    rows = placed(p_slices, q_slices).join(F.broadcast(given), ["p", "q"]).select((F.col("first") + salt).alias("t"), "r", "c", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        count = 0

        def out(ts: list[int]) -> Iterator[pa.RecordBatch]:
            for t in ts:
                parts = held.pop(t)
                one = [np.concatenate([p[k] for p in parts]).tobytes() for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32())] + [pa.array([d], pa.binary()) for d in one], names=["t", "r", "c", "v"])

        for batch in batches:
            t, r, c, v = (np.asarray(batch.column(k)) for k in ("t", "r", "c", "v"))
            order = np.argsort(t, kind="stable")
            t, r, c, v = t[order], r[order], c[order], v[order]
            at = np.flatnonzero(np.diff(t, prepend=-1)).tolist()
            for lo, hi in zip(at, [*at[1:], len(t)], strict=True):
                held.setdefault(int(t[lo]), []).append((r[lo:hi], c[lo:hi], v[lo:hi]))
            count += len(t)
            if count >= HELD:
                yield from out(sorted(held))
                count = 0
        yield from out(sorted(held))

    packed = rows.mapInArrow(run, "t int, r binary, c binary, v binary")
    table = bucketed_table(packed, "t", max(1, min(2 * count, 10_000)), "tiles")
    return Tiles(table, route, n_rows, n_cols, p_slices, q_slices)


# ---------------------------------------------------------------- blocks

def each(block: DataFrame, make: Callable[[np.ndarray], np.ndarray], b: int) -> DataFrame:
    """The block with ``make`` applied to the (b, n) values of every slice; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, d in zip(batch.column("s").to_pylist(), batch.column("x"), strict=True):
                yield _batch([(s, make(np.frombuffer(d.as_buffer()).reshape(b, -1)))])

    return block.mapInArrow(run, BLOCK)


def combine(block: DataFrame, t: np.ndarray) -> DataFrame:
    """The block times a small matrix."""
    t = np.ascontiguousarray(np.asarray(t, float).T)
    return each(block, lambda x: t @ x, t.shape[1])


def gram_rows(block: DataFrame, b: int) -> DataFrame:
    """(i, j, g): the products of the block's columns, formed in the tasks; b (b + 1) / 2 rows."""
    ii, jj = np.triu_indices(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((b, b))
        for batch in batches:
            for d in batch.column("x"):
                x = np.frombuffer(d.as_buffer()).reshape(b, -1)
                g += x @ x.T
        yield pa.RecordBatch.from_arrays([pa.array(ii.astype("int32")), pa.array(jj.astype("int32")), pa.array(g[ii, jj])], names=["i", "j", "g"])

    return block.select("s", "x").mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def beside(blocks: list[DataFrame], n: int) -> DataFrame:
    """Blocks over the same ``n`` numbers as one, the columns of the first one first."""
    every = None
    for i, one in enumerate(blocks):
        one = one.select("s", F.lit(i).alias("i"), "x")
        every = one if every is None else every.unionByName(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for s, d in zip(batch.column("s").to_pylist(), batch.column("x").to_pylist(), strict=True):
                if s != now and held:
                    yield _batch([(now, np.frombuffer(b"".join(held)))])
                    held = []
                now = s
                held.append(d)
        if held:
            yield _batch([(now, np.frombuffer(b"".join(held)))])

    return every.repartition(partitions(every.sparkSession, n), "s").sortWithinPartitions("s", "i").mapInArrow(run, BLOCK)


def from_rows(rows: DataFrame, number: str, cols: list[str], n: int) -> DataFrame:
    """A block from rows that hold the numbers below ``n``, each once, and a value for each of ``cols``."""
    at = F.col(number).cast("long")
    given = rows.select(F.floor(at / SLICE).cast("int").alias("s"), at.alias("at"), *[F.col(c).cast("double").alias(f"k{j}") for j, c in enumerate(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            s, at = np.asarray(batch.column("s")), np.asarray(batch.column("at"))
            values = np.array([np.asarray(batch.column(f"k{j}")) for j in range(len(cols))])
            begins = np.flatnonzero(np.diff(s, prepend=-1)).tolist()
            for lo, hi in zip(begins, [*begins[1:], len(s)], strict=True):
                if s[lo] != now:
                    if now is not None:
                        yield _batch([(now, x)])
                    now = int(s[lo])
                    x = np.zeros((len(cols), min(SLICE, n - now * SLICE)))
                x[:, at[lo:hi] - now * SLICE] = values[:, lo:hi]
        if now is not None:
            yield _batch([(now, x)])

    return given.repartition(partitions(rows.sparkSession, n), "s").sortWithinPartitions("s").mapInArrow(run, BLOCK)


def to_rows(block: DataFrame, number: str, cols: list[str]) -> DataFrame:
    """The rows of a block: the number as long, and a column for each of ``cols``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, d in zip(batch.column("s").to_pylist(), batch.column("x"), strict=True):
                x = np.frombuffer(d.as_buffer()).reshape(len(cols), -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1]) + s * SLICE), *[pa.array(row) for row in x]], names=[number, *cols])

    return block.mapInArrow(run, f"{number} long, " + ", ".join(f"{c} double" for c in cols))
