"""Lines of text files in file order: numbering, concatenation and chunks.

Spark reads a file in splits, and a line belongs to the split it begins in.  Every line
is written once with its file, the byte offset of its split and its position there; the
lines of each split are counted, and running sums over the splits in (path, file, offset)
order give every line its number in the concatenation.  No task sees more than one
split's lines, and the running sum is over one row for each split.

A line is what Spark's text reader gives: empty lines count, a last line may lack its
end.  Files of a folder come in name order, the given paths in the given order; a path
given twice is read twice.  Without lines all results are empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratewise.session import materialise

SPLIT = ["_path", "_file", "_start"]


def numbered_lines(spark: SparkSession, paths: list[str] | str, with_file: bool = False) -> DataFrame:
    """(line long from 0, value) of the concatenation of ``paths``; ``with_file`` adds each
    line's file as a third column."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    each = [spark.read.text(p).select(
        F.lit(i).alias("_path"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), "value")
        for i, p in enumerate(paths)]
    # Ids grow along a task's lines; written, because another reading may deal the splits otherwise.
    rows = materialise(reduce(lambda a, b: a.unionAll(b), each).withColumn("_id", F.monotonically_increasing_id()), "lines")
    splits = rows.groupBy(*SPLIT).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(*SPLIT, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(materialise(starts, "splits"), SPLIT).select(
        (F.col("_id") + F.col("_shift")).alias("line"), "value", *([F.col("_file").alias("file")] if with_file else []))


def chunk_lines(lines: DataFrame, path: str, size: int = 50_000) -> str:
    """Numbered lines as files of ``size`` lines; file i, in folder ``chunk=i`` (eight
    digits, so names sort as numbers), holds the lines from i * size on, in order."""
    at = F.floor(F.col("line") / size)
    rows = lines.select(F.format_string("%08d", at).alias("chunk"), "line", "value")
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", "line").select("chunk", "value")
    # The tasks move their files to the folder themselves; the driver would move them one by
    # one.  A repeated task writes the same names.
    rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("chunk").text(path)
    return path


def concat_in_order(spark: SparkSession, paths: list[str], path: str) -> str:
    """The lines of ``paths`` one after the other, as files whose name order is that order."""
    numbered_lines(spark, paths).orderBy("line").select("value").write.mode("overwrite").text(path)
    return path
