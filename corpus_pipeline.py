"""The training-data pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller (as
``run`` does) writes as Parquet and reads again as the next stage's documents.  When a
stage begins, the result before it is written, so it first deletes the intermediate
tables of the stages before it: disk holds those of one stage at a time.  Every run has
its own list of them, and a stage never deletes those of its own or a later position, so
the result of an earlier run can still be read while another run is under way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ratewise.llm import exact, mixing, near, packing, rules
from ratewise.llm.common import Scratch, documents
from ratewise.session import remove_paths, shared_path


def _stage(at: int, work: Callable[[DataFrame], DataFrame], left: list[Scratch]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for scratch in left[:at]:
            scratch.clear(spark)
        with left[at]:
            return work(docs)

    return stage


def _stages() -> list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]]:
    work = [("quality_rules", rules.keep_good), ("exact_dedup", exact.drop_copies), ("minhash_near_dedup", near.drop_near),
            ("mix_sources", mixing.mix), ("best_fit_packing", packing.pack)]
    left = [Scratch() for _ in work]
    return [(name, _stage(at, f, left)) for at, (name, f) in enumerate(work)]


STAGES = _stages()

# Tokenizing and hash-ordered mixing can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    stages = _stages()
    for name, stage in stages[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_paths(spark, [before])
        docs, before = spark.read.parquet(path), path
    return stages[-1][1](spark, docs, sf_dir)
