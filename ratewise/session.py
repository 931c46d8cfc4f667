"""Session construction and shared-storage helpers.

Library code never creates its own session; it receives one.  ``get_session``
is for tests, the bench and command-line use.  Checkpoints always go to the
folder the cluster names in ``spark.checkpoint.dir``; a private folder is only
chosen when that setting is absent (local tests).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, Row, SparkSession


# Settings for the 100 TB deployment, used by ``get_session`` where the submit
# settings leave them open.  Shuffle partitions start high and AQE coalesces them to
# ~256 MB; input splits match; AQE splits skewed join partitions and converts
# joins to broadcast only below a measured size.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, partitions: int = 8, app: str = "ratewise") -> SparkSession:
    """A session for tests, bench and command line.

    Loopback host, memory and partition settings are for a local master only.  On a
    cluster the submit settings hold, and what they leave open comes from ``CLUSTER_CONF``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # under spark-submit its settings are in the JVM already
        SparkContext._ensure_initialized()
    given = SparkConf()
    where = master or given.get("spark.master", "local[*]")
    conf = {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    if is_local(where):
        conf |= {
            "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.cleaner.referenceTracking.cleanCheckpoints": "true", "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1", "spark.driver.memory": "16g",
        }
    else:
        conf |= {k: v for k, v in CLUSTER_CONF.items() if not given.contains(k)}
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_local(master: str) -> bool:
    """Whether driver and executors are one process (local-cluster has several)."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.  Only a local master may do without the setting: it
    gets a private folder, which goes with the process; elsewhere a folder of this
    machine would be lost on the others, so that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="ratewise-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_WRITTEN: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for written intermediates."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _WRITTEN.append(path)
    return path


def clean_up(spark: SparkSession) -> None:
    """Delete every intermediate that this process wrote; call it when results are written,
    also after a failure (the command line and the bench do)."""
    paths, _WRITTEN[:] = list(_WRITTEN), []
    remove_paths(spark, paths)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet below the shared checkpoint folder and read it back.

    The returned frame's plan is a plain file scan: lineage is cut, iterative
    plans stay small, and the data survives executor loss."""
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def one_row(aggregate: DataFrame) -> Row:
    """The row of an aggregate without groups: a few numbers, whatever the size of its input."""
    return aggregate.first()


def bucketed_table(df: DataFrame, key, buckets: int, name: str) -> str:
    """Write ``df`` as a table bucketed (and sorted) by ``key`` (a column or a
    list of columns) in the shared folder; returns the table name."""
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    path = shared_path(spark, name)
    table = f"rw_{name}_{uuid.uuid4().hex[:12]}".replace("-", "_")
    # Hash-partitioning by the bucket key first makes each task write exactly one
    # bucket file (instead of one file per bucket per task).
    (df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(table))
    return table


def remove_paths(spark: SparkSession, paths) -> None:
    """Delete intermediate outputs through the Hadoop FileSystem API (works on
    HDFS / object stores as well as local disks)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a temporary bucketed table and delete its files."""
    loc = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").select("data_type").first()
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    if loc is not None:
        remove_paths(spark, [loc[0]])
