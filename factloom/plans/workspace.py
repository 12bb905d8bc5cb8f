"""Intermediate tables in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch while a table is written: bounds a Python worker's memory also for very long texts.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}

_workspaces: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Where that is unset a local session gets a folder of its
    own; on a cluster that would lie on one machine only, so it is an error there."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = tempfile.mkdtemp(prefix="factloom-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def workspace(spark: SparkSession) -> str:
    """A folder of this session inside the shared one, removed when Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _workspaces:
        path = f"{shared_dir(spark).rstrip('/')}/factloom-{app}-{uuid.uuid4().hex[:8]}"
        _workspaces[app] = path
        atexit.register(_remove, spark, path)
    return _workspaces[app]


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for what is executed inside; the caller's are as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Small Arrow batches for what is executed inside."""
    return _settings(spark, _BATCHES)


def few_listing_tasks(spark: SparkSession) -> AbstractContextManager[None]:
    """Folders that are listed inside are dealt over a few tasks for each core.  By default each folder is a task of its own, up to
    10,000 of them, which takes the driver more time than the listing takes the tasks."""
    return _settings(spark, {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism)})


def few_folders(spark: SparkSession) -> AbstractContextManager[None]:
    """Rows that are written inside go to folders by a column of few values: a task keeps a file open for each of them, up to 64, and does
    not sort its rows."""
    return _settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": "64"})


def sorted_groups(spark: SparkSession) -> AbstractContextManager[None]:
    """Lists that are collected inside are made one after the other from rows in the order of their groups.  By default a task that meets
    more than 128 groups sorts all its rows, then the lists, and on the disk what the memory does not hold of either."""
    return _settings(spark, {"spark.sql.execution.useObjectHashAggregateExec": "false"})


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, and
    what is read later survives the loss of any executor.  Parquet keeps it smaller
    than a checkpoint of rows."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
