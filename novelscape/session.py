"""Session helpers: a local session for tests and benches, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("novelscape")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def concurrently(work: Callable, items: Iterable, width: int = 8) -> list:
    """``work`` of each item, with the Spark jobs of up to ``width`` items at once."""
    with ThreadPool(width) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(work), items)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints; a local session without that setting gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="novelscape-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside deletes its shuffles as it ends, not whenever the driver collects its garbage.

    The setting is the session's.  Of several threads one puts it back; what others write meanwhile may keep its shuffles.
    """
    old = spark.conf.get(_CLEANUP, None)
    if old == "true":
        yield
        return
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if old is None else spark.conf.set(_CLEANUP, old)


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the cluster's shared folder, so that all readers see the same rows.

    Used where a later step must agree with values that depend on the physical
    partitioning, and where one result feeds many jobs.
    """
    shared_folder(df.sparkSession)
    # Selected anew, so that what is deleted belongs to this run and to no other one of ``df``.
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def fresh_path(spark: SparkSession) -> str:
    """A new folder for a table in the shared folder."""
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, schema: StructType | None = None, path: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again, with another schema of the same fields if given."""
    path = path or fresh_path(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)
