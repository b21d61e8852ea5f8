"""Session helpers and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDER: dict[str, str] = {}
_PASSING = threading.local()


def local_session(cpus: int | str = "*", app: str = "quire", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for cut points: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session, where driver and executors are one process, may
    fall back to a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDER:
        _LOCAL_FOLDER[app] = tempfile.mkdtemp(prefix="quire-")
    return _LOCAL_FOLDER[app]


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/quire-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{'/'.join([_own_folder(spark), *getattr(_PASSING, 'folders', [])])}/{label}-{uuid.uuid4().hex}"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Cut points made inside go when it ends well; results that read them must be stored elsewhere by then."""
    outer = getattr(_PASSING, "folders", [])
    _PASSING.folders = [*outer, f"passing-{uuid.uuid4().hex}"]
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join([_own_folder(spark), *_PASSING.folders]))
    try:
        yield
    finally:
        _PASSING.folders = outer
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def at_once(*steps: Callable[[], None]) -> None:
    """Run steps that do not need each other side by side: short Spark jobs leave most cores idle one after the other."""
    folders = getattr(_PASSING, "folders", [])

    def run(step: Callable[[], None]) -> None:
        _PASSING.folders = folders
        step()

    with ThreadPoolExecutor(max(1, len(steps))) as pool:
        for done in [pool.submit(run, step) for step in steps]:
            done.result()


def drop_scratch(spark: SparkSession) -> None:
    """Remove this application's cut points; DataFrames that read them stop working."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str, partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The copy outlives lost executors, is computed once however often it is
    used, and carries its true size, so that later joins broadcast it only
    when it really is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


# Inputs up to this size may be spread over all cores before costly row work.
SPREAD_BYTES = 256 * 1024 * 1024


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of a small input that came in too few blocks.

    A small file is often a single row group, which one task would have to
    work through alone. Larger inputs keep the partitions of their scan, so
    this never shuffles more than a fixed amount.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)
