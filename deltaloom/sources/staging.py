"""Relations written to the shared folder and read back, which cuts lineage and survives lost executors.

A stage is a Parquet folder below spark.checkpoint.dir.  The shuffle files of the job that writes it are removed
with the job's end, as nothing reads them again; `drop` removes a stage that nothing reads any more, and what is
left goes when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where it is unset: a temporary folder if all runs in this process, else
    one in the warehouse, which a cluster's machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            base = "file://" + tempfile.mkdtemp(prefix="deltaloom-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_deltaloom"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/deltaloom/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs inside remove their shuffle files when they end."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and returns the relation that reads it."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return owning(spark.read.schema(df.schema).parquet(path), path)


def owning(df: DataFrame, source: DataFrame | str) -> DataFrame:
    """df, so that `drop` of it removes the stage of source."""
    df._stage = source if isinstance(source, str) else getattr(source, "_stage", None)
    return df


def drop(*stages: DataFrame) -> None:
    """Removes stages; whatever still reads them fails, so drop what only finished stages were made from."""
    for df in stages:
        path = getattr(df, "_stage", None)
        if path in _MADE:
            _delete(path, _MADE.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_all() -> None:
    for path, spark in _MADE.items():
        try:
            if spark.sparkContext._jsc is None or spark.sparkContext._jvm is None:
                continue
            _delete(path, spark)
        except Exception:  # the JVM may be gone already
            return
