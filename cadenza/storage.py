"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Paths made in each settled() that is under way, the innermost last.
_MADE: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where none is named, a temporary folder of this machine does in local mode only; elsewhere
    other machines could not read it, and ValueError is raised.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if path:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(path)
        return path
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cadenza-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends, if not before."""
    path = f"{scratch_dir(spark)}/cadenza-{label}-{uuid.uuid4().hex}"
    target, fs = _place(spark, path)
    fs.deleteOnExit(target)
    if _MADE:
        _MADE[-1].append(path)
    return path


def _place(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that stored() returned, which nothing may read any more."""
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        target, fs = _place(df.sparkSession, folder)
        fs.delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so when the driver's JVM has
    collected what refers to them, which may else be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(build: Callable[[], DataFrame], label: str) -> DataFrame:
    """What build() returns, stored; the tables that it stored on its way, which nothing else may
    read, are deleted, and its shuffle files with them."""
    _MADE.append([])
    try:
        out = stored(build(), label)
    finally:
        made = _MADE.pop()
    release(out.sparkSession)
    for path in made[:-1]:
        target, fs = _place(out.sparkSession, path)
        fs.delete(target, True)
    if _MADE:
        _MADE[-1].append(made[-1])
    return out
