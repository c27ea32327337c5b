"""Listings of files, with their sizes and companions."""

from __future__ import annotations

import resource
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.music import file_name, file_stem
from cadenza.storage import stored

#: Audio files that are listed; those that are not WAV give an error row.
AUDIO = ["wav", "mp3", "flac", "m4a", "aiff"]
LISTING = "path string, length long, name string, stem string"


def peak_mb() -> float:
    """The most memory that this process, a task's worker, has held so far, in MB."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * (1 if sys.platform == "darwin" else 1024) / 1e6


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def list_files(spark: SparkSession, folders: Iterable[str], extensions: Iterable[str], content: bool = False) -> DataFrame:
    """Files of some extensions in folders, not below them; folders that don't exist are skipped.

    A folder that is named twice counts twice.  path, length (bytes), name, stem, and content.
    """
    glob = "*.{" + ",".join(extensions) + "}"
    found = None
    for folder in folders:
        if _exists(spark, folder):
            rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
            rows = rows.select("path", "length", file_name(F.col("path")).alias("name"), file_stem(F.col("path")).alias("stem"), *(["content"] if content else []))
            found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], LISTING + (", content binary" if content else "")) if found is None else found


def require(spark: SparkSession, paths: Iterable[str]) -> None:
    """Raise FileNotFoundError for the first path that doesn't exist, before anything is run."""
    for path in paths:
        if not _exists(spark, path):
            raise FileNotFoundError(path)


def companions(files: DataFrame, audio: DataFrame, order: Iterable[str] = ("wav", "mp3", "flac")) -> DataFrame:
    """Each file with the audio file of its stem, by extension in the given order, if any."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)))
    a = audio.withColumn("_rank", rank).filter("_rank > 0")
    best = a.groupBy("stem").agg(F.min_by("path", F.struct("_rank", "path")).alias("audio_path"))
    return files.join(best, "stem", "left")


def in_turn(files: DataFrame) -> DataFrame:
    """Files with their position by path, for reports: each range of paths is numbered by itself,
    after those before it have been counted."""
    ranged = stored(files.repartitionByRange("path").withColumn("_range", F.spark_partition_id()), "files-in-turn")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("path"))
    return ranged.join(before, "_range").withColumn("position", (own + F.col("_before")).cast("int")).drop("_range", "_before")
