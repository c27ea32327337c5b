"""Times the headline queries, and two jobs that the tables can't show; prints one line of JSON."""

import json
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza import schemas
from cadenza.operators import events, transcribe
from cadenza.plans import queries as own
from cadenza.plans.pipeline import Pipeline
from cadenza.sources import midi
from cadenza.sources.files import list_files

HEADLINES = ["segments", "chord_events", "key_signature", "segments_auto", "note_stats", "pitch_top5", "window_activity", "clean_notes", "onset_pitch"]


def calibration(spark: SparkSession) -> float:
    """Seconds of a fixed job of sorting and hashing, so that figures of other machines and days compare."""
    best = float("inf")
    for _ in range(3):
        start = time.perf_counter()
        spark.range(4_000_000).select(F.xxhash64("id").alias("x")).repartition(16, "x").sortWithinPartitions("x").groupBy((F.col("x") % 1000).alias("k")).agg(F.max("x")).write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return best


def long_track(spark: SparkSession, frames: int = 155_000, seconds: float | None = None) -> DataFrame:
    """Clean notes of one track of an hour, a drone with onsets in its first second only; with
    `seconds`, by chunks of it."""
    f = spark.range(frames).select(
        F.lit(1).cast("long").alias("track_id"), F.col("id").alias("frame_idx"), (F.col("id") * 512 / 22050).alias("time"), F.lit(440.0).alias("f0_hz"),
        (0.5 + F.col("id") % 7 / 20).alias("confidence"))
    return transcribe.clean(transcribe.raw_notes(f, spark.createDataFrame([(1, 0.5)], schemas.ONSETS), None, seconds=seconds), seconds)


def long_recording(spark: SparkSession, windows: int = 3_000_000, chunk: int | None = None) -> DataFrame:
    """Chord events of one recording of many segments; with `chunk`, by chunks of so many."""
    i = F.col("id")
    rows = spark.range(windows).select(
        F.lit(1).cast("long").alias("recording_id"), i.alias("window_idx"), (i * 0.5).alias("start"), (i * 0.5 + 0.5).alias("end"),
        F.element_at(F.array(*map(F.lit, ("C", "G", "Am", "F"))), (F.pmod(F.xxhash64((i / 3).cast("long")), F.lit(4)) + 1).cast("int")).alias("chord"),
        F.lit(3).cast("long").alias("note_count"), F.lit(3).cast("long").alias("unique_pitches"))
    return events.chord_events(rows, chunk)


def midi_files(spark: SparkSession, folder: str, files: int = 200) -> DataFrame:
    """Results of MIDI files of 400 notes each, from decoding on."""
    for k in range(files):
        notes = [(i // 3 * 0.8, i // 3 * 0.8 + 0.7, (55, 60, 62)[i // 3 % 3] + (0, 4, 7)[i % 3], 90) for i in range(399 + k % 3)]
        Path(folder, f"{k}.mid").write_bytes(midi.encode(notes))
    return Pipeline().analyze_midi(list_files(spark, [folder], ["mid"], content=True)).results


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = own.queries(), {}
    queries["note_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles, warms the file cache
    for name in HEADLINES:
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        took[name] = round(best, 3)
    more = {}
    with tempfile.TemporaryDirectory() as folder:
        jobs = {
            "long_track": lambda: long_track(spark), "long_track_by_chunk": lambda: long_track(spark, seconds=120.0),
            "long_recording": lambda: long_recording(spark), "long_recording_by_chunk": lambda: long_recording(spark, chunk=100_000),
            "midi_files": lambda: midi_files(spark, folder), "midi_files_again": lambda: midi_files(spark, folder)}
        for name, job in jobs.items():
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            more[name] = round(time.perf_counter() - start, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline queries, best of two", "value": total, "unit": "sec", "queries": took | more, "not_in_value": list(more), "calibration": round(calibration(spark), 3), "sf": sf_dir}))


if __name__ == "__main__":
    main()
