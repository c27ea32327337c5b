"""python -m cadenza.cli PATH... [--window-size auto|SECONDS] [--confidence X] [--min-duration S] [--max-duration S] [--midi DIR | --keep-midi] [--long] [--output DIR] [--report] [--statistics] [--quiet]"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cadenza.operators import scans
from cadenza.plans.analysis import TranscriptionSettings
from cadenza.plans.pipeline import Pipeline, midi_report
from cadenza.plans.report import reports
from cadenza.sources.files import AUDIO, list_files


def window_size(text: str) -> float | None:
    if text.lower() == "auto":
        return None
    size = float(text)
    if size <= 0:
        raise argparse.ArgumentTypeError("the window size must be positive, or auto")
    return size


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Chords and keys of audio and MIDI files")
    p.add_argument("paths", nargs="+")
    p.add_argument("--window-size", type=window_size, default=None)
    p.add_argument("--confidence", type=float, default=0.3)
    p.add_argument("--min-duration", type=float, default=0.1)
    p.add_argument("--max-duration", type=float, default=4.0)
    p.add_argument("--midi", help="folder for the transcriptions of audio files as MIDI")
    p.add_argument("--keep-midi", action="store_true", help="transcriptions as MIDI beside the audio files")
    p.add_argument("--long", action="store_true", help="recordings of hours: many tasks for each")
    p.add_argument("--output", help="folder for the results as Parquet")
    p.add_argument("--report", action="store_true", help="segments, chord events, plays and key of each file as text")
    p.add_argument("--statistics", action="store_true", help="statistics of MIDI files, beside those of audio files of the same names")
    p.add_argument("--quiet", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("cadenza").getOrCreate()
    run = Pipeline(
        TranscriptionSettings(a.confidence, a.min_duration, a.max_duration), a.window_size, midi_folder=a.midi, cleanup_midi=not a.keep_midi,
        chunk=scans.WINDOWS if a.long else None, seconds=scans.SECONDS if a.long else None)
    begun = time.perf_counter()
    try:
        runs = run.runs(spark, *a.paths)
    except FileNotFoundError as e:
        print(f"no such file: {e}")
        return 1
    rows = runs[0].results.unionByName(runs[1].results)
    if a.output:
        rows.write.mode("overwrite").parquet(a.output)
        rows = spark.read.parquet(a.output)
    if not a.quiet:
        rows.select("path", "key", F.array_join("chord_events.chord", " ").alias("chords"), "midi_file", "conversion_time", "error").show(50, truncate=100)
        if a.report:
            for row in reports(runs[0]).unionByName(reports(runs[1])).orderBy("path").toLocalIterator():
                print(row["report"] + "\n")
        if a.statistics:
            listed = midi_report(list_files(spark, a.paths, ["mid", "midi"], content=True), list_files(spark, a.paths, AUDIO, content=True))
            listed.select("file_name", "total_notes", *(F.round(c, 1).alias(c) for c in ("duration", "note_density", "file_size_kb")), "audio_path", "duration_match").show(50, truncate=60)
        counts = [r.counts for r in runs]
        peak = max((c["peak_mb"] or 0 for c in counts), default=0)
        print(f"{sum(c['processed'] for c in counts)} of {sum(c['files'] for c in counts)} files, {time.perf_counter() - begun:.1f} s, {peak:.0f} MB")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
