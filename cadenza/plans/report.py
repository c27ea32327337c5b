"""The analysis of each file as text: segments, chord events, plays, key and how windows were chosen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.music import time_range
from cadenza.operators import notes as note_ops
from cadenza.operators.chords import label
from cadenza.operators.windows import pitch_sets
from cadenza.plans.pipeline import Run


def reports(run: Run) -> DataFrame:
    """path, report: one text for each file of a run; an error is one line."""
    found = run.analysis
    counts = found.counts.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("position", "chord", "played"))).alias("_counts"))
    sizes = note_ops.reasoning(note_ops.auto_window(run.notes)).select("recording_id", F.concat_ws("; ", "reasoning").alias("_why"))
    kept = note_ops.filter_counts(run.notes).select("recording_id", "kept", "dropped")
    rows = run.results.withColumn("recording_id", F.xxhash64("path"))
    for part in (counts, sizes, kept):
        rows = rows.join(part, "recording_id", "left")
    segments = F.transform("chord_progression", lambda s: F.format_string(
        "  %s %s (%d notes, %d pitches)", s["time_range"], s["chord"], s["note_count"], s["unique_pitches"]))
    events = F.transform("chord_events", lambda e, i: F.format_string(
        "  %d. %s %s, play %d, %.1f s, %d notes", i + 1, time_range(e["start"], e["end"]), e["chord"], e["play_number"], e["duration"], e["total_notes"]))
    plays = F.transform(F.coalesce("_counts", F.array().cast("array<struct<position:int,chord:string,played:string>>")), lambda c: F.concat(F.lit("  "), c["chord"], F.lit(": "), c["played"]))
    head = F.array(
        F.concat(F.lit("File: "), F.element_at(F.split("path", "/"), -1)), F.concat(F.lit("Notes: "), F.col("kept").cast("string"), F.lit(" musical, "), F.col("dropped").cast("string"), F.lit(" left out")),
        F.concat(F.lit("Windows: "), F.col("_why")), F.concat(F.lit("Segments: "), F.size("chord_progression").cast("string")))
    body = F.concat(
        F.array_compact(head), segments, F.array(F.concat(F.lit("Chord events: "), F.size("chord_events").cast("string"))), events, F.array(F.lit("Plays:")), plays,
        F.array(F.concat(F.lit("Key: "), F.col("key"))))
    failed = F.concat(F.lit("File: "), F.element_at(F.split("path", "/"), -1), F.lit("\nError: "), F.col("error"))
    return rows.select("path", F.when(F.col("error").isNotNull(), failed).otherwise(F.array_join(body, "\n")).alias("report"))


def window_report(windows: DataFrame) -> DataFrame:
    """recording_id, window_idx and a line for each active window: its pitches, classes, chord and remark."""
    sets = pitch_sets(windows)
    named = label(windows).select("recording_id", "window_idx", "label", time_range(F.col("start"), F.col("end")).alias("at"))
    rows = sets.join(named, ["recording_id", "window_idx"])
    line = F.concat_ws(" ", "at", "label", F.concat(F.lit("{"), "note_names", F.lit("}")), F.concat(F.lit("["), "classes", F.lit("]")), F.when(F.col("remark") != "", F.col("remark")))
    return rows.select("recording_id", "window_idx", line.alias("line"))
