"""Chord events: runs of segments of one chord, and what is counted of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.scans import Chunks, positions

MAX_GAP = 1.0
SHORT, SHORT_GAP = 0.8, 1.5


def islands(segments: DataFrame, chunk: int | None = None) -> DataFrame:
    """Runs of segments: one chord, not weak, no gap over MAX_GAP.  Silent and weak segments are
    no part of any run, but end one.

    (recording_id, start, end, chord, duration, total_notes, first_idx)

    With `chunk`, so many windows of a recording are a task, and runs that go on from one into the
    next are stitched; without it a recording is one.
    """
    if chunk is not None:
        return _islands_by_chunk(segments, chunk)
    order = Window.partitionBy("recording_id").orderBy("window_idx")
    weak = (F.col("chord") == "Silence") | (F.col("note_count") < 2)
    goes_on = (F.lag("chord").over(order) == F.col("chord")) & ~F.lag("_weak").over(order) & (F.col("start") - F.lag("end").over(order) <= MAX_GAP)
    rows = segments.withColumn("_weak", weak).withColumn("_new", F.when(goes_on, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(order)).filter(~F.col("_weak"))
    runs = rows.groupBy("recording_id", "_run").agg(
        F.min("start").alias("start"), F.max_by("end", "window_idx").alias("end"), F.first("chord").alias("chord"),
        F.sum("note_count").alias("total_notes"), F.min("window_idx").alias("first_idx"))
    return runs.withColumn("duration", F.col("end") - F.col("start")).drop("_run")


def _islands_by_chunk(segments: DataFrame, chunk: int) -> DataFrame:
    weak = (F.col("chord") == "Silence") | (F.col("note_count") < 2)
    chunks = Chunks(segments.withColumn("_weak", weak), ["recording_id"], ["window_idx"], F.floor(F.col("window_idx") / chunk))
    rows = chunks.with_neighbours(["chord", "end", "_weak"])
    goes_on = (F.col("_prev.chord") == F.col("chord")) & ~F.col("_prev._weak") & (F.col("start") - F.col("_prev.end") <= MAX_GAP)
    strong = lambda c: F.when(~F.col("_weak"), c)
    parts = {
        "start": F.min(strong(F.col("start"))), "last": F.max(strong(F.struct("window_idx", "end"))), "chord": F.min(strong(F.col("chord"))),
        "total_notes": F.sum(strong(F.col("note_count"))), "first_idx": F.min(strong(F.col("window_idx")))}
    runs = chunks.runs(rows, ~F.coalesce(goes_on, F.lit(False)), parts, _whole("first_idx"))
    runs = runs.filter(F.col("start").isNotNull()).withColumn("end", F.col("last.end"))
    return runs.select("recording_id", "start", "end", "chord", "total_notes", "first_idx", (F.col("end") - F.col("start")).alias("duration"))


def _whole(position: str):
    return lambda c: {"start": F.min(c["start"]), "last": F.max(c["last"]), "chord": F.min(c["chord"]), "total_notes": F.sum(c["total_notes"]), position: F.min(c[position])}


def chord_events(segments: DataFrame, chunk: int | None = None) -> DataFrame:
    """Chord events: islands, short ones merged into the same chord before them, numbered.

    An island is merged if it lasts under SHORT and begins under SHORT_GAP after the end of the
    island before; as that end is the merged event's end too, looking back one row is enough.
    `chunk` is that of islands().
    """
    if chunk is not None:
        return _events_by_chunk(islands(segments, chunk), chunk)
    order = Window.partitionBy("recording_id").orderBy("first_idx")
    merged = (F.lag("chord").over(order) == F.col("chord")) & (F.col("duration") < SHORT) & (F.col("start") - F.lag("end").over(order) < SHORT_GAP)
    rows = islands(segments).withColumn("_new", F.when(merged, 0).otherwise(1)).withColumn("_event", F.sum("_new").over(order))
    events = rows.groupBy("recording_id", "_event").agg(
        F.min("start").alias("start"), F.max_by("end", "first_idx").alias("end"), F.first("chord").alias("chord"), F.sum("total_notes").alias("total_notes"))
    plays = Window.partitionBy("recording_id", "chord").orderBy("_event")
    return events.select(
        "recording_id", "start", "end", "chord", F.row_number().over(plays).cast("long").alias("play_number"),
        (F.col("end") - F.col("start")).alias("duration"), "total_notes")


def _events_by_chunk(runs: DataFrame, chunk: int) -> DataFrame:
    place = lambda c: F.floor(F.col(c) / chunk)
    chunks = Chunks(runs, ["recording_id"], ["first_idx"], place("first_idx"))
    merged = (F.col("_prev.chord") == F.col("chord")) & (F.col("duration") < SHORT) & (F.col("start") - F.col("_prev.end") < SHORT_GAP)
    parts = {
        "start": F.min("start"), "last": F.max(F.struct("first_idx", "end")), "chord": F.min("chord"), "total_notes": F.sum("total_notes"), "at": F.min("first_idx")}
    found = chunks.runs(chunks.with_neighbours(["chord", "end"]), ~F.coalesce(merged, F.lit(False)), parts, _whole("at"))
    found = positions(found.withColumn("end", F.col("last.end")), ["recording_id", "chord"], "at", place("at"))
    return found.select(
        "recording_id", "start", "end", "chord", F.col("_position").cast("long").alias("play_number"), (F.col("end") - F.col("start")).alias("duration"), "total_notes")


def chord_counts(events: DataFrame) -> DataFrame:
    """Plays of each chord, in order of its first."""
    c = events.groupBy("recording_id", "chord").agg(F.count("*").alias("plays"), F.min("start").alias("first_start"))
    order = Window.partitionBy("recording_id").orderBy("first_start")
    times = F.when(F.col("plays") > 1, "times").otherwise("time")
    return c.withColumn("position", F.row_number().over(order)).withColumn("played", F.concat(F.col("plays").cast("string"), F.lit(" "), times))


def chord_rollup(events: DataFrame) -> DataFrame:
    return events.groupBy("recording_id", "chord").agg(F.count("*").alias("plays"), F.sum("duration").alias("total_duration"))


def result_stats(segments: DataFrame, events: DataFrame) -> DataFrame:
    """total_chords, unique_chords, chord_events, audio_duration of each recording."""
    s = segments.groupBy("recording_id").agg(
        F.count("*").alias("total_chords"), F.countDistinct("chord").alias("unique_chords"), F.max_by("end", "window_idx").alias("audio_duration"))
    e = events.groupBy("recording_id").agg(F.count("*").alias("chord_events"))
    return s.join(e, "recording_id", "left").select(
        "recording_id", "total_chords", "unique_chords", F.coalesce("chord_events", F.lit(0)).cast("long").alias("chord_events"), "audio_duration")
