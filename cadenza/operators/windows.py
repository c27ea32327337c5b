"""Time windows: notes to every tumbling window that they overlap, and what each window holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.music import note_name, pitch_bit
from cadenza.operators.notes import filter_musical


def window_starts(ends: DataFrame) -> DataFrame:
    """(recording_id, _total, _ws) -> recording_id, window_idx, w_start, w_end: windows whose starts are
    sums, each the one before plus the size, rounded as such additions are.

    A running sum adds row by row; the last window is the one before the start that reaches the end.
    """
    steps = ends.withColumn("window_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_total") / F.col("_ws")) + 1)))
    before = Window.partitionBy("recording_id").orderBy("window_idx").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("w_start", F.coalesce(F.sum("_ws").over(before), F.lit(0.0))).filter(F.col("w_start") < F.col("_total"))
    return steps.select("recording_id", "window_idx", "w_start", F.least(F.col("w_start") + F.col("_ws"), F.col("_total")).alias("w_end"))


def window_ends(kept: DataFrame, size: float | DataFrame) -> DataFrame:
    """recording_id, _total, the last end of its musical notes, and _ws, its window size."""
    ends = kept.groupBy("recording_id").agg(F.max("end").alias("_total"))
    if isinstance(size, DataFrame):
        return ends.join(size.select("recording_id", F.col("window_size").alias("_ws")), "recording_id")
    if size > 0:
        return ends.withColumn("_ws", F.lit(float(size)))
    raise ValueError("window size must be positive")


def window_notes(notes: DataFrame, size: float | DataFrame, exact: bool = False) -> DataFrame:
    """Musical notes by window: the note's columns, window_idx, w_start, w_end.

    Windows of `size` seconds run from 0 to the last end of a recording's musical notes, where
    the last one is cut off; a note is in each window that it overlaps by more than a point.
    size may be a table (recording_id, window_size).  The overlap join is an explode of the few
    indices that a note can reach and an exact test, not a join of notes with windows.

    Starts are index * size; with `exact` they are window_starts(), which differ from that in the
    last bits where the size is no sum of a few powers of two.  They are then looked up by
    index, one more on either side of what a note reaches.
    """
    kept = filter_musical(notes)
    ends = window_ends(kept, size)
    first = F.greatest(F.lit(0), F.floor(F.col("start") / F.col("_ws")) - 1)
    last = F.least(F.ceil(F.col("end") / F.col("_ws")), F.ceil(F.col("_total") / F.col("_ws")) - 1)
    if exact:
        near = F.sequence(F.greatest(F.lit(0).cast("long"), first.cast("long")), F.greatest(first, last).cast("long") + 1)
        rows = kept.join(ends, "recording_id").withColumn("window_idx", F.explode(near)).drop("_ws", "_total")
        return rows.join(window_starts(ends), ["recording_id", "window_idx"]).filter((F.col("start") < F.col("w_end")) & (F.col("end") > F.col("w_start")))
    rows = kept.join(ends, "recording_id").withColumn("_n", F.explode(F.when(first <= last, F.sequence(first, last))))
    rows = rows.withColumn("window_idx", F.col("_n").cast("long")).withColumn("w_start", F.col("window_idx") * F.col("_ws"))
    rows = rows.withColumn("w_end", F.least((F.col("window_idx") + 1) * F.col("_ws"), F.col("_total")))
    return rows.filter((F.col("start") < F.col("w_end")) & (F.col("end") > F.col("w_start"))).drop("_n", "_ws", "_total")


def window_stats(placed: DataFrame) -> DataFrame:
    """One row for each window that has notes: count, velocity sum, distinct pitches, class mask."""
    return placed.groupBy("recording_id", "window_idx").agg(
        F.min("w_start").alias("start"), F.min("w_end").alias("end"), F.count("*").alias("note_count"),
        F.sum(F.col("velocity").cast("long")).alias("velocity_sum"), F.array_sort(F.collect_set("pitch")).alias("pitches"),
        F.bit_or(pitch_bit(F.col("pitch"))).alias("mask"))


def is_musical(min_notes: int = 2, min_velocity: int = 120, max_range: int = 60) -> Column:
    span = F.array_max("pitches") - F.array_min("pitches")
    return (F.col("note_count") >= min_notes) & (F.col("velocity_sum") >= min_velocity) & (F.size("pitches") >= 2) & (span <= max_range)


def active_windows(notes: DataFrame, size: float | DataFrame, exact: bool = False) -> DataFrame:
    return window_stats(window_notes(notes, size, exact)).filter(is_musical())


def pitch_sets(windows: DataFrame) -> DataFrame:
    """What a window's report shows: note names, pitches, classes and a remark on suspensions."""
    names = F.array_sort(F.array_distinct(F.transform("pitches", note_name)))
    has = lambda *bits: F.col("mask").bitwiseAND(F.lit(sum(1 << b for b in bits))) == sum(1 << b for b in bits)
    remark = F.when(has(4, 11, 6), "sus2 detected").when(has(4, 11), "missing F#").otherwise("")
    classes = ["A", "A#", "B", "C", "C#", "D", "D#", "E", "F", "F#", "G", "G#"]
    at = [9, 10, 11, 0, 1, 2, 3, 4, 5, 6, 7, 8]
    present = F.array_compact(F.array(*(F.when(has(b), F.lit(c)) for c, b in zip(classes, at))))
    return windows.select(
        "recording_id", "window_idx", F.array_join(names, ", ").alias("note_names"),
        F.array_join(F.transform("pitches", lambda p: p.cast("string")), ",").alias("pitch_list"),
        F.array_join(present, ",").alias("classes"), remark.alias("remark"))
