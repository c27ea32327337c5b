"""Chord labels of windows, without and with their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.music import chord_lut, chord_patterns, mask_of, time_range
from cadenza.operators.scans import Chunks

MINOR_A = ("Am", "Am7")


def exact_chords(windows: DataFrame) -> DataFrame:
    """Windows whose classes are a pattern (47 rows at most, a fixed table): window, chord."""
    p = F.broadcast(chord_patterns(windows.sparkSession))
    return windows.join(p, F.col("mask") == F.col("pattern")).select("recording_id", "window_idx", F.col("name").alias("chord"))


def contained_chord(windows: DataFrame) -> DataFrame:
    """The largest pattern that a window's classes contain, the earlier one if two are as large.

    Distinct masks, 4,096 at most, are matched with the patterns; windows then look theirs up.
    """
    p = F.broadcast(chord_patterns(windows.sparkSession))
    masks = windows.select("mask").distinct().join(p, F.col("mask").bitwiseAND(F.col("pattern")) == F.col("pattern"))
    best = masks.groupBy("mask").agg(F.min_by("name", F.struct(-F.col("size"), F.col("priority"))).alias("chord"))
    return windows.join(F.broadcast(best), "mask").select("recording_id", "window_idx", "chord")


def label(windows: DataFrame, mask: str = "mask", name: str = "label") -> DataFrame:
    """windows with the chord of a class mask: one broadcast hash join with all 4,096 masks."""
    lut = F.broadcast(chord_lut(windows.sparkSession).select(F.col("mask").alias("_mask"), F.col("label").alias(name)))
    return windows.join(lut, F.col(mask) == F.col("_mask")).drop("_mask")


def neighbours(labelled: DataFrame, chunk: int | None = None) -> DataFrame:
    """Labelled windows with the labels before and after, and the pitches of all three.

    Neighbours are those of the recording's list of active windows, however far in time.  With
    `chunk`, so many windows of a recording are a task; without it a recording is one."""
    if chunk is not None:
        rows = Chunks(labelled, ["recording_id"], ["window_idx"], F.floor(F.col("window_idx") / chunk)).with_neighbours(["label", "pitches", "mask"], after=True)
        pitches = F.flatten(F.array_compact(F.array("_prev.pitches", "pitches", "_next.pitches")))
        heard = F.coalesce("_prev.mask", F.lit(0)).bitwiseOR(F.col("mask")).bitwiseOR(F.coalesce("_next.mask", F.lit(0)))
        return rows.withColumns({
            "prev": F.col("_prev.label"), "next": F.col("_next.label"), "region": F.array_sort(F.array_distinct(pitches)), "region_mask": heard,
        }).drop("_prev", "_next", "_chunk")
    order = Window.partitionBy("recording_id").orderBy("window_idx")
    near = order.rowsBetween(-1, 1)
    return labelled.withColumns({
        "prev": F.lag("label").over(order), "next": F.lead("label").over(order),
        "region": F.array_sort(F.array_distinct(F.flatten(F.collect_list("pitches").over(near)))),
        "region_mask": F.bit_or("mask").over(near)})


def _has(column: str, *names: str) -> Column:
    m = F.lit(mask_of(*names))
    return F.col(column).bitwiseAND(m) == m


def in_context(near: DataFrame) -> DataFrame:
    """The chord of each window with its neighbours heard: six rules in order, else its label."""
    near = label(near, "region_mask", "region_label")
    one_of = lambda c, names: F.coalesce(F.col(c).isin(*names), F.lit(False))
    either = lambda names: one_of("prev", names) | one_of("next", names)
    lacks = lambda name: ~_has("mask", name)
    chord = (
        F.when(_has("mask", "E", "B") & lacks("G#"), "Esus2")
        .when(_has("mask", "F#", "A", "C#") & either(("Esus2", "E")), "F#m7")
        .when(_has("mask", "A", "B", "E") & lacks("C#"), "Asus2")
        .when(_has("mask", "E", "B", "G#"), "E")
        .when((F.col("label") == "C") & either(MINOR_A) & (_has("region_mask", "A") | one_of("prev", MINOR_A) & one_of("next", MINOR_A)), "Am7")
        .when((F.size("region") > F.size("pitches")) & F.contains("region_label", F.lit("7")) & ~F.contains("label", F.lit("7")), F.col("region_label"))
        .otherwise(F.col("label"))
    )
    return near.withColumn("chord", chord)


def segments(windows: DataFrame, chunk: int | None = None) -> DataFrame:
    """Active windows -> segments: window, times, chord in context, counts, time range."""
    out = in_context(neighbours(label(windows), chunk))
    return out.select(
        "recording_id", "window_idx", "start", "end", "chord", "note_count", F.size("pitches").cast("long").alias("unique_pitches"),
        time_range(F.col("start"), F.col("end")).alias("time_range"))
