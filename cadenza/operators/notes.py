"""Notes: filters, statistics, pitch counts, onset clusters and window sizes of each recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.music import note_name, pitch_class
from cadenza.operators.scans import Chunks

MIN_VELOCITY, MIN_DURATION = 45, 0.1
STRIKE_GAP = 0.3


def by_start() -> "Window":
    return Window.partitionBy("recording_id").orderBy("start", "note_id")


def musical(min_velocity: int = MIN_VELOCITY, min_duration: float = MIN_DURATION) -> Column:
    return (F.col("velocity") >= min_velocity) & ~(F.col("end") - F.col("start") < min_duration)


def filter_musical(notes: DataFrame, min_velocity: int = MIN_VELOCITY, min_duration: float = MIN_DURATION) -> DataFrame:
    """Notes of some loudness and length; those of exactly the least values stay."""
    return notes.filter(musical(min_velocity, min_duration))


def filter_counts(notes: DataFrame) -> DataFrame:
    """recording_id, kept, dropped of filter_musical()."""
    return notes.groupBy("recording_id").agg(F.count_if(musical()).alias("kept"), F.count_if(~musical()).alias("dropped"))


def named(notes: DataFrame) -> DataFrame:
    return notes.withColumns({"note_name": note_name(F.col("pitch")), "pitch_class": pitch_class(F.col("pitch"))})


def density_bucket(density: Column) -> Column:
    return F.when(density > 1.0, "High").when(density > 0.5, "Moderate").otherwise("Low")


def note_stats(notes: DataFrame) -> DataFrame:
    """One row for each recording: counts, durations, pitch range, density; one pass, partial sums."""
    length = F.col("end") - F.col("start")
    s = notes.groupBy("recording_id").agg(
        F.count("*").alias("total_notes"), F.max("end").alias("duration"), F.sum(length).alias("_sum"),
        F.min("pitch").alias("min_pitch"), F.max("pitch").alias("max_pitch"))
    density = F.when(F.col("duration") > 0, F.col("total_notes") / F.col("duration")).otherwise(0.0)
    return s.select(
        "recording_id", "total_notes", "duration", density.alias("note_density"), (F.col("_sum") / F.col("total_notes")).alias("avg_note_duration"),
        "min_pitch", "max_pitch", (F.col("max_pitch") - F.col("min_pitch")).alias("pitch_span"), density_bucket(density).alias("density_class"))


def pitch_top(notes: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent pitches of each recording; ties go to the pitch that is heard first."""
    c = notes.groupBy("recording_id", "pitch").agg(F.count("*").alias("notes"), F.min(F.struct("start", "note_id")).alias("_first"))
    order = Window.partitionBy("recording_id").orderBy(F.col("notes").desc(), "_first")
    return c.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("_first")


def first_notes(notes: DataFrame, k: int = 10) -> DataFrame:
    return notes.withColumn("position", F.row_number().over(by_start())).filter(F.col("position") <= k)


def prefix_counts(notes: DataFrame) -> DataFrame:
    """Notes whose name begins with G, C, D (sharps count too), and whether G and D both occur."""
    name = note_name(F.col("pitch"))
    c = notes.groupBy("recording_id").agg(*(F.count_if(F.startswith(name, F.lit(x))).alias(f"{x.lower()}_notes") for x in "GCD"))
    return c.withColumn("progression", (F.col("g_notes") > 0) & (F.col("d_notes") > 0))


def capped_pitch_histogram(notes: DataFrame, cap: int = 10) -> DataFrame:
    """Notes of each pitch, cut off at the weight that key analysis gives a pitch at most."""
    return notes.groupBy("recording_id", "pitch").agg(F.least(F.count("*"), F.lit(cap)).alias("weight"))


def strikes(notes: DataFrame, gap: float = STRIKE_GAP, seconds: float | None = None) -> DataFrame:
    """Onsets of chord strikes: notes that begin over `gap` seconds after the note before.  With
    `seconds`, so much of a recording is a task."""
    if seconds is not None:
        rows = Chunks(notes, ["recording_id"], ["start", "note_id"], F.floor(F.col("start") / seconds)).with_neighbours(["start"])
        return rows.filter(F.col("_prev").isNull() | (F.col("start") - F.col("_prev.start") > gap)).drop("_prev", "_chunk")
    before = F.lag("start").over(by_start())
    return notes.withColumn("_new", before.isNull() | (F.col("start") - before > gap)).filter("_new").drop("_new")


def auto_window(notes: DataFrame, seconds: float | None = None) -> DataFrame:
    """Window size of each recording: 0.8 of the mean gap between strikes, 0.5 to 3 seconds.

    The gaps between strikes add up to the last strike less the first, so no second sort is due.
    """
    s = strikes(notes, seconds=seconds).groupBy("recording_id").agg(F.count("*").alias("strikes"), F.min("start").alias("_a"), F.max("start").alias("_b"))
    gap = F.when(F.col("strikes") > 1, (F.col("_b") - F.col("_a")) / (F.col("strikes") - 1))
    size = F.when(gap.isNull(), F.lit(2.0)).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(3.0), gap * 0.8)))
    pace = F.when(gap.isNull(), "single").when(size < 1.0, "fast").when(size > 2.0, "slow").otherwise("medium")
    return s.select("recording_id", "strikes", gap.alias("avg_gap"), size.alias("window_size"), pace.alias("pace"))


def reasoning(sizes: DataFrame) -> DataFrame:
    """Rows of auto_window() with reasoning, lines of text that say why."""
    pace = F.col("pace")
    why = (
        F.when(pace == "single", "One chord strike: windows of 2 s").when(pace == "fast", "Fast playing: small windows for precision")
        .when(pace == "slow", "Slow playing: larger windows").otherwise("Medium pace: balanced windows")
    )
    found = F.format_string("Chord strikes found: %d", "strikes")
    gap = F.when(F.col("avg_gap").isNotNull(), F.format_string("Average gap between strikes: %.1fs", "avg_gap"))
    return sizes.withColumn("reasoning", F.array_compact(F.array(found, gap, why)))
