"""Keys: from the chords that are played, from the notes, and the first of both that is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.music import KEY_TEMPLATES, PITCH_CLASSES, key_profiles, key_templates, pitch_class
from cadenza.operators.notes import capped_pitch_histogram

UNKNOWN = "Unknown"


def plays(events: DataFrame) -> DataFrame:
    """recording_id, chord, n, first: how often a chord is played, and when first."""
    return events.groupBy("recording_id", "chord").agg(F.count("*").alias("n"), F.min("start").alias("first"))


def key_scores(events: DataFrame) -> DataFrame:
    """Score of each key that has one of a recording's chords: the sum of squares of their plays.

    (recording_id, key, key_order, score)
    """
    scores = plays(events).join(F.broadcast(key_templates(events.sparkSession)), "chord")  # 79 rows, fixed
    return scores.groupBy("recording_id", "key", "key_order").agg(F.sum(F.col("n") * F.col("n")).alias("score"))


def key_from_chords(events: DataFrame) -> DataFrame:
    """The key of the highest score, the earlier one if two are as high; without any score, the
    minor of the most frequent chord (the one heard first, if tied) if that is a minor chord.

    Both come from one count: a recording's plays by chord, of which there are 46 at most.
    """
    p = plays(events).groupBy("recording_id").agg(
        F.max_by("chord", F.struct("n", -F.col("first"))).alias("common"), F.collect_list(F.struct("chord", "n")).alias("_plays"))
    score = lambda chords: F.aggregate(
        F.filter("_plays", lambda x: x["chord"].isin(chords)), F.lit(0).cast("long"), lambda s, x: s + x["n"] * x["n"])
    keys = F.array(*(F.struct(score(c.split()).alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("key")) for i, (k, c) in enumerate(KEY_TEMPLATES)))
    best = p.withColumn("_best", F.array_max(keys))
    minor = F.when(F.endswith("common", F.lit("m")), F.concat(F.expr("left(common, length(common) - 1)"), F.lit(" minor"))).otherwise(UNKNOWN)
    return best.select("recording_id", F.when(F.col("_best.score") > 0, F.col("_best.key")).otherwise(minor).alias("key"))


def key_from_notes(notes: DataFrame) -> DataFrame:
    """The key that the most frequent pitch class stands for, if the classes that belong to it
    are heard; else its major.  Ties go to the class that is heard first."""
    c = notes.withColumn("pc", pitch_class(F.col("pitch"))).groupBy("recording_id", "pc").agg(
        F.count("*").alias("n"), F.min(F.struct("start", "note_id")).alias("first"))
    c = c.withColumns({"_s": F.col("first.start"), "_i": F.col("first.note_id")})
    wide = c.groupBy("recording_id").agg(
        F.min_by("pc", F.struct(-F.col("n"), F.col("_s"), F.col("_i"))).alias("top"),
        *(F.sum(F.when(F.col("pc") == p, F.col("n")).otherwise(0)).alias(p) for p in PITCH_CLASSES))
    has = lambda *ps: F.expr(" AND ".join(f"`{p}` > 0" for p in ps))
    top = F.col("top")
    key = (
        F.when((top == "A") & has("C", "E"), F.when(F.col("C") > F.col("`C#`"), "A minor").otherwise("A major"))
        .when((top == "E") & ~has("G#", "B") & has("G", "B"), "E minor")
        .otherwise(F.concat(top, F.lit(" major")))
    )
    return wide.select("recording_id", key.alias("key"))


def profile_scores(notes: DataFrame, cap: int = 10) -> DataFrame:
    """recording_id, key, key_order, correlation: of the histogram of a recording's pitch classes, in
    which a pitch counts `cap` at most, with the profile of each of 24 keys.

    Null where the histogram is the same for all classes.  Sums are of whole numbers, so that
    equal correlations are equal to the last bit.
    """
    weights = capped_pitch_histogram(notes, cap).groupBy("recording_id", F.pmod("pitch", F.lit(12)).alias("pc")).agg(F.sum("weight").alias("x"))
    both = weights.join(F.broadcast(key_profiles(notes.sparkSession)), "pc")  # 288 rows, fixed
    x, y = F.col("x"), F.col("rating")
    s = both.groupBy("recording_id", "key", "key_order").agg(
        F.sum(x * y).alias("xy"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"))
    profiles = key_profiles(notes.sparkSession).groupBy("key_order").agg(F.sum("rating").alias("sy"), F.sum(y * y).alias("syy"))
    s = s.join(F.broadcast(profiles), "key_order")
    spread = (12 * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double") * (12 * F.col("syy") - F.col("sy") * F.col("sy")).cast("double")
    r = F.when(spread > 0, (12 * F.col("xy") - F.col("sx") * F.col("sy")).cast("double") / F.sqrt(spread))
    return s.select("recording_id", "key", "key_order", r.alias("correlation"))


def key_by_profile(notes: DataFrame, cap: int = 10) -> DataFrame:
    """The key whose profile correlates best with a recording's notes, the earlier one of equals:
    recording_id, key, correlation.  A recording in which all classes are as frequent has the key Unknown."""
    best = profile_scores(notes, cap).groupBy("recording_id").agg(
        F.max(F.when(F.col("correlation").isNotNull(), F.struct("correlation", (-F.col("key_order")).alias("order"), "key"))).alias("b"))
    return best.select("recording_id", F.coalesce("b.key", F.lit(UNKNOWN)).alias("key"), F.col("b.correlation").alias("correlation"))


def key_signature(events: DataFrame, notes: DataFrame) -> DataFrame:
    """The key from chords, or else from all notes."""
    a = key_from_chords(events).select("recording_id", F.nullif("key", F.lit(UNKNOWN)).alias("_chords"))
    b = key_from_notes(notes).select("recording_id", F.col("key").alias("_notes"))
    return b.join(a, "recording_id", "left").select("recording_id", F.coalesce("_chords", "_notes", F.lit(UNKNOWN)).alias("key"))
