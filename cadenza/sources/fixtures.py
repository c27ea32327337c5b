"""Views of the driver's tables as notes, frames, onsets and energies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The pitches that the events' keys stand for, in turn.
PITCHES = [40, 42, 44, 45, 47, 49, 52, 54, 56, 57, 59, 61, 64, 66, 68, 69, 43, 48, 60, 67]


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, note_id, start, end, pitch, velocity: one note for each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = e.select(
        F.col("user_id").alias("recording_id"), F.col("event_id").alias("note_id"), micros.alias("us"),
        F.round(F.col("value") * 100).cast("long").alias("c"), k.alias("k"))
    pitch = F.element_at(F.array(*map(F.lit, PITCHES)), F.col("k") % 20 + 1)
    return rows.withColumn("st", F.expr("us div 64000000")).select(
        "recording_id", "note_id", (F.col("st") / 1024.0).alias("start"), (F.expr("st + 20 + c div 10") / 1024.0).alias("end"),
        pitch.cast("int").alias("pitch"), (30 + F.col("c") % 98).cast("int").alias("velocity"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.expr("o_orderkey div 300").alias("track_id"), F.expr("o_orderkey % 300").alias("frame_idx"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("n"), "o_custkey", "o_orderpriority")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, frame_idx, time, f0_hz (NaN: unvoiced), confidence."""
    m = F.expr("""48 + ((frame_idx div 6) * 7 + track_id) % 24 + (o_custkey % 5 - 2) / 8
        + CASE WHEN o_custkey % 10 = 0 THEN 12 WHEN o_custkey % 29 = 0 THEN -40 ELSE 0 END""")
    hz = F.when(F.col("o_custkey") % 17 == 0, F.lit(float("nan"))).otherwise(440.0 * F.pow(F.lit(2.0), (m - 69) / 12))
    return _orders(spark, sf_dir).select(
        "track_id", "frame_idx", (F.col("frame_idx") * 512 / 22050.0).alias("time"), hz.alias("f0_hz"),
        ((F.col("n") % 11) / 10.0).alias("confidence"))


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).filter("o_orderpriority LIKE '1-%'").select("track_id", (F.col("frame_idx") * 512 / 22050.0).alias("onset_time"))


def rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("track_id", "frame_idx", ((F.col("n") % 500) / 1024.0).alias("energy"))
