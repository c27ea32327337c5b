"""Notes that arrive as a stream: window statistics and labels, kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.functions.music import pitch_bit
from cadenza.operators import chords
from cadenza.operators.notes import filter_musical
from cadenza.operators.windows import is_musical
from cadenza.plans.analysis import analyze


STATS = "recording_id long, window_idx long, note_count long, velocity_sum long, pitches array<int>, mask int"


def _gathered(delay: str):
    wait = int(pd.Timedelta(delay).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, velocity, pitches, latest = state.get if state.exists else (0, 0, [], 0)
        held = set(pitches)
        for b in batches:
            count, velocity = count + len(b), velocity + int(b["velocity"].sum())
            held.update(b["pitch"].tolist())
            latest = max(latest, int(b["_arrived"].max()))
        pitches = sorted(held)
        state.update((count, velocity, pitches, latest))
        state.setTimeoutTimestamp(max(latest + wait, state.getCurrentWatermarkMs() + 1))
        mask = sum({1 << p % 12 for p in pitches})
        yield pd.DataFrame({"recording_id": [key[0]], "window_idx": [key[1]], "note_count": [count], "velocity_sum": [velocity], "pitches": [pitches], "mask": [mask]})

    return update


def stream_windows(notes: DataFrame, size: float, arrived: str | None = None, delay: str = "1 hour") -> DataFrame:
    """A stream of notes -> statistics of each window that has notes, for output mode update.

    Windows are those of the batch operator, except that the last one of a recording is whole,
    as a stream does not tell where a recording ends.  With `arrived`, a column of timestamps,
    a window's state is dropped `delay` after its last note arrived; until then its notes count
    together, whenever they arrive.  Without it state is kept.
    """
    if size <= 0:
        raise ValueError("window size must be positive")
    kept = filter_musical(notes)
    if arrived:
        kept = kept.withWatermark(arrived, delay)
    first = F.floor(F.col("start") / size).cast("long")
    last = F.greatest(first, F.ceil(F.col("end") / size).cast("long") - 1)
    rows = kept.withColumn("window_idx", F.explode(F.sequence(first, last)))
    if arrived:
        rows = rows.withColumn("_arrived", F.unix_millis(F.col(arrived)))
        state = "note_count long, velocity_sum long, pitches array<int>, latest long"
        return rows.groupBy("recording_id", "window_idx").applyInPandasWithState(_gathered(delay), STATS, state, "update", GroupStateTimeout.EventTimeTimeout)
    return rows.groupBy("recording_id", "window_idx").agg(
        F.count("*").alias("note_count"), F.sum(F.col("velocity").cast("long")).alias("velocity_sum"),
        F.array_sort(F.collect_set("pitch")).alias("pitches"), F.bit_or(pitch_bit(F.col("pitch"))).alias("mask"))


def stream_labels(notes: DataFrame, size: float, arrived: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Active windows of a stream of notes with their labels, without their neighbours."""
    return chords.label(stream_windows(notes, size, arrived, delay).filter(is_musical()))


def analyze_batches(notes: DataFrame, path: str, window_size: float | None = None) -> DataStreamWriter:
    """A stream whose batches hold whole recordings -> their chord events, appended to Parquet.

    Each batch goes to a folder of its own number, so that one that is run again after a failure
    replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        analyze(batch, window_size).events.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return notes.writeStream.foreachBatch(write)
