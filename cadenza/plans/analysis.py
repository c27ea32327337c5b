"""Notes to chords and keys in one plan, for all recordings at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import chords, events, keys, notes, transcribe, windows
from cadenza.storage import stored


@dataclass(frozen=True)
class Analysis:
    """The tables of an analysis; none is computed before it is used."""

    segments: DataFrame
    events: DataFrame
    counts: DataFrame
    key: DataFrame
    stats: DataFrame


@dataclass(frozen=True)
class TranscriptionSettings:
    confidence_threshold: float = 0.3
    min_note_duration: float = 0.1
    max_note_duration: float = 4.0


def analyze(all_notes: DataFrame, window_size: float | None = None, chunk: int | None = None) -> Analysis:
    """Chords of recordings; window_size None infers one for each recording from all its notes.

    With `chunk`, so many windows of a recording are a task, which pays for recordings of hours;
    the rows are the same.

    Keys come from all notes, windows from musical ones.  A recording without active windows
    has a key and no segments; one without notes does not appear.
    """
    size = notes.auto_window(all_notes, None if chunk is None else float(chunk)) if window_size is None else window_size
    found = chords.segments(windows.active_windows(all_notes, size), chunk)
    found = found if chunk is None else stored(found, "segments")
    played = events.chord_events(found, chunk)
    return Analysis(found, played, events.chord_counts(played), keys.key_signature(played, all_notes), events.result_stats(found, played))


def transcribe_frames(frames: DataFrame, onsets: DataFrame, rms: DataFrame | None, settings: TranscriptionSettings = TranscriptionSettings(), seconds: float | None = None) -> DataFrame:
    """Clean notes of tracks, as notes of recordings; with `seconds`, so much of a track is a task."""
    raw = transcribe.raw_notes(frames, onsets, rms, settings.confidence_threshold, settings.min_note_duration, settings.max_note_duration, seconds)
    return transcribe.clean(raw, seconds).select(
        F.col("track_id").alias("recording_id"), F.col("frame_idx").alias("note_id"), "start", "end", "pitch", "velocity", "confidence")
