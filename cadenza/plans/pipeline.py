"""Audio or MIDI files to chords, for any number of files in one plan; errors are rows.

Files are decoded once: signals and notes are written to the shared folder, and what follows reads
them there.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import notes as note_ops
from cadenza.operators import transcribe
from cadenza.plans.analysis import Analysis, TranscriptionSettings, analyze, transcribe_frames
from cadenza.sources import audio, midi
from cadenza.sources.audio import PLAIN, Signal
from cadenza.sources.files import AUDIO, companions, list_files, require
from cadenza.storage import stored


@dataclass
class Run:
    """What a run found: results() with one row for each file, the notes, the tables of the
    analysis, seconds by step; and files, processed (those without an error) and peak_mb (of a
    worker), which are counted while the results are written."""

    results: DataFrame
    notes: DataFrame
    analysis: Analysis
    seconds: dict[str, float] = field(default_factory=dict)
    counts: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Pipeline:
    """Settings of a run: of the signals, the transcription, the window size (None: inferred),
    whether and where transcriptions are kept as MIDI files (no folder: beside the audio file), and
    how many windows and seconds of a recording are a task (None: all; for recordings of hours)."""

    transcription: TranscriptionSettings = TranscriptionSettings()
    window_size: float | None = None
    signal: Signal = Signal()
    midi_folder: str | None = None
    cleanup_midi: bool = True
    chunk: int | None = None
    seconds: float | None = None

    def signals(self, files: DataFrame) -> DataFrame:
        return stored(audio.read_signals(files, self.signal), "signals")

    def transcribe(self, files: DataFrame, frames: DataFrame | None = None) -> DataFrame:
        """Audio files (path, content) -> notes of recordings, stored.

        frames of another tracker (path, frame_idx, time, f0_hz, confidence) come first: a file
        that has some is transcribed from them, the others from this package's own.
        """
        return self._transcribed(self.signals(files), frames)

    def _transcribed(self, signals: DataFrame, others: DataFrame | None = None) -> DataFrame:
        frames, onsets, rms = audio.tables(signals)
        if others is not None:
            others = others.select(F.xxhash64("path").alias("track_id"), "frame_idx", "time", "f0_hz", "confidence")
            frames = frames.join(others.select("track_id").distinct(), "track_id", "left_anti").unionByName(others)
        return stored(transcribe_frames(frames, onsets, rms, self.transcription, self.seconds), "notes")

    def convert(self, files: DataFrame, folder: str | None = None, frames: DataFrame | None = None) -> DataFrame:
        """Audio files -> MIDI files: path, midi_file, midi_bytes, error; in a folder or beside the audio."""
        signals = self.signals(files)
        bad = _errors(signals)
        places = midi.targets(files.join(bad, "path", "left_anti"), folder)
        out = stored(midi.write_files(self._transcribed(signals, frames), places), "midi-files")
        return files.select("path").join(out, "path", "left").join(bad, "path", "left")

    def analyze_audio(self, files: DataFrame, frames: DataFrame | None = None) -> Run:
        """The analysis of audio files (path, content), and its results()."""
        begun = time.perf_counter()
        signals = self.signals(files)
        notes = self._transcribed(signals, frames)
        converted = time.perf_counter()
        made = signals.filter("kind = 'file'").select("path", F.col("seconds").alias("conversion_time"), F.col("offset").alias("trim_offset"), "peak_mb")
        if self.midi_folder is not None or not self.cleanup_midi:
            places = midi.targets(files.join(_errors(signals), "path", "left_anti"), self.midi_folder)
            made = made.join(stored(midi.write_files(notes, places), "midi-files").select("path", "midi_file"), "path", "left")
        return self._analyzed(files, _errors(signals), notes, made, begun, converted)

    def analyze_midi(self, files: DataFrame) -> Run:
        begun = time.perf_counter()
        rows = stored(midi.decode_files(files), "midi-notes")
        notes = rows.filter("error IS NULL").withColumn("recording_id", F.xxhash64("path"))
        read = rows.filter("peak_mb IS NOT NULL").select("path", F.col("seconds").alias("conversion_time"), "peak_mb")
        made = files.select("path", F.col("path").alias("midi_file")).join(read, "path", "left")
        return self._analyzed(files, rows.filter("error IS NOT NULL").select("path", "error"), notes, made, begun, time.perf_counter())

    def _analyzed(self, files: DataFrame, errors: DataFrame, notes: DataFrame, made: DataFrame, begun: float, converted: float) -> Run:
        found = analyze(notes, self.window_size, self.chunk)
        seen = Observation("files")
        counted = results(files, errors, found, made).observe(
            seen, F.count(F.lit(1)).alias("files"), F.count_if(F.col("error").isNull()).alias("processed"), F.max("peak_mb").alias("peak_mb"))
        rows = stored(counted, "results")
        ended = time.perf_counter()
        return Run(rows, notes, found, {"conversion": converted - begun, "analysis": ended - converted, "total": ended - begun}, seen.get)

    def runs(self, spark: SparkSession, *paths: str) -> list[Run]:
        """The runs of the audio and of the MIDI files among files or folders; a path that doesn't
        exist raises at once."""
        require(spark, paths)
        sound = list_files(spark, paths, AUDIO, content=True)
        scores = list_files(spark, paths, ["mid", "midi"], content=True)
        return [self.analyze_audio(sound), self.analyze_midi(scores)]

    def analyze_paths(self, spark: SparkSession, *paths: str) -> DataFrame:
        """results() of audio and MIDI files or folders."""
        sound, scores = self.runs(spark, *paths)
        return sound.results.unionByName(scores.results)


def _errors(signals: DataFrame) -> DataFrame:
    return signals.filter("kind = 'error'").select("path", "error")


def results(files: DataFrame, errors: DataFrame, found: Analysis, made: DataFrame | None = None) -> DataFrame:
    """One row for each file: its chords, events, key and counts, or its error; and of made (by path) its
    midi_file, conversion_time (seconds of decoding and tracking it), trim_offset and peak_mb (the most memory
    that the worker that decoded it had held by then), where known.

    A file without notes has the error "no notes"; one with notes but without active windows
    has empty lists.
    """
    order = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    chords = found.segments.groupBy("recording_id").agg(order("window_idx", "start", "end", "chord", "note_count", "unique_pitches", "time_range").alias("chord_progression"))
    played = found.events.groupBy("recording_id").agg(order("start", "end", "chord", "play_number", "duration", "total_notes").alias("chord_events"))
    stats = found.stats.select("recording_id", F.struct("total_chords", "unique_chords", "chord_events", "audio_duration").alias("stats"))
    rows = files.select("path", F.xxhash64("path").alias("recording_id")).join(errors.dropDuplicates(["path"]), "path", "left")
    for part in (chords, played, stats, found.key):
        rows = rows.join(part, "recording_id", "left")
    known = {"midi_file": "string", "conversion_time": "double", "trim_offset": "double", "peak_mb": "double"}
    if made is not None:
        rows = rows.join(made.dropDuplicates(["path"]), "path", "left")
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in known.items() if c not in rows.columns})
    error = F.coalesce("error", F.when(F.col("key").isNull(), "no notes"))
    return rows.select(
        "path", F.when(error.isNull(), F.coalesce("chord_progression", F.array().cast(chords.schema["chord_progression"].dataType))).alias("chord_progression"),
        F.when(error.isNull(), F.coalesce("chord_events", F.array().cast(played.schema["chord_events"].dataType))).alias("chord_events"),
        "key", "stats", *known, error.alias("error"))


def successes(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("files"), F.count_if(F.col("error").isNull()).alias("processed"))


def midi_report(files: DataFrame, sound: DataFrame | None = None) -> DataFrame:
    """Statistics of MIDI files (path, length, stem, content): notes, density, range, size, instruments, the
    five most frequent pitches, the first ten notes, and whether G and D are both heard; with audio files (path,
    stem, content), the companion of each, its length, and whether the two last equally long."""
    rows = stored(midi.decode_files(files), "midi-notes").filter("error IS NULL").withColumn("recording_id", F.xxhash64("path"))
    more = rows.groupBy("recording_id").agg(
        F.countDistinct("instrument").alias("instruments"),
        F.array_sort(F.collect_list(F.when(F.col("note_id") < 20, F.struct("note_id", "pitch", "start", "end", "velocity")))).alias("notes_list"))
    ranked = note_ops.pitch_top(rows).withColumn("note_name", note_ops.note_name(F.col("pitch")))
    top = ranked.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("rank", "pitch", "note_name", "notes"))).alias("top_pitches"))
    early = note_ops.first_notes(rows).withColumn("note_name", note_ops.note_name(F.col("pitch")))
    early = early.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("position", "note_name", "start", "end", "velocity"))).alias("first_notes"))
    listing = files.select(F.xxhash64("path").alias("recording_id"), "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), (F.col("length") / 1024).alias("file_size_kb"))
    for part in (note_ops.note_stats(rows), more, top, early, note_ops.prefix_counts(rows).select("recording_id", "progression")):
        listing = listing.join(part, "recording_id", "left")
    beside = []
    if sound is not None:
        pairs = companions(files.select("path", "stem"), sound).select("path", "audio_path")
        times = stored(audio.lengths(sound), "audio-lengths").withColumnRenamed("path", "audio_path")
        listing = listing.join(pairs, "path", "left").join(times.dropDuplicates(["audio_path"]), "audio_path", "left")
        beside = ["audio_path", "audio_length", duration_match(F.col("audio_length"), F.col("duration")).alias("duration_match")]
    zero = lambda c: F.coalesce(c, F.lit(0))
    return listing.select(
        "file_name", zero("total_notes").alias("total_notes"), zero("duration").alias("duration"), zero("note_density").alias("note_density"),
        zero("avg_note_duration").alias("avg_note_duration"), F.struct(zero("min_pitch").alias("min"), zero("max_pitch").alias("max")).alias("pitch_range"),
        "file_size_kb", zero("instruments").alias("instruments"), "notes_list", "top_pitches", "first_notes", F.coalesce("progression", F.lit(False)).alias("progression"), *beside)


def duration_match(a, b):
    """Whether two durations differ by less than 0.1 s."""
    return F.abs(a - b) < 0.1


def simulated_transcription(files: DataFrame, settings: Signal = PLAIN) -> tuple[DataFrame, DataFrame]:
    """A plain transcription of audio files (path, content): notes at onsets with their pitch, path, start,
    duration, midi_note, frequency; and a summary of each file with a line of text, or its error."""
    signals = stored(audio.read_signals(files, settings), "signals")
    frames, onsets, _ = audio.tables(signals)
    known = signals.filter("kind = 'file'").select("path", F.xxhash64("path").alias("track_id"), F.col("length").alias("audio_length"), "seconds")
    notes = transcribe.onset_notes(onsets, frames, known.select("track_id", "audio_length"), settings.rate, settings.hop)
    notes = stored(known.select("path", "track_id").join(notes, "track_id"), "onset-notes")
    counts = notes.groupBy("track_id").agg(F.count("*").alias("note_count"))
    summary = known.join(transcribe.voiced_ratio(frames), "track_id", "left").join(counts, "track_id", "left").fillna(0, ["note_count"])
    line = F.format_string("File: %s | Time: %.0fms | Notes: %d", F.element_at(F.split("path", "/"), -1), F.col("seconds") * 1000, F.col("note_count"))
    summary = summary.withColumn("summary", line).drop("track_id").unionByName(_errors(signals), allowMissingColumns=True)
    return notes.drop("track_id"), summary

