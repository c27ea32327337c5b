"""Chunk and stitch: the same rows as the window forms, whatever the chunks."""

import random

import pytest
from cadenza import schemas
from cadenza.operators import chords, events, notes, transcribe, windows
from cadenza.operators.scans import Chunks, positions
from cadenza.plans.analysis import analyze
from pyspark.sql import functions as F


def rows(frame, digits=9):
    return sorted(tuple(str(round(v, digits) if isinstance(v, float) else v) for v in r) for r in frame.select(*sorted(frame.columns)).collect())


def random_segments(spark, seed, count=400, recordings=3):
    """Few chords, weak and silent segments, gaps about the limits."""
    rnd, out = random.Random(seed), []
    for rec in range(recordings):
        at, idx = 0.0, 0
        for _ in range(count):
            idx += rnd.choice([1, 1, 1, 2, 9])
            at += rnd.choice([0.0, 0.0, 0.5, 1.0, 1.25, 1.5])
            length = rnd.choice([0.3, 0.5, 0.625, 0.8])
            out.append((rec, idx, at, at + length, rnd.choice(["C", "C", "C", "G", "Silence"]), rnd.choice([1, 2, 3, 4, 5]), 3))
            at += length
    return spark.createDataFrame(out, schemas.SEGMENTS)


@pytest.mark.parametrize("chunk", [1, 3, 50, 10_000])
def test_events_by_chunk(spark, chunk):
    segments = random_segments(spark, chunk)
    assert rows(events.islands(segments, chunk)) == rows(events.islands(segments))
    assert rows(events.chord_events(segments, chunk)) == rows(events.chord_events(segments))


def test_one_chord_over_many_chunks(spark):
    segments = spark.createDataFrame([(1, i, i * 1.0, i + 1.0, "C", 2, 3) for i in range(300)], schemas.SEGMENTS)
    assert [tuple(r) for r in events.chord_events(segments, 7).collect()] == [(1, 0.0, 300.0, "C", 1, 300.0, 600)]
    assert events.chord_events(segments.limit(0), 7).count() == 0


def random_track(spark, seed, count=500, tracks=2):
    """Dense notes of two pitches: chains of near duplicates that reach over many chunks."""
    rnd, out = random.Random(seed), []
    for track in range(tracks):
        at = 0.0
        for i in range(count):
            at += rnd.choice([0.0, 0.02, 0.03, 0.05, 0.07, 0.1, 0.3])
            out.append((track, i, rnd.choice([60, 60, 60, 64]), at, at + rnd.choice([0.02, 0.1, 0.5]), rnd.randint(30, 90), rnd.choice([0.4, 0.5, 0.5, 0.9])))
    return spark.createDataFrame(out, "track_id long, frame_idx long, pitch int, start double, end double, velocity int, confidence double")


@pytest.mark.parametrize("seconds", [0.11, 0.25, 2.0, 1e6])
def test_cleaning_by_chunk(spark, seconds):
    track = random_track(spark, int(seconds * 100))
    assert rows(transcribe.dedupe(track, seconds=seconds)) == rows(transcribe.dedupe(track))
    assert rows(transcribe.merge(track, seconds=seconds)) == rows(transcribe.merge(track))
    assert rows(transcribe.clean(track, seconds)) == rows(transcribe.clean(track))


def test_chunks_shorter_than_a_duplicate_are_refused(spark):
    with pytest.raises(ValueError):
        transcribe.dedupe(random_track(spark, 1), seconds=0.1)
    assert transcribe.clean(random_track(spark, 1).limit(0), 5.0).count() == 0


@pytest.mark.parametrize("seconds", [0.3, 5.0])
def test_onsets_and_strikes_by_chunk(spark, seconds):
    rnd = random.Random(3)
    frames = spark.createDataFrame([(t, i, i * 0.023) for t in range(2) for i in range(700)], "track_id long, frame_idx long, time double")
    onsets = spark.createDataFrame([(t, round(rnd.random() * 20, 2) if t else 0.4) for t in range(2) for _ in range(12 if t else 1)], "track_id long, onset_time double")
    assert rows(transcribe.next_onsets(frames, onsets, seconds=seconds)) == rows(transcribe.next_onsets(frames, onsets))
    played, at = [], 0.0
    for i in range(300):
        at += rnd.choice([0.0, 0.1, 0.3, 0.31, 2.0])
        played.append((i % 2, i, at, at + 0.2, 60, 90))
    table = spark.createDataFrame(played, schemas.NOTES)
    assert rows(notes.strikes(table, seconds=seconds)) == rows(notes.strikes(table))
    assert rows(notes.auto_window(table, seconds)) == rows(notes.auto_window(table))


def test_analysis_by_chunk(spark):
    rnd, played = random.Random(5), []
    for i in range(900):
        at = i // 3 * 0.7 + rnd.random() * 0.1
        played.append((i % 2, i, at, at + 0.6, rnd.choice([57, 60, 64, 67, 62, 69, 71, 55]), rnd.randint(50, 100)))
    table = spark.createDataFrame(played, schemas.NOTES)
    for size in (0.7, None):
        whole, parts = analyze(table, size), analyze(table, size, 9)
        for name in ("segments", "events", "counts", "key", "stats"):
            assert rows(getattr(parts, name)) == rows(getattr(whole, name)), name
    labelled = chords.label(windows.active_windows(table, 0.7))
    assert rows(chords.neighbours(labelled, 4)) == rows(chords.neighbours(labelled))


def test_positions_and_null_keys(spark):
    frame = spark.createDataFrame([(k, i) for k in ("a", None) for i in range(40)], "k string, i long")
    got = positions(frame, ["k"], "i", F.floor(F.col("i") / 7)).collect()
    assert all(r["_position"] == r["i"] + 1 for r in got) and len(got) == 80
    chunks = Chunks(frame, ["k"], ["i"], F.floor(F.col("i") / 7))
    before = chunks.with_neighbours(["i"], after=True).collect()
    assert all((r["_prev"].i if r["_prev"] else -1) == r["i"] - 1 and (r["_next"].i if r["_next"] else 40) == r["i"] + 1 for r in before)


def test_no_task_sorts_a_whole_recording(spark):
    """Rows are windowed by recording and chunk; by recording alone only summaries of chunks are."""
    n, chunk = 40_000, 1000
    segments = spark.range(n).select(
        F.lit(1).cast("long").alias("recording_id"), F.col("id").alias("window_idx"), F.col("id").cast("double").alias("start"), (F.col("id") + 1).cast("double").alias("end"),
        F.when(F.col("id") % 3 == 0, "C").otherwise("G").alias("chord"), F.lit(3).cast("long").alias("note_count"), F.lit(3).cast("long").alias("unique_pitches"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        seen = []
        own = Chunks.runs

        def runs(self, frame, *rest):
            per_task = frame.withColumn("_run", F.row_number().over(self.own)).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
            seen.append(per_task)
            return own(self, frame, *rest)

        Chunks.runs = runs
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = events.chord_events(segments, chunk).count()
    finally:
        Chunks.runs = own
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == events.chord_events(segments).count() and len(seen) == 2 and all(x < 0.5 * n for x in seen)


def test_exact_starts_are_repeated_sums(spark):
    for size, total in ((0.1, 33.3), (0.7, 99.4), (0.625, 10.0)):
        table = spark.createDataFrame([(1, 0, 0.0, total, 60, 90), (1, 1, 0.05, 0.4, 64, 90), (2, 0, 0.0, 0.05, 60, 90), (2, 1, 0.0, 0.1, 60, 90)], schemas.NOTES)
        starts, at = [], 0.0
        while at < total:
            starts.append((at, min(at + size, total)))
            at += size
        got = windows.window_starts(windows.window_ends(notes.filter_musical(table), size)).filter("recording_id = 1").orderBy("window_idx").collect()
        assert [(r["w_start"], r["w_end"]) for r in got] == starts
        inside = windows.window_notes(table, size, exact=True).filter("recording_id = 1").collect()
        want = {(i, n) for i, (a, b) in enumerate(starts) for n, s, e in ((0, 0.0, total), (1, 0.05, 0.4)) if s < b and e > a}
        assert {(r["window_idx"], r["note_id"]) for r in inside} == want and len(inside) == len(want)


def dense_track(spark, step=1):
    """A track of one pitch whose notes, but for those left out by `step`, are near duplicates of their neighbours."""
    i = F.col("id")
    return spark.range(0, 1500, step).select(
        F.lit(1).cast("long").alias("track_id"), i.alias("frame_idx"), F.lit(60).alias("pitch"), (i * 0.07).alias("start"),
        (i * 0.07 + 0.1).alias("end"), F.lit(80).alias("velocity"), (F.pmod(F.xxhash64("id"), F.lit(5)) / 5).alias("confidence"))


def entered(monkeypatch, track):
    """What chunks of 0.11 s are entered with."""
    made, own = [], transcribe._entered
    monkeypatch.setattr(transcribe, "_entered", lambda tables: made.append(own(tables)) or made[-1])
    transcribe.dedupe(track, seconds=0.11)
    return made[0]


def test_chains_of_chunks_are_folded_in_the_jvm(spark, monkeypatch):
    """No group of a track's pitch costs a call of Python, and a chain of over 256 chunks is one."""
    track = dense_track(spark)
    assert rows(transcribe.clean(track, 0.11)) == rows(transcribe.clean(track))
    chain = entered(monkeypatch, track)
    assert "InPandas" not in chain._jdf.queryExecution().optimizedPlan().toString()
    assert chain.count() == chain.select("_chunk").distinct().count() > 256


def test_chunks_that_nothing_enters_are_not_chained(spark, monkeypatch):
    track = dense_track(spark, 2)
    assert entered(monkeypatch, track).count() == 0
    assert rows(transcribe.dedupe(track, seconds=0.11)) == rows(track)
