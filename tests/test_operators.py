"""Golden vectors, traps and sequential restatements of the music operators."""

import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza import schemas
from cadenza.functions import music
from cadenza.operators import chords, events, keys, notes, transcribe, windows
from cadenza.plans.analysis import analyze

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def make_notes(spark, *given_):
    """(start, end, pitch, velocity), with recording 1 unless a fifth item names another."""
    return spark.createDataFrame([(n[4] if len(n) > 4 else 1, i, float(n[0]), float(n[1]), n[2], n[3]) for i, n in enumerate(given_)], schemas.NOTES)


def make_segments(spark, *given_):
    return spark.createDataFrame([(1, i, float(s), float(e), c, n, 3) for i, (s, e, c, n) in enumerate(given_)], schemas.SEGMENTS)


def mask(pitches):
    return sum({1 << p % 12 for p in pitches})


def test_scalar_functions(spark):
    frame = spark.createDataFrame([(60,), (61,), (21,), (108,), (0,), (70,)], "p int")
    assert [r[0] for r in frame.select(music.note_name(F.col("p"))).collect()] == ["C4", "C♯4", "A0", "C8", "C-1", "A♯4"]
    assert [r[0] for r in frame.select(music.pitch_class(F.col("p"))).collect()] == ["C", "C#", "A", "C", "C", "A#"]
    times = spark.createDataFrame([(0.0,), (59.99,), (75.9,), (6000.0,)], "s double")
    assert [r[0] for r in times.select(music.format_time(F.col("s"))).collect()] == ["00:00", "00:59", "01:15", "100:00"]
    one = spark.range(1)
    e = [0.05, 0.3, 0.9]
    assert list(one.select(*[music.energy_velocity(F.lit(x)) for x in e]).first()) == [30, 76, 127]
    assert one.select(music.pitch_class_of_name(F.lit("C♯4")), music.transcribed_path(F.lit("/a.b/c.wav")), music.file_stem(F.lit("/x/.hid.mid"))).first() == ("C#", "/a.b/c_transcribed.mid", ".hid")
    music.register(spark)
    assert spark.sql("SELECT note_name(61), pitch_class(70), format_time(75.9D)").first() == ("C♯4", "A#", "01:15")


@pytest.mark.parametrize("pitches, label", [
    ([], "Silence"), ([60, 72], "C"), ([64, 66, 71], "Bsus4"), ([57, 59, 64], "Esus4"), ([59, 61, 66], "Bsus2"), ([55, 59, 62], "G"), ([57, 60, 64, 67], "Am7"),
    ([60, 64, 67, 70], "C"), ([60, 63, 67], "C"), ([60, 61], "C"), ([61, 63], "C#"), ([68, 70], "A#"), ([64, 68, 71, 74], "E7"), ([62, 65], "D"), ([57, 62, 64], "Asus4"),
    ([62, 67, 69], "Dsus4"), ([60, 62, 67], "Gsus4"), ([60, 65, 67], "Csus4"),
])
def test_labels(pitches, label):
    assert music.label_of_mask(mask(pitches)) == label


def test_all_masks():
    labels = [music.label_of_mask(m) for m in range(4096)]
    patterns = {m for _, m, _, _ in music.pattern_rows()}
    assert len(patterns) == len(music.pattern_rows()) == 41 and len(set(labels)) == 46
    exact = [m for m in range(4096) if m in patterns]
    inside = [m for m in range(4096) if m.bit_count() > 1 and m not in patterns and any(m & p == p for p in patterns)]
    assert len(exact) == 41 and len(inside) == 2767
    for name, want in [("Bsus4", 2128), ("F#maj7", 1122), ("G7", 2212), ("C#m", 274), ("Am7", 657)]:
        assert {n: m for _, m, _, n in music.pattern_rows()}[name] == want


def in_context(spark, *pitch_sets):
    frame = spark.createDataFrame([(1, i, list(p), mask(p)) for i, p in enumerate(pitch_sets)], "recording_id long, window_idx long, pitches array<int>, mask int")
    out = chords.in_context(chords.neighbours(chords.label(frame))).orderBy("window_idx").collect()
    return [r["chord"] for r in out]


def test_context_rules(spark):
    assert in_context(spark, [64, 67, 71]) == ["Esus2"]
    assert in_context(spark, [64, 68, 71], [54, 57, 61])[1] == "F#m7" and in_context(spark, [54, 57, 61]) == ["F#m"]
    assert in_context(spark, [57, 59, 64, 68]) == ["Asus2"]
    assert in_context(spark, [64, 68, 71, 74]) == ["E"]
    assert in_context(spark, [57, 60, 64], [60, 64, 67])[1] == "Am7"
    assert in_context(spark, [57, 60], [62, 65], [60, 57])[1] == "Dm7"


def test_note_filter_edges(spark):
    kept = notes.filter_musical(make_notes(spark, (0, 1, 60, 44), (0, 1, 61, 45), (0, 0.099, 62, 90), (0, 0.125, 63, 90)))
    assert rows(kept, "pitch") == [(61,), (63,)]


def test_activity(spark):
    def active(*given_):
        return windows.active_windows(make_notes(spark, *given_), 2.0).count()

    assert active((0, 1, 40, 60), (0, 1, 100, 60)) == 1 and active((0, 1, 40, 60), (0, 1, 101, 60)) == 0
    assert active((0, 1, 40, 60), (0, 1, 40, 60)) == 0 and active((0, 1, 40, 60), (0, 1, 50, 59)) == 0


def test_window_sizes(spark):
    def size(*starts):
        return notes.auto_window(make_notes(spark, *((s, s + 0.2, 60, 90) for s in starts))).first()["window_size"]

    assert size(1) == 2.0 and size(0, 1, 2) == 0.8 and size(0, 10) == 3.0 and size(0, 0.25, 0.5) == 2.0 and size(0, 0.4) == 0.5


def test_window_overlap(spark):
    placed = windows.window_notes(make_notes(spark, (2, 4, 60, 90), (0, 6, 61, 90)), 2.0)
    assert rows(placed.filter("pitch = 60"), "window_idx") == [(1,)]
    placed = windows.window_notes(make_notes(spark, (1.5, 4.5, 60, 90)), 2.0)
    assert rows(placed, "window_idx", "w_end") == [(0, 2.0), (1, 4.0), (2, 4.5)]
    with pytest.raises(ValueError):
        windows.window_notes(make_notes(spark, (0, 1, 60, 90)), 0)


@QUICK
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(4, 90), st.sampled_from([48, 55, 60])), min_size=1, max_size=12), st.sampled_from([0.3, 0.7, 1.1]))
def test_windows_of_any_size(spark, given_, ws):
    parts = [(s / 40, (s + d) / 40, p, 90) for s, d, p in given_]
    total = max(e for _, e, _, _ in parts)
    want, i = [], 0
    while i * ws < total:
        want += [(i, n) for n, (s, e, _, _) in enumerate(parts) if not e - s < 0.1 and s < min((i + 1) * ws, total) and e > i * ws]
        i += 1
    assert rows(windows.window_notes(make_notes(spark, *parts), ws), "window_idx", "note_id") == sorted(want)


def test_chord_events(spark):
    def played(*given_):
        return rows(events.chord_events(make_segments(spark, *given_)), "start", "end", "chord", "play_number")

    assert played((0, 2, "G", 3), (2, 4, "G", 3), (5, 7, "G", 3)) == [(0, 7, "G", 1)]
    assert played((0, 2, "G", 3), (3.5, 5.5, "G", 3)) == [(0, 2, "G", 1), (3.5, 5.5, "G", 2)]
    assert played((0, 0.625, "G", 3), (1.875, 2.5, "G", 3)) == [(0, 2.5, "G", 1)]
    assert played((0, 1, "G", 3), (1, 2, "G", 1), (2, 3, "G", 3)) == [(0, 1, "G", 1), (2, 3, "G", 2)]


def slow_events(segments):
    runs, i = [], 0
    while i < len(segments):
        s, e, c, n = segments[i]
        i += 1
        if c == "Silence" or n < 2:
            continue
        while i < len(segments) and segments[i][2] == c and segments[i][3] >= 2 and segments[i][0] - e <= 1.0:
            e, n, i = segments[i][1], n + segments[i][3], i + 1
        runs.append([s, e, c, n])
    out = []
    for s, e, c, n in runs:
        if out and out[-1][2] == c and e - s < 0.8 and s - out[-1][1] < 1.5:
            out[-1][1], out[-1][3] = e, out[-1][3] + n
        else:
            out.append([s, e, c, n])
    return sorted(map(tuple, out))


@QUICK
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(1, 5), st.sampled_from(["G", "C", "Silence"]), st.integers(1, 4)), min_size=1, max_size=25))
def test_events_follow_the_sequential_rule(spark, given_):
    at, segments = 0.0, []
    for gap, length, chord, n in given_:
        at += gap / 4
        segments.append((at, at + length / 4, chord, n))
        at += length / 4
    got = rows(events.chord_events(make_segments(spark, *segments)), "start", "end", "chord", "total_notes")
    assert got == slow_events(segments)


def test_keys(spark):
    def made(*chords_):
        return spark.createDataFrame([(1, float(i), i + 1.0, c, 1, 1.0, 3) for i, c in enumerate(chords_)], schemas.CHORD_EVENTS)

    scores = {r["key"]: r["score"] for r in keys.key_scores(made("G", "C", "D", "G")).collect()}
    assert scores == {"G major": 6, "E minor": 6, "C major": 5, "D major": 5, "A minor": 5, "B minor": 5, "F major": 1, "A major": 1, "F# minor": 1, "D minor": 1, "G minor": 1} | scores
    assert scores["G major"] == 6 and scores["E minor"] == 6 and keys.key_from_chords(made("G", "C", "D", "G")).first()["key"] == "G major"
    assert keys.key_from_chords(made("Esus2", "Asus4")).first()["key"] == "Unknown"
    assert keys.key_from_chords(made("D#m", "D#m")).first()["key"] == "D# minor"

    def of_notes(*pitches):
        return keys.key_from_notes(make_notes(spark, *((i, i + 1, p, 90) for i, p in enumerate(pitches)))).first()["key"]

    assert of_notes(60, 60, 62) == "C major" and of_notes(57, 57, 57, 60, 60, 61, 64) == "A minor" and of_notes(57, 57, 57, 60, 61, 64) == "A major"
    assert of_notes(64, 64, 67, 71) == "E minor" and of_notes(66, 62) == "F# major"
    both = keys.key_signature(made("Esus2"), make_notes(spark, (0, 1, 67, 90), (0, 1, 71, 90)))
    assert both.first()["key"] == "G major"


def test_progression_end_to_end(spark):
    chord = {"G": (55, 59, 62), "C": (60, 64, 67), "D": (62, 66, 69)}
    played = [(2 * i, 2 * i + 2, p, 90) for i, c in enumerate("GCDG") for p in chord[c]]
    found = analyze(make_notes(spark, *played), 2.0)
    # each window is heard with its neighbours, whose notes make sevenths (rule 6)
    assert [r["chord"] for r in found.events.orderBy("start").collect()] == ["Em7", "Am7", "Bm7"]
    assert found.key.first()["key"] == "G major"
    assert found.stats.first().asDict() == {"recording_id": 1, "total_chords": 4, "unique_chords": 3, "chord_events": 3, "audio_duration": 8.0}
    plain = chords.label(windows.active_windows(make_notes(spark, *played), 2.0))
    assert [r["label"] for r in plain.orderBy("window_idx").collect()] == list("GCDG")


def make_frames(spark, *given_):
    return spark.createDataFrame([(1, i, float(t), float(f), float(c)) for i, (t, f, c) in enumerate(given_)], schemas.FRAMES)


def test_frames_to_notes(spark):
    hz = lambda m: 440 * 2 ** ((m - 69) / 12)
    frames = make_frames(spark, (0, hz(60.4), 0.3), (1, hz(20.6), 0.9), (1.5, float("nan"), 0.9), (2, hz(61), 0.29), (3, hz(62), float("nan")))
    onsets = spark.createDataFrame([(1, 0.03), (1, 0.06), (1, 2.0)], schemas.ONSETS)
    got = rows(transcribe.raw_notes(frames, onsets, None).fillna(-1.0).select("pitch", "start", F.round("end", 6).alias("end")), "pitch", "start", "end")
    assert got == [(60, 0.0, 0.1), (62, 3.0, 3.5)]
    short = transcribe.raw_notes(frames.filter("time = 3"), onsets, None, max_duration=0.3)
    assert short.first()["end"] == 3.5
    rms = spark.createDataFrame([(1, i, e) for i, e in enumerate([0.05, 0.3])], schemas.RMS)
    assert rows(transcribe.frame_energy(frames, rms), "frame_idx", "energy") == [(0, 0.05), (1, 0.3), (2, 0.3), (3, 0.3), (4, 0.3)]


def raw(spark, given_):
    return spark.createDataFrame([(1, i, p, s, e, 50 + i % 5, c) for i, (s, p, e, c) in enumerate(given_)], schemas.RAW_NOTES)


def test_clean_notes_examples(spark):
    out = transcribe.dedupe(raw(spark, [(0.0, 60, 1.0, 0.5), (0.05, 60, 1.0, 0.9), (0.12, 60, 1.0, 0.7), (0.2, 60, 1.0, 0.7)]))
    assert rows(out, "start", "confidence") == [(0.05, 0.9), (0.2, 0.7)]
    out = transcribe.merge(raw(spark, [(0.0, 60, 1.0, 0.5), (1.05, 60, 1.5, 0.5), (1.55, 62, 2.0, 0.5), (1.6, 60, 2.0, 0.5)]))
    assert rows(out, "start", "end", "pitch") == [(0.0, 1.5, 60), (1.55, 2.0, 62), (1.6, 2.0, 60)]


def slow_clean(given_):
    kept = []
    for n in sorted(given_):
        near = next((k for k in kept if abs(k[0] - n[0]) < 0.1 and k[1] == n[1]), None)
        if near and not n[3] > near[3]:
            continue
        if near:
            kept.remove(near)
        kept.append(n)
    out = []
    for s, p, e, c in kept:
        if out and out[-1][1] == p and s - out[-1][2] < 0.1:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([s, p, e, c])
    return sorted((s, p, e, c) for s, p, e, c in out)


@QUICK
@given(st.lists(st.tuples(st.integers(0, 60), st.sampled_from([60, 62]), st.integers(1, 12), st.integers(1, 9)), min_size=1, max_size=25, unique_by=lambda x: x[0]))
def test_cleaning_follows_the_sequential_rule(spark, given_):
    parts = [(s / 32, p, (s + d) / 32, c / 10) for s, p, d, c in sorted(given_)]
    assert rows(transcribe.clean(raw(spark, parts)), "start", "pitch", "end", "confidence") == slow_clean(parts)


def test_plan_has_no_nested_loop_join(spark, sf):
    from cadenza.sources import fixtures

    found = analyze(fixtures.notes(spark, sf), 0.625)
    plan = found.events._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_random_recordings_stay_apart(spark):
    rnd = random.Random(1)
    parts = [(rnd.randint(0, 300) / 16, 0, rnd.choice([55, 59, 62, 60, 64, 67]), 90, r) for r in (1, 2, 3) for _ in range(60)]
    parts = [(s, s + 0.5, p, v, r) for s, _, p, v, r in parts]
    all_at_once = rows(analyze(make_notes(spark, *parts), 1.0).events, "recording_id", "start", "end", "chord", "play_number")
    each = [x for r in (1, 2, 3) for x in rows(analyze(make_notes(spark, *(p for p in parts if p[4] == r)), 1.0).events, "recording_id", "start", "end", "chord", "play_number")]
    assert all_at_once == sorted(each)


def test_long_tracks_take_time_in_proportion(spark):
    """One track of very many frames, a drone of one pitch, without any onset after its beginning."""
    n = 100_000
    frames = spark.range(n).select(
        F.lit(1).cast("long").alias("track_id"), F.col("id").alias("frame_idx"), (F.col("id") * 0.0232).alias("time"), F.lit(440.0).alias("f0_hz"),
        (0.5 + F.col("id") % 7 / 20).alias("confidence"))
    onsets = spark.createDataFrame([(1, 0.5)], schemas.ONSETS)
    out = transcribe.clean(transcribe.raw_notes(frames, onsets, None))
    begun = time.perf_counter()
    assert out.agg(F.max("end")).first()[0] > n * 0.0232
    assert time.perf_counter() - begun < 90
