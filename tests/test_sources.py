"""MIDI and WAV files, the pipeline over them, and streams."""

import datetime as dt
import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza import cli, schemas
from cadenza.operators import notes as note_ops
from cadenza.plans.pipeline import Pipeline, midi_report, simulated_transcription, successes
from cadenza.sources import audio, midi
from cadenza.sources.files import companions, in_turn, list_files
from cadenza.streaming import windows as streaming

CHORDS = {"G": (55, 59, 62), "C": (60, 64, 67), "D": (62, 66, 69)}
PLAYED = [(2.0 * i, 2.0 * i + 1.9, p, 90) for i, c in enumerate("GCDG") for p in CHORDS[c]]


def wav(y, rate=22050):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(y, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def tone(pitch, seconds, rate=22050):
    t = np.arange(int(seconds * rate)) / rate
    return 0.5 * np.sin(2 * np.pi * 440 * 2 ** ((pitch - 69) / 12) * t)


def test_midi_round_trip():
    got = midi.decode(midi.encode(PLAYED))
    assert [(round(s, 2), round(e, 2), p, v) for _, s, e, p, v in sorted(got, key=lambda n: (n[1], n[3]))] == sorted(PLAYED)
    assert midi.decode(midi.encode([])) == []
    for bad in (b"", b"MThd", midi.encode(PLAYED)[:-9], b"RIFF" + bytes(40)):
        with pytest.raises((ValueError, IndexError, struct.error)):
            midi.decode(bad)


def test_midi_tempo_channels_and_running_status():
    track = bytes([0, 0xFF, 0x51, 3, 0x0F, 0x42, 0x40, 0, 0x90, 60, 80, 0x60, 60, 0, 0, 0x99, 35, 70, 0x60, 0x89, 35, 0, 0, 0xFF, 0x2F, 0])
    data = b"MThd" + struct.pack(">IHHH", 6, 1, 1, 96) + b"MTrk" + struct.pack(">I", len(track)) + track
    assert midi.decode(data) == [(0, 0.0, 1.0, 60, 80), (1, 1.0, 2.0, 35, 70)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "song.mid").write_bytes(midi.encode(PLAYED))
    (d / "empty.midi").write_bytes(midi.encode([]))
    (d / "broken.mid").write_bytes(b"MThd nothing")
    silence = np.zeros(8000)
    (d / "song.wav").write_bytes(wav(np.concatenate([silence, *(tone(p, 0.6) for p in (60, 64, 67)), silence])))
    (d / "silent.wav").write_bytes(wav(silence))
    (d / "bad.wav").write_bytes(b"RIFFxxxx")
    (d / "song.mp3").write_bytes(b"ID3")
    (d / "song.txt").write_text("no")
    return str(d)


def test_listing(spark, folder):
    found = list_files(spark, [folder, folder, folder + "/missing"], ["mid", "midi"])
    assert found.count() == 6 and list_files(spark, [], ["mid"]).count() == 0
    pairs = companions(list_files(spark, [folder], ["mid", "midi"]), list_files(spark, [folder], ["wav"])).collect()
    assert {r["name"]: r["audio_path"] is not None for r in pairs} == {"song.mid": True, "empty.midi": False, "broken.mid": False}


def test_midi_analysis(spark, folder):
    files = list_files(spark, [folder], ["mid", "midi"], content=True)
    rows = {r["path"].rsplit("/")[-1]: r for r in Pipeline(window_size=2.0).analyze_midi(files).results.collect()}
    assert [e["chord"] for e in rows["song.mid"]["chord_events"]] == ["Em7", "Am7", "Bm7"] and rows["song.mid"]["key"] == "G major"
    assert rows["empty.midi"]["error"] == "no notes" and rows["broken.mid"]["error"] not in (None, "no notes")
    report = {r["file_name"]: r for r in midi_report(files).collect()}
    assert report["song.mid"]["total_notes"] == 12 and report["song.mid"]["instruments"] == 1 and len(report["song.mid"]["notes_list"]) == 12
    assert report["empty.midi"]["pitch_range"] == (0, 0)
    again = midi.encode_files(midi.read_notes(spark, folder)).first()["content"]
    assert len(midi.decode(bytes(again))) == 12


def test_audio_analysis(spark, folder):
    files = list_files(spark, [folder], ["wav"], content=True)
    notes = Pipeline().transcribe(files)
    heard = {r["pitch"] for r in notes.filter("confidence > 0.8 AND end - start > 0.1").collect()}
    # 36 is the common fundamental of C4, E4 and G4, two of which sound in a frame where they meet
    assert {60, 64, 67} <= heard and heard <= {59, 60, 61, 63, 64, 65, 66, 67, 68, 48, 52, 55, 36}
    rows = {r["path"].rsplit("/")[-1]: r for r in Pipeline(window_size=0.5).analyze_audio(files).results.collect()}
    assert rows["silent.wav"]["error"] == "no notes" and rows["bad.wav"]["error"] and rows["song.wav"]["error"] is None
    out = Pipeline(window_size=0.5).analyze_paths(spark, folder)
    assert out.count() == 7 and successes(out).first() == (7, 2)
    with pytest.raises(FileNotFoundError):
        Pipeline().analyze_paths(spark, folder + "/none.wav")


def test_pitch_of_tones():
    for pitch in (45, 57, 69, 81):
        f0, confidence = audio.pitches(tone(pitch, 0.5))
        middle = f0[5:-5]
        assert np.nanmedian(np.abs(69 + 12 * np.log2(middle / 440) - pitch)) < 0.1 and confidence[5:-5].min() > 0.8
    assert np.isnan(audio.pitches(np.zeros(5000))[0]).all()
    y = np.concatenate([np.zeros(11025), tone(60, 0.5), np.zeros(11025), tone(67, 0.5)])
    onsets = audio.onset_times(y)
    assert any(abs(o - 0.5) < 0.08 for o in onsets) and any(abs(o - 1.5) < 0.08 for o in onsets)


def test_command_line(spark, folder, tmp_path, capsys):
    assert cli.main([folder + "/song.mid", "--window-size", "2.0", "--output", str(tmp_path / "out")]) == 0
    assert "Em7 Am7 Bm7" in capsys.readouterr().out
    assert cli.main([folder + "/none.mid"]) == 1
    assert cli.window_size("AUTO") is None
    with pytest.raises(Exception):
        cli.window_size("-1")


def test_streams_agree_with_batches(spark, tmp_path):
    notes = spark.createDataFrame([(1, i, s, e, p, v) for i, (s, e, p, v) in enumerate(PLAYED)], schemas.NOTES)
    notes.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(notes.schema).parquet(str(tmp_path / "in"))
    q = streaming.stream_labels(stream, 2.0).writeStream.format("memory").queryName("labels").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["label"] for r in spark.table("labels").orderBy("window_idx").collect()] == list("GCDG")
    q = streaming.analyze_batches(stream, str(tmp_path / "out"), 2.0).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["chord"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()] == ["Em7", "Am7", "Bm7"]


def test_windows_whose_notes_arrive_apart_are_whole(spark, tmp_path):
    """The three notes of a chord arrive in three batches, minutes apart."""
    at = dt.datetime(2024, 1, 1)
    for i, (s, e, p, v) in enumerate(PLAYED[:3]):
        spark.createDataFrame([(1, i, s, e, p, v, at + dt.timedelta(minutes=5 * i))], schemas.NOTES + ", arrived timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    labels = streaming.stream_labels(stream, 2.0, "arrived").select("recording_id", "window_idx", "note_count", "label")
    q = labels.writeStream.format("memory").queryName("apart").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("apart").collect()}
    assert (1, 0, 3, "G") in got and max(r[2] for r in got) == 3


def test_midi_files_are_written(spark, folder, tmp_path):
    files = list_files(spark, [folder], ["wav", "mp3"], content=True)
    out = {r["path"].rsplit("/")[-1]: r for r in Pipeline().convert(files, str(tmp_path / "midi")).collect()}
    assert out["bad.wav"]["error"] and out["bad.wav"]["midi_file"] is None and out["song.mp3"]["error"] == "format not decoded: mp3"
    assert out["song.wav"]["midi_file"] == f"{tmp_path}/midi/song.mid" and midi.decode((tmp_path / "midi" / "silent.mid").read_bytes()) == []
    notes = Pipeline().transcribe(files.filter("path LIKE '%song.wav'")).collect()
    again = midi.decode((tmp_path / "midi" / "song.mid").read_bytes())
    assert sorted((round(n[1], 2), n[3]) for n in again) == sorted((round(r["start"], 2), r["pitch"]) for r in notes) and again
    run = Pipeline(window_size=0.5, midi_folder=str(tmp_path / "kept")).analyze_audio(files)
    row = run.results.filter("path LIKE '%song.wav'").first()
    assert row["midi_file"].endswith("/kept/song.mid") and row["conversion_time"] > 0 and row["trim_offset"] > 0.2 and run.seconds["total"] > 0
    twins = spark.createDataFrame([("file:/a/x.wav",), ("file:/b/x.wav",), ("file:/b/y.wav",)], "path string")
    assert len({r["midi_file"] for r in midi.targets(twins, "/out").collect()}) == 3
    assert midi.targets(twins).filter("path = 'file:/b/y.wav'").first()["midi_file"] == "file:/b/y_transcribed.mid"


def test_files_are_decoded_once(spark, folder):
    found = Pipeline(window_size=0.5).analyze_audio(list_files(spark, [folder], ["wav"], content=True))
    for frame in (found.results, found.notes, found.analysis.events, found.analysis.key):
        assert "MapInPandas" not in frame._jdf.queryExecution().toString()


def test_frames_of_another_tracker_come_first(spark, folder):
    files = list_files(spark, [folder], ["wav"], content=True).filter("path LIKE '%song.wav' OR path LIKE '%silent.wav'")
    path = files.filter("path LIKE '%silent.wav'").first()["path"]
    frames = spark.createDataFrame([(path, i, i * 0.0232, 440.0, 0.9) for i in range(8)], "path string, frame_idx long, time double, f0_hz double, confidence double")
    heard = Pipeline().transcribe(files, frames).groupBy(F.col("recording_id") == F.xxhash64(F.lit(path))).agg(F.collect_set("pitch")).collect()
    assert dict(map(tuple, heard))[True] == [69] and len(dict(map(tuple, heard))[False]) >= 3


def test_reports(spark, folder):
    sound = list_files(spark, [folder], ["wav"], content=True)
    report = {r["file_name"]: r for r in midi_report(list_files(spark, [folder], ["mid", "midi"], content=True), sound).collect()}
    song = report["song.mid"]
    assert [x["note_name"] for x in song["first_notes"]][:3] == ["G3", "B3", "D4"] and len(song["first_notes"]) == 10 and song["progression"]
    assert len(song["top_pitches"]) == 5 and song["audio_path"].endswith("song.wav") and song["audio_length"] > 2 and song["duration_match"] is False
    assert report["empty.midi"]["audio_path"] is None and report["empty.midi"]["progression"] is False
    notes, summary = simulated_transcription(sound)
    lines = {r["path"].rsplit("/")[-1]: r for r in summary.collect()}
    assert lines["bad.wav"]["error"] and lines["silent.wav"]["note_count"] == 0 and lines["song.wav"]["summary"].startswith("File: song.wav | Time: ")
    assert {60, 64, 67} <= {round(r["midi_note"]) for r in notes.collect()}
    sizes = note_ops.reasoning(note_ops.auto_window(spark.createDataFrame([(1, 0, 0.0, 0.2, 60, 90), (1, 1, 1.0, 1.2, 60, 90)], schemas.NOTES))).first()
    assert sizes["reasoning"] == ["Chord strikes found: 2", "Average gap between strikes: 1.0s", "Fast playing: small windows for precision"]


def test_files_in_turn(spark):
    rows = spark.createDataFrame([(f"/x/{i % 7}{i}",) for i in range(50)], "path string")
    got = in_turn(rows).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 51)) and [r["path"] for r in got] == sorted(r["path"] for r in got)


def test_wide_samples_rates_and_voicing():
    y = np.round(tone(69, 0.3) * (1 << 23)).astype("<i4")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(3)
        w.setframerate(22050)
        w.writeframes(y.view(np.uint8).reshape(-1, 4)[:, :3].tobytes())
    assert np.abs(audio.decode_wav(out.getvalue())[0] - tone(69, 0.3)).max() < 1e-6
    high = np.sin(2 * np.pi * 15000 * np.arange(44100) / 44100)  # would be heard at 7,050 Hz
    low = np.sin(2 * np.pi * 440 * np.arange(44100) / 44100)
    assert np.abs(audio.resample(high, 44100, 22050)[500:-500]).max() < 0.05 < 0.9 < np.abs(audio.resample(low, 44100, 22050)).max()
    assert audio.voicing(np.array([0.0] * 5 + [0.9] * 9 + [0.3] + [0.9] * 5 + [0.0] * 9)).tolist() == [False] * 5 + [True] * 15 + [False] * 9
    noise = np.random.default_rng(1).normal(0, 0.3, 22050)
    kept = audio.harmonic((tone(69, 1.0) + noise).astype(np.float32))
    assert np.abs(np.fft.rfft(kept))[440] > 20 * np.abs(np.fft.rfft(kept))[3000:].max()
