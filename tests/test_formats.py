"""MIDI as a format, its writer and table function; reports; events and strikes of streams."""

import datetime as dt
import math
import random

import pytest
from cadenza import cli, schemas
from cadenza.functions import music
from cadenza.operators import events, keys, notes, windows
from cadenza.plans.pipeline import Pipeline
from cadenza.plans.report import reports, window_report
from cadenza.sources import midi, midi_format
from cadenza.sources.files import list_files
from cadenza.streaming import events as stream
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringEndsWith

CHORDS = {"G": [55, 59, 62], "C": [60, 64, 67], "D": [62, 66, 69]}
PLAYED = [(2.0 * i, 2.0 * i + 1.9, p, 90) for i, c in enumerate("GCDG") for p in CHORDS[c]]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("midi")
    for k in range(12):
        (d / f"{k}.mid").write_bytes(midi.encode([(s, e, p + k, v) for s, e, p, v in PLAYED]))
    (d / "empty.MIDI").write_bytes(midi.encode([]))
    (d / "broken.mid").write_bytes(b"MThd nothing")
    (d / "other.txt").write_text("no")
    (d / "below").mkdir()
    (d / "below" / "x.mid").write_bytes(midi.encode(PLAYED))
    return str(d)


def test_format_reads_what_the_batch_decoder_reads(spark, folder):
    midi_format.register(spark)
    got = spark.read.format("midi").load(folder)
    want = midi.decode_files(list_files(spark, [folder], ["mid", "MIDI"], content=True)).select(*got.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert got.filter("error IS NOT NULL").count() == 1


def test_conditions_are_pushed(spark, folder):
    midi_format.register(spark)
    frame = spark.read.format("midi").load(folder).filter("path LIKE '%/3.mid' AND pitch >= 60 AND velocity > 3")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    got = frame.collect()
    assert {r["path"].rsplit("/")[-1] for r in got} == {"3.mid"} and min(r["pitch"] for r in got) >= 60 and len(got) == sum(p + 3 >= 60 for _, _, p, _ in PLAYED)
    condition = next(line for line in plan.split("\n") if "Filter" in line)
    assert "velocity" in condition and "pitch >=" not in condition.replace("isnotnull", "")
    reader = midi_format.MidiReader(folder, 1 << 20)
    rest = list(reader.pushFilters([StringEndsWith(("path",), "/3.mid"), GreaterThan(("pitch",), 70), In(("pitch",), (72, 74)), EqualTo(("velocity",), 90)]))
    parts = reader.partitions()
    assert len(rest) == 1 and [len(p.files) for p in parts] == [1]
    assert {p for batch in reader.read(parts[0]) for p in batch.column("pitch").to_pylist()} == {72}


def test_files_are_dealt_by_size(folder):
    size = len(midi.encode(PLAYED))
    parts = midi_format.MidiReader(folder, 3 * size + 1).partitions()
    assert 4 <= len(parts) <= 6 and sum(len(p.files) for p in parts) == 14 and max(len(p.files) for p in parts) <= 5
    assert len(midi_format.MidiReader(folder, 1 << 30).partitions()) == 1


def test_writer_leaves_all_or_none(spark, tmp_path):
    rows = [(f"{i}.mid", midi.encode([(0.0, 1.0, 60 + i, 90)])) for i in range(20)]
    good = spark.createDataFrame(rows, "midi_file string, content binary").repartition(4)
    midi_format.save(good, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(n for n, _ in rows)
    assert midi.decode((tmp_path / "out" / "7.mid").read_bytes())[0][3] == 67
    fails = F.udf(lambda name, content: content if name != "13.mid" else 1 / 0, "binary")
    with pytest.raises(Exception):
        midi_format.save(good.withColumn("content", fails("midi_file", "content")), str(tmp_path / "half"))
    assert not [p for p in (tmp_path / "half").rglob("*") if p.is_file()]
    with pytest.raises(Exception):
        midi_format.save(good.unionByName(good.limit(1)), str(tmp_path / "twice"))
    assert not [p for p in (tmp_path / "twice").rglob("*") if p.is_file()]
    midi_format.save(good.limit(2), str(tmp_path / "out"))  # replaces files of the same name
    assert len(list((tmp_path / "out").iterdir())) == 20


def test_from_listing_to_notes_in_sql(spark, folder):
    midi_format.register(spark)
    got = spark.sql(f"""
        SELECT regexp_extract(f.path, '([^/]+)$', 1) AS name, n.pitch, n.start
        FROM binaryFile.`{folder}/*.mid` f, LATERAL midi_notes(f.content) n WHERE n.error IS NULL""")
    want = spark.read.format("midi").load(folder).filter("error IS NULL").selectExpr("regexp_extract(path, '([^/]+)$', 1) AS name", "pitch", "start")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 12 * 12


def test_counts_and_memory_of_a_run(spark, folder):
    run = Pipeline(window_size=2.0).analyze_midi(list_files(spark, [folder], ["mid", "MIDI"], content=True))
    assert run.counts["files"] == 14 and run.counts["processed"] == 12 and run.counts["peak_mb"] > 10
    row = run.results.filter("path LIKE '%/0.mid'").first()
    assert 0 < row["peak_mb"] <= run.counts["peak_mb"] and row["conversion_time"] >= 0


def test_reports_as_text(spark, folder, capsys):
    run = Pipeline(window_size=2.0).analyze_midi(list_files(spark, [folder], ["mid"], content=True))
    text = {r["path"].rsplit("/")[-1]: r["report"] for r in reports(run).collect()}
    assert text["broken.mid"].startswith("File: broken.mid\nError: ")
    lines = text["0.mid"].split("\n")
    assert lines[:2] == ["File: 0.mid", "Notes: 12 musical, 0 left out"] and lines[2].startswith("Windows: Chord strikes found: 4")
    assert "Segments: 4" in lines and "Chord events: 3" in lines and any(x.startswith("  1. [00:00 - 00:02] ") for x in lines) and lines[-1].startswith("Key: ")
    assert any(x.endswith(" 1 time") for x in lines)
    drawn = [r["line"] for r in window_report(windows.active_windows(run.notes, 2.0)).orderBy("recording_id", "window_idx").collect()]
    assert len(drawn) == 48 and all(x.startswith("[00:0") and "{" in x for x in drawn)
    assert cli.main([folder + "/0.mid", folder + "/broken.mid", "--window-size", "2.0", "--long", "--report", "--statistics"]) == 0
    out = capsys.readouterr().out
    assert "File: 0.mid" in out and "Key: " in out and "note_density" in out and "1 of 2 files" in out


def test_runs_by_chunk_have_the_same_results(spark, folder):
    files = list_files(spark, [folder], ["mid"], content=True).filter("path LIKE '%/3.mid' OR path LIKE '%/4.mid'")
    whole, parts = Pipeline(window_size=0.7).analyze_midi(files), Pipeline(window_size=0.7, chunk=2, seconds=1.0).analyze_midi(files)
    columns = ["path", "chord_progression", "chord_events", "key", "stats", "error"]
    assert sorted(map(str, whole.results.select(*columns).collect())) == sorted(map(str, parts.results.select(*columns).collect()))


def test_labels_follow_a_second_statement_of_the_rule():
    """The largest pattern, of equals the one listed first; else the first root present; else the first
    class by name: from the listed chords as text, for all 4,096 sets."""
    listed = [e.split() for e in music.PATTERNS.replace("\n", " ").split(";")]
    names = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
    for m in range(4096):
        held = {n for i, n in enumerate(names) if m >> i & 1}
        if not held:
            want = "Silence"
        elif len(held) == 1:
            want = next(iter(held))
        else:
            inside = [(len(set(c[1:])), -i, c[0]) for i, c in enumerate(listed) if set(c[1:]) <= held]
            exact = [c[0] for c in listed if set(c[1:]) == held]
            roots = [r for r in ("E", "F#", "A", "B", "C", "D", "G", "F") if r in held]
            want = exact[0] if exact else max(inside)[2] if inside else roots[0] if roots else min(held)
        assert music.label_of_mask(m) == want, m


def test_key_by_profile(spark):
    scale = lambda tonic, steps: [tonic + s for s in steps]
    c_major, a_minor = scale(60, (0, 4, 7, 0, 5, 9, 7, 11, 2, 0)), scale(57, (0, 3, 7, 0, 0, 3, 8, 10, 2, 7))
    rows = [(k, i, i * 1.0, i + 0.9, p, 90) for k, pitches in enumerate((c_major, a_minor, [60 + i for i in range(12)], [60])) for i, p in enumerate(pitches)]
    got = {r["recording_id"]: r for r in keys.key_by_profile(spark.createDataFrame(rows, schemas.NOTES)).collect()}
    assert got[0]["key"] == "C major" and got[1]["key"] == "A minor" and got[2]["key"] == "Unknown" and got[2]["correlation"] is None and got[3]["key"] == "C major"
    x = [sum(min(c_major.count(p), 10) for p in set(c_major) if p % 12 == c) for c in range(12)]
    y = music.MAJOR_PROFILE
    dx, dy = [a - sum(x) / 12 for a in x], [a - sum(y) / 12 for a in y]
    want = sum(a * b for a, b in zip(dx, dy)) / math.sqrt(sum(a * a for a in dx) * sum(b * b for b in dy))
    assert abs(got[0]["correlation"] - want) < 1e-12


# -- streams

ORIGIN = dt.datetime(2024, 1, 1)


@pytest.fixture
def state_store(spark):
    before = spark.conf.get(stream.STATE_STORE[0], None)
    spark.conf.set(*stream.STATE_STORE)
    yield
    spark.conf.unset(stream.STATE_STORE[0]) if before is None else spark.conf.set(stream.STATE_STORE[0], before)


def streamed(spark, path, rows, schema, build, batches, seed):
    """Rows in random order over some batches, and then a row that moves the watermark on."""
    rnd, name = random.Random(seed), f"s{seed}"
    order = list(rows)
    rnd.shuffle(order)
    cuts = [order[i::batches] for i in range(batches)]
    for i, some in enumerate([*cuts, [rows[0][:0] + (-1, *rows[0][1:-1], ORIGIN + dt.timedelta(days=9))]]):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{path}/in/{i:03}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{path}/in/*")
    q = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return [r for r in spark.table(name).collect() if r["recording_id"] >= 0]


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_events_are_those_of_the_batch(spark, tmp_path, state_store, seed):
    rnd, rows = random.Random(seed), []
    for rec in range(3):
        at = 0.0
        for i in range(120):
            at += rnd.choice([0.0, 0.0, 0.5, 1.0, 1.25, 1.5, 3.0])
            length = rnd.choice([0.25, 0.5, 0.625, 1.0])
            rows.append((rec, i, at, at + length, rnd.choice(["C", "C", "G", "Silence"]), rnd.choice([1, 2, 3, 4]), 3))
            at += length
    want = events.chord_events(spark.createDataFrame(rows, schemas.SEGMENTS))
    timed = [(*r, ORIGIN + dt.timedelta(seconds=r[2])) for r in rows]
    got = streamed(spark, str(tmp_path), timed, schemas.SEGMENTS + ", at timestamp", lambda s: stream.stream_events(s, "at", "1 hour"), 5, 10 + seed)
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in want.select(*[c.split()[0] for c in stream.EVENTS.split(", ")]).collect())


def test_streamed_events_come_before_the_end(spark, tmp_path, state_store):
    """In order and with a short delay, events are final while the stream still runs."""
    rows = [(1, i, i * 1.0, i + 1.0, "CG"[i // 10 % 2], 3, 3, ORIGIN + dt.timedelta(seconds=i)) for i in range(60)]
    schema = schemas.SEGMENTS + ", at timestamp"
    for i in range(6):
        spark.createDataFrame(rows[10 * i : 10 * i + 10], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = stream.stream_events(source, "at", "1 second").writeStream.format("memory").queryName("early").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["start"], r["end"], r["chord"], r["play_number"]) for r in spark.table("early").collect())
    assert got[:4] == [(10.0 * k, 10.0 * k + 10, "CG"[k % 2], k // 2 + 1) for k in range(4)] and len(got) < 6


def test_streamed_strikes_are_those_of_the_batch(spark, tmp_path):
    rnd, rows, at = random.Random(4), [], 0.0
    for i in range(200):
        at += rnd.choice([0.0, 0.1, 0.3, 0.3000005, 0.31, 2.0])
        rows.append((i % 2, i, at, at + 0.2, 60, 90))
    want = notes.strikes(spark.createDataFrame(rows, schemas.NOTES)).select("recording_id", "note_id", "start")
    timed = [(*r, ORIGIN + dt.timedelta(seconds=r[2])) for r in rows]
    got = streamed(spark, str(tmp_path), timed, schemas.NOTES + ", at timestamp", lambda s: stream.stream_strikes(s, "at", "1 hour"), 4, 30)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))
