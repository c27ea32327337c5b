"""MIDI files as tables of notes, and notes as MIDI files."""

from __future__ import annotations

import bisect
import struct
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.music import file_stem, transcribed_path
from cadenza.sources.files import list_files, peak_mb
from cadenza.storage import stored

TICKS = 480
TEMPO = 500_000  # microseconds a quarter, where a file sets none

FILE_NOTES = "path string, note_id long, instrument int, start double, end double, pitch int, velocity int, error string, seconds double, peak_mb double"


def _varlen(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    while True:
        value = value << 7 | data[at] & 127
        at += 1
        if not data[at - 1] & 128:
            return value, at


def _events(track: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tick, status, data) of a track; status 0x51 stands for a tempo."""
    at = tick = status = 0
    while at < len(track):
        delta, at = _varlen(track, at)
        tick += delta
        if track[at] & 128:
            status, at = track[at], at + 1
        if status == 0xFF:
            kind = track[at]
            size, at = _varlen(track, at + 1)
            if kind == 0x51:
                yield tick, kind, track[at : at + size]
            at += size
        elif status in (0xF0, 0xF7):
            size, at = _varlen(track, at)
            at += size
        else:
            size = 1 if status >> 4 in (0xC, 0xD) else 2
            if at + size > len(track):
                raise ValueError("the track ends inside an event")
            yield tick, status, track[at : at + size]
            at += size


def decode(data: bytes) -> list[tuple[int, float, float, int, int]]:
    """A standard MIDI file -> (instrument, start, end, pitch, velocity) in file order.

    An instrument is a track and channel that has notes.  A note ends at the next end of its
    pitch; one that is never ended is left out.  Damaged files raise ValueError.
    """
    if data[:4] != b"MThd" or len(data) < 14:
        raise ValueError("not a MIDI file")
    _, tracks, division = struct.unpack(">HHH", data[8:14])
    if division & 0x8000 or not division:
        raise ValueError("time codes are not supported")
    at, bodies = 8 + struct.unpack(">I", data[4:8])[0], []
    for _ in range(tracks):
        size = struct.unpack(">I", data[at + 4 : at + 8])[0] if len(data) >= at + 8 else -1
        if size < 0 or data[at : at + 4] != b"MTrk" or len(data) < at + 8 + size:
            raise ValueError("the file ends inside a track")
        bodies.append(list(_events(data[at + 8 : at + 8 + size])))
        at += 8 + size
    tempi = sorted((tick, int.from_bytes(d, "big")) for body in bodies for tick, status, d in body if status == 0x51)
    marks = [(0, 0.0, TEMPO)]
    for tick, tempo in tempi:
        last, seconds, old = marks[-1]
        marks.append((tick, seconds + (tick - last) * old / division / 1e6, tempo))

    ticks = [m[0] for m in marks]

    def seconds(tick: int) -> float:
        mark = marks[bisect.bisect_right(ticks, tick) - 1]
        return mark[1] + (tick - mark[0]) * mark[2] / division / 1e6

    notes, instruments = [], {}
    for number, body in enumerate(bodies):
        open_: dict[tuple[int, int], list] = {}
        for tick, status, d in body:
            key = (status & 15, d[0])
            if status >> 4 == 9 and d[1]:
                open_.setdefault(key, []).append((tick, d[1]))
            elif status >> 4 in (8, 9) and open_.get(key):
                for begun, velocity in open_.pop(key):
                    instrument = instruments.setdefault((number, key[0]), len(instruments))
                    notes.append((instrument, seconds(begun), seconds(tick), d[0], velocity))
    return sorted(notes, key=lambda n: n[0])


def encode(notes: list[tuple[float, float, int, int]], name: str = "Audio Transcription") -> bytes:
    """(start, end, pitch, velocity) -> a MIDI file of one piano; times to 1/960 second."""
    per_second = TICKS * 1_000_000 / TEMPO
    events = [(round(s * per_second), 1, 0x90, p, v) for s, e, p, v in notes] + [(max(round(e * per_second), round(s * per_second) + 1), 0, 0x80, p, 0) for s, e, p, _ in notes]

    def varlen(n: int) -> bytes:
        out = [n & 127]
        while n := n >> 7:
            out.append(n & 127 | 128)
        return bytes(reversed(out))

    title = name.encode()
    body, last = bytearray(b"\x00\xff\x03" + varlen(len(title)) + title + b"\x00\xc0\x00"), 0
    for tick, _, status, pitch, velocity in sorted(events):
        body += varlen(tick - last) + bytes([status, pitch, velocity])
        last = tick
    body += b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, TICKS) + b"MTrk" + struct.pack(">I", len(body)) + bytes(body)


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in FILE_NOTES.split(", ")]
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"]):
            begun, first = time.perf_counter(), len(rows)
            try:
                notes = sorted(enumerate(decode(bytes(content))), key=lambda n: n[1][1])
                rows += [(path, i, n[0], n[1], n[2], n[3], n[4], None, None, None) for i, (_, n) in enumerate(notes)]
            except (ValueError, IndexError, struct.error) as e:
                rows.append((path, None, None, None, None, None, None, str(e) or "damaged file", None, None))
            if len(rows) > first:
                rows[first] = (*rows[first][:-2], time.perf_counter() - begun, peak_mb())
        out = pd.DataFrame(rows, columns=names)
        yield out.astype({"note_id": "Int64", "instrument": "Int32", "pitch": "Int32", "velocity": "Int32", "start": float, "end": float, "seconds": float, "peak_mb": float, "error": object})


def decode_files(files: DataFrame) -> DataFrame:
    """Binary files (path, content) -> their notes, sorted by start within a file; a file that
    can't be read gives one row with its error and nothing else.  The first row of a file has the
    seconds that decoding it took and the most memory that its worker had held by then."""
    return files.select("path", "content").mapInPandas(_decoded, FILE_NOTES)


def read_notes(spark: SparkSession, *folders: str) -> DataFrame:
    """Notes of all MIDI files in folders: recording_id is a hash of the path."""
    rows = decode_files(list_files(spark, folders, ["mid", "midi"], content=True)).filter("error IS NULL")
    return rows.select(F.xxhash64("path").alias("recording_id"), "path", "note_id", "instrument", "start", "end", "pitch", "velocity")


def _rows(group: pd.DataFrame) -> bytes:
    notes = group.dropna(subset=["pitch"]).sort_values(["start", "note_id"])
    return encode(list(zip(notes["start"], notes["end"], notes["pitch"].astype(int), notes["velocity"].astype(int))))


def _encoded(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"recording_id": [group["recording_id"].iloc[0]], "content": [_rows(group)]})


def encode_files(notes: DataFrame) -> DataFrame:
    """Notes -> (recording_id, content): a MIDI file for each recording, as bytes."""
    columns = notes.select("recording_id", "note_id", "start", "end", "pitch", "velocity")
    return columns.groupBy("recording_id").applyInPandas(_encoded, "recording_id long, content binary")


def targets(files: DataFrame, folder: str | None = None) -> DataFrame:
    """path, recording_id, midi_file: where the transcription of each file goes.

    Without a folder that is beside the file, <stem>_transcribed.mid; in a folder <stem>.mid, or
    <stem>-<hash of the path>.mid where several files have that stem.
    """
    rows = files.select("path", F.xxhash64("path").alias("recording_id"), file_stem(F.col("path")).alias("_stem")).distinct()
    if folder is None:
        return rows.select("path", "recording_id", transcribed_path(F.col("path")).alias("midi_file"))
    shared = F.count("*").over(Window.partitionBy("_stem")) > 1
    name = F.when(shared, F.concat("_stem", F.lit("-"), F.lower(F.hex("recording_id")))).otherwise(F.col("_stem"))
    return rows.select("path", "recording_id", F.concat(F.lit(folder.rstrip("/") + "/"), name, F.lit(".mid")).alias("midi_file"))


def write_files(notes: DataFrame, places: DataFrame) -> DataFrame:
    """Write the notes of each of targets() as a MIDI file: path, midi_file, midi_bytes.

    Recordings become files by themselves, which are stored, written beside where they belong, to any
    store that pyarrow knows and all machines share, and moved there when all are written.  A
    recording without notes gives a file without notes.
    """
    from cadenza.sources import midi_format

    columns = notes.select("recording_id", "note_id", "start", "end", "pitch", "velocity")
    rows = places.join(columns, "recording_id", "left")
    files = stored(rows.groupBy("path", "midi_file").applyInPandas(_file, "path string, midi_file string, content binary"), "midi-content")
    midi_format.save(files)
    return files.select("path", "midi_file", F.length("content").cast("long").alias("midi_bytes"))


def _file(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"path": [group["path"].iloc[0]], "midi_file": [group["midi_file"].iloc[0]], "content": [_rows(group)]})
