"""MIDI files as a format of Spark's readers and writers, and as a table function of SQL.

    register(spark)
    spark.read.format("midi").load(folder).filter("path LIKE '%a.mid' AND pitch >= 60")
    files.write.format("midi").mode("append").save(folder)     # midi_file, content
    SELECT f.path, n.* FROM binaryFile.`folder` f, LATERAL midi_notes(f.content) n
"""

from __future__ import annotations

import operator
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

from cadenza.sources import midi

COLUMNS = "note_id long, instrument int, start double, end double, pitch int, velocity int, error string"
_TYPES = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]

#: Bytes of files that one task reads, where the option partitionBytes doesn't say otherwise.
PARTITION_BYTES = 32 << 20


def file_system(uri: str):
    """(pyarrow file system, path in it, what stands before its paths) of a URI or a local path."""
    from pyarrow.fs import FileSystem

    plain = uri.startswith("file:") and not uri.startswith("file://")
    fs, path = FileSystem.from_uri("file://" + uri.removeprefix("file:") if plain else uri)
    before = "file:" if uri.startswith(("file:", "/")) else uri.partition("://")[0] + "://"
    return fs, path, before


def note_rows(content: bytes) -> list[tuple]:
    """The notes of a file by start, as rows of COLUMNS; of a damaged one a row with its error."""
    try:
        notes = sorted(midi.decode(content), key=lambda n: n[1])
        return [(i, *n, None) for i, n in enumerate(notes)]
    except (ValueError, IndexError, struct.error) as e:
        return [(None,) * 6 + (str(e) or "damaged file",)]


_COMPARED: dict[type, Callable] = {
    EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le,
    In: lambda a, b: a in b, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: operator.contains}


@dataclass
class Files(InputPartition):
    """Files that one task reads: (path to show, path in the file system)."""

    files: list[tuple[str, str]]


class MidiReader(DataSourceReader):
    """Files of a folder, dealt by their sizes; conditions on the path leave files unopened, those on
    the pitch leave notes out before they become rows."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit = folder, limit
        self.on_path: list[tuple[type, object]] = []
        self.on_pitch: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            kept = {("path",): self.on_path, ("pitch",): self.on_pitch}.get(getattr(f, "attribute", None))
            texts = isinstance(f, StringStartsWith | StringEndsWith | StringContains)
            if kept is None or type(f) not in _COMPARED or texts and kept is self.on_pitch or f.value is None:
                yield f
            else:
                kept.append((type(f), f.value))

    def partitions(self) -> list[Files]:
        from pyarrow.fs import FileSelector, FileType

        fs, path, before = file_system(self.folder)
        found = []
        for info in fs.get_file_info(FileSelector(path)):
            shown = before + info.path
            if info.type == FileType.File and info.extension.lower() in ("mid", "midi") and all(_COMPARED[kind](shown, value) for kind, value in self.on_path):
                found.append((info.size, shown, info.path))
        out, held = [], self.limit
        for size, shown, inner in sorted(found, reverse=True):
            if held + size > self.limit or not out:
                out.append([])
                held = 0
            out[-1].append((shown, inner))
            held += size
        return [Files(files) for files in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _, _ = file_system(self.folder)
        names = ["path", *(c.split()[0] for c in COLUMNS.split(", "))]
        for shown, inner in partition.files:
            with fs.open_input_stream(inner) as f:
                rows = note_rows(f.read())
            rows = [r for r in rows if all(r[4] is not None and _COMPARED[kind](r[4], value) for kind, value in self.on_pitch)]
            for i in range(0, len(rows), 1 << 14):
                columns = list(zip(*rows[i : i + (1 << 14)]))
                yield pa.RecordBatch.from_arrays([pa.array([shown] * len(columns[0]), pa.string()), *(pa.array(c, t) for c, t in zip(columns, _TYPES))], names=names)


@dataclass
class Staged(WriterCommitMessage):
    """Files of a task: (path where it is written, path where it belongs)."""

    files: list[tuple[str, str]]


class MidiWriter(DataSourceWriter):
    """Files are written below a folder of the job beside where they belong, and moved there when all
    tasks have ended; a job that fails leaves none of them."""

    def __init__(self, folder: str | None):
        self.folder, self.job = folder, f"_midi-{uuid.uuid4().hex}"

    def _target(self, name: str) -> str:
        return name if name.startswith("/") or ":" in name.partition("/")[0] or not self.folder else f"{self.folder.rstrip('/')}/{name}"

    def write(self, rows: Iterator[Row]) -> Staged:
        done: list[tuple[str, str]] = []
        try:
            for row in rows:
                target = self._target(row["midi_file"])
                fs, path, before = file_system(target)
                folder, _, name = path.rpartition("/")
                staged = f"{folder}/{self.job}/{uuid.uuid4().hex}-{name}"
                fs.create_dir(f"{folder}/{self.job}", recursive=True)
                done.append((before + staged, target))
                with fs.open_output_stream(staged) as out:
                    out.write(bytes(row["content"]))
        except BaseException:
            for staged, _ in done:
                self._drop(staged)
            raise
        return Staged(done)

    def _drop(self, staged: str) -> None:
        fs, path, _ = file_system(staged)
        try:
            fs.delete_file(path)
        except FileNotFoundError:
            return

    def _clear(self, messages: list[Staged | None]) -> None:
        """Delete the job's folders, with what tasks that ran twice have left in them."""
        places = {staged.rpartition("/")[0] for m in messages if m for staged, _ in m.files}
        if self.folder:
            places.add(f"{self.folder.rstrip('/')}/{self.job}")
        for place in places:
            fs, path, _ = file_system(place)
            try:
                fs.delete_dir(path)
            except FileNotFoundError:
                continue

    def commit(self, messages: list[Staged | None]) -> None:
        targets = [target for m in messages if m for _, target in m.files]
        if len(set(targets)) < len(targets):
            self._clear(messages)
            raise ValueError("two rows have the same midi_file")
        for m in messages:
            for staged, target in m.files if m else ():
                fs, path, _ = file_system(staged)
                fs.move(path, file_system(target)[1])
        self._clear(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(messages)


class MidiSource(DataSource):
    """Format midi: path and notes when read; midi_file and content when written."""

    @classmethod
    def name(cls) -> str:
        return "midi"

    def schema(self) -> str:
        return "path string, " + COLUMNS

    def reader(self, schema: StructType) -> MidiReader:
        return MidiReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> MidiWriter:
        if overwrite:
            raise ValueError("files of the same name are replaced, others stay: write with mode append")
        if not {"midi_file", "content"} <= set(schema.names):
            raise ValueError("columns midi_file and content are needed")
        return MidiWriter(self.options.get("path"))


@udtf(returnType=COLUMNS)
class MidiNotes:
    """midi_notes(content): the notes of a MIDI file, for LATERAL joins in SQL."""

    def eval(self, content: bytes):
        if content is not None:
            yield from note_rows(bytes(content))


def register(spark: SparkSession) -> None:
    """Make the format and the table function known to a session."""
    spark.dataSource.register(MidiSource)
    spark.udtf.register("midi_notes", MidiNotes)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def save(files: DataFrame, folder: str | None = None) -> None:
    """Write files (midi_file, content), names in folder or whole paths: all of them or, if a task
    fails, none."""
    files.sparkSession.dataSource.register(MidiSource)
    writer = files.select("midi_file", "content").write.format("midi").mode("append")
    writer.save(folder) if folder else writer.save()
