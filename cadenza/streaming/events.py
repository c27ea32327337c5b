"""Chord events and chord strikes of streams, equal to those of the batch operators.

Rows may arrive in any order within the watermark's delay; what is emitted is final.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cadenza.operators.events import MAX_GAP, SHORT, SHORT_GAP
from cadenza.operators.notes import STRIKE_GAP

#: The state store that transformWithState needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

EVENTS = "recording_id long, start double, end double, chord string, play_number long, duration double, total_notes long"

_PENDING = "at long, window_idx long, start double, end double, chord string, note_count long"
_RUN = "start double, end double, chord string, total_notes long"
_LAST = "origin long, timer long"


class _Events(StatefulProcessor):
    """Segments wait in a list until the watermark passes them and are then taken in order.

    What is kept of those taken is the open run of one chord, the event that a short run may
    still be merged into, and how often each chord has been played.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)
        self.run = handle.getValueState("run", _RUN)
        self.event = handle.getValueState("event", _RUN)
        self.reach = handle.getValueState("reach", "end double")  # where the event's last run ends
        self.last = handle.getValueState("last", _LAST)
        self.plays = handle.getMapState("plays", "chord string", "plays long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for frame in rows for r in zip(frame.iloc[:, -1], frame["window_idx"], frame["start"], frame["end"], frame["chord"], frame["note_count"])]
        new = [(int(a), int(i), float(s), float(e), str(c), int(n)) for a, i, s, e, c, n in new]
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        return

    def _close_run(self, run: tuple, out: list) -> None:
        """A run has ended: it goes on with the event before it, or ends that one and begins another."""
        event = tuple(self.event.get()) if self.event.exists() else None
        if event and event[2] == run[2] and run[1] - run[0] < SHORT and run[0] - self.reach.get()[0] < SHORT_GAP:
            event = event[0], run[1], event[2], event[3] + run[3]
        else:
            if event:
                self._emit(event, out)
            event = run
        self.event.update(event)
        self.reach.update((run[1],))

    def _emit(self, event: tuple, out: list) -> None:
        start, end, chord, notes = event
        number = (self.plays.getValue((chord,))[0] if self.plays.containsKey((chord,)) else 0) + 1
        self.plays.updateValue((chord,), (number,))
        out.append((start, end, chord, number, end - start, notes))

    def _advance(self, key, new: list, watermark: int) -> Iterator[pd.DataFrame]:
        waiting = sorted([tuple(p) for p in self.pending.get()] + new, key=lambda p: p[1])
        origin, timer = tuple(self.last.get()) if self.last.exists() else (0, -1)
        run, out = tuple(self.run.get()) if self.run.exists() else None, []
        later = []
        for p in waiting:
            at, _, start, end, chord, count = p
            if at > watermark:
                later.append(p)
                continue
            origin = at - int(start * 1000)
            weak = chord == "Silence" or count < 2
            if run and not weak and run[2] == chord and start - run[1] <= MAX_GAP:
                run = run[0], end, chord, run[3] + count
                continue
            if run:
                self._close_run(run, out)
            run = None if weak else (start, end, chord, count)
        # A millisecond's rounding aside, what comes later begins after the watermark.
        now = (watermark - origin) / 1000 - 0.002
        if run and now - run[1] > MAX_GAP:
            self._close_run(run, out)
            run = None
        if run is None and self.event.exists() and now - self.reach.get()[0] >= SHORT_GAP:
            self._emit(tuple(self.event.get()), out)
            self.event.clear()
        if run:
            self.run.update(run)
        else:
            self.run.clear()
        if timer >= 0:
            self.handle.deleteTimer(timer)
        due = [p[0] for p in later]
        if run or self.event.exists():
            last = run[1] if run else self.reach.get()[0]
            due.append(origin + int((last + SHORT_GAP) * 1000) + 10)
        timer = max(min(due), watermark + 1) if due else -1
        if timer >= 0:
            self.handle.registerTimer(timer)
        if later:
            self.pending.put(later)
        else:
            self.pending.clear()
        self.last.update((origin, timer))
        if out:
            frame = pd.DataFrame(out, columns=["start", "end", "chord", "play_number", "duration", "total_notes"])
            frame.insert(0, "recording_id", key[0])
            yield frame


def stream_events(segments: DataFrame, at: str, delay: str = "10 seconds") -> DataFrame:
    """A stream of segments -> chord events, each once and final, for output mode append.

    `at` is a column of timestamps: when a segment's start was, the same origin for all of a
    recording.  Segments may come in any order up to `delay` late.  An event is final when a run that
    ends it has ended, or when the watermark is SHORT_GAP past its end.  The state of a recording
    is what the watermark has not passed, one run, one event and a count for each chord.  The
    session must use the state store STATE_STORE.
    """
    rows = segments.withWatermark(at, delay).withColumn("_at", F.unix_millis(F.col(at)))  # the last column: a computed one comes without its name
    return rows.groupBy("recording_id").transformWithStateInPandas(_Events(), EVENTS, "append", "eventTime")


def stream_strikes(notes: DataFrame, at: str, delay: str = "10 seconds") -> DataFrame:
    """A stream of notes -> the onsets of chord strikes, for output mode append: recording_id,
    note_id, start, of the first note of each strike.

    `at` is a column of timestamps, when a note began.  Sessions of notes are merged with a gap that is
    a little over STRIKE_GAP, as a session ends before its gap does and timestamps are whole
    microseconds; what is then STRIKE_GAP apart or not is told by the starts themselves.
    """
    gap = f"{round(STRIKE_GAP * 1e6) + 2} microseconds"
    sessions = notes.withWatermark(at, delay).groupBy("recording_id", F.session_window(at, gap)).agg(F.array_sort(F.collect_list(F.struct("start", "note_id"))).alias("_notes"))
    first = F.expr(f"filter(_notes, (x, i) -> i = 0 OR x.start - get(_notes, i - 1).start > {STRIKE_GAP}D)")
    return sessions.select("recording_id", F.explode(first).alias("_n")).select("recording_id", "_n.note_id", "_n.start")
