"""From pitch frames to notes: frame filters, velocities, durations, duplicates and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.music import confidence_velocity, energy_velocity, hz_to_midi
from cadenza.operators.scans import Chunks, joined
from cadenza.storage import stored

LOW, HIGH = 21, 108


def voiced(min_confidence: float = 0.3) -> Column:
    """Frames with a pitch and not too little confidence; unknown confidence (NaN) is enough."""
    return ~(F.col("confidence") < min_confidence) & ~F.isnan("f0_hz") & (F.col("f0_hz") > 0)


def frame_pitches(frames: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    """Voiced frames within the piano's range: _midi, and pitch rounded half to even."""
    rows = frames.filter(voiced(min_confidence)).withColumn("_midi", hz_to_midi(F.col("f0_hz")))
    return rows.filter(F.col("_midi").between(LOW, HIGH)).withColumn("pitch", F.bround("_midi").cast("int"))


def next_onsets(frames: DataFrame, onsets: DataFrame, buffer: float = 0.05, seconds: float | None = None) -> DataFrame:
    """As-of join forward: each frame with next_onset, the first onset over `buffer` seconds on.

    Frames and onsets of a track are put in one order of time, the last first, and each frame
    takes the onset met last: one pass, as what is met only grows.  Of equal times frames come
    before onsets, so that an onset exactly `buffer` on is not taken.  With `seconds`, so much of a
    track is a task, and what finds no onset in it takes the first one of the later ones.
    """
    f = frames.select(F.struct(*frames.columns).alias("_row"), "track_id", (F.col("time") + buffer).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_onset"))
    o = onsets.select(F.lit(None).cast(f.schema["_row"].dataType).alias("_row"), "track_id", F.col("onset_time").alias("_at"), F.lit(0).alias("_kind"), F.col("onset_time").alias("_onset"))
    backwards = F.col("_at").desc(), F.col("_kind").desc()
    if seconds is not None:
        chunks = Chunks(f.union(o), ["track_id"], ["_at"], F.floor(F.col("_at") / seconds))
        firsts = chunks.rows.groupBy(*chunks.by).agg(F.min("_onset").alias("_earliest"))
        later = F.first("_earliest", ignorenulls=True).over(chunks.along.rowsBetween(1, Window.unboundedFollowing))
        rows = joined(chunks.rows, firsts.select(*chunks.by, later.alias("_later")), chunks.by)
        near = F.last("_onset", ignorenulls=True).over(Window.partitionBy(*chunks.by).orderBy(*backwards).rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("next_onset", F.coalesce(near, "_later")).filter("_kind = 1").select("_row.*", "next_onset")
    order = Window.partitionBy("track_id").orderBy(*backwards).rowsBetween(Window.unboundedPreceding, 0)
    rows = f.union(o).withColumn("next_onset", F.last("_onset", ignorenulls=True).over(order))
    return rows.filter("_kind = 1").select("_row.*", "next_onset")


def frame_energy(frames: DataFrame, rms: DataFrame) -> DataFrame:
    """Each frame with the energy of its ordinal, the track's last one beyond the end."""
    last = rms.groupBy("track_id").agg(F.max("frame_idx").alias("_last"))
    at = frames.join(last, "track_id", "left").withColumn("_at", F.least("frame_idx", "_last"))
    e = rms.select(F.col("track_id").alias("_track"), F.col("frame_idx").alias("_idx"), "energy")
    return at.join(e, (F.col("track_id") == F.col("_track")) & (F.col("_at") == F.col("_idx")), "left").drop("_last", "_at", "_track", "_idx")


def raw_notes(frames: DataFrame, onsets: DataFrame, rms: DataFrame | None, min_confidence: float = 0.3, min_duration: float = 0.1, max_duration: float = 4.0, seconds: float | None = None) -> DataFrame:
    """A note for each voiced frame, up to the next onset.

    Durations are at most max_duration, 0.5 where no onset follows (whatever the maximum), and
    then at least min_duration.  Without energies, velocity comes from confidence.
    """
    rows = next_onsets(frame_pitches(frames, min_confidence), onsets, seconds=seconds)
    rows = rows.withColumn("velocity", confidence_velocity(F.col("confidence"))) if rms is None else frame_energy(rows, rms).withColumn("velocity", energy_velocity(F.col("energy")))
    length = F.when(F.col("next_onset").isNull(), F.lit(0.5)).otherwise(F.least(F.col("next_onset") - F.col("time"), F.lit(max_duration)))
    length = F.greatest(length, F.lit(min_duration))
    return rows.select("track_id", "frame_idx", "pitch", F.col("time").alias("start"), (F.col("time") + length).alias("end"), "velocity", "confidence")


_NOTE = ("start", "frame_idx", "end", "velocity", "confidence")


def _survivors(within: float, at: str = "CAST(NULL AS double)", by: str = "CAST(NULL AS double)", i: str = "CAST(NULL AS int)") -> Column:
    """Places of the survivors among _notes, the last one still open; at, by and i are the start,
    confidence and place of one that is open before the first.  Places are gathered in lists of
    up to 256, as adding to a list copies it."""
    state = f"named_struct('full', CAST(array() AS array<array<int>>), 'done', CAST(array() AS array<int>), 'at', {at}, 'by', {by}, 'i', {i})"
    new = "'at', x.start, 'by', x.confidence, 'i', x.i"
    return F.expr(f"""flatten(aggregate(
        transform(_notes, (x, i) -> named_struct('i', i, 'start', x.start, 'confidence', x.confidence)), {state}, (s, x) -> CASE
        WHEN s.i IS NULL THEN named_struct('full', s.full, 'done', s.done, {new})
        WHEN abs(s.at - x.start) >= {within}D AND size(s.done) < 255 THEN named_struct('full', s.full, 'done', array_append(s.done, s.i), {new})
        WHEN abs(s.at - x.start) >= {within}D THEN named_struct('full', array_append(s.full, array_append(s.done, s.i)), 'done', CAST(array() AS array<int>), {new})
        WHEN x.confidence > s.by THEN named_struct('full', s.full, 'done', s.done, {new})
        ELSE s END, s -> array_append(s.full, array_append(s.done, s.i))))""")


def dedupe(notes: DataFrame, within: float = 0.1, seconds: float | None = None) -> DataFrame:
    """Of notes of one pitch that begin within 0.1 s of a survivor, the more confident survives.

    Order matters: a note is held against the last survivor of its pitch only, replaces it if it
    is more confident, and goes if not.  A note that begins 0.1 s or more after the note before
    it is in nobody's way, so that each run of closer ones is a group of its own, folded inside the
    JVM.  With `seconds`, which must be over `within`, so much of a track is a task, however long a run is.
    """
    if seconds is not None:
        return _dedupe_by_chunk(notes, within, seconds)
    order = Window.partitionBy("track_id", "pitch").orderBy("start", "frame_idx")
    far = F.when(F.col("start") - F.lag("start").over(order) < within, 0).otherwise(1)
    rows = notes.withColumn("_far", far).withColumn("_run", F.sum("_far").over(order))
    group = rows.groupBy("track_id", "pitch", "_run").agg(F.array_sort(F.collect_list(F.struct(*_NOTE))).alias("_notes"))
    return _unpacked(group.withColumn("_kept", _survivors(within)))


def _unpacked(group: DataFrame) -> DataFrame:
    kept = group.select("track_id", "pitch", F.explode(F.expr("transform(_kept, i -> _notes[i])")).alias("_n"))
    return kept.select("track_id", "_n.frame_idx", "pitch", "_n.start", "_n.end", "_n.velocity", "_n.confidence")


def _entered(tables: DataFrame) -> DataFrame:
    """Chains of chunks, each with what it may be entered with and is then left with -> for each
    chunk what it is entered with, and whether its last survivor is replaced by the next chunk.

    Chains are folded inside the JVM: a Python worker takes milliseconds for each group, and most
    have a few chunks.  Places are gathered in lists of up to 256, as in _survivors().
    """
    links = tables.groupBy("track_id", "pitch", "_chain").agg(F.array_sort(F.collect_list(F.struct("_chunk", "_ins", "_outs", "_replaced", "_fresh"))).alias("_links"))
    at = "coalesce(CAST(array_position(transform(x._ins, s -> s.frame_idx), a.now) AS int), 0)"  # from 1; 0: none
    now = f"'now', coalesce(get(x._outs, {at} - 1), x._fresh)"
    places = F.expr(f"""flatten(aggregate(_links,
        named_struct('full', CAST(array() AS array<array<int>>), 'done', CAST(array() AS array<int>), 'now', CAST(NULL AS bigint)), (a, x) -> CASE
        WHEN size(a.done) < 255 THEN named_struct('full', a.full, 'done', array_append(a.done, {at}), {now})
        ELSE named_struct('full', array_append(a.full, array_append(a.done, {at})), 'done', CAST(array() AS array<int>), {now}) END,
        a -> array_append(a.full, a.done)))""")
    chunk = """transform(_links, (x, i) -> named_struct('_chunk', x._chunk, '_s', get(x._ins, get(_at, i) - 1),
        '_gone', coalesce(get(get(_links, i + 1)._replaced, get(_at, i + 1) - 1), false)))"""
    return links.withColumn("_at", places).select("track_id", "pitch", F.inline(F.expr(chunk)))


def _dedupe_by_chunk(notes: DataFrame, within: float, seconds: float) -> DataFrame:
    """A chunk can only be entered with a survivor from the last `within` seconds before its first
    note, of which there are few, and mostly none.  Where there are some it is folded for each of
    them, and without any; these tables of what goes in and out are chained, from a chunk that
    nothing enters to the next such, and then each chunk is folded with what does enter it.  Its
    last survivor stays unless the next chunk replaces it.
    """
    if seconds <= within:
        raise ValueError("a chunk must be longer than the time in which notes are duplicates")
    by = ["track_id", "pitch", "_chunk"]
    rows = notes.withColumn("_chunk", F.floor(F.col("start") / seconds).cast("long"))
    groups = stored(rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*_NOTE))).alias("_notes")), "dedupe-chunks")
    along = Window.partitionBy("track_id", "pitch").orderBy("_chunk")
    edges = groups.select(
        *by, F.expr("_notes[0].start").alias("_first"),
        F.expr(f"filter(_notes, x -> element_at(_notes, -1).start - x.start < {2 * within}D)").alias("_tail"))  # of neighbours, more than can enter
    entering = F.expr(f"filter(coalesce(_tail, array()), x -> abs(x.start - _first) < {within}D)")
    edges = edges.withColumn("_tail", F.lag("_tail").over(along)).select(*by, entering.alias("_ins")).withColumn("_open", F.size("_ins") > 0)
    edges = edges.withColumn("_chain", F.count_if(~F.col("_open")).over(along)).withColumn("_next", F.lead("_open", 1, False).over(along))
    linked = joined(edges.filter("_open OR _next").drop("_open", "_next"), groups, by)
    left = lambda s: f"aggregate(_notes, {s}, (a, x) -> CASE WHEN abs(a.start - x.start) >= {within}D OR x.confidence > a.confidence THEN x ELSE a END)"
    first_other = f"filter(_notes, x -> abs(s.start - x.start) >= {within}D OR x.confidence > s.confidence)"
    tables = linked.select(
        *by, "_chain", "_ins", F.expr(f"transform(_ins, s -> {left('s')}.frame_idx)").alias("_outs"),
        F.expr(f"transform(_ins, s -> coalesce(abs(s.start - get({first_other}, 0).start) < {within}D, false))").alias("_replaced"), F.expr(f"{left('_notes[0]')}.frame_idx").alias("_fresh"))
    groups = joined(groups, _entered(tables), by)
    groups = groups.withColumn("_all", _survivors(within, "_s.start", "_s.confidence", "IF(_s IS NULL, CAST(NULL AS int), -1)"))
    left_over = F.when(F.col("_gone"), F.expr("slice(_all, 1, size(_all) - 1)")).otherwise(F.col("_all"))
    return _unpacked(groups.withColumn("_kept", F.filter(left_over, lambda i: i >= 0)))


def merge(notes: DataFrame, gap: float = 0.1, seconds: float | None = None) -> DataFrame:
    """Notes that follow each other at one pitch without a gap of 0.1 s become one: the first's
    start and confidence, the latest end, the highest velocity.  Another pitch between them, in
    the track's order of starts, keeps them apart.  With `seconds`, so much of a track is a task."""
    if seconds is not None:
        return _merge_by_chunk(notes, gap, seconds)
    order = Window.partitionBy("track_id").orderBy("start", "frame_idx")
    rows = notes.withColumn("_change", F.when(F.lag("pitch").over(order) == F.col("pitch"), 0).otherwise(1))
    rows = rows.withColumn("_same", F.sum("_change").over(order))
    before = Window.partitionBy("track_id", "_same").orderBy("start", "frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end").over(before)
    rows = rows.withColumn("_new", F.when(F.col("start") - reach < gap, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    first = F.struct("start", "frame_idx")
    return rows.groupBy("track_id", "_run").agg(
        F.min("frame_idx").alias("frame_idx"), F.first("pitch").alias("pitch"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.max("velocity").alias("velocity"), F.min_by("confidence", first).alias("confidence")).drop("_run")


def _merge_by_chunk(notes: DataFrame, gap: float, seconds: float) -> DataFrame:
    """What a chunk's first notes may go on from is the latest end of the notes of their pitch before
    it, back to where the pitch last changed: a running maximum over the chunks since then."""
    chunks = Chunks(notes, ["track_id"], ["start", "frame_idx"], F.floor(F.col("start") / seconds))
    rows = chunks.with_neighbours(["pitch"])
    rows = rows.withColumn("_same", F.sum(F.when(F.col("_prev.pitch") == F.col("pitch"), 0).otherwise(1)).over(chunks.own))
    last = rows.groupBy(*chunks.by, "_same").agg(F.max("end").alias("_end")).groupBy(*chunks.by).agg(F.max("_same").alias("_changes"), F.max_by("_end", "_same").alias("_end"))
    last = stored(last, "merge-chunks").withColumn("_since", F.sum(F.when(F.col("_changes") > 0, 1).otherwise(0)).over(chunks.along))
    last = last.withColumn("_reach", F.max("_end").over(Window.partitionBy("track_id", "_since").orderBy("_chunk")))
    rows = joined(rows, last.select(*chunks.by, F.lag("_reach").over(chunks.along).alias("_open")), chunks.by)
    before = Window.partitionBy(*chunks.by, "_same").orderBy("start", "frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.max("end").over(before), F.when(F.col("_same") == 0, F.col("_open")))
    parts = {
        "frame_idx": F.min("frame_idx"), "pitch": F.min("pitch"), "first": F.min(F.struct("start", "frame_idx", "confidence")),
        "end": F.max("end"), "velocity": F.max("velocity")}
    whole = lambda c: {n: (F.max if n in ("end", "velocity") else F.min)(c[n]) for n in parts}
    runs = chunks.runs(rows.withColumn("_new", ~F.coalesce(F.col("start") - reach < gap, F.lit(False))), F.col("_new"), parts, whole)
    return runs.select("track_id", "frame_idx", "pitch", "first.start", "end", "velocity", "first.confidence")


def clean(notes: DataFrame, seconds: float | None = None) -> DataFrame:
    return merge(dedupe(notes, seconds=seconds), seconds=seconds)


def onset_durations(onsets: DataFrame, lengths: DataFrame) -> DataFrame:
    """Onsets with the time to the next one, to the end of the audio for the last.

    lengths: (track_id, audio_length) in seconds.
    """
    order = Window.partitionBy("track_id").orderBy("onset_time")
    rows = onsets.withColumn("_next", F.lead("onset_time").over(order)).join(lengths, "track_id")
    return rows.select("track_id", "onset_time", (F.coalesce("_next", "audio_length") - F.col("onset_time")).alias("duration"))


def onset_notes(onsets: DataFrame, frames: DataFrame, lengths: DataFrame, sample_rate: int = 22050, hop: int = 512) -> DataFrame:
    """A note for each onset whose frame is voiced: start, duration, fractional midi_note, frequency."""
    rows = onset_durations(onsets, lengths).withColumn("frame_idx", F.floor(F.col("onset_time") * sample_rate / hop).cast("long"))
    f = frames.filter(~F.isnan("f0_hz")).select("track_id", "frame_idx", "f0_hz")
    return rows.join(f, ["track_id", "frame_idx"]).select(
        "track_id", F.col("onset_time").alias("start"), "duration", hz_to_midi(F.col("f0_hz")).alias("midi_note"), F.col("f0_hz").alias("frequency"))


def voiced_ratio(frames: DataFrame) -> DataFrame:
    """Voiced frames of each track in percent, and its range of confidence."""
    return frames.groupBy("track_id").agg(
        F.count("*").alias("frames"), (F.count_if(~F.isnan("f0_hz")) / F.count("*") * 100).alias("voiced_percent"),
        F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"))
