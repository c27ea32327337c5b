"""A query for each operator, on notes made of events and frames made of orders, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.music import KEY_TEMPLATES, energy_velocity, format_time, label_of_mask, pattern_rows
from cadenza.operators import chords, events, keys, transcribe, windows
from cadenza.operators import notes as note_ops
from cadenza.plans.analysis import analyze
from cadenza.sources import fixtures
from cadenza.sources.fixtures import PITCHES

WS = 0.625

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = f"WITH RECURSIVE {sql}" if sql.lstrip().startswith(("notes AS", "fr AS")) else sql
        return f

    return add


NOTES = f"""notes AS (
  SELECT recording_id, note_id, st / 1024.0::DOUBLE AS s, (st + 20 + c // 10) / 1024.0::DOUBLE AS e,
         {PITCHES}[k % 20 + 1]::INT AS pitch, (30 + c % 98)::INT AS velocity
  FROM (SELECT user_id AS recording_id, event_id AS note_id, (epoch_us(ts) - 1704067200000000) // 64000000 AS st,
               round(value * 100)::BIGINT AS c, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events))"""
NAMES = "['C','C♯','D','D♯','E','F','F♯','G','G♯','A','A♯','B']"
CLASSES = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"
MUSICAL = NOTES + """, musical AS (SELECT * FROM notes WHERE velocity >= 45 AND NOT (e - s < 0.1::DOUBLE))"""
LUT = ", lut AS (SELECT * FROM (VALUES " + ", ".join(f"({m}, '{label_of_mask(m)}')" for m in range(4096)) + ") t(mask, label))"


def windows_sql(ws: str = f"{WS}::DOUBLE", sizes: str = "") -> str:
    """placed: notes by window; win: one row for each window; act: those that are musical."""
    join = "JOIN sizes USING (recording_id)" if sizes else ""
    return MUSICAL + sizes + f""", tot AS (SELECT recording_id, max(e) AS total FROM musical GROUP BY recording_id),
  grid AS (SELECT recording_id, total, {ws} AS ws, unnest(range(0, ceil(total / {ws})::BIGINT)) AS window_idx FROM tot {join}),
  bounds AS (SELECT recording_id, window_idx, window_idx * ws AS w_start, least((window_idx + 1) * ws, total) AS w_end FROM grid),
  placed AS (SELECT n.*, window_idx, w_start, w_end FROM musical n JOIN bounds b ON n.recording_id = b.recording_id AND n.s < b.w_end AND n.e > b.w_start),
  win AS (SELECT recording_id, window_idx, min(w_start) AS s, min(w_end) AS e, count(*)::BIGINT AS note_count, sum(velocity)::BIGINT AS velocity_sum,
            list_sort(list(DISTINCT pitch)) AS pitches, bit_or(1 << (pitch % 12))::INT AS mask FROM placed GROUP BY recording_id, window_idx),
  act AS (SELECT * FROM win WHERE note_count >= 2 AND velocity_sum >= 120 AND len(pitches) >= 2 AND list_max(pitches) - list_min(pitches) <= 60)"""


def segments_sql(ws: str = f"{WS}::DOUBLE", sizes: str = "") -> str:
    return windows_sql(ws, sizes) + LUT + """,
  lab AS (SELECT a.*, label FROM act a JOIN lut USING (mask)),
  nb AS (SELECT *, lag(label) OVER o AS prev, lead(label) OVER o AS nxt,
           bit_or(mask) OVER (o ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS rmask,
           len(list_distinct(flatten([coalesce(lag(pitches) OVER o, []), pitches, coalesce(lead(pitches) OVER o, [])]))) AS rsize
         FROM lab WINDOW o AS (PARTITION BY recording_id ORDER BY window_idx)),
  ctx AS (SELECT nb.*, l.label AS rlabel, coalesce(prev, '') AS p, coalesce(nxt, '') AS n FROM nb JOIN lut l ON l.mask = nb.rmask),
  seg AS (SELECT *, CASE
      WHEN mask & 2064 = 2064 AND mask & 256 = 0 THEN 'Esus2'
      WHEN mask & 578 = 578 AND (p IN ('Esus2', 'E') OR n IN ('Esus2', 'E')) THEN 'F#m7'
      WHEN mask & 2576 = 2576 AND mask & 2 = 0 THEN 'Asus2'
      WHEN mask & 2320 = 2320 THEN 'E'
      WHEN label = 'C' AND (p IN ('Am', 'Am7') OR n IN ('Am', 'Am7')) AND (rmask & 512 = 512 OR p IN ('Am', 'Am7') AND n IN ('Am', 'Am7')) THEN 'Am7'
      WHEN rsize > len(pitches) AND contains(rlabel, '7') AND NOT contains(label, '7') THEN rlabel
      ELSE label END AS chord FROM ctx)"""


def time_sql(x: str) -> str:
    return f"lpad(floor({x} / 60)::BIGINT::VARCHAR, greatest(2, length(floor({x} / 60)::BIGINT::VARCHAR))::INT, '0') || ':' || lpad((floor({x})::BIGINT % 60)::VARCHAR, 2, '0')"


def events_sql(ws: str = f"{WS}::DOUBLE", sizes: str = "") -> str:
    return segments_sql(ws, sizes) + """,
  flags AS (SELECT *, CASE WHEN lag(chord) OVER o = chord AND lag(note_count) OVER o >= 2 AND lag(chord) OVER o <> 'Silence' AND s - lag(e) OVER o <= 1.0 THEN 0 ELSE 1 END AS brk
            FROM seg WINDOW o AS (PARTITION BY recording_id ORDER BY window_idx)),
  runs AS (SELECT *, sum(brk) OVER (PARTITION BY recording_id ORDER BY window_idx) AS run FROM flags),
  isl AS (SELECT recording_id, min(window_idx) AS first_idx, min(s) AS s, max_by(e, window_idx) AS e, min(chord) AS chord, sum(note_count)::BIGINT AS total_notes
          FROM runs WHERE chord <> 'Silence' AND note_count >= 2 GROUP BY recording_id, run),
  mrg AS (SELECT *, CASE WHEN lag(chord) OVER o = chord AND e - s < 0.8::DOUBLE AND s - lag(e) OVER o < 1.5 THEN 0 ELSE 1 END AS brk
          FROM isl WINDOW o AS (PARTITION BY recording_id ORDER BY first_idx)),
  num AS (SELECT *, sum(brk) OVER (PARTITION BY recording_id ORDER BY first_idx) AS ev FROM mrg),
  ev0 AS (SELECT recording_id, ev, min(s) AS s, max_by(e, first_idx) AS e, min(chord) AS chord, sum(total_notes)::BIGINT AS total_notes FROM num GROUP BY recording_id, ev),
  evs AS (SELECT *, row_number() OVER (PARTITION BY recording_id, chord ORDER BY ev) AS play_number, e - s AS duration FROM ev0)"""


KEYS = ", tpl AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{c}')" for i, (k, cs) in enumerate(KEY_TEMPLATES) for c in cs.split()) + ") t(key_order, key, chord))"
SCORES = KEYS + """, cnt AS (SELECT recording_id, chord, count(*) AS n, min(s) AS first FROM evs GROUP BY recording_id, chord),
  scr AS (SELECT recording_id, key, key_order, sum(n * n)::BIGINT AS score FROM cnt JOIN tpl USING (chord) GROUP BY ALL)"""
CHORD_KEY = SCORES + """,
  best AS (SELECT recording_id, key FROM scr QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY score DESC, key_order) = 1),
  common AS (SELECT recording_id, chord FROM cnt QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY n DESC, first) = 1),
  ckey AS (SELECT c.recording_id, coalesce(b.key, CASE WHEN c.chord LIKE '%m' THEN c.chord[:-2] || ' minor' ELSE 'Unknown' END) AS key
           FROM common c LEFT JOIN best b USING (recording_id))"""
NOTE_KEY = f""", pcs AS (SELECT recording_id, {CLASSES}[pitch % 12 + 1] AS pc, count(*) AS n, min(struct_pack(s, note_id)) AS first FROM notes GROUP BY ALL),
  top AS (SELECT recording_id, pc FROM pcs QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY n DESC, first) = 1),
  has AS (SELECT recording_id, list(pc) AS all_pc, max(CASE WHEN pc = 'C' THEN n ELSE 0 END) AS c, max(CASE WHEN pc = 'C#' THEN n ELSE 0 END) AS cs FROM pcs GROUP BY recording_id),
  nkey AS (SELECT recording_id, CASE
      WHEN pc = 'A' AND list_has_all(all_pc, ['C', 'E']) THEN CASE WHEN c > cs THEN 'A minor' ELSE 'A major' END
      WHEN pc = 'E' AND NOT list_has_all(all_pc, ['G#', 'B']) AND list_has_all(all_pc, ['G', 'B']) THEN 'E minor'
      ELSE pc || ' major' END AS key FROM top JOIN has USING (recording_id))"""

SIZES = """,
  stk AS (SELECT * FROM (SELECT *, lag(s) OVER (PARTITION BY recording_id ORDER BY s, note_id) AS before FROM notes) WHERE before IS NULL OR s - before > 0.3::DOUBLE),
  auto AS (SELECT recording_id, count(*)::BIGINT AS strikes, CASE WHEN count(*) > 1 THEN (max(s) - min(s)) / (count(*) - 1) END AS gap FROM stk GROUP BY recording_id),
  sizes AS (SELECT *, CASE WHEN gap IS NULL THEN 2.0::DOUBLE ELSE greatest(0.5::DOUBLE, least(3.0::DOUBLE, gap * 0.8::DOUBLE)) END AS window_size FROM auto)"""

FRAMES = """fr AS (
  SELECT o_orderkey // 300 AS track_id, o_orderkey % 300 AS frame_idx, (o_orderkey % 300) * 512 / 22050.0::DOUBLE AS time, o_orderpriority AS prio,
         CASE WHEN o_custkey % 17 = 0 THEN 'nan'::DOUBLE ELSE 440.0::DOUBLE * pow(2.0::DOUBLE, ((48 + ((o_orderkey % 300) // 6 * 7 + o_orderkey // 300) % 24
           + CASE WHEN o_custkey % 10 = 0 THEN 12 WHEN o_custkey % 29 = 0 THEN -40 ELSE 0 END) + (o_custkey % 5 - 2) / 8.0::DOUBLE - 69) / 12) END AS f0,
         (round(o_totalprice * 100)::BIGINT % 11) / 10.0::DOUBLE AS confidence, (round(o_totalprice * 100)::BIGINT % 500) / 1024.0::DOUBLE AS energy FROM orders),
  ons AS (SELECT track_id, time AS onset FROM fr WHERE prio LIKE '1-%'),
  val AS (SELECT *, 12 * (log2(f0) - log2(440.0::DOUBLE)) + 69 AS midi FROM fr WHERE confidence >= 0.3::DOUBLE AND NOT isnan(f0) AND f0 > 0),
  pit AS (SELECT *, round_even(midi, 0)::INT AS pitch FROM val WHERE midi BETWEEN 21 AND 108),
  nxt AS (SELECT p.*, (SELECT min(onset) FROM ons o WHERE o.track_id = p.track_id AND o.onset > p.time + 0.05::DOUBLE) AS next_onset FROM pit p),
  raw AS (SELECT track_id, frame_idx, pitch, time AS s, time + greatest(CASE WHEN next_onset IS NULL THEN 0.5::DOUBLE ELSE least(next_onset - time, 4.0::DOUBLE) END, 0.1::DOUBLE) AS e,
            trunc(least(greatest(energy * 127 * 2, 30.0::DOUBLE), 127.0::DOUBLE))::INT AS velocity, confidence FROM nxt)"""
#: The fold of duplicates, one note after another of each track and pitch: last survivor's start
#: and confidence go along, and a survivor is final when the next one doesn't replace it.
DEDUPE = FRAMES + """,
  ord AS (SELECT *, row_number() OVER (PARTITION BY track_id, pitch ORDER BY s, frame_idx) AS i FROM raw),
  fold AS (
    SELECT track_id, pitch, i, s AS ls, confidence AS lc, i AS li FROM ord WHERE i = 1
    UNION ALL
    SELECT o.track_id, o.pitch, o.i, CASE WHEN abs(f.ls - o.s) >= 0.1::DOUBLE OR o.confidence > f.lc THEN o.s ELSE f.ls END,
           CASE WHEN abs(f.ls - o.s) >= 0.1::DOUBLE OR o.confidence > f.lc THEN o.confidence ELSE f.lc END,
           CASE WHEN abs(f.ls - o.s) >= 0.1::DOUBLE OR o.confidence > f.lc THEN o.i ELSE f.li END
    FROM fold f JOIN ord o ON o.track_id = f.track_id AND o.pitch = f.pitch AND o.i = f.i + 1),
  surv AS (SELECT f.track_id, f.pitch, f.li, lead(f.li) OVER w AS nli, f.ls, lead(f.ls) OVER w AS nls FROM fold f WINDOW w AS (PARTITION BY f.track_id, f.pitch ORDER BY f.i)),
  ded AS (SELECT o.* FROM surv v JOIN ord o ON o.track_id = v.track_id AND o.pitch = v.pitch AND o.i = v.li
          WHERE v.nli IS NULL OR v.nli <> v.li AND v.nls - v.ls >= 0.1::DOUBLE)"""
MERGE = """,
  ch AS (SELECT *, CASE WHEN lag(pitch) OVER o = pitch THEN 0 ELSE 1 END AS chg FROM {t} WINDOW o AS (PARTITION BY track_id ORDER BY s, frame_idx)),
  sm AS (SELECT *, sum(chg) OVER (PARTITION BY track_id ORDER BY s, frame_idx) AS same FROM ch),
  rc AS (SELECT *, max(e) OVER (PARTITION BY track_id, same ORDER BY s, frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sm),
  rn AS (SELECT *, sum(CASE WHEN s - reach < 0.1::DOUBLE THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY s, frame_idx) AS run FROM rc),
  mrg AS (SELECT track_id, min(frame_idx) AS frame_idx, min(pitch) AS pitch, min(s) AS s, max(e) AS e, max(velocity) AS velocity, min_by(confidence, frame_idx) AS confidence
          FROM rn GROUP BY track_id, run)"""
NOTE_COLUMNS = 'track_id, frame_idx, pitch, s AS start, e AS "end", velocity, confidence'


@query(MUSICAL + ' SELECT recording_id, note_id, s AS start, e AS "end", pitch, velocity FROM musical')
def filter_musical_notes(spark, sf):
    return note_ops.filter_musical(fixtures.notes(spark, sf))


@query(NOTES + " SELECT recording_id, count_if(velocity >= 45 AND NOT (e - s < 0.1::DOUBLE))::BIGINT AS kept, count_if(velocity < 45 OR e - s < 0.1::DOUBLE)::BIGINT AS dropped FROM notes GROUP BY recording_id")
def filtered_counts(spark, sf):
    return note_ops.filter_counts(fixtures.notes(spark, sf))


@query(NOTES + f" SELECT note_id, pitch, {NAMES}[pitch % 12 + 1] || (pitch // 12 - 1)::VARCHAR AS note_name, {CLASSES}[pitch % 12 + 1] AS pitch_class FROM notes")
def note_names(spark, sf):
    return note_ops.named(fixtures.notes(spark, sf)).select("note_id", "pitch", "note_name", "pitch_class")


@query(NOTES + f" SELECT note_id, {time_sql('s')} AS start_label, {time_sql('e * 100')} AS late_label FROM notes")
def time_labels(spark, sf):
    return fixtures.notes(spark, sf).select("note_id", format_time(F.col("start")).alias("start_label"), format_time(F.col("end") * 100).alias("late_label"))


@query(NOTES + """ SELECT *, CASE WHEN note_density > 1.0 THEN 'High' WHEN note_density > 0.5 THEN 'Moderate' ELSE 'Low' END AS density_class FROM (
  SELECT recording_id, count(*)::BIGINT AS total_notes, max(e) AS duration, CASE WHEN max(e) > 0 THEN round(count(*) / max(e), 6) ELSE 0 END AS note_density,
    round(sum(e - s) / count(*), 6) AS avg_note_duration, min(pitch) AS min_pitch, max(pitch) AS max_pitch, max(pitch) - min(pitch) AS pitch_span FROM notes GROUP BY recording_id)""")
def note_stats(spark, sf):
    return note_ops.note_stats(fixtures.notes(spark, sf)).withColumns({c: F.round(c, 6) for c in ("note_density", "avg_note_duration")})


@query(NOTES + """ SELECT recording_id, pitch, notes, rank FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY notes DESC, first)::INT AS rank
  FROM (SELECT recording_id, pitch, count(*)::BIGINT AS notes, min(struct_pack(s, note_id)) AS first FROM notes GROUP BY ALL)) WHERE rank <= 5""")
def pitch_top5(spark, sf):
    return note_ops.pitch_top(fixtures.notes(spark, sf))


@query(NOTES + """ SELECT recording_id, note_id, pitch, position FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY s, note_id)::INT AS position FROM notes) WHERE position <= 10""")
def first_notes(spark, sf):
    return note_ops.first_notes(fixtures.notes(spark, sf)).select("recording_id", "note_id", "pitch", "position")


@query(NOTES + """ SELECT recording_id, count_if(pitch % 12 IN (7, 8))::BIGINT AS g_notes, count_if(pitch % 12 IN (0, 1))::BIGINT AS c_notes, count_if(pitch % 12 IN (2, 3))::BIGINT AS d_notes,
  count_if(pitch % 12 IN (7, 8)) > 0 AND count_if(pitch % 12 IN (2, 3)) > 0 AS progression FROM notes GROUP BY recording_id""")
def prefix_counts(spark, sf):
    return note_ops.prefix_counts(fixtures.notes(spark, sf))


@query(NOTES + " SELECT recording_id, pitch, least(count(*), 10)::BIGINT AS weight FROM notes GROUP BY recording_id, pitch")
def pitch_histogram_capped(spark, sf):
    return note_ops.capped_pitch_histogram(fixtures.notes(spark, sf)).withColumn("weight", F.col("weight").cast("long"))


@query(NOTES + SIZES + " SELECT recording_id, note_id, s AS start FROM stk")
def strike_onsets(spark, sf):
    return note_ops.strikes(fixtures.notes(spark, sf)).select("recording_id", "note_id", "start")


@query(NOTES + SIZES + """ SELECT recording_id, strikes, round(gap, 6) AS avg_gap, round(window_size, 6) AS window_size,
  CASE WHEN gap IS NULL THEN 'single' WHEN window_size < 1.0 THEN 'fast' WHEN window_size > 2.0 THEN 'slow' ELSE 'medium' END AS pace FROM sizes""")
def auto_window(spark, sf):
    return note_ops.auto_window(fixtures.notes(spark, sf)).withColumns({c: F.round(c, 6) for c in ("avg_gap", "window_size")})


@query(windows_sql() + " SELECT recording_id, window_idx, note_id, w_start, w_end FROM placed")
def window_notes(spark, sf):
    return windows.window_notes(fixtures.notes(spark, sf), WS).select("recording_id", "window_idx", "note_id", "w_start", "w_end")


@query(windows_sql() + ' SELECT recording_id, window_idx, s AS start, e AS "end", note_count, velocity_sum, len(pitches)::INT AS n_pitches, mask FROM act')
def window_activity(spark, sf):
    return windows.active_windows(fixtures.notes(spark, sf), WS).withColumn("n_pitches", F.size("pitches")).drop("pitches")


@query(windows_sql() + f""" SELECT recording_id, window_idx, array_to_string(list_sort(list_distinct([{NAMES}[p % 12 + 1] || (p // 12 - 1)::VARCHAR for p in pitches])), ', ') AS note_names,
  array_to_string(pitches, ',') AS pitch_list, array_to_string(list_sort(list_distinct([{CLASSES}[p % 12 + 1] for p in pitches])), ',') AS classes,
  CASE WHEN mask & 2128 = 2128 THEN 'sus2 detected' WHEN mask & 2064 = 2064 THEN 'missing F#' ELSE '' END AS remark FROM act""")
def window_pitch_sets(spark, sf):
    return windows.pitch_sets(windows.active_windows(fixtures.notes(spark, sf), WS))


# Repeated addition, one step after another; the sizes are no sums of a few powers of two.
def exact_windows_sql(ws: str) -> str:
    return MUSICAL + f""", tot AS (SELECT recording_id, max(e) AS total FROM musical GROUP BY recording_id),
  stp(i, w) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION ALL SELECT i + 1, w + {ws}::DOUBLE FROM stp WHERE w < (SELECT max(total) FROM tot)),
  bounds AS (SELECT recording_id, i AS window_idx, w AS w_start, least(w + {ws}::DOUBLE, total) AS w_end FROM stp JOIN tot ON w < total)"""


@query(exact_windows_sql("0.1") + " SELECT recording_id, window_idx, w_start, w_end FROM bounds")
def window_starts_exact(spark, sf):
    return windows.window_starts(windows.window_ends(note_ops.filter_musical(fixtures.notes(spark, sf)), 0.1))


@query(exact_windows_sql("0.7") + """ SELECT recording_id, window_idx, note_id, w_start, w_end
  FROM musical JOIN bounds USING (recording_id) WHERE s < w_end AND e > w_start""")
def window_notes_exact(spark, sf):
    return windows.window_notes(fixtures.notes(spark, sf), 0.7, exact=True).select("recording_id", "window_idx", "note_id", "w_start", "w_end")


PAT = ", pat AS (SELECT * FROM (VALUES " + ", ".join(f"({p}, {m}, {z}, '{n}')" for p, m, z, n in pattern_rows()) + ") t(priority, pattern, size, name))"


@query(windows_sql() + PAT + " SELECT recording_id, window_idx, name AS chord FROM act JOIN pat ON mask = pattern")
def chord_exact(spark, sf):
    return chords.exact_chords(windows.active_windows(fixtures.notes(spark, sf), WS))


@query(windows_sql() + PAT + " SELECT recording_id, window_idx, name AS chord FROM act JOIN pat ON mask & pattern = pattern QUALIFY row_number() OVER (PARTITION BY recording_id, window_idx ORDER BY size DESC, priority) = 1")
def chord_subset_topk(spark, sf):
    return chords.contained_chord(windows.active_windows(fixtures.notes(spark, sf), WS))


@query(windows_sql() + PAT + f""", own AS (SELECT *, list_sort([c for c in list_distinct([{CLASSES}[p % 12 + 1] for p in pitches])]) AS pcs FROM act),
  inside AS (SELECT recording_id, window_idx, name FROM act JOIN pat ON mask & pattern = pattern QUALIFY row_number() OVER (PARTITION BY recording_id, window_idx ORDER BY (mask = pattern)::INT DESC, size DESC, priority) = 1)
  SELECT o.recording_id, o.window_idx, CASE WHEN len(pcs) = 1 THEN pcs[1] ELSE coalesce(name, list_filter(['E','F#','A','B','C','D','G','F'], lambda r: list_contains(pcs, r))[1], pcs[1]) END AS label
  FROM own o LEFT JOIN inside i ON o.recording_id = i.recording_id AND o.window_idx = i.window_idx""")
def chord_label(spark, sf):
    return chords.label(windows.active_windows(fixtures.notes(spark, sf), WS)).select("recording_id", "window_idx", "label")


@query(segments_sql() + " SELECT recording_id, window_idx, label, prev, nxt AS next, rmask AS region_mask, rsize::INT AS region_pitches FROM nb")
def chord_neighbors(spark, sf):
    out = chords.neighbours(chords.label(windows.active_windows(fixtures.notes(spark, sf), WS)))
    return out.select("recording_id", "window_idx", "label", "prev", "next", "region_mask", F.size("region").alias("region_pitches"))


@query(segments_sql() + " SELECT recording_id, window_idx, label, rlabel AS region_label, chord FROM seg")
def chord_context(spark, sf):
    near = chords.neighbours(chords.label(windows.active_windows(fixtures.notes(spark, sf), WS)))
    return chords.in_context(near).select("recording_id", "window_idx", "label", "region_label", "chord")


@query(segments_sql() + f""" SELECT recording_id, window_idx, s AS start, e AS "end", chord, note_count, len(pitches)::BIGINT AS unique_pitches,
  '[' || {time_sql('s')} || ' - ' || {time_sql('e')} || ']' AS time_range FROM seg""")
def segments(spark, sf):
    return chords.segments(windows.active_windows(fixtures.notes(spark, sf), WS))


@query(segments_sql("window_size", SIZES) + ' SELECT recording_id, window_idx, round(s, 6) AS start, round(e, 6) AS "end", chord, note_count FROM seg')
def segments_auto(spark, sf):
    out = analyze(fixtures.notes(spark, sf)).segments
    return out.select("recording_id", "window_idx", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "chord", "note_count")


@query(events_sql() + ' SELECT recording_id, s AS start, e AS "end", chord, total_notes, first_idx, e - s AS duration FROM isl')
def event_islands(spark, sf):
    return events.islands(analyze(fixtures.notes(spark, sf), WS).segments)


@query(events_sql() + ' SELECT recording_id, s AS start, e AS "end", chord, play_number::BIGINT AS play_number, duration, total_notes FROM evs')
def chord_events(spark, sf):
    return analyze(fixtures.notes(spark, sf), WS).events


@query(events_sql() + """ SELECT recording_id, chord, plays, first_start, row_number() OVER (PARTITION BY recording_id ORDER BY first_start)::INT AS position,
  plays::VARCHAR || CASE WHEN plays > 1 THEN ' times' ELSE ' time' END AS played FROM (SELECT recording_id, chord, count(*)::BIGINT AS plays, min(s) AS first_start FROM evs GROUP BY ALL)""")
def chord_counts(spark, sf):
    return analyze(fixtures.notes(spark, sf), WS).counts


@query(events_sql() + " SELECT recording_id, chord, count(*)::BIGINT AS plays, sum(duration) AS total_duration FROM evs GROUP BY recording_id, chord")
def chord_rollup(spark, sf):
    return events.chord_rollup(analyze(fixtures.notes(spark, sf), WS).events)


@query(events_sql() + SCORES + " SELECT recording_id, key, key_order, score FROM scr")
def key_scores(spark, sf):
    return keys.key_scores(analyze(fixtures.notes(spark, sf), WS).events)


@query(events_sql() + CHORD_KEY + " SELECT recording_id, key FROM ckey")
def key_from_chords(spark, sf):
    return keys.key_from_chords(analyze(fixtures.notes(spark, sf), WS).events)


@query(NOTES + NOTE_KEY + " SELECT recording_id, key FROM nkey")
def key_from_notes(spark, sf):
    return keys.key_from_notes(fixtures.notes(spark, sf))


@query(NOTES + """, w AS (SELECT recording_id, pitch % 12 AS pc, least(count(*), 10) AS n FROM notes GROUP BY recording_id, pitch),
  h AS (SELECT recording_id, pc, sum(n)::BIGINT AS x FROM w GROUP BY ALL),
  profile AS (SELECT 0 AS mode, unnest([6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]) AS y, unnest(range(12)) AS step
    UNION ALL SELECT 1, unnest([6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]), unnest(range(12))),
  k AS (SELECT mode * 12 + t AS key_order, (step + t) % 12 AS pc, round(y * 100)::BIGINT AS y,
          ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][t + 1] || CASE WHEN mode = 0 THEN ' major' ELSE ' minor' END AS key FROM profile, range(12) r(t)),
  g AS (SELECT r.recording_id, k.key, k.key_order, k.y, coalesce(h.x, 0) AS x FROM (SELECT DISTINCT recording_id FROM h) r CROSS JOIN k LEFT JOIN h ON h.recording_id = r.recording_id AND h.pc = k.pc),
  c AS (SELECT recording_id, key, key_order, (12 * sum(x * y) - sum(x) * sum(y))::DOUBLE AS up,
          (12 * sum(x * x) - sum(x) * sum(x))::DOUBLE * (12 * sum(y * y) - sum(y) * sum(y))::DOUBLE AS spread FROM g GROUP BY ALL),
  best AS (SELECT *, CASE WHEN spread > 0 THEN up / sqrt(spread) END AS r FROM c QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY r DESC NULLS LAST, key_order) = 1)
  SELECT recording_id, CASE WHEN r IS NULL THEN 'Unknown' ELSE key END AS key, round(r, 6) AS correlation FROM best""")
def key_by_profile(spark, sf):
    return keys.key_by_profile(fixtures.notes(spark, sf)).withColumn("correlation", F.round("correlation", 6))


@query(events_sql() + CHORD_KEY + NOTE_KEY + " SELECT n.recording_id, coalesce(nullif(c.key, 'Unknown'), n.key) AS key FROM nkey n LEFT JOIN ckey c USING (recording_id)")
def key_signature(spark, sf):
    return analyze(fixtures.notes(spark, sf), WS).key


@query(events_sql() + """, sg AS (SELECT recording_id, count(*)::BIGINT AS total_chords, count(DISTINCT chord)::BIGINT AS unique_chords, max_by(e, window_idx) AS audio_duration FROM seg GROUP BY recording_id)
  SELECT sg.*, (SELECT count(*) FROM evs v WHERE v.recording_id = sg.recording_id)::BIGINT AS chord_events FROM sg""")
def result_stats(spark, sf):
    return analyze(fixtures.notes(spark, sf), WS).stats


@query(FRAMES + " SELECT track_id, frame_idx, pitch, round(midi, 6) AS midi FROM pit")
def frame_filter(spark, sf):
    return transcribe.frame_pitches(fixtures.frames(spark, sf)).select("track_id", "frame_idx", "pitch", F.round("_midi", 6).alias("midi"))


@query(FRAMES + " SELECT track_id, frame_idx, next_onset FROM nxt")
def next_onset(spark, sf):
    pitches = transcribe.frame_pitches(fixtures.frames(spark, sf))
    return transcribe.next_onsets(pitches, fixtures.onsets(spark, sf)).select("track_id", "frame_idx", "next_onset")


@query(FRAMES + " SELECT track_id, frame_idx, energy, trunc(least(greatest(energy * 127 * 2, 30.0::DOUBLE), 127.0::DOUBLE))::INT AS velocity FROM fr")
def frame_velocity(spark, sf):
    rows = transcribe.frame_energy(fixtures.frames(spark, sf), fixtures.rms(spark, sf))
    return rows.select("track_id", "frame_idx", "energy", energy_velocity(F.col("energy")).alias("velocity"))


@query(FRAMES + f" SELECT {NOTE_COLUMNS} FROM raw")
def raw_notes(spark, sf):
    return transcribe.raw_notes(fixtures.frames(spark, sf), fixtures.onsets(spark, sf), fixtures.rms(spark, sf))


@query(DEDUPE + f" SELECT {NOTE_COLUMNS} FROM ded")
def dedupe_notes(spark, sf):
    return transcribe.dedupe(raw_notes(spark, sf))


@query(FRAMES + MERGE.format(t="raw") + f" SELECT {NOTE_COLUMNS} FROM mrg")
def merge_notes(spark, sf):
    return transcribe.merge(raw_notes(spark, sf))


@query(DEDUPE + MERGE.format(t="ded") + f" SELECT {NOTE_COLUMNS} FROM mrg")
def clean_notes(spark, sf):
    return transcribe.clean(raw_notes(spark, sf))


# The same rows by chunk and stitch: chunks far shorter than a job would take, so that recordings have several.
CHUNK, SECONDS = 5, 0.5


def _segments_by_chunk(spark, sf):
    return chords.segments(windows.active_windows(fixtures.notes(spark, sf), WS), CHUNK)


@query(_SQL["segments"])
def segments_by_chunk(spark, sf):
    return _segments_by_chunk(spark, sf)


@query(_SQL["event_islands"])
def event_islands_by_chunk(spark, sf):
    return events.islands(_segments_by_chunk(spark, sf), CHUNK)


@query(_SQL["chord_events"])
def chord_events_by_chunk(spark, sf):
    return analyze(fixtures.notes(spark, sf), WS, CHUNK).events


@query(_SQL["strike_onsets"])
def strike_onsets_by_chunk(spark, sf):
    return note_ops.strikes(fixtures.notes(spark, sf), seconds=CHUNK).select("recording_id", "note_id", "start")


@query(_SQL["next_onset"])
def next_onset_by_chunk(spark, sf):
    pitches = transcribe.frame_pitches(fixtures.frames(spark, sf))
    return transcribe.next_onsets(pitches, fixtures.onsets(spark, sf), seconds=SECONDS).select("track_id", "frame_idx", "next_onset")


@query(_SQL["dedupe_notes"])
def dedupe_notes_by_chunk(spark, sf):
    return transcribe.dedupe(raw_notes(spark, sf), seconds=SECONDS)


@query(_SQL["merge_notes"])
def merge_notes_by_chunk(spark, sf):
    return transcribe.merge(raw_notes(spark, sf), seconds=SECONDS)


@query(_SQL["clean_notes"])
def clean_notes_by_chunk(spark, sf):
    return transcribe.clean(raw_notes(spark, sf), SECONDS)


LENGTHS = ", len AS (SELECT track_id, (max(frame_idx) + 1) * 512 / 22050.0::DOUBLE AS audio_length FROM fr GROUP BY track_id)"
ONSET_LENGTHS = FRAMES + LENGTHS + """, dur AS (SELECT track_id, onset, coalesce(lead(onset) OVER (PARTITION BY track_id ORDER BY onset), audio_length) - onset AS duration
  FROM ons JOIN len USING (track_id))"""


def _lengths(spark, sf):
    return fixtures.frames(spark, sf).groupBy("track_id").agg(((F.max("frame_idx") + 1) * 512 / 22050.0).alias("audio_length"))


@query(ONSET_LENGTHS + " SELECT track_id, onset AS onset_time, round(duration, 6) AS duration FROM dur")
def onset_note_durations(spark, sf):
    return transcribe.onset_durations(fixtures.onsets(spark, sf), _lengths(spark, sf)).withColumn("duration", F.round("duration", 6))


@query(ONSET_LENGTHS + """ SELECT d.track_id, onset AS start, round(duration, 6) AS duration, round(12 * (log2(f0) - log2(440.0::DOUBLE)) + 69, 6) AS midi_note, round(f0, 6) AS frequency
  FROM dur d JOIN fr f ON d.track_id = f.track_id AND f.frame_idx = floor(onset * 22050 / 512)::BIGINT WHERE NOT isnan(f0)""")
def onset_pitch(spark, sf):
    out = transcribe.onset_notes(fixtures.onsets(spark, sf), fixtures.frames(spark, sf), _lengths(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("duration", "midi_note", "frequency")})


@query(FRAMES + """ SELECT track_id, count(*)::BIGINT AS frames, round(count_if(NOT isnan(f0)) / count(*) * 100, 6) AS voiced_percent,
  min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM fr GROUP BY track_id""")
def voiced_ratio(spark, sf):
    return transcribe.voiced_ratio(fixtures.frames(spark, sf)).withColumn("voiced_percent", F.round("voiced_percent", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
