"""Scalar functions of pitch, time and chord names, as column expressions, and chord tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the twelve pitch classes, with the musical and the ASCII sharp.
NOTE_NAMES = ["C", "C♯", "D", "D♯", "E", "F", "F♯", "G", "G♯", "A", "A♯", "B"]
PITCH_CLASSES = [n.replace("♯", "#") for n in NOTE_NAMES]

# The chord patterns in effect, in the order that breaks ties (six more of the
# same list, which need flats, never match).
PATTERNS = """
Bsus4 E F# B; Esus4 E A B; Asus4 A D E; Dsus4 D G A; Gsus4 G C D; Csus4 C F G; Bsus2 B C# F#;
F#m7 F# A C# E; Am7 A C E G; Dm7 D F A C; Em7 E G B D; Bm7 B D F# A; C#m7 C# E G# B;
Emaj7 E G# B D#; Amaj7 A C# E G#; Bmaj7 B D# F# A#; F#maj7 F# A# C# F; Cmaj7 C E G B; Dmaj7 D F# A C#;
Gmaj7 G B D F#; Fmaj7 F A C E; E7 E G# B D; A7 A C# E G; B7 B D# F# A; F#7 F# A# C# E; D7 D F# A C; G7 G B D F;
E E G# B; A A C# E; B B D# F#; F# F# A# C#; C C E G; D D F# A; G G B D; F F A C;
F#m F# A C#; Am A C E; Bm B D F#; Em E G B; Dm D F A; C#m C# E G#
"""

# The root taken when no pattern is contained, the first of these that is present.
ROOT_ORDER = ["E", "F#", "A", "B", "C", "D", "G", "F"]

# Keys in the order that breaks ties, each with its chords.
KEY_TEMPLATES = [
    ("C major", "C F G Am Dm Em"),
    ("G major", "G C D Em Am Bm"),
    ("D major", "D G A Bm Em F#m"),
    ("A major", "A D E F#m Bm C#m"),
    ("E major", "E A B C#m F#m G#m"),
    ("F major", "F Bb C Dm Gm Am"),
    ("A minor", "Am F G C Dm Em E"),
    ("E minor", "Em C D G Am Bm B"),
    ("B minor", "Bm G A D Em F#m F#"),
    ("F# minor", "F#m D E A Bm C#m C#"),
    ("D minor", "Dm Bb C F Gm Am A"),
    ("G minor", "Gm Eb F Bb Cm Dm D"),
]

# How well each pitch class, counted from the keynote, was found to fit a major and a minor key (the
# probe-tone ratings published by Krumhansl and Kessler in 1982), in hundredths.
MAJOR_PROFILE = [635, 223, 348, 233, 438, 409, 252, 519, 239, 366, 229, 288]
MINOR_PROFILE = [633, 268, 352, 538, 260, 353, 254, 475, 398, 269, 334, 317]


def bit(name: str) -> int:
    return 1 << PITCH_CLASSES.index(name)


def mask_of(*names: str) -> int:
    return sum(map(bit, names))


@cache
def pattern_rows() -> list[tuple[int, int, int, str]]:
    """(priority, mask, size, name) of each chord pattern."""
    rows = []
    for i, entry in enumerate(PATTERNS.replace("\n", " ").split(";")):
        name, *notes = entry.split()
        rows.append((i, mask_of(*notes), len(notes), name))
    return rows


def label_of_mask(mask: int) -> str:
    """Chord label of a set of pitch classes: exact pattern, largest contained one, root, name."""
    present = [p for i, p in enumerate(PITCH_CLASSES) if mask >> i & 1]
    if len(present) < 2:
        return present[0] if present else "Silence"
    inside = [(mask != m, -size, priority, name) for priority, m, size, name in pattern_rows() if mask & m == m]
    if inside:
        return min(inside)[3]
    return next((r for r in ROOT_ORDER if r in present), min(present))


def chord_lut(spark: SparkSession) -> DataFrame:
    """(mask, label) of all 4,096 sets of pitch classes."""
    return spark.createDataFrame([(m, label_of_mask(m)) for m in range(4096)], "mask int, label string")


def chord_patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pattern_rows(), "priority int, pattern int, size int, name string")


def key_templates(spark: SparkSession) -> DataFrame:
    rows = [(i, key, chord) for i, (key, chords) in enumerate(KEY_TEMPLATES) for chord in chords.split()]
    return spark.createDataFrame(rows, "key_order int, key string, chord string")


def note_name(pitch: Column) -> Column:
    """Name with octave: 60 is C4, 61 is C♯4."""
    return F.concat(F.element_at(F.array(*map(F.lit, NOTE_NAMES)), F.pmod(pitch, F.lit(12)).cast("int") + 1), (F.floor(pitch / 12) - 1).cast("string"))


def pitch_class(pitch: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PITCH_CLASSES)), F.pmod(pitch, F.lit(12)).cast("int") + 1)


def pitch_class_of_name(name: Column) -> Column:
    """The pitch class in a note name; empty if it has none."""
    return F.regexp_extract(F.translate(name, "♯♭", "#b"), "^([A-G][#b]?)", 1)


def pitch_bit(pitch: Column) -> Column:
    return F.element_at(F.array(*(F.lit(1 << i) for i in range(12))), F.pmod(pitch, F.lit(12)).cast("int") + 1)


def format_time(seconds: Column) -> Column:
    """MM:SS, rounded down; minutes may have more digits."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("long"), (F.floor(seconds) % 60).cast("long"))


def time_range(start: Column, end: Column) -> Column:
    return F.concat(F.lit("["), format_time(start), F.lit(" - "), format_time(end), F.lit("]"))


def hz_to_midi(hz: Column) -> Column:
    return (F.log2(hz) - F.log2(F.lit(440.0))) * 12 + 69


def energy_velocity(energy: Column) -> Column:
    """Velocity 30 to 127 of an energy, cut off."""
    return F.least(F.greatest(energy * 127 * 2, F.lit(30.0)), F.lit(127.0)).cast("int")


def confidence_velocity(confidence: Column) -> Column:
    """Velocity of a confidence, cut off; null if that is not known."""
    return (confidence * 127).try_cast("int")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def transcribed_path(path: Column) -> Column:
    """Where the transcription of an audio file goes: beside it, as <stem>_transcribed.mid."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit("_transcribed.mid"))


def register(spark: SparkSession) -> None:
    """The functions of one argument for SQL: note_name, pitch_class, format_time."""
    names = ", ".join(f"'{n}'" for n in NOTE_NAMES)
    classes = ", ".join(f"'{n}'" for n in PITCH_CLASSES)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION note_name(p INT) RETURNS STRING
        RETURN concat(element_at(array({names}), pmod(p, 12) + 1), CAST(CAST(floor(p / 12) AS INT) - 1 AS STRING))""")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION pitch_class(p INT) RETURNS STRING RETURN element_at(array({classes}), pmod(p, 12) + 1)")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION format_time(s DOUBLE) RETURNS STRING
        RETURN format_string('%02d:%02d', CAST(floor(s / 60) AS BIGINT), CAST(floor(s) % 60 AS BIGINT))""")


def key_profiles(spark: SparkSession) -> DataFrame:
    """key_order, key, pc, rating: the profile of each of 24 keys, majors first, 12 rows each."""
    rows = [
        (12 * mode + tonic, f"{PITCH_CLASSES[tonic]} {name}", (tonic + i) % 12, rating)
        for mode, (name, profile) in enumerate((("major", MAJOR_PROFILE), ("minor", MINOR_PROFILE))) for tonic in range(12) for i, rating in enumerate(profile)]
    return spark.createDataFrame(rows, "key_order int, key string, pc int, rating long")
