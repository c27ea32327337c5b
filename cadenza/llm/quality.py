"""Quality rules whose thresholds come from quantile sketches of each language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import if_small, stored

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Relative error of the sketches: buckets are powers of (1 + ERROR) / (1 - ERROR).
ERROR = 0.002
#: By rule: the ratio, what is added to both its numbers in the sketch, by how many quartile
#: ranges, of logarithms, a value may lie outside the quartiles, below and above (None: by any), and
#: whether it is a mean over words, which varies more the fewer they are.
#: With 1 added, documents that all have none of something still have a spread, that of their lengths.
RULES = {
    "word_length": ("word_chars / n_words", 0, 4.0, 4.0, True),
    "symbol_ratio": ("n_symbols / n_words", 1, None, 2.0, False),
    "dup_line_ratio": ("n_dup_lines / n_lines", 1, None, 2.0, False),
}
#: A group's quartiles count as much as its number of documents, those of its language as much as this.
BLEND = 50

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of `window` words that the text has twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    codes, size = ids[:n], len(number)
    for k in range(1, window):
        if size * len(number) >= 1 << 62:  # too many to number without a table: number those that occur
            seen, codes = np.unique(codes, return_inverse=True)
            size = len(seen)
        codes = codes * len(number) + ids[k : k + n]
        size *= len(number)
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:n] += twice
    cover[window : window + n] -= twice
    return int((np.cumsum(cover[:-1]) > 0).sum())


def text_metrics(text: bytes) -> tuple[int, ...]:
    """METRICS of a UTF-8 text; words are split at ASCII white space, lines at \\n."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = np.frombuffer(b"".join(words), np.uint8)
    points = int(((chars & 0xC0) != 0x80).sum())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), points, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines)


def with_metrics(rows: DataFrame, text: str, keep: bool = False) -> DataFrame:
    """rows with _n_words and the other METRICS of a string column, which stays only if asked."""
    left = [f for f in rows.schema if keep or f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in left), *(f"_{m} long" for m in METRICS)])
    names, measured = [f.name for f in left], [f"_{m}" for m in METRICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [text_metrics(t or b"") for t in part.column(text).cast(pa.large_binary()).to_pylist()]
                found = np.array(found, np.int64).reshape(-1, len(METRICS))
                cols = [*(part.column(n) for n in names), *(pa.array(found[:, j]) for j in range(len(METRICS)))]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *measured])

    return rows.mapInArrow(run, schema)


def base_failed() -> Column:
    return F.expr(f"_n_words < {MIN_WORDS} OR 100 * _n_repeat_words > {MAX_REPEAT_PERCENT} * _n_words")


def ratio(rule: str, added: int = 0) -> Column:
    over, under = (F.col(f"_{x}") + added for x in RULES[rule][0].split(" / "))
    return F.when(under > 0, over / under).otherwise(F.lit(0.0))


def thresholds(metrics: DataFrame) -> DataFrame:
    """Quartiles of each (_lang, _source) and rule, low_ and high_, and the median size, words, of
    all documents that pass the base rules; all are logarithms.

    The sketch of a group is the count of its values by logarithmic bucket, so that sketches
    merge by adding counts: partial counts of tasks to those of a group, groups to languages.
    Quantiles are the outer edges of their buckets, right to 2 * ERROR, relative.  Those of a group
    and of its language are averaged, weighted by the group's documents and BLEND.
    """
    log = float(np.log((1 + ERROR) / (1 - ERROR)))
    measures = {r: ratio(r, own[1]) for r, own in RULES.items()} | {"words": F.col("_n_words").cast("double")}
    named = F.create_map(*(x for r, v in measures.items() for x in (F.lit(r), v)))
    values = metrics.filter(~base_failed()).select("_lang", "_source", F.explode(named).alias("rule", "value"))
    bucket = F.ceil(F.ln("value") / F.lit(log)).cast("int")
    sketches = stored(values.withColumn("bucket", bucket).groupBy("_lang", "_source", "rule", "bucket").agg(F.count("*").alias("n")), "quality-sketch")

    def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys, "rule").orderBy("bucket")
        full = Window.partitionBy(*keys, "rule")
        s = sketch.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(full))
        at = {"low": (0.25, F.col("bucket") - 1), "middle": (0.5, F.col("bucket") - 0.5), "high": (0.75, F.col("bucket"))}
        q = [F.min(F.when(F.col("upto") >= F.col("all") * p, edge * log)).alias(name) for name, (p, edge) in at.items()]
        return s.groupBy(*keys, "rule").agg(F.max("all").alias("docs"), *q)

    own = quartiles(sketches, ["_lang", "_source"])
    merged = sketches.groupBy("_lang", "rule", "bucket").agg(F.sum("n").alias("n"))
    wide = quartiles(merged, ["_lang"]).drop("docs").withColumnsRenamed({c: f"l_{c}" for c in ("_lang", "rule", "low", "middle", "high")})
    both = own.join(wide, own["_lang"].eqNullSafe(wide["l__lang"]) & (own["rule"] == wide["l_rule"]))
    blended = lambda c: (F.col(c) * F.col("docs") + F.col(f"l_{c}") * BLEND) / (F.col("docs") + BLEND)
    of = lambda r, c: F.max(F.when(F.col("rule") == r, blended(c)))
    return both.groupBy("_lang", "_source").agg(*(of(r, c).alias(f"{c}_{r}") for r in RULES for c in ("low", "high")), of("words", "middle").alias("words"))


def judged(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """metrics with _base_failed and _kept: joined with the quartiles of its language and source.

    A document is kept if it lies within Tukey's fences, on a logarithmic scale, of each rule.  For means over
    words they are wider, for a document that is shorter than the median, by the square root of how much.
    """
    limits = if_small(limits.select(F.struct("*").alias("_max")))
    same = F.col("_lang").eqNullSafe(F.col("_max._lang")) & F.col("_source").eqNullSafe(F.col("_max._source"))
    short = F.greatest(F.lit(1.0), F.exp((F.col("_max.words") - F.ln("_n_words")) / 2))
    within = F.lit(True)
    for r, (_, _, below, above, mean) in RULES.items():
        value, low, high = F.ln(ratio(r)), F.col(f"_max.low_{r}"), F.col(f"_max.high_{r}")
        wide = (high - low) * (short if mean else 1.0)
        if above is not None:
            within = within & ~F.coalesce(value > high + above * wide, F.lit(False))
        if below is not None:
            within = within & ~F.coalesce(value < low - below * wide, F.lit(False))
    return metrics.join(limits, same, "left").withColumn("_base_failed", base_failed()).withColumn("_kept", ~base_failed() & within).drop("_max")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The verdict on each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    A null, empty or wordless text has no words and fails.  Null languages and sources are
    groups of their own; where no document of a group passes the base rules it has no limits,
    and none is needed.  Null and repeated ids stay; an empty table gives an empty one; other
    columns, of whatever name, are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.col(text_col).cast("string").alias("_t"))
    found = stored(with_metrics(rows, "_t"), "quality-metrics")
    out = judged(found, stored(thresholds(found), "quality-limits"))
    return out.select("doc_id", *(F.col(f"_{m}").alias(m) for m in METRICS[:5]), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def good_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows that quality() keeps, columns of docs, of whatever name.  Each text is measured once and
    written with its metrics, never shuffled."""
    names = docs.columns
    rows = docs.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"))
    text = f"c{names.index(text_col)}"
    found = stored(with_metrics(rows.withColumn(text, F.col(text).cast("string")), text, keep=True), "quality-measured")
    kept = judged(found, stored(thresholds(found), "quality-limits")).filter("_kept")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
