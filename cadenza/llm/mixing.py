"""Mixing sources to target weights (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import WORD, carried, if_small, shuffle_partitions, stored

WEIGHT_CYCLE = (5, 2, 1)
MAX_EPOCHS = 3
KEY_BITS = 60
#: Rows of a range of a source's keys, on average: what one task sorts where the source is cut.
RANGE_ROWS = 1 << 16


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: int) -> Column:
    """A hash-random key of 60 bits, the same in every run: 15 hex digits of an MD5."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(totals: DataFrame, cycle=WEIGHT_CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources: (source, source_size) -> the same with weight and target.

    The i-th source by code point (null last) weighs cycle[i mod len].  All sources together get
    the sum of sizes; a target is at most max_epochs times its source's size, and what that cuts
    off goes to the others by weight.  Repeating that until none is above ends at one level L
    with target = min(cap, L * weight), and L is found in one pass over the sources by
    cap / weight: the first that fits below its cap gives the highest level that fits.  There is one
    row for each source here, and no more; they are ranked in one task, in time that grows as their number.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(cycle))) + 1).cast("int"))
    s = totals.withColumn("weight", w.cast("double")).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything).cast("double")
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("level", (total - before) / rest)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    s = s.withColumn("level", F.max(fits).over(everything))
    return s.select("source", "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def mixture_plan(sized: DataFrame, cycle=WEIGHT_CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Where each source is cut: (source, size, key) rows -> one row for each source.

    Columns: source, source_size, target, epochs (whole passes), cut (key at which the last,
    partial pass ends; null: it takes nothing), cut_words (words it takes of the rows with that
    key), cut_size (words those rows have).  Keys are random, so their top bits deal each source
    into even ranges, more of them the more rows there are; prefix sums run over the ranges' totals
    first and then, inside the one range in which the budget ends, over its rows.  No task holds
    a whole source.  sized is a stored table.
    """
    ranges = max(16, 2 * shuffle_partitions(sized.sparkSession), sized.count() // RANGE_ROWS)
    sized = sized.withColumn("bin", F.floor(F.col("key") / F.lit(float(1 << KEY_BITS)) * ranges).cast("int"))
    bins = sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    bins = stored(bins, "mix-bins")
    targets = source_targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), cycle, max_epochs)
    budget = F.round("target").cast("long")
    targets = targets.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("int")
    ).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    targets = stored(targets, "mix-targets")

    by_bin = Window.partitionBy("source").orderBy("bin")
    here = bins.withColumn("end", F.sum("bin_size").over(by_bin)).alias("b").join(
        targets.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    here = here.withColumn("start", F.col("end") - F.col("bin_size")).filter("start < rest AND rest <= end")
    here = here.select("s", F.col("bin").alias("cut_bin"), "start", "rest")
    rows = sized.join(if_small(stored(here, "mix-here")), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("cut_bin")))
    keyed = rows.groupBy("s", "start", "rest", "key").agg(F.sum("size").alias("cut_size"))
    by_key = Window.partitionBy("s").orderBy("key")
    keyed = keyed.withColumn("upto", F.col("start") + F.sum("cut_size").over(by_key))
    cut = keyed.filter("upto - cut_size < rest AND rest <= upto").select(
        "s", F.col("key").alias("cut"), (F.col("rest") - F.col("upto") + F.col("cut_size")).alias("cut_words"), "cut_size")
    return targets.join(if_small(stored(cut, "mix-cut")), F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "epochs", "cut", "cut_words", "cut_size")


OWN = ("mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_epochs")


def _taken(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, cycle, max_epochs: int, whole_documents: bool) -> DataFrame:
    """Rows of docs as _row, beside the columns in OWN."""
    sized = docs.select(
        F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), random_key(F.col(id_col), seed).alias("key"))
    plan = mixture_plan(stored(sized, "mix-sizes"), cycle, max_epochs)
    plan = stored(plan.select(F.struct("*").alias("_p")), "mix-plan")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.join(if_small(plan), F.col(f"_row.`{source_col}`").eqNullSafe(F.col("_p.source")))
    size, key = word_count(F.col(f"_row.`{text_col}`")), random_key(F.col(f"_row.`{id_col}`"), seed)
    rows = rows.withColumn("_size", size).withColumn("_key", key)
    share = F.expr("_size * _p.cut_words div _p.cut_size")
    if whole_documents:
        share = F.when(F.expr("_size > 0 AND 2 * _p.cut_words >= _p.cut_size"), F.col("_size")).otherwise(F.lit(0))
    last = F.when(F.expr("_key < _p.cut"), F.col("_size")).when(F.expr("_key = _p.cut"), share).otherwise(F.lit(0)).cast("long")
    return rows.select(
        "_row",
        F.col("_size").alias("mix_size"),
        F.col("_p.source_size").alias("mix_source_size"),
        F.col("_p.target").alias("mix_target"),
        (F.col("_p.epochs") * F.col("_size") + last).alias("mix_taken"),
        (F.col("_p.epochs") + F.when(last > 0, 1).otherwise(0)).alias("mix_epochs"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 1,
    cycle=WEIGHT_CYCLE,
    max_epochs: int = MAX_EPOCHS,
    whole_documents: bool = False,
) -> DataFrame:
    """Mix a corpus: each row with mix_size, mix_source_size, mix_target, mix_taken, mix_epochs.

    mix_taken is the number of words the mix takes of the row, repeats counted: mix_epochs whole
    passes over its source, and one more if its random key lies before the source's cut.  The
    row at the cut gives the words still missing, so that a source's taken words are its target
    rounded; with whole_documents it is taken once more if at least half of it lies before the
    cut, and not otherwise.

    A null or empty text has size 0 and nothing taken; sources of size 0 have target 0.  A null
    source is a source of its own, the last.  Rows that share an id share a key: at a cut they
    share its words in proportion to their sizes, rounded down.  An empty table gives an empty
    one.  Other columns are carried along, but for those that have the names of the new ones.
    """
    rows = _taken(docs, id_col, text_col, source_col, seed, cycle, max_epochs, whole_documents)
    return rows.select(*(F.col(f"_row.`{c}`").alias(c) for c in carried(docs, *OWN)), *OWN)


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, cycle=WEIGHT_CYCLE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """The mixed corpus itself: each document as often as it is taken whole, columns of docs, of
    whatever name.  As mix() otherwise."""
    taken = _taken(docs, id_col, text_col, source_col, seed, cycle, max_epochs, True).filter("mix_taken > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("mix_epochs")))).select("_row.*")
