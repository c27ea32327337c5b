"""What the training-data operators share: checked broadcasts, blocks of bounded size, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from cadenza.storage import discard, release, scratch_dir, scratch_path, settled, stored

__all__ = [
    "WORD", "blocks", "bounded_batches", "carried", "connected_components", "discard", "having", "if_small", "lower_hex", "release", "scratch_path", "settled", "shuffle_partitions", "sieved", "stored"]

#: A word of every contract: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Tables of up to this many bytes may be broadcast.
BROADCAST_BYTES = 48 << 20

#: Words of 64 bits in a sieve at most, which is broadcast whatever its keys are.
SIEVE_WORDS = 1 << 20

#: Rows and bytes of an Arrow batch at most, where the session doesn't say otherwise.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Hand texts to Python workers in small batches: in what is run inside, not what is planned
    there and run later.

    Spark's own limit of 10,000 rows is one of rows alone: with long texts a batch is then as
    large as they are, and both JVM and worker hold one.  Settings of the session's own stay, and
    the others are as before when the block ends.
    """
    own = [key for key in ARROW_BATCH if key not in spark.conf.getAll]
    for key in own:
        spark.conf.set(key, str(ARROW_BATCH[key]))
    try:
        yield
    finally:
        for key in own:
            spark.conf.unset(key)


def carried(docs: DataFrame, *own: str) -> list[str]:
    """The columns of docs but for those that an operator's own columns replace."""
    taken = {c.lower() for c in own}
    return [c for c in docs.columns if c.lower() not in taken]


def _bytes(kind: DataType, col: Column) -> Column:
    """About what a value takes in a broadcast table."""
    if isinstance(kind, StructType):
        return sum((_bytes(f.dataType, col[f.name]) for f in kind), F.lit(8))
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType | BinaryType | ArrayType | StructType):
            return F.coalesce(F.aggregate(col, F.lit(24).cast("long"), lambda s, x: s + _bytes(kind.elementType, x)), F.lit(8))
        return F.coalesce(F.size(col), F.lit(0)) * 8 + 24
    return F.lit(8)


def if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df, marked for broadcast only if its rows, measured, take at most `limit` bytes (None:
    BROADCAST_BYTES).  df is read twice: a stored table, or a small aggregate of one."""
    size = sum((_bytes(f.dataType, F.col(f"`{f.name}`")) for f in df.schema), F.lit(32))
    taken = df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if taken <= (BROADCAST_BYTES if limit is None else limit) else df


def having(rows: DataFrame, wanted: DataFrame, key: str, *more: str) -> DataFrame:
    """rows joined with wanted by key (and more columns), inner, when few of many rows have a key of it.

    wanted, a stored table, is broadcast if it is small.  Else rows go through a sieve first: a
    Bloom filter of one bit a key, a table of SIEVE_WORDS words at most, which lets all rows pass that
    have a key and few others, so that the rest are not shuffled.  With very many keys it lets most pass.
    """
    on = [key, *more]
    small = if_small(wanted)
    if small is not wanted:
        return rows.join(small, on)
    passed = sieved(rows, wanted, key).filter("_maybe").drop("_maybe")
    return passed.join(wanted, on)


def sieved(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows with _maybe: false only where wanted, a stored table, surely has no row of that key."""
    number = wanted.count()
    words = min(SIEVE_WORDS, 1 << max(4, (number // 4).bit_length()))
    place = F.xxhash64(F.lit("sieve"), key)
    word = F.pmod(place, F.lit(words)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(place, 32), F.lit(64)).cast("int"))
    sieve = stored(wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "sieve")
    found = rows.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(sieve), "_word", "left")
    return found.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))).drop("_word", "_bit", "_bits")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(rows: DataFrame, key: str, weight: str, member: str, limit: int) -> DataFrame:
    """Deal the members of each key into groups of bounded size.

    rows: (key, weight = that of all members of the key, member).  Keys of weight up to `limit`
    are one block.  Heavier ones are cut by hash into parts of about half of it, and each two
    parts make a block, so that any two members meet in some block and no block outgrows one task.
    Returns (block, member).
    """
    parts = F.when(F.col(weight) <= limit, F.lit(1)).otherwise(F.ceil(F.col(weight) * 2 / F.lit(limit))).cast("int")
    own = F.pmod(F.xxhash64(F.lit("part"), F.col(member)), F.col("_parts")).cast("int")
    others = F.when(F.col("_parts") == 1, F.array(F.lit(0))).otherwise(
        F.array_remove(F.sequence(F.lit(0), F.col("_parts") - 1), F.col("_own")))
    return (
        rows.withColumn("_parts", parts)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(others))
        .select(
            F.xxhash64(F.col(key), F.least("_own", "_other"), F.greatest("_own", "_other")).alias("block"),
            F.col(member),
        )
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    edges: (a, b), nodes of any type that can be ordered, in any order and number; loops and
    nulls are ignored.  Returns (node, component), component being the smallest node reachable,
    one row for each node that has an edge.  Each step is two joins with an aggregate, which is
    written first and then broadcast or joined by itself, so that a hub with very many edges is
    neither a list in one task nor bound to one.  Components that are stars take no part in
    further steps, so that a long one makes no others be joined again.  Lineage is cut by
    checkpoint().
    """
    scratch_dir(edges.sparkSession)
    now = (
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )

    def stars(pairs: DataFrame, only_larger: bool) -> DataFrame:
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).checkpoint()
        linked = pairs.join(if_small(least), "u")
        if only_larger:
            return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))

    now, done = now.checkpoint(), None
    while not (left := _unfinished(now)).isEmpty():
        small = if_small(left)
        ended = now.join(small, "v", "left_anti").select("u", "v")
        done = ended if done is None else done.union(ended)
        now = now.join(small, "v", "left_semi").select("u", "v").checkpoint()
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stars(both, True).filter("u <> v").distinct().checkpoint()
        now = stars(large, False).filter("u <> v").distinct().checkpoint()
    now = now if done is None else done.union(now)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _unfinished(pairs: DataFrame) -> DataFrame:
    """(v): the parents in (u, v) whose components are not stars yet.  In a star the parent has none
    itself, and its children have no other parent and no children."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        pairs.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    wrong = ends.filter("up > 1 OR up = 1 AND down = 1").select(F.col("node").alias("u")).checkpoint()
    return pairs.join(if_small(wrong), "u").select("v").union(wrong).distinct().checkpoint()


def lower_hex(col: Column) -> Column:
    return F.lpad(F.lower(F.hex(col)), 16, "0")
