"""Scans along one long recording by many tasks: chunks, summaries of chunks, and stitching.

A window over a recording is one task, however long the recording is.  Here its rows are cut into
chunks by their order; each chunk gives a summary of bounded size (first and last row, number
of runs, what is still open at its end), a window over the summaries alone tells each chunk what
came before it, and then every chunk is finished by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cadenza.storage import stored

#: Windows of a chunk, and seconds of one where notes or frames are scanned.
WINDOWS, SECONDS = 65_536, 600.0


def joined(rows: DataFrame, other: DataFrame, names: list[str], how: str = "left") -> DataFrame:
    """rows with other's columns by equal names, nulls being equal too."""
    right = other.select(*(F.col(n).alias(f"_on_{n}") for n in names), *(c for c in other.columns if c not in names))
    on = [F.col(n).eqNullSafe(F.col(f"_on_{n}")) for n in names]
    return rows.join(right, on, how).drop(*(f"_on_{n}" for n in names))


class Chunks:
    """Rows of each key in order, stored, with _chunk, the number of the chunk that they are in.

    chunk must not fall along the order.  What is windowed by `own` is one chunk, by `along` the
    summaries of a key's chunks.
    """

    def __init__(self, rows: DataFrame, key: list[str], order: list[str], chunk: Column):
        self.rows = stored(rows.withColumn("_chunk", chunk.cast("long")), "chunks")
        self.key, self.order, self.by = key, order, [*key, "_chunk"]

    @property
    def own(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    @property
    def along(self) -> WindowSpec:
        return Window.partitionBy(*self.key).orderBy("_chunk")

    def with_neighbours(self, columns: list[str], after: bool = False) -> DataFrame:
        """The rows with _prev, a struct of the columns in the row before, and _next if `after`."""
        at, kept = F.struct(*self.order), F.struct(*columns)
        edges = self.rows.groupBy(*self.by).agg(F.min_by(kept, at).alias("_first"), F.max_by(kept, at).alias("_last"))
        edges = edges.select(*self.by, F.lag("_last").over(self.along).alias("_before"), F.lead("_first").over(self.along).alias("_after"))
        rows = joined(self.rows, edges, self.by)
        rows = rows.withColumn("_prev", F.coalesce(F.lag(kept).over(self.own), "_before"))
        if after:
            rows = rows.withColumn("_next", F.coalesce(F.lead(kept).over(self.own), "_after"))
        return rows.drop("_before", "_after")

    def runs(self, rows: DataFrame, new: Column, parts: dict[str, Column], whole: Callable[[dict[str, Column]], dict[str, Column]]) -> DataFrame:
        """Runs of rows, each begun by a row that is `new`: the key and the aggregates of each run.

        parts are aggregates of the rows of a run in one chunk; `whole` gives those of a run
        from the columns of its parts.  What stands in a chunk before its first new row belongs to
        the last run of the chunks before that has one.
        """
        rows = rows.withColumn("_run", F.sum(F.when(new, 1).otherwise(0)).over(self.own))
        pieces = stored(rows.groupBy(*self.by, "_run").agg(*(c.alias(n) for n, c in parts.items())), "chunk-runs")
        last = pieces.groupBy(*self.by).agg(F.max("_run").alias("_runs"))
        open_ = F.when(F.col("_runs") > 0, F.struct(F.col("_chunk").alias("chunk"), F.col("_runs").alias("run")))
        homes = last.select(*self.by, F.last(open_, ignorenulls=True).over(self.along.rowsBetween(Window.unboundedPreceding, -1)).alias("_home"))
        home = F.when(F.col("_run") > 0, F.struct(F.col("_chunk").alias("chunk"), F.col("_run").alias("run"))).otherwise(F.col("_home"))
        pieces = joined(pieces, homes, self.by).withColumn("_home", home)
        return pieces.groupBy(*self.key, "_home").agg(*(c.alias(n) for n, c in whole({n: F.col(n) for n in parts}).items())).drop("_home")


def positions(rows: DataFrame, key: list[str], order: str, chunk: Column) -> DataFrame:
    """rows with _position, their number within the key from 1: chunks are counted, then numbered."""
    rows = stored(rows.withColumn("_chunk", chunk.cast("long")), "chunk-positions")
    counts = rows.groupBy(*key, "_chunk").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = joined(rows, counts.select(*key, "_chunk", before.alias("_before")), [*key, "_chunk"])
    own = F.row_number().over(Window.partitionBy(*key, "_chunk").orderBy(order))
    return rows.withColumn("_position", own + F.col("_before")).drop("_before", "_chunk")
