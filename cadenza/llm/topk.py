"""Exact top-k inner products by MaxScore over the components of vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import stored

SCALE = 64
#: Vectors of a shard and queries of a block; a task holds one of each.  Each vector is copied once
#: for each block of queries, and each query once for each shard.
SHARD, QUERIES = 8192, 8192
#: Vectors, by hash of their ids, that all queries are scored with first, for a threshold that holds
#: in every shard; lists probed at a time.
HEAD, STEP = 1024, 8


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Integer vectors as rows, filled up with zeros."""
    flat = lists.combine_chunks()
    lengths = np.asarray(pa.compute.list_value_length(flat)).astype(np.int64)
    out = np.zeros((len(flat), width), np.int64)
    out[np.repeat(np.arange(len(flat)), lengths), np.concatenate([np.arange(n) for n in lengths] or [[]]).astype(np.int64)] = np.asarray(flat.flatten())
    return out


def _exact(queries: np.ndarray, vectors: np.ndarray) -> type:
    """The fastest type in which no inner product is rounded, nor a sum of two of them, as bounds are."""
    most = 2 * float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def kth_best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[int | None]:
    """The k-th best score of each query among vectors of distinct ids, its own left out; None if there
    are fewer.  No vector that scores less can be among the k best of any larger set."""
    kind = _exact(queries, vectors)
    scores, out = queries.astype(kind) @ vectors.T.astype(kind), []
    for own, row in zip(query_ids.tolist(), scores):
        values = row[ids != own]
        out.append(int(np.sort(values)[-k]) if len(values) >= k else None)
    return out


def candidates(q: np.ndarray, lists: np.ndarray, top: np.ndarray, bottom: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a shard that may score `floor` or more, and the scores of those that do.

    Each component is a term, and its posting list the shard's column of it.  A term contributes
    between its low and its high bound; sorted by the span between them, the terms that could
    not lift a vector at its low bounds to the threshold are not essential.  Essential lists are
    traversed, the others probed, the largest first, for vectors that can still reach the threshold.
    """
    high, low = np.maximum(q * top, q * bottom), np.minimum(q * top, q * bottom)
    order = np.argsort(high - low, kind="stable")
    reach = low.sum() + np.cumsum((high - low)[order])
    cut = int(np.count_nonzero(reach < floor))
    idle, essential = order[:cut][::-1], np.sort(order[cut:])
    if not len(essential):
        return np.zeros(0, np.int64), np.zeros(0, lists.dtype)
    score = q[essential] @ lists[essential]
    rest = high[idle].sum()
    alive = np.flatnonzero(score + rest >= floor)
    score = score[alive]
    for i in range(0, len(idle), STEP):
        if not len(alive):
            break
        some = idle[i : i + STEP]
        score = score + q[some] @ lists[np.ix_(some, alive)]
        rest -= high[some].sum()
        still = score + rest >= floor
        alive, score = alive[still], score[still]
    return alive, score


def search(query_ids: np.ndarray, queries: np.ndarray, floors: list[int | None], ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of each query's k best in one shard that reach its floor, ties to
    the smaller id.  Of rows that share an id the best counts."""
    kind = _exact(queries, vectors)
    lists, wide, out = np.ascontiguousarray(vectors.T.astype(kind)), queries.astype(kind), []
    top, bottom = lists.max(axis=1), lists.min(axis=1)
    names, number = np.unique(ids, return_inverse=True)
    for own, q, floor in zip(query_ids.tolist(), wide, floors):
        found, values = candidates(q, lists, top, bottom, -math.inf if floor is None else floor)
        other = ids[found] != own
        found, values = found[other], values[other]
        if len(names) < len(ids) and len(found):
            order = np.lexsort((-values.astype(np.float64), number[found])) if kind is not object else np.array(sorted(range(len(found)), key=lambda i: (number[found[i]], -values[i])))
            found, values = found[order], values[order]
            first = np.diff(number[found], prepend=-1) > 0
            found, values = found[first], values[first]
        if len(found) > k:
            best = values >= np.sort(values)[-k]
            found, values = found[best], values[best]
        order = np.lexsort((ids[found], -values.astype(np.float64))) if kind is not object else sorted(range(len(found)), key=lambda i: (-values[i], ids[found[i]]))
        for i in list(order)[:k]:
            out.append((own, int(ids[found[i]]), int(values[i])))
    return out


def _shard(k: int, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        width = max((pa.compute.max(pa.compute.list_value_length(t.column("v"))).as_py() or 0 for t in (left, right) if t.num_rows), default=0) or 1
        ids = lambda t: np.asarray(t.column("id").combine_chunks())
        floors = left.column("floor").to_pylist()
        rows = search(ids(left), _matrix(left.column("v"), width), floors, ids(right), _matrix(right.column("v"), width), k) if left.num_rows and right.num_rows else []
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], schema=schema)

    return run


def _with_floors(head: pa.Table, k: int):
    """Queries with the score that their k best are known to reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.compute.list_value_length(head.column("v"))
        for batch in batches:
            own = pa.Table.from_batches([batch])
            width = max(pa.compute.max(lists).as_py() or 0, pa.compute.max(pa.compute.list_value_length(own.column("v"))).as_py() or 0) if batch.num_rows else 0
            ids = np.asarray(own.column("id").combine_chunks())
            floors = kth_best(ids, _matrix(own.column("v"), width), np.asarray(head.column("id").combine_chunks()), _matrix(head.column("v"), width), k) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.int64())], names=["id", "v", "floor"])

    return run


def integer_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<long>): components x as floor(SCALE * x); vectors with a null or non-finite
    component, null vectors and null ids are left out, rows that repeat both count once."""
    v = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return rows.select("id", F.transform("v", lambda x: F.floor(x * SCALE)).alias("v")).distinct()


def top_k(table: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best vectors of each query by integer inner product: query_id, rank, vec_id, score.

    queries is a condition on id: the rows for which it holds are the queries, and candidates
    are all rows of another id.  Rank counts from 1; ties go to the smaller id; fewer than k
    candidates are all returned.  Vectors that are null, or hold null or non-finite components,
    take no part; an empty one scores 0 and a shorter one counts as filled up with zeros.  Rows
    of one id and different vectors are candidates each, of which the best score counts, and
    queries together.  Scores beyond 64 bits raise an error.  An empty table gives an empty one;
    other columns are not read.

    Queries are first scored with HEAD vectors, and the k-th best of these is a threshold for all
    shards.  Then every query meets every vector in one pair of a block of queries and a shard of
    vectors, each of bounded size; only the k best of each pair go on to be merged.
    """
    vectors = stored(integer_vectors(table, id_col, vector_col), "topk-vectors")
    head = vectors.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.xxhash64("id")).limit(HEAD).toArrow()
    asked = stored(vectors.filter(queries).mapInArrow(_with_floors(head, k), "id long, v array<long>, floor long"), "topk-queries")
    shards = max(1, math.ceil(vectors.count() / SHARD))
    parts = max(1, math.ceil(asked.count() / QUERIES))
    shard, part = F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(shards)), F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(parts))
    left = asked.select("id", "v", "floor", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    right = vectors.select("id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), shard.alias("shard"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    found = left.groupBy("part", "shard").cogroup(right.groupBy("part", "shard")).applyInArrow(_shard(k, schema), "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
