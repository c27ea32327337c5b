"""Hard negatives by one-dimensional distance keys: exact search of growing annuli around pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import if_small, stored
from cadenza.llm.topk import _exact, _matrix

#: Pivots, and the rows that they are fitted on: a bounded sample, by hash of their ids.
PIVOTS, SAMPLE = 16, 2048
#: Rows of a block of the index, and anchors that are held against one; a task holds one of each.
BLOCK, ANCHORS = 4096, 8192
#: Rings of a pivot at least and at most; fuller rings are dealt into several blocks.
RINGS = 4, 1024
#: Radii doubled for an anchor that has found too few rows, before it is given all that is left.
TRIES = 3

INDEX = "id long, label long, v array<long>, n2 double, pivot int, dist double"


def usable(table: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v array<long>, n2): integer vectors floor(scale * x) and their squared norms; no
    rows with null ids or labels, null vectors or null or non-finite components; one row an id."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    rows = rows.select("id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("_r")).select("id", "_r.label", "_r.v")
    return rows.withColumn("n2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def fit_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of a sample of augmented vectors: spread-out rows, then a few rounds of means."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    centres = sample[chosen].copy()
    for _ in range(4):
        own = _distances(sample, centres).argmin(axis=1)
        for i in range(len(centres)):
            if (own == i).any():
                centres[i] = sample[own == i].mean(axis=0)
    return centres


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * rows @ centres.T
    return np.sqrt(np.maximum(squares, 0))


def _augmented(lists: pa.Array, n2: np.ndarray, width: int, most: float) -> np.ndarray:
    """Vectors with one more component, which lifts all of them to the norm sqrt(most): the nearer
    two of them, one with 0 there, the larger the vectors' inner product."""
    return np.hstack([_matrix(pa.chunked_array([lists]), width).astype(np.float64), np.sqrt(np.maximum(most - n2, 0))[:, None]])


def _keys(pivots: np.ndarray, width: int, most: float):
    """Rows -> rows with their nearest pivot and the distance to it: their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                d = _distances(_augmented(part.column("v"), np.asarray(part.column("n2")), width, most), pivots)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["id", "label", "v", "n2", "pivot", "dist"])

    return run


def _from_pivots(pivots: np.ndarray, width: int):
    """Anchors, which have 0 for the added component, and their distances to all pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n2 = np.asarray(batch.column("n2"))
            d = _distances(_augmented(batch.column("v"), n2, width, 0.0), pivots) if len(n2) else np.zeros((0, len(pivots)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(d), pa.list_(pa.float64()))], names=["id", "label", "v", "n2", "d"])

    return run


def _scan(k: int, same: bool):
    """A block of anchors and a block of the index -> each target's k best rows of the block."""
    schema = pa.schema([("id", pa.int64()), ("target", pa.int64()), ("other", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            width = max(pa.compute.max(pa.compute.list_value_length(t.column("v"))).as_py() or 0 for t in (left, right))
            asked, held = (_matrix(t.column("v"), width) for t in (left, right))
            kind = _exact(asked, held)
            turned = np.ascontiguousarray(held.T.astype(kind))
            ids, labels = (np.asarray(right.column(c).combine_chunks()) for c in ("id", "label"))
            own, own_label = (np.asarray(left.column(c).combine_chunks()) for c in ("id", "label"))
            targets = left.column("targets").to_pylist()
            for i in range(0, len(own), 256):
                scores = asked[i : i + 256].astype(kind) @ turned
                for row, s in enumerate(scores, i):
                    fits = np.flatnonzero(((labels == own_label[row]) == same) & (ids != own[row]))
                    values = s[fits]
                    for t in targets[row]:
                        at, some = fits, values
                        if t["lo"] is not None:
                            inside = (values >= t["lo"]) & (values <= t["hi"])
                            at, some = fits[inside], values[inside]
                        if len(at) > k:
                            best = some >= np.sort(some)[-k]
                            at, some = at[best], some[best]
                        found = sorted((-int(x), int(j)) for x, j in zip(some.tolist(), ids[at].tolist()))
                        out += [(int(own[row]), t["target"], j, -x) for x, j in found[:k]]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], [], []))], schema=schema)

    return run


class DistanceIndex:
    """Rows sorted by (pivot, distance), in rings of about as many rows each.

    Pivots are fitted on a sample of SAMPLE rows; every row is indexed.  `rings` has the bounds
    of each ring and in how many blocks its rows are dealt, RINGS[1] rows a pivot at most.
    """

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        rows = stored(rows, "negatives-rows")
        found = rows.agg(F.count("*"), F.max("n2"), F.max(F.size("v"))).first()
        self.count, self.most, self.width = found[0], found[1] or 0.0, found[2] or 0
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v", "n2").toArrow()
        lists = sample.column("v").combine_chunks()
        points = _augmented(lists, np.asarray(sample.column("n2")), self.width, self.most) if len(lists) else np.zeros((0, self.width + 1))
        self.pivots = fit_pivots(points, PIVOTS)
        keyed = rows.mapInArrow(_keys(self.pivots, self.width, self.most), INDEX)
        number = min(max(RINGS[0], math.ceil(self.count / (len(self.pivots) * BLOCK))), RINGS[1])
        keyed = stored(keyed, "negatives-keys")
        cuts = keyed.groupBy("pivot").agg(F.percentile_approx("dist", [i / number for i in range(1, number)], F.lit(100 * number)).alias("cuts"))
        ringed = keyed.join(F.broadcast(cuts), "pivot")  # a row for each pivot
        ringed = ringed.withColumn("ring", F.aggregate("cuts", F.lit(0), lambda s, x: s + F.when(x < F.col("dist"), 1).otherwise(0))).drop("cuts")
        rings = ringed.groupBy("pivot", "ring").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.ceil(F.count("*") / F.lit(BLOCK)).alias("parts"))
        self.rings = stored(rings, "negatives-rings")
        self.rows = stored(ringed.repartitionByRange("pivot", "dist").sortWithinPartitions("pivot", "dist"), "negatives-index")
        self.spark = spark

    @property
    def margin(self) -> float:
        """What distances may be rounded by, and more."""
        return 1e-6 * (math.sqrt(self.most) + 1)

    def radius(self, score: Column, n2: Column) -> Column:
        """The distance at which a row has this score; infinite for none."""
        square = F.greatest(F.lit(0.0), n2 + F.lit(self.most) - 2 * score.cast("double"))  # greatest() passes over nulls
        return F.when(score.isNull(), F.lit(float("inf"))).otherwise(F.sqrt(square) + F.lit(self.margin))

    def anchors(self, condition: Column) -> DataFrame:
        asked = self.rows.filter(condition).select("id", "label", "v", "n2")
        return stored(asked.mapInArrow(_from_pivots(self.pivots, self.width), "id long, label long, v array<long>, n2 double, d array<double>"), "negatives-anchors")

    def _visits(self, asked: DataFrame, reach: DataFrame) -> DataFrame:
        """(id, pivot, ring, parts): the rings that come within reach for the first time.

        A row's distance from an anchor is at least the difference of their distances from the
        row's pivot, and half of how much farther that pivot is than the anchor's nearest one.
        """
        rows = asked.join(if_small(reach), "id").select("id", "old", "new", F.array_min("d").alias("near"), F.posexplode("d").alias("pivot", "at"))
        least = F.greatest(F.lit(0.0), F.col("lo") - F.col("at"), F.col("at") - F.col("hi"), (F.col("at") - F.col("near")) / 2)
        rows = rows.join(F.broadcast(self.rings), "pivot").withColumn("least", least)
        return rows.filter("least > old AND least <= new").select("id", "pivot", "ring", "parts")

    def _look(self, asked: DataFrame, targets: DataFrame, visits: DataFrame, k: int, same: bool, groups: int) -> DataFrame:
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1 if isinstance(n, str) else F.lit(n - 1).cast("long")))
        dealt = F.pmod(F.xxhash64(F.lit("group"), "id"), F.lit(groups))
        left = asked.select("id", "label", "v").join(targets, "id").join(visits, "id")
        left = left.select("id", "label", "v", "targets", "pivot", "ring", dealt.alias("group"), every("parts").alias("part"))
        here = F.broadcast(visits.select("pivot", "ring", "parts").distinct())  # rings at most
        right = self.rows.join(here, ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), "parts"))
        right = right.select("id", "label", "v", "pivot", "ring", "part", every(groups).alias("group"))
        by = ["pivot", "ring", "part", "group"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_scan(k, same), "id long, target long, other long, score long")

    def search(self, asked: DataFrame, targets: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best rows of each target: (id, target, other, score, rank), ties to the smaller id.

        asked: anchors().  targets: (id, target, lo, hi), scores of which only those from lo to
        hi count, null for all.  Only rows of the anchor's label count if `same`, of other labels if not.

        An anchor first looks at the rings that its own key is in.  The distance of the k-th best
        row found, or of the lowest score that counts, bounds what must still be searched: rings
        within it are scanned, and then nothing beyond can be among the best.
        """
        targets = stored(targets, "negatives-targets")
        groups = max(1, math.ceil(asked.count() / ANCHORS))
        of = targets.groupBy("id").agg(F.collect_list(F.struct("target", "lo", "hi")).alias("targets"))
        step = self.rings.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 1.0
        reach = targets.select("id").distinct().select("id", F.lit(-1.0).alias("old"), F.lit(self.margin).alias("new"))
        best, round_ = None, 0
        order = Window.partitionBy("id", "target").orderBy(F.col("score").desc(), "other")
        while True:
            reach = stored(reach, "negatives-reach")
            if best is not None and reach.isEmpty():
                return best
            visits = stored(self._visits(asked, reach), "negatives-visits")
            found = self._look(asked, of, visits, k, same, groups)
            found = found if best is None else found.unionByName(best.drop("rank"))
            best = stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "negatives-best")
            last = best.filter(F.col("rank") == k).select("id", "target", F.col("score").alias("last"))
            bound = targets.join(last, ["id", "target"], "left").join(asked.select("id", "n2"), "id")
            bound = bound.groupBy("id").agg(F.max(self.radius(F.coalesce("last", "lo"), F.col("n2"))).alias("bound"))
            grown = F.lit(step * 2**round_) if round_ < TRIES else F.lit(float("inf"))
            new = F.when(F.col("bound") < float("inf"), F.col("bound")).otherwise(grown)
            reach = reach.join(bound, "id").filter(F.col("bound") > F.col("new")).select("id", F.col("new").alias("old"), new.alias("new"))
            round_ += 1


def hard_negatives(
    table: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Rows of other labels that score nearly as high as an anchor's positives.

    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).  Vectors count
    as integers floor(scale * x), a row's score is its inner product with the anchor.  `anchors`
    is a condition on id.  Positives of an anchor are its best rows of the same label; for each,
    the best rows of other labels with low * positive_score <= 100 * negative_score <= high *
    positive_score are returned.  Ties go to the smaller id; where there are fewer, all are returned.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part.
    Of rows that share an id the first by label and vector counts.  An empty vector scores 0, a
    shorter one counts as filled up with zeros.  Scores beyond 64 bits raise an error.  An empty
    table gives an empty one; other columns are not read.
    """
    index = DistanceIndex(usable(table, scale, id_col, vector_col, label_col))
    asked = index.anchors(anchors)
    none = F.lit(None).cast("long")
    liked = index.search(asked, asked.select("id", F.lit(0).cast("long").alias("target"), none.alias("lo"), none.alias("hi")), positives, True)
    least, most = (F.lit(p).cast("long") * F.col("score") for p in (low, high))
    hundred = F.lit(100).cast("long")
    bounds = liked.withColumns({"_lo": least + F.pmod(-least, hundred), "_hi": most - F.pmod(most, hundred)}).select(
        "id", F.col("other").alias("target"), F.expr("_lo div 100").alias("lo"), F.expr("_hi div 100").alias("hi"))
    found = index.search(asked, bounds.filter("lo <= hi"), negatives, False)
    scores = liked.select("id", F.col("other").alias("target"), F.col("score").alias("positive_score"))
    return found.join(scores, ["id", "target"]).select(
        F.col("id").alias("anchor_id"), F.col("target").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
