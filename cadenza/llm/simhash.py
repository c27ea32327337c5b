"""SimHash near-duplicates by segment-popcount embedding and a grid join under Manhattan distance."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import blocks, connected_components, if_small, lower_hex, settled, stored

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
#: Fingerprints that one task compares with each other at most.
BLOCK = 4096

#: The 32 segments of 2 bits in groups of neighbours, so many at least and at most; see grid_cells().
GROUPS = 6, 12
PAIRS = 0x5555555555555555


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a UTF-8 text, signed: bit i is set if it is in over half of the shingles' XXH64."""
    tokens = text.lower().split()  # both: ASCII only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(lengths + 1) - 1
        begins = (ends - lengths)[: 1 - words].tolist()
        shingles = [joined[b:e] for b, e in zip(begins, ends[words - 1 :].tolist())]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, out = batch.column("text").cast(pa.large_binary()), []
        for i in range(0, len(texts), 128):
            out += [fingerprint(t or b"") for t in texts.slice(i, 128).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.int64())], names=["doc_id", "fp"])


def embedding(fp):
    """The 32 bit counts (0 to 2) of a fingerprint's 2-bit segments, packed in the same places.
    Their Manhattan distance is at most the fingerprints' Hamming distance."""
    half = F.shiftrightunsigned(fp, 1)
    both, one = fp.bitwiseAND(half).bitwiseAND(F.lit(PAIRS)), fp.bitwiseXOR(half).bitwiseAND(F.lit(PAIRS))
    return F.shiftleft(both, 1).bitwiseOR(one)


def grid_groups(count: int) -> int:
    """In how many groups to deal the segments for so many fingerprints: as few as leave about one
    of them in a cell, as a segment that two must share tells apart 1.5 bits."""
    least, most = GROUPS
    return next((g for g in range(least, most) if count <= 2 ** (1.5 * 32 * (g - MAX_BITS) / g)), most)


def grid_cells(fps: DataFrame, groups: int) -> DataFrame:
    """(cell, fp): the grid cells in which a fingerprint can meet others.

    A Manhattan distance of at most 3, shared out over groups of segments, leaves all but 3
    groups at distance 0.  Two such embeddings thus have the same coordinates in at least one of
    the sub-grids of all but 3 groups (20 of 6 groups); each fingerprint stands in one cell of each.
    """
    bounds = [round(32 * g / groups) * 2 for g in range(groups + 1)]
    masks = [((1 << hi) - 1) & ~((1 << lo) - 1) for lo, hi in itertools.pairwise(bounds)]
    grids = [sum(m) for m in itertools.combinations(masks, groups - MAX_BITS)]
    signed = [m - (1 << 64) if m >> 63 else m for m in grids]
    cells = [F.xxhash64(F.lit(i), F.col("e").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)]
    return fps.withColumn("e", embedding(F.col("fp"))).select(F.explode(F.array(*cells)).alias("cell"), "fp")


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of fingerprints -> links that connect all that are within MAX_BITS, and no others.

    A search goes out from each fingerprint to those not yet reached: the Manhattan distance of
    the embeddings comes first, as it is a lower bound, then the exact distance.
    """
    two = np.uint64(3)
    shifts = np.arange(0, 64, 2, dtype=np.uint64)
    for batch in batches:
        a, b = [], []
        for fps in batch.column("fps").to_pylist():
            fp = np.array(fps, np.int64).view(np.uint64)
            e = fp - ((fp >> np.uint64(1)) & np.uint64(PAIRS))
            counts = ((e[:, None] >> shifts) & two).astype(np.int8)
            left = np.arange(len(fp))
            while len(left) > 1:
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    x = queue.pop()
                    near = np.abs(counts[left] - counts[x]).sum(axis=1, dtype=np.int16) <= MAX_BITS
                    near[near] = np.bitwise_count(fp[left[near]] ^ fp[x]) <= MAX_BITS
                    found, left = left[near], left[~near]
                    queue += found.tolist()
                    a += [fps[x]] * len(found)
                    b += [fps[y] for y in found.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect all within MAX_BITS of each other.

    Cells of two give their pair directly.  The members of fuller cells are compared in blocks
    of at most BLOCK, and only the links of a search tree are emitted, never all pairs.
    """
    cells = grid_cells(fps, grid_groups(fps.count()))
    full = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    full = stored(full, "simhash-cells")
    two = full.filter("n = 2").select("a", "b").filter(F.bit_count(F.expr("a ^ b")) <= MAX_BITS)
    more = blocks(cells.join(full.filter("n > 2").select("cell", "n"), "cell"), "cell", "n", "fp", BLOCK)
    more = more.groupBy("block").agg(F.collect_set("fp").alias("fps")).select("fps")
    return two.union(more.mapInArrow(_trees, "a long, b long")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of near-duplicate documents: (doc_id, fp, component_id), one row for each row.

    fp is the SimHash of the text's shingles as a signed long; documents are linked if their
    fingerprints differ in at most 3 bits, and component_id is the smallest id reachable.

    A null, empty or wordless text has fingerprint 0 and is linked like any other.  Repeated
    rows stay.  Null ids stay null and are never the smallest; a component of null ids alone has
    a null component_id.  An empty table gives an empty one; other columns are not read.
    Copies collapse to one fingerprint before anything is compared.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stored(rows.mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash-docs")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-fps")
    parts = connected_components(stored(fingerprint_links(fps.select("fp")), "simhash-links"))
    parts = parts.select(F.col("node").alias("fp"), "component")
    linked = stored(fps.join(parts, "fp"), "simhash-linked")
    least = stored(linked.groupBy("component").agg(F.min("first").alias("component_id")), "simhash-least")
    linked = linked.join(if_small(least), "component").select("fp", "component_id")
    named = fps.join(if_small(linked), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(if_small(stored(named, "simhash-named")), "fp").select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The documents with one of each group: that of the smallest id.  Columns of docs.

    Rows that share the smallest id of a group all stay, and so do rows without an id.
    """
    out = lambda: near_duplicates(docs, id_col, **kw).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = if_small(settled(out, "simhash-gone"))
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", lower_hex(F.col("fp")).alias("fingerprint"), "component_id")
