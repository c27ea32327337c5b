"""Fuzzy line deduplication: MinHash of character shingles, banding, exact Jaccard, components."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bounded_batches, carried, connected_components, discard, having, if_small, release, settled, shuffle_partitions, sieved, stored

#: Characters of a shingle.  A changed character touches as many shingles: longer ones would lose near copies of short lines.
SHINGLE = 5
SIMILARITY = 0.8
#: Lines of similarity s meet in a band with probability 1 - (1 - s^ROWS)^BANDS: 0.994 at 0.8.
#: Unrelated lines of a language share some runs of five (0.03 on average here, seldom over 0.1):
#: with each row more, a tenth as many of them meet, and their number grows with the table's square.
BANDS, ROWS = 22, 7
#: What one task compares with each other at most: a line counts 1, and 1 more for each 1,024 characters.
BLOCK, UNIT = 2048, 1024
#: Blocks of up to so many lines are compared pair by pair, larger ones by an inverted index.
FEW = 32
#: Seeds of a line's two hashes, those of xxhash64(line) and xxhash64(1, line) in SQL.
SEEDS = 42, xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)

#: Bands that are counted together, by one group of a task, and lines whose bands a task sends at a time.
SHARD, _FLUSH = 1 << 20, 1 << 15

_BINS = BANDS * ROWS
_EMPTY = np.uint32(0xFFFFFFFF)
#: Signatures with at most so many filled bins fill the others by rank, those with more by trial.
_SPARSE = 32
#: Characters and lines hashed at a time; lines that a task remembers.
_CHARS, _LINES, _SEEN = 1 << 16, 1 << 12, 200_000

# For each bin a random order of all bins; and the place of each bin in that order.
_ORDER = np.random.default_rng(42).permuted(np.tile(np.arange(_BINS), (_BINS, 1)), axis=1)
_RANK = np.argsort(_ORDER, axis=1).astype(np.uint16)
_TRIALS = _ORDER.T.copy()


def _filled(least: np.ndarray) -> np.ndarray:
    """Signatures whose empty bins take the value of another one: of the first that is not empty in
    the bin's own random order, which is the same for all lines."""
    full = least != _EMPTY
    counts = full.sum(axis=1)
    out = least.copy()
    for m in np.unique(counts[counts <= _SPARSE]).tolist():
        rows = np.flatnonzero(counts == m)
        bins = np.nonzero(full[rows])[1].reshape(len(rows), m)
        for i in range(0, len(rows), 512):
            some, own = rows[i : i + 512], bins[i : i + 512]
            first = _RANK[:, own].argmin(axis=2).T  # bins by lines by filled bins
            out[some] = np.where(full[some], least[some], np.take_along_axis(least[some], np.take_along_axis(own, first, axis=1), axis=1))
    flat, values, filled = least.ravel(), out.ravel(), full.ravel()
    at = np.flatnonzero(~full & (counts > _SPARSE)[:, None])
    cols = at % _BINS
    begins = at - cols
    for trial in range(_BINS):
        if not len(at):
            break
        source = begins + _TRIALS[trial][cols]
        found = filled[source]
        values[at[found]] = flat[source[found]]
        left = ~found
        at, cols, begins = at[left], cols[left], begins[left]
    return out


def signatures(lines: list[str]) -> np.ndarray:
    """Band hashes of lines: one row for each line, BANDS columns of uint32.

    One permutation serves all of a signature's values: a shingle's hash, a polynomial of its
    SHINGLE code points, names one of BANDS * ROWS bins and the value that it has there, and each
    bin keeps its least.  Two lines agree in a bin with the probability of their similarity.  A
    shorter line counts as one shingle, filled up with line feeds, which no line has.
    """
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\n") for x in lines]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    base = np.uint64(0x9E3779B97F4A7C15)
    n = len(points) - SHINGLE + 1
    codes = points[:n].astype(np.uint64)
    for i in range(1, SHINGLE):
        codes *= base
        codes += points[i : i + n]
    codes ^= codes >> np.uint64(29)
    codes *= np.uint64(0xBF58476D1CE4E5B9)
    codes ^= codes >> np.uint64(32)
    counts = lengths - SHINGLE + 1
    inside = np.ones(n, bool)  # shingles that reach from one line into the next are none
    ends = np.cumsum(lengths)[:-1]
    for i in range(1, SHINGLE):
        inside[ends - i] = False
    codes = codes[inside]
    bins = (codes >> np.uint64(32)).astype(np.uint32)
    bins -= bins // np.uint32(_BINS) * np.uint32(_BINS)
    at = np.repeat(np.arange(len(lines)) * _BINS, counts) + bins
    least = np.full(len(lines) * _BINS, _EMPTY)
    np.minimum.at(least, at, np.minimum(codes.astype(np.uint32), _EMPTY - np.uint32(1)))
    least = _filled(least.reshape(len(lines), _BINS)).astype(np.uint64)
    bands = np.zeros((len(lines), BANDS), np.uint64)
    for r in range(ROWS):
        bands = (bands ^ least[:, r::ROWS]) * base
        bands ^= bands >> np.uint64(31)
    return (bands >> np.uint64(32)).astype(np.uint32)


#: Columns of two band hashes each.
_PAIRS = [f"_b{i}" for i in range(BANDS // 2)]
#: The first character that _coded() and _alike() can't take.
_WIDE = chr(1 << 12)

_PLACES = ", ".join(["_k1 long, _k2 long, _doc long, _line int, _h1 long, _h2 long, _more int", *(f"{c} long" for c in _PAIRS)])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line that has a word: where it stands, its two hashes and how often UNIT characters go
    into it; and its band hashes where the task first meets it, or meets it again after it has
    forgotten what it has seen."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            rows, numbers, hashes, more, new, lines, held, bands = [], [], [], [], [], [], 0, []
            for row, text in enumerate(part.column("_text").to_pylist()):
                for number, line in enumerate((text or "").split("\n")):
                    if line.strip(" \t\r\x0b\x0c"):
                        data = line.encode()
                        own = xxhash.xxh64_intdigest(data, SEEDS[0]), xxhash.xxh64_intdigest(data, SEEDS[1])
                        if own not in seen:
                            seen.add(own)
                            new.append(len(rows))
                            lines.append(line)
                            held += len(line)
                            if held >= _CHARS or len(lines) >= _LINES:
                                bands.append(signatures(lines))
                                lines, held = [], 0
                        rows.append(row)
                        numbers.append(number)
                        hashes.append(own)
                        more.append(len(line) // UNIT)
            if lines:
                bands.append(signatures(lines))
            if len(seen) > _SEEN:
                seen.clear()
            if rows:
                both, pairs = np.array(hashes, np.uint64).view(np.int64), np.zeros((len(rows), len(_PAIRS)), np.int64)
                known = np.ones(len(rows), bool)
                if new:
                    pairs[new], known[new] = np.concatenate(bands).view(np.int64), False
                cols = [part.column(c).take(pa.array(rows, pa.int32())) for c in ("_k1", "_k2", "_doc")]
                cols += [pa.array(numbers, pa.int32()), *(pa.array(both[:, j].copy()) for j in range(2)), pa.array(more, pa.int32())]
                cols += [*(pa.array(pairs[:, j].copy(), mask=known) for j in range(len(_PAIRS)))]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _PLACES.split(", ")])


def _packed(places: np.ndarray) -> bytes:
    """Ascending numbers of less than 48 bits: the low 16 of each in two bytes, the others as unary
    differences, a one for each number and a zero for each step, so that both together take about
    18 to 20 bits a number where they are dense."""
    steps = (places >> 16).astype(np.int64)
    bits = np.zeros(len(places) + (int(steps[-1]) if len(places) else 0), np.uint8)
    bits[np.arange(len(places)) + steps] = 1
    return np.array([len(places)], "<i8").tobytes() + places.astype("<u2").tobytes() + np.packbits(bits).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + 2 * n)))
    return (ones - np.arange(n)) << 16 | np.frombuffer(data, "<u2", n, 8)


def _edges(shards: int) -> list[int]:
    """Where shards begin among the places of bands, and where the last one ends."""
    return [(BANDS << 32) * i // shards for i in range(shards + 1)]


def _sharded(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Band hashes of distinct lines -> for each shard, a range of hashes, the bands in it: those
    met once, packed, and those met more often, with how often.  A band's place is its hash times
    BANDS and its number; it is packed as its distance from the shard's begin."""
    edges = np.array(_edges(shards), np.int64)

    def sent(pairs: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.ascontiguousarray(np.concatenate(pairs)).view(np.uint32)
        places = (hashes.astype(np.int64) * BANDS + np.arange(BANDS)).ravel()
        places.sort()
        first = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
        n = np.diff(first, append=len(places))
        places = places[first]
        ends = np.searchsorted(places, edges).tolist()
        rows = []
        for shard, (a, b) in enumerate(zip(ends, ends[1:])):
            if a < b:
                own, held = places[a:b] - edges[shard], n[a:b]
                rows.append((shard, int(edges[shard]), _packed(own[held == 1]), np.stack((own, held), axis=1)[held > 1].astype("<i8").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "begin", "once", "more"])

    held, lines = [], 0
    for batch in batches:
        held.append(np.stack([np.asarray(c) for c in batch.columns], axis=1))
        lines += batch.num_rows
        if lines >= _FLUSH:
            yield sent(held)
            held, lines = [], 0
    if lines:
        yield sent(held)


def _full(shard: pa.Table) -> pa.Table:
    """The bands of one shard that more than one line has, and how many."""
    places = np.concatenate([_unpacked(x) for x in shard.column("once").to_pylist()])
    places.sort()
    more = np.frombuffer(b"".join(shard.column("more").to_pylist()), "<i8").reshape(-1, 2)
    at = np.flatnonzero(places[1:] == places[:-1])  # two or more that are met once each
    found, which = np.unique(np.concatenate((more[:, 0], places[at])), return_inverse=True)
    count = np.zeros(len(found), np.int64)
    np.add.at(count, which[: len(more)], more[:, 1])
    count += np.searchsorted(places, found, "right") - np.searchsorted(places, found, "left")
    hashes, numbers = np.divmod(found + (shard.column("begin")[0].as_py() if len(found) else 0), BANDS)
    return pa.table({"band": hashes << 8 | numbers, "n": count})


def full_bands(lines: DataFrame) -> DataFrame:
    """(band, n): the bands that n distinct lines have, two or more; a band is named by its hash and
    its number.  Nearly all have one line: to sort packed ones takes a fraction of what an
    aggregate of a row for each does."""
    spark = lines.sparkSession
    shards = max(shuffle_partitions(spark), -(-lines.count() * BANDS // SHARD))
    sent = lines.select(*_PAIRS).mapInArrow(lambda batches: _sharded(batches, shards), "shard int, begin long, once binary, more binary")
    with bounded_batches(spark):
        return stored(sent.groupBy("shard").applyInArrow(_full, "band long, n long"), "lines-bands")


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def _coded(lines: list[str]) -> list[np.ndarray] | None:
    """The shingles of lines as sorted integers, code points of 12 bits each; None if a line has
    others.  A short line is filled up with line feeds."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\n") for x in lines]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if points.max() >> 12:
        return None
    n = len(points) - SHINGLE + 1
    codes = points[:n].copy()
    for i in range(1, SHINGLE):
        codes <<= 12
        codes |= points[i : i + n]
    out, at = [], 0
    for x in padded:  # shingles that reach from one line into the next are none
        own = codes[at : at + len(x) - SHINGLE + 1]
        own.sort()
        first = np.ones(len(own), bool)
        np.not_equal(own[1:], own[:-1], out=first[1:])
        out.append(own[first])
        at += len(x)
    return out


def _similar(shared, one, others):
    """Whether sets of these sizes that share so many members are similar."""
    return shared >= SIMILARITY * (one + others - shared) - 1e-9


def _shared(a, b) -> int:
    """How many members two sets share, which are sets or sorted arrays of distinct integers."""
    if isinstance(a, set):
        return len(a & b)
    both = np.concatenate((a, b))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _alike(lines: list[str]) -> np.ndarray:
    """For lines of code points of 12 bits, the first with the second, the third with the fourth and so
    on: whether they are similar.  A pair's shingles are sorted together, by code and line."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\n") for x in lines]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    codes = points.copy()
    for i in range(1, SHINGLE):
        codes[: len(codes) - i] = codes[: len(codes) - i] << 12 | points[i:]
    for i in range(1, SHINGLE):  # shingles that reach from one line into the next are none
        codes[ends - i] = codes[starts]
    codes = codes << 1 | np.repeat(np.arange(len(lines)) & 1, lengths)
    starts = starts[::2]
    for a, b in zip(starts.tolist(), ends[1::2].tolist()):
        codes[a:b].sort()
    new, both = np.ones(len(codes), bool), np.zeros(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    np.equal(codes[1:], codes[:-1] | 1, out=both[1:])
    both &= new
    new[starts], both[starts] = True, False
    shared = np.add.reduceat(both.astype(np.int64), starts)
    return _similar(shared, np.add.reduceat(new.astype(np.int64), starts), 0)


def _few(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Links of a small block, found by intersecting sets of about the same size."""
    coded = _coded(lines)
    sets = list(map(shingles, lines)) if coded is None else coded
    left = list(range(len(sets)))
    while len(left) > 1:
        queue = [left.pop(0)]
        while queue and left:
            x = queue.pop()
            mine, size = sets[x], len(sets[x])
            found = [
                y for y in left
                if _similar(min(size, len(sets[y])), size, len(sets[y])) and _similar(_shared(mine, sets[y]), size, len(sets[y]))]
            if found:
                left = [y for y in left if y not in found]
                queue += found
                yield from ((x, y) for y in found)


def _indexed(lines: list[str]) -> tuple[np.ndarray, Callable[[int], np.ndarray]]:
    """How many shingles each line of a block has, and a function that gives how many a line shares
    with each, from the block's inverted index at once."""
    number: dict[str, int] = {}
    if (coded := _coded(lines)) is None:
        ids = [np.array([number.setdefault(s, len(number)) for s in shingles(x)], np.int64) for x in lines]
        flat, count = np.concatenate(ids), len(number)
    else:
        known, flat = np.unique(np.concatenate(coded), return_inverse=True)
        ids, count = np.split(flat, np.cumsum([len(x) for x in coded])[:-1]), len(known)
    sizes = np.array([len(x) for x in ids])
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[np.argsort(flat, kind="stable")]
    held = np.bincount(flat, minlength=count)
    begins = np.cumsum(held) - held

    def shared(x: int) -> np.ndarray:
        counts = held[ids[x]]
        out = np.zeros(len(ids), np.int64)
        for i in range(0, len(counts), 4096):
            some = counts[i : i + 4096]
            places = np.repeat(begins[ids[x][i : i + 4096]] - np.cumsum(some) + some, some) + np.arange(some.sum())
            out += np.bincount(owner[places], minlength=len(ids))
        return out

    return sizes, shared


def _many(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Links of a large block, by its inverted index."""
    sizes, shared = _indexed(lines)
    free = np.ones(len(sizes), bool)
    for start in range(len(sizes)):
        if not free[start]:
            continue
        free[start] = False
        queue = [start]
        while queue and free.any():
            x = queue.pop()
            found = np.flatnonzero(free & _similar(shared(x), sizes[x], sizes))
            free[found] = False
            queue += found.tolist()
            yield from ((x, y) for y in found.tolist())


def _across(lines: list[str], classes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of lines that are dealt into classes, numbered from 0: of those between classes as many as
    connect all that any such link connects.  Lines of the smaller of two classes are looked up
    among those of the larger one."""
    sizes, shared = _indexed(lines)
    counts = np.bincount(classes)
    part, later = np.arange(len(counts)), np.ones(len(sizes), bool)
    for c in np.argsort(counts, kind="stable")[:-1].tolist():
        own = np.flatnonzero(classes == c)
        later[own] = False
        free = later & (part[classes] != part[c])
        for x in own.tolist():
            if not free.any():
                break
            found = np.flatnonzero(free & _similar(shared(x), sizes[x], sizes)).tolist()
            for y in found:
                if part[classes[y]] != part[c]:
                    part[part == part[classes[y]]] = part[c]
                    yield x, y
            if found:
                free &= part[classes] != part[c]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of lines -> a link from each line to the first one, by its hashes, of those that links of
    Jaccard similarity SIMILARITY lead to within the group.

    A search goes out from each line to those not yet reached.
    """
    for batch in batches:
        lists = batch.column("lines")
        ends, flat = np.asarray(lists.offsets).tolist(), lists.values
        texts, h1, h2 = flat.field("line"), *(np.asarray(flat.field(c)) for c in ("_h1", "_h2"))
        a, b, linked, pairs, held, size = [], [], [], [], [], 0
        for begin, end in zip(ends, ends[1:]):
            lines, trees = texts.slice(begin, end - begin).to_pylist(), {}
            if len(lines) == 2 and all(x.isascii() or max(x) < _WIDE for x in lines):
                pairs.append(begin)
                held += lines
                size += len(lines[0]) + len(lines[1])
                if size >= _CHARS:
                    linked += itertools.compress(pairs, _alike(held))
                    pairs, held, size = [], [], 0
                continue
            for x, y in (_few if len(lines) <= FEW else _many)(lines):
                # x was reached before y, and what is reached from one start comes before the next start
                root = trees.setdefault(x, [x]) if x not in trees else trees[x]
                root.append(y)
                trees[y] = root
            for tree in {id(t): t for t in trees.values()}.values():
                own = sorted(((h1[begin + x], h2[begin + x], begin + x) for x in tree))
                a += [x for _, _, x in own[1:]]
                b += [own[0][2]] * (len(own) - 1)
        if pairs:
            linked += itertools.compress(pairs, _alike(held))
        for x in linked:
            first = x + ((h1[x + 1], h2[x + 1]) < (h1[x], h2[x]))
            a.append(2 * x + 1 - first)
            b.append(first)
        yield pa.RecordBatch.from_arrays([pa.array(h[i]) for i in (np.array(a, int), np.array(b, int)) for h in (h1, h2)], names=["a1", "a2", "b1", "b2"])


def _bridges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of lines, each with its class (_r1, _r2) -> links of classes that have similar lines."""
    for batch in batches:
        lists = batch.column("lines")
        ends, flat = np.asarray(lists.offsets).tolist(), lists.values
        texts, r1, r2 = flat.field("line"), *(np.asarray(flat.field(c)) for c in ("_r1", "_r2"))
        a, b = [], []
        for begin, end in zip(ends, ends[1:]):
            _, classes = np.unique(np.stack((r1[begin:end], r2[begin:end]), axis=1), axis=0, return_inverse=True)
            for x, y in _across(texts.slice(begin, end - begin).to_pylist(), classes.ravel()):
                a.append(begin + x)
                b.append(begin + y)
        yield pa.RecordBatch.from_arrays([pa.array(r[i]) for i in (np.array(a, int), np.array(b, int)) for r in (r1, r2)], names=["a1", "a2", "b1", "b2"])


def line_links(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct lines (_h1, _h2, _more, _b0 ...) and texts (_h1, _h2, line) of all lines -> links (a, b)
    that connect all similar lines that share a band, and none that similar ones don't connect; a
    line is named by struct(_h1, _h2).

    Lines meet in the buckets of their bands.  Buckets are counted first, so that the many of one
    line alone go no further.  Those that share lines are put together: nearly all lines that
    share a bucket are similar, so that a component of buckets is seldom more than the lines that
    a single task compares, and each line's text is fetched for it once, not for each bucket.  The
    buckets of a larger component are compared by themselves, see _bucket_links().  Until texts are fetched one hash
    stands for a line: should two share it, both are fetched.
    """
    return _member_links(_members(lines), texts)


def _members(lines: DataFrame) -> DataFrame:
    """(band, n, _h1, _more): the lines of all bands that n of them share."""
    low, named = F.lit((1 << 32) - 1), lambda h, i: F.shiftleft(h, 8).bitwiseOR(F.lit(i).cast("long"))
    bands = [x for i, c in enumerate(_PAIRS) for x in (
        named(F.col(c).bitwiseAND(low), 2 * i), named(F.shiftrightunsigned(c, 32), 2 * i + 1))]
    rows = lines.select("_h1", "_more", F.explode(F.array(*bands)).alias("band"))
    release(lines.sparkSession)
    full = full_bands(lines)
    release(lines.sparkSession)
    return stored(having(rows, full, "band"), "lines-members")


def _near(members: DataFrame) -> DataFrame:
    """(_h1, part): the lines that buckets connect, part being the least of them."""
    ends = stored(members.groupBy("band").agg(F.min("_h1").alias("a"), F.max("_h1").alias("z")), "lines-ends")
    edges = members.join(if_small(ends.filter("a < z").select("band", "a")), "band").select("a", F.col("_h1").alias("b"))
    near = stored(connected_components(edges).select(F.col("node").alias("_h1"), F.col("component").alias("part")), "lines-near")
    alone = ends.filter("a = z").select(F.col("a").alias("_h1"), F.col("a").alias("part"))
    if alone.isEmpty():
        return near
    return stored(near.union(alone.distinct().join(near, "_h1", "left_anti")), "lines-near")


def _member_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    near = _near(members)
    long = stored(members.filter("_more > 0").groupBy("_h1").agg(F.max("_more").alias("more")), "lines-long")
    weighed = near.join(if_small(long), "_h1", "left").groupBy("part").agg(F.sum(F.lit(1) + F.coalesce("more", F.lit(0))).alias("weight"))
    heavy = stored(weighed.filter(F.col("weight") > BLOCK).select("part"), "lines-heavy")
    if heavy.isEmpty():
        return _compared(having(texts, near, "_h1"), "part")
    light = stored(near.join(if_small(heavy), "part", "left_anti"), "lines-light")
    rest = near.join(if_small(heavy), "part").select("_h1")
    rest = stored(members.join(if_small(stored(rest, "lines-rest")), "_h1"), "lines-rest")
    return _compared(having(texts, light, "_h1"), "part").union(_bucket_links(rest, long, texts))


def _bucket_links(members: DataFrame, long: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of lines whose buckets are compared by themselves, in blocks of bounded size.

    To compare each two parts of a bucket takes blocks, and gives links, by the square of its size.
    So each line is first compared in its fullest bucket alone, with the lines of its part and of
    a small first part that all parts meet: what is linked there is a class.  Then buckets of
    several classes are compared so, between classes only.  Lines of those buckets that still have
    several, and more lines than a block, meet all others but those of the largest class, which
    don't meet each other.
    """
    weight = F.lit(1) + F.coalesce("more", F.lit(0))
    members = stored(members.join(if_small(long), "_h1", "left").select("band", "n", "_h1", weight.alias("weight")), "lines-weighed")
    homes = members.groupBy("_h1").agg(F.max(F.struct("n", "band")).alias("_home"), F.max("weight").alias("weight"))
    homes = stored(homes.select("_home.band", "_h1", "weight"), "lines-homes")
    found = stored(having(texts, homes.select("_h1"), "_h1").dropDuplicates(["_h1", "_h2"]), "lines-texts")
    first = F.pmod(F.xxhash64(F.lit("first"), "_h1"), F.ceil(F.col("whole") * 4 / F.lit(BLOCK))) == 0
    links = stored(_compared(_blocks(homes, first).join(if_small(found), "_h1"), "block"), "lines-home-links")
    own = stored(found.select(F.struct("_h1", "_h2").alias("a"), F.struct("_h1", "_h2").alias("root")), "lines-own")
    classes = _classes(own, "a", links)
    bridges = stored(_class_links(members, classes, found, first), "lines-bridges")
    classes = _classes(classes, "root", bridges)
    rest = _class_links(members, classes, found, F.col("root") != F.col("main"), BLOCK)
    return classes.filter("a != root").select("a", F.col("root").alias("b")).union(rest)


def _classes(named: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """(a, root): lines and their classes, after links of `key` have put some together."""
    parts = stored(connected_components(links).select(F.col("node").alias(key), "component"), "lines-merged")
    return stored(named.join(if_small(parts), key, "left").select("a", F.coalesce("component", "root").alias("root")), "lines-classes")


def _class_links(members: DataFrame, classes: DataFrame, found: DataFrame, hub: Column, above: int = 0) -> DataFrame:
    """Links (a, b) of classes that have similar lines in a bucket of several classes, of more weight than
    `above`.  hub: see _blocks()."""
    placed = members.join(if_small(classes.select("a._h1", "root")), "_h1")
    shares = placed.groupBy("band", "root").agg(F.sum("weight").alias("own"))
    mixed = shares.groupBy("band").agg(F.max(F.struct("own", "root")).alias("main"), F.sum("own").alias("all"), F.count("*").alias("n"))
    mixed = stored(mixed.filter((F.col("n") > 1) & (F.col("all") > above)).select("band", F.col("main.root").alias("main")), "lines-mixed")
    rows = stored(placed.drop("n").join(if_small(mixed), "band"), "lines-mixed")
    texts = found.join(if_small(classes.select("a._h1", "a._h2", F.col("root._h1").alias("_r1"), F.col("root._h2").alias("_r2"))), ["_h1", "_h2"])
    lines = _blocks(rows, hub).join(texts, "_h1").groupBy("block").agg(F.collect_set(F.struct("_h1", "_h2", "_r1", "_r2", "line")).alias("lines"))
    return _ends(lines.select("lines").mapInArrow(_bridges, "a1 long, a2 long, b1 long, b2 long"))


def _blocks(members: DataFrame, hub: Column) -> DataFrame:
    """(block, _h1): the lines (band, _h1, weight) of each bucket in blocks of a weight of about BLOCK, equal
    blocks once.

    A heavier bucket is cut by hash into parts of half a block, those of its hubs and those of other
    lines; a block is two parts, one of them of hubs.  hub may read `whole`, the bucket's weight.
    """
    whole = stored(members.groupBy("band").agg(F.sum("weight").alias("whole")).filter(F.col("whole") > BLOCK), "lines-whole")
    light = members.join(if_small(whole), "band", "left_anti").select(F.col("band").alias("block"), "_h1")
    heavy = members.join(if_small(whole), "band").withColumn("_hub", hub)
    count = lambda x: F.ceil(F.coalesce(F.sum(x), F.lit(0)) * 2 / F.lit(BLOCK)).cast("int")
    parts = heavy.groupBy("band").agg(
        F.greatest(count(F.when(F.col("_hub"), F.col("weight"))), F.lit(1)).alias("_hubs"), count(F.when(~F.col("_hub"), F.col("weight"))).alias("_others"))
    heavy = heavy.join(if_small(stored(parts, "lines-parts")), "band")
    place = F.xxhash64(F.lit("part"), "_h1")
    own = F.when(F.col("_hub"), F.pmod(place, F.col("_hubs"))).otherwise(F.col("_hubs") + F.pmod(place, F.col("_others"))).cast("int")
    last = F.when(F.col("_hub"), F.col("_hubs") + F.col("_others") - 1).otherwise(F.col("_hubs") - 1)
    heavy = heavy.withColumn("_own", own).withColumn("_other", F.explode(F.array_remove(F.sequence(F.lit(0), last), F.col("_own"))))
    heavy = heavy.select(F.xxhash64("band", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("block"), "_h1")
    sets = light.union(heavy).groupBy("block").agg(F.array_sort(F.collect_set("_h1")).alias("set")).filter(F.size("set") > 1).select("set").distinct()
    sets = stored(sets.select(F.struct(*long_hash(F.col("set"))).alias("block"), "set"), "lines-blocks")
    release(members.sparkSession)
    return sets.select("block", F.explode("set").alias("_h1"))


def _compared(placed: DataFrame, group: str) -> DataFrame:
    """Links (a, b) of the lines (_h1, _h2, line) of each group, any of which may come again."""
    lines = placed.groupBy(group).agg(F.collect_set(F.struct("_h1", "_h2", "line")).alias("lines"))
    return _ends(lines.select("lines").mapInArrow(_trees, "a1 long, a2 long, b1 long, b2 long"))


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.struct(F.col("a1").alias("_h1"), F.col("a2").alias("_h2")).alias("a"), F.struct(F.col("b1").alias("_h1"), F.col("b2").alias("_h2")).alias("b"))


def _once(lines: DataFrame, again: DataFrame) -> DataFrame:
    """(_h1, _h2, _more, _b0 ...): each distinct line once.  Several tasks may have met a line and given its
    bands; only those that come again can be among them, and the others need no shuffle."""
    met = sieved(lines.filter(F.col(_PAIRS[0]).isNotNull()).select("_h1", "_h2", "_more", *_PAIRS), again, "_h1")
    met = met.withColumnRenamed("_maybe", "_again")
    several = stored(met.filter("_again").drop("_again").dropDuplicates(["_h1", "_h2"]), "lines-met")
    return met.filter("NOT _again").drop("_again").union(several)


def long_hash(*cols: Column) -> tuple[Column, Column]:
    """128 bits that name a row, as two longs."""
    return F.xxhash64(*cols).alias("_k1"), F.xxhash64(F.lit(1), *cols).alias("_k2")


def repeated_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_k1, _k2, _drop array<int>): the lines that go, for each document that loses some.

    _k1 and _k2 are long_hash() of the document's id and text.  Each distinct line is counted; of all
    lines only those that come again, or are similar to others, are looked up once more, and
    the first place of each group of them is kept.  Bands are most of what is stored: they are
    neither shuffled with the lines nor kept beyond the search for those that lines share.
    """
    rows = docs.select(
        *long_hash(F.col(id_col), F.col(text_col)), F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    lines = stored(rows.mapInArrow(_lines, _PLACES), "lines")
    again = stored(lines.groupBy("_h1", "_h2").agg(F.count("*").alias("n")).filter("n > 1").select("_h1", "_h2"), "lines-again")
    texts = rows.select(F.explode(F.split("_text", "\n", -1)).alias("line"))
    texts = texts.select(*(h.alias(n) for h, n in zip(long_hash(F.col("line")), ("_h1", "_h2"))), "line")
    members = _members(_once(lines, again))
    places = stored(lines.drop("_more", *_PAIRS), "lines-all")
    discard(lines)
    links = settled(lambda: _member_links(members, texts), "lines-links")
    discard(members)
    parts = stored(connected_components(links), "lines-parts")
    parts = parts.select("node._h1", "node._h2", "component")
    repeated = again.join(parts, ["_h1", "_h2"], "full")
    repeated = stored(repeated.select("_h1", "_h2", F.coalesce("component", F.struct("_h1", "_h2")).alias("_group")), "lines-repeated")
    places = having(places, repeated, "_h1", "_h2")
    places = stored(places.select("_group", F.struct(F.col("_doc").isNull().alias("_none"), "_doc", "_line", "_k1", "_k2").alias("_at")), "lines-places")
    kept = stored(places.groupBy("_group").agg(F.min("_at").alias("_kept")), "lines-kept")
    gone = places.join(if_small(kept), "_group").filter("_at != _kept").select("_at.*")
    return gone.groupBy("_k1", "_k2").agg(F.collect_set("_line").alias("_drop"))


def _without(lines: Column, drop: Column) -> Column:
    """Lines but for those of these numbers, by hashing numbers: in proportion to the lines.  lines
    is a column of its own, as what an element is computed from is computed for each element."""
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without the lines that repeat others: all columns, and n_dropped_lines.

    Lines are equal, or similar if their sets of SHINGLE-character shingles have a Jaccard
    similarity of SIMILARITY or more; each component of similar lines keeps one line, the first
    by id (null last) and place.  Lines without a word stay where they are.

    A null text stays null, and a document whose lines all go has an empty text.  Rows equal in
    id and text count as one document: a line kept in one is kept in all of them.  Ids may
    repeat or be null.  An empty table gives an empty one; other columns are carried along, but
    for one named n_dropped_lines, which gives way.
    """
    drop = if_small(settled(lambda: repeated_lines(docs, id_col, text_col), "lines-gone"))
    names = carried(docs, "n_dropped_lines")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *long_hash(F.col(id_col), F.col(text_col)))
    whole = F.col(f"_row.`{text_col}`").cast("string")
    rows = rows.join(drop, ["_k1", "_k2"], "left").withColumn("_lines", F.when(F.col("_drop").isNotNull(), F.split(whole, "\n", -1)))
    text = F.when(F.col("_drop").isNull(), whole).otherwise(_without(F.col("_lines"), F.col("_drop")))
    columns = [text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in names]
    return rows.select(*columns, F.coalesce(F.size("_drop"), F.lit(0)).alias("n_dropped_lines"))
