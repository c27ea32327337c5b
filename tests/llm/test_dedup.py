"""Near-duplicate operators against brute force."""

import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import linededup, simhash
from cadenza.llm.common import blocks, connected_components
from cadenza.storage import scratch_dir

DOCS = "doc_id long, text string, source string, _key string, fp string"


def components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        if linked(a, b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def variants(rnd, n):
    base = [" ".join(rnd.choice(["The", "ÉA", "of", "tion", "ha", "x%d" % rnd.randint(0, 60)]) for _ in range(60)) for _ in range(6)]
    out = []
    for _ in range(n):
        words = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = rnd.choice(["new", "word"])
        out.append(" ".join(words))
    return out


def test_near_duplicates_match_brute_force(spark, sf):
    rnd = random.Random(5)
    texts = variants(rnd, 120) + [None, "", " \n\t", "one", "one two", "a b c", "a b c d " * 3000] + ["same text here again"] * 9
    rows = [(i, t, None, "k", "f") for i, t in enumerate(texts)]
    want = [slow_fingerprint(t) for t in texts]
    near = components(len(texts), lambda a, b: (want[a] ^ want[b]).bit_count() <= 3)
    got = {r["doc_id"]: r for r in simhash.digest(simhash.near_duplicates(spark.createDataFrame(rows, DOCS))).collect()}
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{x:016x}" for x in want]
    assert [got[i]["component_id"] for i in range(len(texts))] == near
    assert len(set(near)) < len(near) - 50
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    want = [slow_fingerprint(t) for t in texts]
    near = components(len(texts), lambda a, b: (want[a] ^ want[b]).bit_count() <= 3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == near


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d", "s", None, None), (None, "a b c d", "s", None, None), (7, "x y z", "s", None, None), (7, "x y z", "s", None, None), (None, "q r s t u", "s", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(map(tuple, simhash.near_duplicates(docs).select("doc_id", "component_id").collect()), key=str)
    assert got == [(7, 7), (7, 7), (None, None), (None, None), (None, None)]
    assert simhash.without_near_duplicates(docs).count() == 5
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.without_near_duplicates(spark.createDataFrame([(1, "a b c d", "s", "k", "f"), (2, "a b c d", "s", "k", "f")], DOCS))
    assert [tuple(r) for r in kept.collect()] == [(1, "a b c d", "s", "k", "f")]


def test_small_blocks_lose_no_link(spark, monkeypatch):
    rnd = random.Random(8)
    monkeypatch.setattr(simhash, "BLOCK", 6)
    fps = list({rnd.getrandbits(64) & 0x3F3F for _ in range(60)})
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    parts = {r["node"]: r["component"] for r in connected_components(simhash.fingerprint_links(frame)).collect()}
    near = components(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    groups = {}
    for i, c in enumerate(near):
        groups.setdefault(c, set()).add(fps[i])
    for members in groups.values():
        assert len({parts.get(x, x) for x in members}) == 1


def test_blocks_let_all_members_meet(spark):
    rows = spark.createDataFrame([(1, 50, i) for i in range(50)] + [(2, 3, i) for i in range(3)], "k long, n long, m long")
    dealt = {}
    for r in blocks(rows, "k", "n", "m", 8).collect():
        dealt.setdefault(r["block"], set()).add(r["m"])
    for a, b in itertools.combinations(range(50), 2):
        assert any(a in s and b in s for s in dealt.values())


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000 + i, 7) for i in range(40)] + [(5, 5)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 100 for i in range(100, 161)} | {1000 + i: 7 for i in range(40)} | {7: 7}


def shingles_of(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def slow_lines(rows):
    lines = [(d, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")]
    sets = [shingles_of(x) for _, _, x in lines]
    part = components(len(lines), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    gone = {(d, i) for (d, i, _), p, k in zip(lines, part, range(len(lines))) if p != k}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def test_dedup_lines_matches_brute_force(spark):
    rnd = random.Random(3)
    pool = variants(rnd, 80) + ["To.", "To.", "é", "short l", "short l ", "  ", ""]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 5)))) for i in range(70)] + [(70, None), (71, ""), (72, "\n\n"), (73, "x" * 50000 + "\nTo.")]
    docs = spark.createDataFrame([(i, t, None, "k", "f") for i, t in rows], DOCS)
    out = linededup.dedup_lines(docs).collect()
    assert {r["doc_id"]: r["text"] for r in out} == slow_lines(rows)
    assert out[0].asDict().keys() == {*docs.columns, "n_dropped_lines"}
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "a line of words\nb", None, None, None), (3, "a line of words\nc", None, None, None), (3, "a line of words\nc", None, None, None)], DOCS)
    assert sorted(r["text"] for r in linededup.dedup_lines(twice).collect()) == ["a line of words\nc", "a line of words\nc", "b"]


def test_dedup_lines_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()} == slow_lines(rows)


def test_dedup_lines_links_short_lines_with_one_edit(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(30):
        line = "".join(rnd.choice("abcdefghij klmnop") for _ in range(70))
        rows += [(2 * i, line), (2 * i + 1, line[:35] + "X" + line[36:])]
    out = linededup.dedup_lines(spark.createDataFrame([(i, t, None, "k", "f") for i, t in rows], DOCS)).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {i: "" if i % 2 else t for i, t in rows}


def test_banding_recall_and_exact_comparison():
    """Nearly all similar lines share a band, short and long, with few and many letters; and both ways to
    compare a block link what brute force does."""
    rnd = random.Random(21)
    pairs = met = 0
    for length in (6, 12, 30, 70, 150, 400, 1500):
        for letters in ("abcdefghijklmnop qrst uvw", "ab cdé", "日本語一二三四五六七八九十"):
            lines = []
            for _ in range(40):
                base = [rnd.choice(letters) for _ in range(length)]
                for edits in range(5):
                    own = list(base)
                    for _ in range(edits * max(1, length // 70)):
                        own[rnd.randrange(length)] = rnd.choice(letters)
                    lines.append("".join(own))
            lines = list(dict.fromkeys(lines))
            sets, bands = [shingles_of(x) for x in lines], linededup.signatures(lines)
            linked = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
            pairs += len(linked)
            met += sum(bool((bands[a] == bands[b]).any()) for a, b in linked)
            some = lines[:60]
            want = components(len(some), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
            for way in (linededup._few, linededup._many):
                links = set(way(some))
                assert components(len(some), lambda a, b: (a, b) in links or (b, a) in links) == want
    assert pairs > 500 and met >= 0.99 * pairs, (met, pairs)


def test_line_hashes_are_those_of_sql(spark):
    rows = spark.createDataFrame([("a line",), ("é日🎉",)], "line string").select("line", *linededup.long_hash(F.col("line"))).collect()
    for line, *own in rows:
        assert [x & (1 << 64) - 1 for x in own] == [xxhash.xxh64_intdigest(line.encode(), s) for s in linededup.SEEDS]


def test_joins_beyond_the_broadcast_limit_give_the_same(spark, monkeypatch):
    from cadenza.llm import common

    rnd = random.Random(5)
    rows = [(i, "\n".join(rnd.choice(["one line of words that comes again", "another line of words here", f"own line number {i} of these"]) for _ in range(4)), None, "k", "f") for i in range(12)]
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted(map(str, linededup.dedup_lines(docs).collect()))
    groups = sorted(map(str, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(map(str, linededup.dedup_lines(docs).collect())) == want
    assert sorted(map(str, simhash.near_duplicates(docs).collect())) == groups


def test_own_columns_replace_those_of_their_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e\na b c d e", "s", "x")], "doc_id long, text string, source string, n_dropped_lines string")
    out = linededup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "source", "n_dropped_lines"] and [tuple(r) for r in out.collect()] == [(1, "a b c d e", "s", 1)]


def test_grids_of_any_number_of_groups_lose_no_link(spark, monkeypatch):
    assert [simhash.grid_groups(n) for n in (1, 1 << 24, 1 << 25, 1 << 40)] == [6, 6, 7, 12]
    rnd = random.Random(9)
    fps = [rnd.getrandbits(63) for _ in range(30)]
    fps = list(dict.fromkeys(fps + [x ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) for x in fps]))
    monkeypatch.setattr(simhash, "grid_groups", lambda n: 9)
    parts = {r["node"]: r["component"] for r in connected_components(simhash.fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect()}
    near = components(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    for i, c in enumerate(near):
        assert parts.get(fps[i], fps[i]) == parts.get(fps[c], fps[c])


def test_bands_are_counted_as_an_aggregate_counts_them(spark, monkeypatch):
    """Bands of lines: many of one line, some of two, one of all, in shards that tasks send in several parts."""
    rnd = np.random.default_rng(5)
    hashes = rnd.integers(0, 1 << 32, (4000, linededup.BANDS), dtype=np.uint64).astype(np.uint32)
    hashes[:1500:2, 3:] = hashes[1:1500:2, 3:]
    hashes[:, 1] = 77
    hashes[0, 0], hashes[1, 21] = 0, (1 << 32) - 1
    want = Counter((int(h) << 8 | i) for row in hashes for i, h in enumerate(row))
    want = sorted((b, n) for b, n in want.items() if n > 1)
    pairs = np.ascontiguousarray(hashes).view(np.int64)
    table = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(pairs)], ", ".join(["_h1 long", *(f"{c} long" for c in linededup._PAIRS)]))
    assert sorted(tuple(r) for r in linededup.full_bands(table.repartition(3)).collect()) == want
    assert linededup.full_bands(table.limit(0)).count() == 0
    monkeypatch.setattr(linededup, "_FLUSH", 500)
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in part.T.copy()], names=linededup._PAIRS) for part in np.split(pairs, 40)]
    sent = pa.Table.from_batches(linededup._sharded(iter(batches), 5))
    assert sent.num_rows == 8 * 5
    got = [linededup._full(sent.filter(pc.equal(sent["shard"], k))) for k in range(5)]
    assert sorted((b, n) for x in got for b, n in zip(x["band"].to_pylist(), x["n"].to_pylist())) == want


def test_bands_of_lines_are_not_kept(spark, monkeypatch):
    """Each line's bands are had once though several tasks met it, only those lines are shuffled with
    their bands, and no table of bands is left when similar lines are compared."""
    folder, own, once = scratch_dir(spark).removeprefix("file:"), linededup._member_links, linededup._once
    tables = lambda: {x for x in os.listdir(folder) if re.fullmatch("cadenza-lines-[0-9a-f]{32}", x)}
    before, left, met = tables(), [], []
    monkeypatch.setattr(linededup, "_member_links", lambda *a: left.append(tables() - before) or own(*a))
    monkeypatch.setattr(linededup, "_once", lambda *a: met.append((a[1].count(), sorted(map(tuple, once(*a).collect())))) or once(*a))
    texts = [f"this line stands in every document of the table\n{chr(97 + i % 26) * 12}{str(i) * 6}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert linededup.dedup_lines(docs).filter("n_dropped_lines > 0").count() == 39
    assert left == [set()]
    (again, rows), = met
    assert again == 1 and len(rows) == len({r[:2] for r in rows}) == 41
    assert all(None not in r for r in rows)


def test_bands_are_sent_in_few_bytes():
    rnd = np.random.default_rng(2)
    pairs = np.ascontiguousarray(rnd.integers(0, 1 << 32, (30_000, linededup.BANDS), dtype=np.uint64).astype(np.uint32)).view(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in pairs.T.copy()], names=linededup._PAIRS)
    for shards in (1, 44):
        once = pa.Table.from_batches(linededup._sharded(iter([batch]), shards))["once"].to_pylist()
        assert sum(map(len, once)) < 2.6 * 30_000 * linededup.BANDS
    for some in ([], [0], [5], [1 << 40, (1 << 40) + 1], [65535, 65536, 1 << 33]):
        assert linededup._unpacked(linededup._packed(np.array(some, np.int64))).tolist() == some


def test_each_text_is_fetched_for_one_group(spark, monkeypatch):
    """Lines that meet in several buckets are compared in one group, but for groups too large for a
    task: these by their buckets, with the same result."""
    placed, own = [], linededup._compared
    monkeypatch.setattr(linededup, "_compared", lambda p, g: placed.append(p.groupBy("_h1", "_h2").agg(F.count_distinct(g).alias("n")).agg(F.sum("n"), F.count("*")).first()) or own(p, g))
    rnd = random.Random(14)
    bases = ["".join(rnd.choice("abcdefghij klmnop") for _ in range(90)) for _ in range(4)]
    lines = [b[:i] + "XY"[i % 2] + b[i + 1 :] for b in bases for i in range(5, 85, 9)]
    rows = [(i, "\n".join(lines[i::12])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()} == slow_lines(rows)
    (groups, met), = placed
    assert groups == met == 36
    monkeypatch.setattr(linededup, "BLOCK", 6)
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()} == slow_lines(rows)
    assert len(placed) == 3


def test_pairs_are_compared_as_sets_of_shingles():
    rnd = random.Random(4)
    lines = []
    for _ in range(600):
        base = [rnd.choice(rnd.choice(["ab é", "abcdefgh ijklmn"])) for _ in range(rnd.choice([1, 2, 4, 5, 6, 9, 30, 200]))]
        other = list(base)
        for _ in range(rnd.randint(0, 3)):
            other[rnd.randrange(len(other))] = rnd.choice(["x", "yz", "é"])
        lines += ["".join(base), "".join(other)]
    want = [5 * len(shingles_of(a) & shingles_of(b)) >= 4 * len(shingles_of(a) | shingles_of(b)) for a, b in zip(lines[::2], lines[1::2])]
    assert linededup._alike(lines).tolist() == want and 100 < sum(want) < 500


def test_signatures_fill_empty_bins_alike_by_rank_and_by_trial(monkeypatch):
    """Lines with a few more or less than _SPARSE filled bins are comparable: bins that are filled stay."""
    rnd = random.Random(6)
    lines = ["".join(rnd.choice("abcdefgh ijkl") for _ in range(n)) for n in range(5, 60)]
    ranked = linededup.signatures(lines)
    monkeypatch.setattr(linededup, "_SPARSE", 0)
    assert (linededup.signatures(lines) == ranked).all()


def test_finished_components_are_not_joined_again(spark, monkeypatch):
    """A long path takes several steps; 400 pairs beside it, which are stars from the start, take none."""
    from cadenza.llm import common

    met, own = [], common.if_small
    monkeypatch.setattr(common, "if_small", lambda df, *a: met.append(df.count() if df.columns == ["u", "m"] else 0) or own(df, *a))
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000 + 2 * i, 1001 + 2 * i) for i in range(400)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 100 for i in range(100, 161)} | {1000 + i: 1000 + i // 2 * 2 for i in range(800)}
    assert sum(x > 0 for x in met) >= 4 and max(met) <= 61, met


def test_links_of_a_large_group_grow_with_its_lines(spark, monkeypatch):
    """Near copies that fill many blocks: not a tree of links for each two parts of each bucket."""
    monkeypatch.setattr(linededup, "BLOCK", 24)
    edges, own = [], linededup.connected_components
    monkeypatch.setattr(linededup, "connected_components", lambda e: edges.append(e.count()) or own(e))
    rnd = random.Random(8)
    base = "".join(rnd.choice("abcdefghij klmnop") for _ in range(160))
    lines = [base[:i] + x + base[i + 1 :] for i in range(2, 158, 2) for x in "XY"]
    other = "".join(rnd.choice("abcdefghij klmnop") for _ in range(160))
    mixed = [base[:k] + other[k:] for k in range(100, 160, 3)]
    rows = [(i, "\n".join((lines + mixed)[i::9])) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()} == slow_lines(rows)
    assert len(lines) * 0.9 < edges[-1] < 1.5 * len(lines + mixed), edges


def test_links_across_classes_connect_what_all_links_do():
    rnd = random.Random(17)
    for letters in ("abcdefgh ijkl", "日本語一二三四五六七八九十"):
        bases = [[rnd.choice(letters) for _ in range(120)] for _ in range(6)]
        lines = ["".join(b[:k] + ["xyz"[k % 3]] + b[k + 1 :]) for b in bases for k in range(3, 117, 13)]
        classes = np.array([i // 9 * 3 + rnd.choice([0, 0, 1, 2]) for i in range(len(lines))])
        _, classes = np.unique(classes, return_inverse=True)
        sets, links = [shingles_of(x) for x in lines], list(linededup._across(lines, classes))
        alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
        assert links and all(alike(a, b) and classes[a] != classes[b] for a, b in links)
        want = components(len(lines), lambda a, b: alike(a, b) or classes[a] == classes[b])
        got = components(len(lines), lambda a, b: classes[a] == classes[b] or (a, b) in links or (b, a) in links)
        assert got == want and len(links) == len(set(classes.tolist())) - len(set(want))
