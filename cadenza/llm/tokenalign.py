"""Alignment of two tokenizers: a sweep over the ends of their tokens, document by document."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bounded_batches, if_small, stored

#: Bytes of text whose token ends make one event row of a side.
WINDOW = 1 << 16
#: New runs of text that a tokenizer is asked for at a time, one after another in one text.
ASKED = 4096
#: Runs of text that a task remembers with their ids, and documents that it knows to be repeated.
RUNS, SEEN = 400_000, 200_000
#: Links of so many of a window's groups are spelled out at a time; a larger group is counted by distinct ids.
LINKS = 1 << 18

EVENTS = "_k1 long, _k2 long, part int, side int, doc_id long, ok boolean, start long, ids binary"
SWEPT = "_k1 long, _k2 long, doc_id long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"

# Fixed value: the pattern that splits text for byte-level vocabularies.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A text may be cut before a space that stands between a character that is no white space and another character.
_CUT = re.compile(r"(?<=[^\s\x85\u180e])(?= .)", re.S)
_UNEVEN = re.compile(r"[\s\x85\u180e] ")
#: So much white space on end tiktoken's pattern can't backtrack over.
_BLANKS = re.compile(r"[\s\x85\u180e]{500}")


def byte_level_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 characters
    are themselves, the other bytes the code points from 256 on, in turn."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """A tokenizer, the bytes of its tokens, and the ids of texts that begin with a space.

    `path` is a tokenizers file (.json) of a byte-level BPE, or a sentencepiece BPE model.

    Of a byte-level BPE whose ids are in the order of its merges, the ids are the ranks of the merges
    as well, and tiktoken, which is several times as fast, gives the same ones.  No piece of a
    sentencepiece model goes on past a single space (where one does, whole texts are encoded), so
    that a text's ids are those of its runs between such spaces, and each distinct run is encoded once.
    """

    def __init__(self, path: str):
        self.runs: dict[str, int] = {}
        self.cuts = self.lossless = False
        if path.endswith(".json"):
            names, self.one = self._byte_level(path)
            alphabet = byte_level_alphabet()
            self.token = [n.encode() if special else bytes(alphabet[c] for c in n) for n, special in names]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            self.token = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
            self.one: Callable = lambda text: model.encode(text[1:], num_threads=1)
            self.cuts = not any(re.search("[^▁]▁", n) for n in names)
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.kind = np.dtype("<u2" if len(self.token) <= 1 << 16 else "<u4")
        self.forget()

    def _byte_level(self, path: str) -> tuple[list[tuple[str, bool]], Callable]:
        """The names of a tokenizers file's ids, with whether they are special, and its encoder."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        special = own.get_added_tokens_decoder()
        names = [(own.id_to_token(i) or "", i in special) for i in range(max(own.get_vocab().values()) + 1)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"][m.replace(" ", "", 1)] for m in merges]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and spec["normalizer"] is None
        self.lossless = bool(plain)  # the bytes of such a vocabulary's tokens are the text's, whatever it is
        if plain and ids == list(range(256, 256 + len(ids))):
            alphabet = byte_level_alphabet()
            ranks = {bytes(alphabet[c] for c in n): i for i, (n, other) in enumerate(names) if not other}
            fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
            return names, lambda text: own.encode(text, add_special_tokens=False).ids if _BLANKS.search(text) else fast(text, disallowed_special=())
        return names, lambda text: own.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.runs.clear()
        self.flat, self.count, self.good = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, bool)
        self.begin = self.count

    @staticmethod
    def _cut(text: str) -> list[str]:
        if _UNEVEN.search(text):
            return _CUT.split(text)
        runs = list(map(" ".__add__, text[1:].split(" ")))
        if len(runs) > 1 and runs[-1] == " ":
            runs[-2:] = [runs[-2] + " "]
        return runs

    def ask(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of runs in turn, how many each has, and whether their bytes are the run's.

        Runs that end in a sign stay apart when they stand one after another, as each begins with a
        space, so that many are one text, whose ids are dealt out by their bytes.
        """
        whole = "".join(runs)
        ids = np.array(self.one(whole), np.int64)
        good = self._spells(ids, whole)
        if len(runs) == 1:
            return ids, np.array([len(ids)]), np.array([good])
        if good:
            sizes = np.fromiter(map(len, map(str.encode, runs)), np.int64, len(runs))
            last = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(sizes))
            return ids, np.diff(last, prepend=-1), np.ones(len(runs), bool)
        half = len(runs) // 2
        return tuple(map(np.concatenate, zip(self.ask(runs[:half]), self.ask(runs[half:]))))

    def _learn(self, new: list[str]) -> None:
        """Add runs to the table: those that end in white space each by itself."""
        apart, together = [], []
        for r in new:
            (apart if r[-1].isspace() or r[-1] == "\u180e" else together).append(r)
        found = [self.ask(together[i : i + ASKED]) for i in range(0, len(together), ASKED)] + [self.ask([r]) for r in apart]
        self.runs.update(zip(together + apart, range(len(self.runs), len(self.runs) + len(new))))
        ids, counts, good = zip(*found)
        self.flat = np.concatenate([self.flat, *(x.astype(self.kind) for x in ids)])
        self.count, self.good = np.concatenate([self.count, *counts]), np.concatenate([self.good, *good])
        self.begin = np.cumsum(self.count) - self.count

    def _spells(self, ids: np.ndarray, text: str) -> bool:
        return b"".join(map(self.token.__getitem__, ids.tolist())) == text.encode()

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of each text, which begins with a space; None where their bytes are not the text's."""
        if not texts:
            return []
        if self.lossless:
            return [np.asarray(self.one(t)).astype(self.kind) for t in texts]
        if not self.cuts:
            return [ids if self._spells(ids, t) else None for ids, t in ((np.array(self.one(t), self.kind), t) for t in texts)]
        if len(self.runs) > RUNS:
            self.forget()
        cut = [self._cut(t) for t in texts]
        if new := [r for r in set().union(*cut) if r not in self.runs]:
            self._learn(new)
        sizes = list(map(len, cut))
        numbers = np.fromiter(map(self.runs.__getitem__, itertools.chain.from_iterable(cut)), np.int64, sum(sizes))
        counts, bounds = self.count[numbers], np.cumsum([0, *sizes])
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.repeat(self.begin[numbers] - upto[:-1], counts) + np.arange(upto[-1])]
        good, out = self.good[numbers], []
        for text, i, j in zip(texts, bounds.tolist(), bounds[1:].tolist()):
            own = ids[upto[i] : upto[j]]
            out.append(own if good[i:j].all() or self._spells(own, text) else None)
        return out


_SIDES: dict[str, Side] = {}


def side_of(path: str) -> Side:
    """One for each worker process, which Spark uses for many tasks."""
    if path not in _SIDES:
        _SIDES[path] = Side(path)
    return _SIDES[path]


def _packed(ids: np.ndarray) -> bytes:
    """Ids as bytes, first all low ones, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(ids.view(np.uint8).reshape(-1, ids.itemsize).T.tobytes())


def _unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).view(kind).ravel()


def _ends(path: str, number: int):
    names = [c.split()[0] for c in EVENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = side_of(path), set()
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                k1, k2, ids, texts = (part.column(c).to_pylist() for c in ("_k1", "_k2", "doc_id", "text"))
                rows = []
                new = []
                for row, key in enumerate(zip(k1, k2)):
                    if key not in seen:
                        seen.add(key)
                        new.append(row)
                    elif number == 0:
                        rows.append((*key, -1, 0, ids[row], True, None, None))
                if len(seen) > SEEN:
                    seen.clear()
                full = [r for r in new if texts[r]]
                found = dict(zip(full, own.encode([" " + texts[r] for r in full])))
                for row in new:
                    tokens = found.get(row)
                    rows.append((k1[row], k2[row], -1, number, ids[row], tokens is not None, None, None))
                    if tokens is not None:
                        ends = np.cumsum(own.length[tokens])
                        parts = (ends - 1) // WINDOW
                        bounds = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(ends)]
                        for a, b in zip(bounds, bounds[1:]):
                            rows.append((k1[row], k2[row], int(parts[a]), number, None, True, int(ends[a - 1]) if a else 0, _packed(tokens[a:b])))
                if rows:
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def end_events(docs: DataFrame, path: str, side: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The end events of one tokenizer: for each document a head (part -1) that says whether its
    tokens spell the text, and for each WINDOW bytes of text the tokens that end in it: the offset
    where the first of them begins and their ids, packed, whose lengths give the ends.

    Side 0 gives a head for each row; a task that meets a row again gives no more than that.
    """
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.xxhash64(id_, text).alias("_k1"), F.xxhash64(F.lit(1), id_, text).alias("_k2"), id_.alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(_ends(path, side), EVENTS)


class Sweep:
    """The state of one document: what it has counted, and the tokens of the group still open."""

    def __init__(self, key, names: list[str], keep_groups: bool):
        self.key, self.names, self.sha = key, names, hashlib.sha256()
        self.doc_id, self.copies, self.ok, self.heads = None, 0, True, 0
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.part, self.now, self.open = -1, [None, None], [np.zeros(0, np.int64)] * 2
        self.pairs, self.text = [], [] if keep_groups else None

    def take(self, part: int, side: int, doc_id, ok: bool, tokens) -> None:
        """An event row; tokens gives the ends and ids of a window, if they are wanted."""
        if part < 0:
            self.ok, self.heads = self.ok and ok, self.heads | 1 << side
            if side == 0:
                self.copies, self.doc_id = self.copies + 1, doc_id
        elif self.ok:
            if part != self.part:
                self.close()
                self.part = part
            if self.now[side] is None:  # else a copy from another task
                self.now[side] = tokens()

    def close(self) -> None:
        """Sweep over a window's events: an offset where tokens of both sides end ends a group."""
        if self.now == [None, None]:
            return
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        (ends_a, ids_a), (ends_b, ids_b) = (none if x is None else x for x in self.now)
        self.now = [None, None]
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        n, tokens, groups = len(shared), [], []
        for side, (ends, ids) in enumerate(((ends_a, ids_a), (ends_b, ids_b))):
            all_ids = np.concatenate([self.open[side], ids.astype(np.int64)])
            group = np.concatenate([np.zeros(len(self.open[side]), np.int64), np.searchsorted(shared, ends)])
            done = int(np.searchsorted(group, n)) if n else 0
            tokens.append(all_ids[:done])
            groups.append(group[:done])
            self.open[side] = all_ids[done:]
        if n:
            self._emit(*tokens, *groups, n)

    def _emit(self, a, b, ga, gb, n: int) -> None:
        ca, cb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        begin = np.cumsum(cb) - cb
        at_a = np.arange(len(a)) + begin[ga]
        at_b = np.arange(len(b)) + np.cumsum(ca)[gb]
        ids, place = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int64)
        ids[at_a], ids[at_b], place[at_a], place[at_b] = a, b, 2 * ga, 2 * gb + 1
        mark = np.full(len(ids), 2, np.int64)  # 0: goes on, 1: the other side, 2: a new group
        mark[1:] = np.where(place[1:] == place[:-1], 0, np.where(place[1:] % 2 == 1, 1, 2))
        text = "".join(map(self.names.__getitem__, (ids * 3 + mark).tolist()))
        text = text if self.n_groups else text[1:]
        self.sha.update(text.encode())
        if self.text is not None:
            self.text.append(text)
        links = ca * cb
        self.n_a, self.n_b, self.n_groups, self.n_links = self.n_a + len(a), self.n_b + len(b), self.n_groups + n, self.n_links + int(links.sum())
        large = links > LINKS
        for g in np.flatnonzero(large).tolist():
            (ua, na), (ub, nb) = (np.unique(x, return_counts=True) for x in (a[ga == g], b[gb == g]))
            self.pairs.append((((ua << 32)[:, None] | ub).ravel(), (na[:, None] * nb).ravel()))
        width = np.where(large, 0, cb)[ga]  # links of each token of A
        bounds = np.searchsorted(np.cumsum(width), np.arange(0, int(width.sum()) + LINKS, LINKS), "left")
        for i, j in zip(bounds, [*bounds[1:], len(a)]):
            if w := int(width[i:j].sum()):
                some = width[i:j]
                other = np.repeat(begin[ga[i:j]] - np.cumsum(some) + some, some) + np.arange(w)
                self.pairs.append(np.unique(np.repeat(a[i:j] << 32, some) | b[other], return_counts=True))

    def row(self) -> tuple:
        self.close()
        good = self.ok and self.heads == 3 and self.n_groups
        if not good:
            return *self.key, self.doc_id, self.copies, 0, 0, 0, 0, "", [], [], [], ""
        pairs, times = (np.concatenate(x) for x in zip(*self.pairs))
        if len(self.pairs) > 1:
            pairs, at = np.unique(pairs, return_inverse=True)
            times = np.bincount(at, times).astype(np.int64)
        groups = "".join(self.text) if self.text is not None else None
        return *self.key, self.doc_id, self.copies, self.n_a, self.n_b, self.n_groups, self.n_links, self.sha.hexdigest(), pairs >> 32, pairs & 0xFFFFFFFF, times, groups


def _lists(columns) -> pa.Array:
    ends = np.cumsum([0, *map(len, columns)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.asarray(c, np.int32) for c in columns])))


def _machine(path_a: str, path_b: str, keep_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [side_of(p) for p in (path_a, path_b)]
        size = max(len(s.token) for s in sides)

        def tokens(side: int, start: int, data: bytes):
            ids = _unpacked(data, sides[side].kind)
            return start + np.cumsum(sides[side].length[ids]), ids

        names = [f"{c}{i}" for i in range(size) for c in ",|;"]
        types = [pa.int64()] * 8 + [pa.string(), *[pa.list_(pa.int32())] * 3, pa.string()]
        columns = [c.split()[0] for c in SWEPT.split(", ")] + ["groups"]
        now, done, held = None, [], 0

        def rows() -> pa.RecordBatch:
            arrays = [pa.array(c, t) if t != types[-2] else _lists(c) for c, t in zip(zip(*done), types)]
            return pa.RecordBatch.from_arrays(arrays[: len(columns) - (not keep_groups)], names=columns[: len(columns) - (not keep_groups)])

        for batch in batches:
            for k1, k2, part, side, doc_id, ok, start, ids in zip(*(batch.column(c.split()[0]).to_pylist() for c in EVENTS.split(", "))):
                if now is None or now.key != (k1, k2):
                    if now is not None:
                        done.append(now.row())
                        held += len(done[-1][9]) + 16
                        if held > 1 << 18:
                            yield rows()
                            done, held = [], 0
                    now = Sweep((k1, k2), names, keep_groups)
                now.take(part, side, doc_id, ok, functools.partial(tokens, side, start, ids))
        if now is not None:
            done.append(now.row())
        if done:
            yield rows()

    return run


def sweep(events: DataFrame, path_a: str, path_b: str, groups: bool = False) -> DataFrame:
    """End events of both tokenizers -> one row for each distinct document: its counts, the digest
    of its groups (with `groups`: and they themselves), its distinct links (a << 32 | b) and how
    often each occurs.  Events are dealt by document, sorted by offset and read once."""
    ordered = events.repartition("_k1", "_k2").sortWithinPartitions("_k1", "_k2", "part", "side")
    return ordered.mapInArrow(_machine(path_a, path_b, groups), SWEPT + ", groups string" * groups)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """How two tokenizers cut each text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256; with `groups` also groups, decimal ids as `a1,a2|b1;a3|b2,b3`.

    Both read the text with a space before it.  Byte offsets where tokens of both end cut the
    text into groups; the links of a group are all its pairs of an A and a B token.  A pair's
    count is the number of documents that hold it, over all of docs; n_best are the links whose
    count is the highest of their A id, ties included, and count_sum is the sum over links.

    Null and empty texts, and texts that a side's tokens don't spell, have zeros and empty
    strings.  Rows that repeat id and text are documents each and get a row each; null ids stay;
    an empty table gives an empty one; other columns are not read.  Sorting a document's events
    and the open group are what a task holds, with the document's distinct links; group and
    links of a text of any length are counted, none are left out.
    """
    with bounded_batches(docs.sparkSession):
        events = end_events(docs, path_a, 0, id_col, text_col).unionByName(end_events(docs, path_b, 1, id_col, text_col))
        swept = stored(sweep(events, path_a, path_b, groups), "align-docs")
    counts = swept.select("copies", F.explode(F.arrays_zip("a", "b")).alias("x")).groupBy("x.a", "x.b").agg(F.sum("copies").alias("n"))
    counts = stored(counts, "align-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # one row for each id of a vocabulary at most
    counts = stored(counts.join(if_small(stored(most, "align-most")), "a").select("a", "b", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "align-pairs")
    links = swept.select("_k1", "_k2", F.explode(F.arrays_zip("a", "b", "times")).alias("x")).select("_k1", "_k2", "x.*")
    sums = links.join(if_small(counts), ["a", "b"]).groupBy("_k1", "_k2").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    whole = swept.drop("a", "b", "times").join(stored(sums, "align-sums"), ["_k1", "_k2"], "left")
    whole = whole.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256"]
    return whole.select(*own, *["groups"] * groups)
