"""Token-id files: tokenized documents in Simple-8b blocks.

File format.  A token file is a Parquet table in ascending document order, one row for each
block of whole documents:

    shard, block   place of the block; blocks of a shard follow each other in its file
    first          ids of the shard before this block
    doc_ids, lens  the block's documents and their numbers of ids
    words          the ids as 64-bit little-endian words
    offsets        for each group of GROUP words: ids of the block before it
    escapes        ids of more than 60 bits, 64-bit little-endian

The top 4 bits of a word are its selector; SLOTS tells how many ids of how many bits the other
60 hold, first id lowest.  Selector 15 is the escape: its payload is an index into `escapes`.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import if_small, scratch_path, shuffle_partitions

# Fixed values of the format: ids in a word, bits of each.
SLOTS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
#: Bits of small ids; those of others are rounded up next to powers of two of over 53 bits only.
WIDTHS = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)
GROUP = 128
BLOCK_IDS = 1 << 18
#: Characters and rows of a shard, on average, at most: what one task sorts and encodes.
SHARD_CHARS, SHARD_ROWS = 1 << 27, 1 << 20

FILE_SCHEMA = (
    "shard int, block int, first long, doc_ids array<long>, lens array<int>, words binary, offsets array<int>, escapes binary"
)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (uint64) -> words, offsets, escapes.  Each word takes as many ids as fit.

    The widest id of each run of `count` ids is kept up to date while count grows, which tells
    where a word of each selector could begin; the words are the chain of positions from 0 on.
    """
    n = len(ids)
    ids = ids.astype(np.uint64, copy=False)
    width = WIDTHS[ids] if n and int(ids.max()) < len(WIDTHS) else np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    step = np.full(n, 1, np.uint8)
    select = np.full(n, ESCAPE, np.uint8)
    widest, run = width, 1
    for s in range(len(SLOTS) - 1, -1, -1):
        count, bits = SLOTS[s]
        while run < min(count, n):
            widest = np.maximum(widest[:-1], width[run:])
            run += 1
        if count > n or not (fits := widest <= bits).any():
            break  # more ids of fewer bits fit nowhere either
        np.copyto(step[: len(fits)], count, where=fits)
        np.copyto(select[: len(fits)], s, where=fits)
    begins, i, jump = [], 0, step.tobytes()
    while i < n:
        begins.append(i)
        i += jump[i]
    begins = np.array(begins, np.int64)
    select = select[begins]
    words = select.astype(np.uint64) << np.uint64(60)
    for s in np.unique(select).tolist():
        if s != ESCAPE:
            own = np.flatnonzero(select == s)
            first, part = begins[own], words[own]
            for i in range(SLOTS[s][0]):
                part |= ids[first + i] << np.uint64(i * SLOTS[s][1])
            words[own] = part
    escaped = np.flatnonzero(select == ESCAPE)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    return words, begins[::GROUP], ids[begins[escaped]]


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The inverse of pack(): all words of a selector are decoded at once."""
    out = np.empty(n, np.uint64)
    select = (words >> np.uint64(60)).astype(np.uint8)
    counts = np.array([c for c, _ in SLOTS] + [1, 1], np.int64)[select]
    begins = np.cumsum(counts) - counts
    if not np.array_equal(begins[::GROUP], offsets):
        raise ValueError("a token block is damaged: its offsets don't match its words")
    payload = words & np.uint64((1 << 60) - 1)
    for s, (count, bits) in enumerate(SLOTS):
        own = np.flatnonzero(select == s)
        if len(own):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[begins[own][:, None] + np.arange(count)] = (payload[own][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    own = np.flatnonzero(select == ESCAPE)
    out[begins[own]] = escapes[payload[own].astype(np.int64)]
    return out


class ChunkEncoder:
    """A tokenizers vocabulary, asked once for each distinct run of text.

    White space splits a text before the vocabulary's own pattern does, and normalisation does
    not reach across it, so a text's ids are those of its runs of other characters in turn.
    Runs of ASCII and Latin letters, digits and marks are
    cut by the pattern, and their new pieces encoded many at a time, spaces between: each piece
    ends with an end-of-word id.  Other runs are encoded one by one.  Runs are numbered, and a
    table has the ids of each; texts become numbers, and numbers ids, in arrays.

    With `special`, the vocabulary's special tokens in a text are their own ids, as is the
    library's default: texts are split at them first.  Without it they are text like any other.
    """

    #: Runs remembered at most.
    KEEP = 500_000
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^a-z0-9à-öø-ÿß]+")

    def __init__(self, path: str, special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder() if special else {}
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("special tokens that take the text around them into account are not supported")
        self.special = {t.content.encode(): i for i, t in added.items()}
        self.split = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if added else None
        self.tokenizer.encode_special_tokens = True  # for what is left between them
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.sizes, self.begins, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.held = 0
        self._add([b""], np.zeros(1, np.int64), np.zeros(0, np.uint32))

    def _add(self, runs: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        first = len(self.number)
        self.number.update(zip(runs, range(first, first + len(runs))))
        while len(self.sizes) < len(self.number):
            self.sizes, self.begins = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.begins))
        while len(self.ids) < self.held + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.sizes[first : first + len(runs)] = sizes
        self.begins[first : first + len(runs)] = self.held + np.cumsum(sizes) - sizes
        self.ids[self.held : self.held + len(ids)] = ids
        self.held += len(ids)

    def _gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs by number -> their ids one after another, and where each run's begin and the last one's end."""
        sizes = self.sizes[number]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.repeat(self.begins[number] - upto[:-1], sizes) + np.arange(upto[-1])], upto

    def _add_each(self, runs: list[bytes]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in runs], add_special_tokens=False)]
        self._add(runs, np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.uint32))

    def _learn(self, runs: list[bytes]) -> None:
        whole, cut, other = {}, {}, []
        for run in runs:
            if run.isalpha():  # of ASCII letters
                whole[run] = None
            elif run[:-1].isalpha() and run[-1:] in b".,:;!?":
                cut[run] = (run[:-1], run[-1:])
            elif self.PLAIN.fullmatch(text := run.decode()):
                pieces = self.PIECES.findall(text.lower())
                if len(pieces) > 1:
                    cut[run] = [x.encode() for x in pieces]
                else:
                    whole[run] = None
            else:
                other.append(run)
        whole.update(dict.fromkeys(p for pieces in cut.values() for p in pieces if p not in self.number))
        pieces = list(whole)
        for i in range(0, len(pieces), 2000):
            some = pieces[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                self._add(some, np.diff(ends, prepend=0), ids)
            else:
                self._add_each(some)
        if cut:
            counts = np.fromiter(map(len, cut.values()), np.int64, len(cut))
            flat = np.fromiter((self.number[p] for pieces in cut.values() for p in pieces), np.int64, int(counts.sum()))
            ids, upto = self._gather(flat)
            self._add(list(cut), np.diff(upto[np.concatenate([[0], np.cumsum(counts)])]), ids)
        if other:
            self._add_each(other)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 texts -> all their ids (uint32), and how many each has."""
        if not self.split or not any(map(self.split.search, texts)):
            return self._plain(texts)
        parts = [self.split.split(t) for t in texts]  # text, token, text, ...
        ids, sizes = self._plain([x for p in parts for x in p[::2]])
        tokens = [[self.special[x] for x in p[1::2]] for p in parts]
        pieces = np.array([len(p) // 2 + 1 for p in parts])
        ends, last = np.cumsum(sizes), np.cumsum(pieces) - 1
        at = np.delete(ends, last)  # a token stands after each text but a document's last
        begins = np.concatenate([[0], ends[last[:-1]]])
        sizes = ends[last] - begins + pieces - 1
        return np.insert(ids, at, np.array([i for own in tokens for i in own], np.uint32)), sizes

    def _plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """encode() of texts whose special tokens, if any, are text."""
        if len(self.number) > self.KEEP:
            self._forget()
        # with no combining mark that could be part of one character with a letter, its case may go first
        texts = [t if b"\xcc" in t or b"\xcd" in t else t.lower() for t in texts]
        runs = pyarrow.compute.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        coded = runs.flatten().dictionary_encode()
        _, places, data = coded.dictionary.buffers()
        places, data = np.frombuffer(places, np.int64)[: len(coded.dictionary) + 1].tolist(), data.to_pybytes() if data else b""
        words = [data[a:b] for a, b in zip(places, places[1:])]
        number = np.fromiter((self.number.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(number < 0).tolist()
        if new:
            self._learn([words[i] for i in new])
            number[new] = [self.number[words[i]] for i in new]
        ids, upto = self._gather(number[np.asarray(coded.indices)])
        offsets = np.asarray(runs.offsets)
        return ids, np.diff(upto[offsets - offsets[0]])


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def _encoder(path: str, special: bool) -> ChunkEncoder:
    """One for each worker process, which Spark uses for many tasks."""
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = ChunkEncoder(path, special)
    return _ENCODERS[path, special]


def _texts(batch: pa.RecordBatch, name: str, rows: int = 1024) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch as UTF-8 (null: empty), some at a time."""
    col = batch.column(name).cast(pa.large_binary())
    for i in range(0, len(col), rows):
        yield i, [x or b"" for x in col.slice(i, rows).to_pylist()]


def _blocks(tokenizer_path: str, end_id: int | None, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard = _encoder(tokenizer_path, special), TaskContext.get().partitionId()
        block = first = held = 0
        ids: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        docs: list[int | None] = []

        def close() -> pa.RecordBatch:
            nonlocal block, first, held, ids, lens, docs
            words, offsets, escapes = pack(np.concatenate(ids))
            row = [[shard], [block], [first], [docs], [np.concatenate(lens)], [words.astype("<u8").tobytes()], [offsets], [escapes.astype("<u8").tobytes()]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.binary()]
            out = pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types)], names=[x.split()[0] for x in FILE_SCHEMA.split(", ")])
            block, first, held, ids, lens, docs = block + 1, first + held, 0, [], [], []
            return out

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for i, texts in _texts(batch, "text"):
                found, sizes = encoder.encode(texts)
                if end_id is not None:
                    found, sizes = np.insert(found, np.cumsum(sizes), end_id), sizes + 1
                ends, a = np.cumsum(sizes), 0
                while a < len(texts):  # a block ends with the document that fills it
                    begin = ends[a] - sizes[a]
                    b = min(int(np.searchsorted(ends, begin + BLOCK_IDS - held)) + 1, len(texts))
                    ids.append(found[begin : ends[b - 1]])
                    lens.append(sizes[a:b])
                    docs += names[i + a : i + b]
                    held += int(ends[b - 1] - begin)
                    a = b
                    if held >= BLOCK_IDS:
                        yield close()
        if docs:
            yield close()

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text",
    special: bool = False,
) -> None:
    """Tokenize documents into a token file at `path`, in ascending id order.

    A null text counts as empty; null ids come first; rows of one id are ordered by their text.
    Every document keeps its row, an empty one with the end id alone.  An empty table gives a
    file without blocks.  Other columns are not read.  With `special`, special tokens in a text are
    recognized, as the library does unless told otherwise; without it they are plain text.  Tasks write through Spark's committer, so
    a lost executor's shard is written again.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    count, size = rows.select(F.count("*"), F.sum(F.length("text"))).first()
    parts = max(shuffle_partitions(docs.sparkSession), (size or 0) // SHARD_CHARS, count // SHARD_ROWS)
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_blocks(tokenizer_path, end_id, special), FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(np.frombuffer(row["words"], "<u8"), np.array(row["offsets"], np.int64),
                         np.frombuffer(row["escapes"], "<u8"), sum(row["lens"]))
            data = memoryview(ids.astype("<u4").tobytes())
            ends = np.cumsum(np.array(row["lens"], np.int64))
            begins = ends - np.array(row["lens"], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"]] * len(ends), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(begins + row["first"]),
                    pa.array(row["lens"], pa.int64()),
                    pa.array([zlib.crc32(data[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist())], pa.int64()),
                ],
                names=["shard", "doc_id", "begin", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark, path: str) -> DataFrame:
    """Decode a token file: (doc_id, start, n_tokens, ids_crc32), start counting all ids before."""
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    shards = blocks.select("shard", F.expr("first + aggregate(lens, 0L, (a, x) -> a + x)").alias("ids")).groupBy("shard").agg(F.max("ids").alias("ids"))
    starts = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    docs = blocks.mapInArrow(_documents, "shard int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return docs.join(if_small(starts), "shard").select(
        "doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def tokenize(docs: DataFrame, tokenizer_path: str, **kw) -> DataFrame:
    """Write a token file in the shared folder and read it back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, **kw)
    return read_tokens(docs.sparkSession, path)
