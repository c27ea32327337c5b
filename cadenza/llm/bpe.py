"""Byte-level BPE by a sentencepiece model that is made from a vocabulary of ranks."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Byte b is written as the character BYTE_BASE + b: a letter each, none of them white space.
BYTE_BASE = 0x4E00


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file (base64 token, rank) as token -> rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One field of a protobuf message: bytes and strings with length, ints as varint, floats."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def to_characters(token: bytes) -> str:
    return token.decode("latin-1").translate(_CHARACTERS)


_CHARACTERS = {b: BYTE_BASE + b for b in range(256)}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of a vocabulary: a piece for each token, scored by its negative
    rank, so that the pair of lowest rank merges first; identity normalisation, no added prefix,
    no escaped white space.  Pieces stand in rank order and the unknown piece after them, so that
    the i-th piece is the i-th lowest rank."""
    pieces = [_field(1, to_characters(t)) + _field(2, -float(r)) + _field(3, 1) for t, r in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(_field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(pieces) - 1) + _field(41, -1 & (1 << 64) - 1) + _field(42, -1 & (1 << 64) - 1)
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class BytePairCoder:
    """Encodes texts and decodes ids; distinct pre-tokens are encoded once.

    No match of the pattern goes on past the last character before a single space, so a text
    in which no space follows white space may be cut before each space; what stands between is
    looked up whole, and split by the pattern only when it is new.
    """

    #: Runs and words remembered at most; those of a task are forgotten when it ends.
    KEEP = 200_000

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.uneven = regex.compile(r"^ |[\s\x1c-\x1f] ").search
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.name_of = [str(r) for r in sorted(ranks.values())]
        self.token_of = {str(r): t for t, r in ranks.items()}
        self.whole = {t: str(r) for t, r in ranks.items()}
        self.words: dict[str, str] = {}
        self.runs: dict[str, str] = {}

    def _learn_words(self, words: list[str]) -> None:
        data = [w.encode() for w in words]
        self.words.update((w, self.whole[d]) for w, d in zip(words, data) if d in self.whole)
        rest = [(w, d) for w, d in zip(words, data) if d not in self.whole]
        found = self.model.encode([to_characters(d) for _, d in rest], num_threads=1)
        name = self.name_of.__getitem__
        self.words.update((w, ",".join(map(name, ids))) for (w, _), ids in zip(rest, found))

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text in decimal, joined by commas."""
        cut, whole = [], {}
        for i, text in enumerate(texts):
            if self.uneven(text):
                whole[i] = self.split(text)
                cut.append([])
            else:
                first, *rest = text.split(" ")
                cut.append([first, *map(" ".__add__, rest)])
        if len(self.runs) > self.KEEP:
            self.runs.clear()
        if len(self.words) > self.KEEP:
            self.words.clear()
        new = {run: self.split(run) for run in set().union(*cut) if run not in self.runs}
        self._learn_words(list({w for ws in (*new.values(), *whole.values()) for w in ws if w not in self.words}))
        word = self.words.__getitem__
        self.runs.update((run, ",".join(map(word, ws))) for run, ws in new.items())
        run = self.runs.__getitem__
        return [",".join(map(word, whole[i])) if i in whole else ",".join(map(run, c)) if c != [""] else "" for i, c in enumerate(cut)]

    def forget(self) -> None:
        self.runs.clear()
        self.words.clear()

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.token_of.__getitem__, ids.split(","))) if ids else b""


_CODERS: dict[tuple[str, str], BytePairCoder] = {}


def coder(path: str, pattern: str) -> BytePairCoder:
    """One for each worker process, which Spark uses for many tasks."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = BytePairCoder(path, pattern)
    return _CODERS[path, pattern]


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                n, ids_sha, text_sha, all_ids = [], [], [], []
                for ids in own.encode([t or "" for t in part.column("text").to_pylist()]):
                    n.append(ids.count(",") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
                    if with_ids:
                        all_ids.append(np.fromstring(ids, np.int32, sep=","))
                cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                cols += [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])
        own.forget()

    return run


def _ids(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                names = own.encode([t or "" for t in part.column("text").to_pylist()])
                ids = [[int(x) for x in s.split(",")] if s else [] for s in names]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
        own.forget()

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Byte-level BPE of each text: (doc_id, ids array<int>).

    The ids are those of the rank file at `path`, each match of `pattern` encoded separately and
    no special tokens known.  A null or empty text has no ids.  One row for each row, in no
    order; null and repeated doc_ids stay; other columns are not read.  No shuffle.
    """
    return _rows(docs, id_col, text_col).mapInArrow(_ids(path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The inverse of encode(): (doc_id, bytes binary); null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            data = [own.decode(",".join(map(str, ids or []))) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each text and decode its ids again: (doc_id, n_tokens, ids_sha256, decoded_sha256),
    the digests of the decimal ids joined by commas and of the decoded bytes; with_ids: and
    ids array<int>.  As encode()."""
    schema = DIGESTS + ", ids array<int>" * with_ids
    return _rows(docs, id_col, text_col).mapInArrow(_digests(path, pattern, with_ids), schema)
