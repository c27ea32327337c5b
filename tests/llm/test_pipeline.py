"""The corpus pipeline as a whole against its stages done by brute force."""

import hashlib
import math
from collections import defaultdict

import public_tokenizers
from test_dedup import components, shingles_of, slow_fingerprint
from test_text import WORDS, slow_metrics, slow_targets, slow_verdicts

import corpus_pipeline
from cadenza.llm import bpe


def slow_line_dedup(docs):
    lines = [(d["doc_id"], i, x) for d in docs for i, x in enumerate(d["text"].split("\n")) if x.strip(" \t\r\x0b\x0c")]
    lines.sort(key=lambda x: x[:2])
    sets = [shingles_of(x) for _, _, x in lines]
    sizes = list(map(len, sets))
    near = lambda a, b: 5 * min(sizes[a], sizes[b]) >= 4 * max(sizes[a], sizes[b]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    part = components(len(lines), near)
    gone = {x[:2] for i, x in enumerate(lines) if part[i] != i}
    return [d | {"text": "\n".join(x for i, x in enumerate(d["text"].split("\n")) if (d["doc_id"], i) not in gone)} for d in docs]


def slow_mix(docs):
    """How often each document is taken whole."""
    size = {d["doc_id"]: len(WORDS.findall(d["text"])) for d in docs}
    by_source = defaultdict(list)
    for d in docs:
        by_source[d["source"]].append((int(hashlib.md5(f"{d['doc_id']}:1".encode()).hexdigest()[:15], 16), d["doc_id"]))
    targets = slow_targets({s: sum(size[i] for _, i in own) for s, own in by_source.items()})
    taken = {}
    for s, own in by_source.items():
        whole, budget = sum(size[i] for _, i in own), math.floor(targets[s] + 0.5)
        left = budget - budget // whole * whole
        for _, i in sorted(own):
            taken[i] = (budget // whole + (left > 0 and 2 * left >= size[i])) * (size[i] > 0)  # nothing is taken of a text without words
            left -= size[i]
    return taken


def test_pipeline_matches_brute_force(spark, sf, tmp_path):
    import tiktoken

    table = spark.read.parquet(f"{sf}/documents.parquet")
    own = spark.createDataFrame([(90_000, None, "en", None, 0), (90_001, "", None, "s", 0), (90_002, "one\n\n two", "en", "s", 8)], table.schema)
    table.union(own).write.parquet(f"{tmp_path}/documents.parquet")
    docs = [r.asDict() for r in table.union(own).collect()]
    kept = slow_verdicts([(d["lang"], d["source"], slow_metrics(d["text"])) for d in docs])
    docs = slow_line_dedup([d for d, k in zip(docs, kept) if k])
    prints = [slow_fingerprint(d["text"]) for d in docs]
    ids = [d["doc_id"] for d in docs]
    order = sorted(range(len(docs)), key=ids.__getitem__)
    docs, prints = [docs[i] for i in order], [prints[i] for i in order]
    part = components(len(docs), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    docs = [d for i, d in enumerate(docs) if part[i] == i]
    taken = slow_mix(docs)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = sorted((d["doc_id"], library.encode_ordinary(d["text"])) for d in docs for _ in range(taken[d["doc_id"]]))
    before = dict(spark.conf.getAll)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in out) == want and len(want) > 50
    for r in out:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
    assert dict(spark.conf.getAll) == before
