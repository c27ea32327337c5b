"""Mixing, quality, tokens, BPE and chat formatting against brute force and the libraries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.llm import bpe, chat, mixing, quality, tokenfile

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, _row string"
ODD = [None, "", " \t\n", "one", "a b  c\x0bd", "é ü　x ́y", "<|endoftext|> </s> ", "İ ΑΣ ﬁ Á Á", "日本語🎉 1²3", "x" * 20000, "a\x1cb \x85 c d", "it's 'RE we'LL 12ab"]


def docs(spark, texts, sources=(None,), ids=None):
    rows = [(i if ids is None else ids[i], t, "en", sources[i % len(sources)], 1, 2, "k", "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# ------------------------------------------------------------------------------------- mixing


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, list(names), sum(sizes.values())
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 3 * sizes[s]]
        if not over:
            return target | {s: share * weight[s] for s in free}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_mixing_reaches_targets(spark):
    rnd = random.Random(2)
    texts = [" ".join(["w"] * rnd.randint(0, 40)) for _ in range(400)] + [None, ""]
    names = ["b"] * 12 + ["a", "Z", "é", None, "z", "a", "a"]
    frame = docs(spark, texts, names)
    out = mixing.mix(frame).collect()
    sizes, taken = Counter(), Counter()
    for r in out:
        assert r["mix_size"] == len(WORDS.findall(r["text"] or "")) and 0 <= r["mix_taken"] <= 3 * r["mix_size"]
        sizes[r["source"]] += r["mix_size"]
        taken[r["source"]] += r["mix_taken"]
    want = slow_targets(sizes)
    for r in out:
        assert r["mix_source_size"] == sizes[r["source"]] and r["mix_target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes) and len(out) == 402
    assert sorted(map(str, mixing.mix(frame.repartition(7)).collect())) == sorted(map(str, out))
    whole = mixing.mixed_documents(frame)
    assert whole.columns == frame.columns
    copies = Counter(r["doc_id"] for r in whole.collect())
    for s in sizes:
        got = sum(copies[r["doc_id"]] * r["mix_size"] for r in out if r["source"] == s)
        assert abs(got - want[s]) <= 40


def test_mixing_of_very_long_texts(spark):
    texts = ["word " * 300_000, "x" * 2_000_000, *["a b c d"] * 200, *["e f"] * 400]
    out = mixing.mix(docs(spark, texts, ["s", "t", "t"])).collect()
    assert [r["mix_size"] for r in sorted(out, key=lambda r: r["doc_id"])[:3]] == [300_000, 1, 4]
    for source in "st":
        rows = [r for r in out if r["source"] == source]
        assert abs(sum(r["mix_taken"] for r in rows) - rows[0]["mix_target"]) <= 0.5


def test_mixing_of_odd_tables(spark):
    assert mixing.mix(docs(spark, ["a"]).limit(0)).count() == 0
    assert [r["mix_taken"] for r in mixing.mix(docs(spark, [None, "", " "])).collect()] == [0, 0, 0]
    tied = mixing.mix(docs(spark, ["a b c"] * 6 + ["d e"] * 60, ["s", "t", "t", "t"], ids=[None] * 66)).collect()
    want = {r["source"]: r["mix_target"] for r in tied}
    for s, target in want.items():
        assert abs(sum(r["mix_taken"] for r in tied if r["source"] == s) - target) < 66


# ------------------------------------------------------------------------------------ quality


def slow_metrics(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), len(lines)


@given(st.text(alphabet="ab \n\té#|", max_size=80))
@settings(max_examples=200, deadline=None)
def test_text_metrics(text):
    assert quality.text_metrics(text.encode()) == slow_metrics(text)


def test_repeat_words_with_many_distinct_words():
    words = [f"w{i}" for i in range(9000)] + [f"w{i}" for i in range(100, 107)]
    assert quality.repeat_words([w.encode() for w in words]) == slow_metrics(" ".join(words))[4] == 14


def test_quality_keeps_clean_documents(spark, sf):
    path = sf.replace("sf0.001", "sf0.01")
    table = spark.read.parquet(f"{path}/documents.parquet")
    texts = dict(table.select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in quality.quality(table).collect()}
    for i, text in texts.items():
        want = slow_metrics(text)
        assert tuple(got[i][m] for m in quality.METRICS[:5]) == want[:5]
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    labels = spark.read.parquet(f"{path}/labels.parquet").collect()
    good = [r["doc_id"] for r in labels if r["quality"] == 1 and not got[r["doc_id"]]["base_failed"]]
    junk = [r["doc_id"] for r in labels if r["quality"] == 0]
    assert sum(got[i]["kept"] for i in good) >= 0.995 * len(good)
    assert sum(got[i]["kept"] for i in junk) <= 0.03 * len(junk)
    rejected = {i for i in texts if not got[i]["kept"]}
    kept = quality.good_documents(table)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == set(texts) - rejected


def test_quality_of_odd_rows(spark):
    frame = docs(spark, ODD + ["word " * 30] * 3, [None, "s"])
    out = quality.quality(frame)
    assert out.count() == len(ODD) + 3 and out.filter("kept IS NULL OR base_failed IS NULL").count() == 0
    assert quality.quality(frame.limit(0)).count() == 0
    assert quality.good_documents(frame).columns == frame.columns


def slow_verdicts(rows):
    """kept by exact order statistics, each put on the edge of its logarithmic bucket.  rows: (lang, source, metrics)."""
    log = math.log((1 + quality.ERROR) / (1 - quality.ERROR))
    names = {m: i for i, m in enumerate(quality.METRICS)}
    ratios = {r: (names[own[0].split(" / ")[0]], names[own[0].split(" / ")[1]], *own[1:]) for r, own in quality.RULES.items()}
    base = [m[0] < 10 or 100 * m[4] > 20 * m[0] for _, _, m in rows]

    def edge(values, p, back):
        at = sorted(values)[math.ceil(len(values) * p) - 1]
        return (math.ceil(math.log(at) / log) - back) * log

    def measure(members):
        out = {r: [(m[a] + plus) / (m[b] + plus) for m in members] for r, (a, b, plus, *_) in ratios.items()}
        return {r: (edge(v, 0.25, 1), edge(v, 0.75, 0)) for r, v in out.items()} | {"words": (edge([m[0] for m in members], 0.5, 0.5),)}

    group, language = defaultdict(list), defaultdict(list)
    for (lang, source, m), bad in zip(rows, base):
        if not bad:
            group[lang, source].append(m)
            language[lang].append(m)
    wide = {k: measure(v) for k, v in language.items()}
    limits = {}
    for k, v in group.items():
        w = len(v) / (len(v) + quality.BLEND)
        limits[k] = {r: tuple(w * x + (1 - w) * y for x, y in zip(own, wide[k[0]][r])) for r, own in measure(v).items()}
    kept = []
    for (lang, source, m), bad in zip(rows, base):
        good = not bad
        for r, (a, b, _, below, above, mean) in ratios.items() if good else ():
            low, high = limits[lang, source][r]
            spread = (high - low) * (max(1, math.exp((limits[lang, source]["words"][0] - math.log(m[0])) / 2)) if mean else 1)
            value = math.log(m[a] / m[b]) if m[a] else -math.inf
            good &= not (above is not None and value > high + above * spread) and not (below is not None and value < low - below * spread)
        kept.append(good)
    return kept


def test_verdicts_match_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    rnd = random.Random(4)
    more = [(10_000 + i, " ".join(rnd.choice(["a", "of", "words", "#", "unimaginable", "x<y"]) for _ in range(rnd.randint(1, 90))), rnd.choice(["en", None, "xx"]), rnd.choice(["s", None])) for i in range(150)]
    more += [(20_000, None, None, None), (20_001, "x" * 100_000, "en", "s"), (20_002, "word " * 100_000, "en", "s"), (20_003, "", "lone", "s"), (20_004, "one of its kind, alone in language and source, of ten words", "lone", "t")]
    table = table.union(spark.createDataFrame(more, table.schema))
    rows = table.collect()
    want = slow_verdicts([(r["lang"], r["source"], slow_metrics(r["text"])) for r in rows])
    got = {r["doc_id"]: r["kept"] for r in quality.quality(table).collect()}
    assert [got[r["doc_id"]] for r in rows] == want and 40 < sum(want) < len(want) - 40 and got[20_004]


# ------------------------------------------------------------------------------------- tokens


@given(st.lists(st.integers(0, 64).flatmap(lambda b: st.integers(0, (1 << b) - 1)), max_size=400))
@settings(max_examples=200, deadline=None)
def test_simple8b_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, offsets, escapes = tokenfile.pack(ids)
    assert (tokenfile.unpack(words, offsets, escapes, len(ids)) == ids).all()


def test_simple8b_packs_tightly():
    assert len(tokenfile.pack(np.zeros(600, np.uint64))[0]) == 10
    assert len(tokenfile.pack(np.full(300, (1 << 20) - 1, np.uint64))[0]) == 100
    assert len(tokenfile.pack(np.full(5, 1 << 60, np.uint64))[2]) == 5
    words, offsets, escapes = tokenfile.pack(np.arange(5000, dtype=np.uint64))
    with pytest.raises(ValueError):
        tokenfile.unpack(words, offsets + 1, escapes, 5000)


def test_token_file_matches_library(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    table = table.union(more)
    got = {r["doc_id"]: r for r in tokenfile.tokenize(table, path, special=True).collect()}
    start = 0
    for i, text in sorted(table.collect()):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(got[i])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    assert len(got) == table.count()
    tokenfile.write_tokens(table.withColumn("shard", F.lit("clash")), str(tmp_path / "t"), path, end_id=None)
    first = spark.read.parquet(str(tmp_path / "t")).orderBy("shard", "block").select(F.explode("doc_ids")).collect()
    assert [r[0] for r in first] == sorted(r[0] for r in first)
    assert tokenfile.tokenize(table.limit(0), path).count() == 0


def test_token_query_recognizes_special_tokens_as_the_library_does(spark, tmp_path):
    from tokenizers import Tokenizer

    from cadenza.llm.queries import op5_tokenfile

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(3)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", "foo", "Bar'", "s", " ", "\n", "é", "e", "\u0301", "Σ", "日本", "1²", "\x1c", "<|"]
    texts = [*ODD, "foo<|endoftext|>bar", "ΑΣ<|endoftext|>", *("".join(rnd.choice(parts) for _ in range(12)) for _ in range(400))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op5_tokenfile(spark, str(tmp_path)).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(got[i])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        start += len(ids)


def test_token_file_of_repeated_and_null_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = tokenfile.tokenize(docs(spark, ["b", "a", "c c", None], ids=[5, 5, None, None]), path).orderBy("start").collect()
    assert [(r["doc_id"], r["start"]) for r in out] == [(None, 0), (None, 1), (5, 4), (5, 6)]


def test_bpe_matches_library(spark, sf):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rnd = random.Random(1)
    odd = ODD + ["".join(rnd.choice(" \n\t\xa0ab1'é日🎉́\x1c") for _ in range(60)) for _ in range(200)]
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(docs(spark, odd, ids=range(9000, 9000 + len(odd))).select("doc_id", "text"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for i, text in table.collect():
        ids = library.encode_ordinary(text or "")
        want[i] = (len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode()))
    out = bpe.encode_decode(table, path, public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in out} == want
    back = bpe.decode(bpe.encode(docs(spark, ODD), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in back} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.encode_decode(table.limit(0), path, public_tokenizers.PATTERN).count() == 0


# --------------------------------------------------------------------------------------- chat


def spans_of(row):
    return row["loss_spans"]


def test_chat_round_trip(spark):
    rnd = random.Random(7)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "[", "<", "/", "INST]", "s>", "\n", " ", "x", "é🎉", "%0A", "[\\INST]", "</\\\\s>"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "a\nb", "[INST]", "%0A", "assistant\n", ""]), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))))
            for c in range(60) for t in range(rnd.randint(1, 6))]
    rows += [(100, 0, None, None), (100, 0, "assistant", None), (None, 1, "user", "hi"), (None, None, "user", "no turn"), (101, 0, "user", "same"), (101, 0, "user", "same"), (102, 0, "assistant", "z" * 30000)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, _at long")
    out = chat.format_conversations(frame).collect()
    source = defaultdict(list)
    for c, t, role, text in rows:
        source[c].append((t is not None, t or 0, role or "", text or ""))
    assert {r["conv_id"] for r in out} == set(source)
    for r in out:
        turns = [x[2:] for x in sorted(source[r["conv_id"]], key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))]
        assert r["round_trip"] and [tuple(t) for t in r["turns"]] == turns
        spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert [re.sub(chat.ESCAPED, r"\1\2\3", s) for s in spans] == [t for role, t in turns if role == "assistant"]
        data = r["formatted"].encode()
        assert [data[s["byte_start"] : s["byte_start"] + s["byte_length"]].decode() for s in spans_of(r)] == spans
        assert len(re.findall(r"<s>|\[INST\]", r["formatted"])) == len(turns)
    hard = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    d = chat.digest(chat.format_conversations(hard)).first()
    said = "user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n"
    assert (d["n_turns"], d["turns_sha256"], d["loss_chars"]) == (2, hashlib.sha256(said.encode()).hexdigest(), 21)
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_chat_of_very_long_texts(spark):
    rows = [(1, 0, "user", "ask [INST] " * 100_000), (1, 1, "assistant", "say </s> é" * 100_000), (2, 0, "assistant", "\\" * 200_000 + "</s>")]
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1]["round_trip"] and got[2]["round_trip"] and got[1]["loss_chars"] == 1_000_000
    assert got[1]["loss_sha256"] == hashlib.sha256(rows[1][3].encode()).hexdigest() and got[2]["loss_sha256"] == hashlib.sha256(rows[2][3].encode()).hexdigest()


def test_chat_escapes_by_what_is_read_back(spark):
    """Plain texts stay as they are, control strings take one round, texts that look escaped a second."""
    texts = ["plain \\ [ </ s>", "</s>", "[\\INST]", "[INST] and <\\s>", "<s"]
    rows = [(i, t, role, x) for i, x in enumerate(texts) for t, role in enumerate(["user", "assistant"])]
    out = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    written = ["plain \\ [ </ s>", "</\\s>", "[\\\\INST]", "[\\INST] and <\\\\s>", "<s"]
    for i, x in enumerate(written):
        assert out[i]["formatted"] == f"[INST]user\n{x}[/INST]<s>{x}</s>" and out[i]["round_trip"]
    parsed = spark.range(1).select(chat.parse(F.lit("a<s>b</s>c[INST]d[/INST]<s>e[INST]u\nf[/INST]")).alias("t")).first()["t"]
    assert [tuple(t) for t in parsed] == [(None, "a"), ("assistant", "b"), (None, "</s>c"), (None, "[INST]d"), (None, "<s>e"), ("u", "f")]


def test_mixing_columns_replace_those_of_their_names(spark):
    frame = docs(spark, ["a b", "c d e", None]).withColumns({"mix_taken": F.lit("own"), "mix_size": F.lit(7), "MIX_EPOCHS": F.lit(1)})
    out = mixing.mix(frame)
    assert [r["mix_taken"] for r in out.orderBy("doc_id").collect()] == [2, 3, 0] and len(set(map(str.lower, out.columns))) == len(out.columns)
    assert mixing.mixed_documents(frame).columns == frame.columns and {r["mix_taken"] for r in mixing.mixed_documents(frame).collect()} == {"own"}


def test_mixing_with_many_ranges(spark, monkeypatch):
    frame = docs(spark, [" ".join(["w"] * (i % 9)) for i in range(500)], ["a", "a", "b", None])
    want = sorted(map(str, mixing.mix(frame).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    assert sorted(map(str, mixing.mix(frame).collect())) == want
