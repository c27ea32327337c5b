"""Alignment of tokenizers, personal data and hard negatives."""

import collections
import hashlib
import math
import pickle
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from cadenza.llm import negatives, pii, queries, tokenalign
from pyspark.sql import functions as F

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", "23", ".", "é", "漢", "😀", " ", "　", "▁", "\x00", "\x1c", "\x85", "᠎", "The", "ing", "====", "<|endoftext|>", "</s>", "​", "ﬁ", "\r", "-"]


@pytest.fixture(scope="module")
def untouched():
    """The libraries' own ids of a text, and the bytes of each id."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=B)
    token_a, token_b = tokenalign.Side(A).token, tokenalign.Side(B).token

    def both(text):
        return t.encode(" " + text, add_special_tokens=False).ids, m.encode(text)

    return both, token_a, token_b


def slow_align(rows, untouched):
    """Groups and links of each row by sets of offsets."""
    both, token_a, token_b = untouched
    docs = []
    for i, text in rows:
        groups = []
        if text:
            a, b = both(text)
            whole = (" " + text).encode()
            if b"".join(token_a[x] for x in a) == whole == b"".join(token_b[x] for x in b):
                ends = [list(np.cumsum([len(t[x]) for x in ids])) for t, ids in ((token_a, a), (token_b, b))]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                for lo, hi in zip([0, *cuts], cuts):
                    groups.append(tuple([x for x, e in zip(ids, own) if lo < e <= hi] for ids, own in zip((a, b), ends)))
        docs.append((i, groups))
    count = collections.Counter()
    for _, groups in docs:
        count.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for i, groups in docs:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((str(i), sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out)


def test_ids_are_those_of_the_libraries(untouched):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(1, 14))) for _ in range(1500)]
    both, *tokens = untouched
    for number, path in enumerate((A, B)):
        side = tokenalign.Side(path)
        for i in range(0, len(texts), 50):
            for text, ids in zip(texts[i : i + 50], side.encode([" " + x for x in texts[i : i + 50]])):
                want = both(text)[number]
                good = b"".join(tokens[number][x] for x in want) == (" " + text).encode()
                assert (None if ids is None else ids.tolist()) == (want if good else None), text


@pytest.mark.parametrize("window,links", [(1 << 16, 1 << 18), (16, 3)])
def test_align_matches_brute_force(spark, sf, untouched, monkeypatch, window, links):
    monkeypatch.setattr(tokenalign, "WINDOW", window)
    monkeypatch.setattr(tokenalign, "LINKS", links)
    rnd = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.length("text")).limit(90).collect()]
    rows += [(1000 + i, "".join(rnd.choice(SIGNS) for _ in range(rnd.randint(1, 20)))) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " "), (None, "The end."), (None, "The end."), (7, "The end."), (2003, "=" * 999 + " " * 77 + "漢" * 50), (2004, "x▁y")]
    rows += rows[:3] * 2
    frame = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, pairs int, _k1 string")
    got = tokenalign.align(frame, A, B).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == slow_align(rows, untouched)
    assert tokenalign.align(frame.limit(0), A, B).count() == 0


def test_groups_of_a_long_text(spark, untouched):
    rnd = random.Random(8)
    text = " ".join("".join(rnd.choice("abcdeéü.") for _ in range(rnd.randint(1, 9))) for _ in range(40000))
    row = tokenalign.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B, groups=True).first()
    sides = [[x for g in row["groups"].split(";") for x in g.split("|")[i].split(",")] for i in (0, 1)]
    assert [list(map(int, s)) for s in sides] == list(untouched[0](text))
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"] and row["n_groups"] == row["groups"].count(";") + 1


# -- personal data

def plain_spans(x):
    out = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    check = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out += [(*m.span(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 12 <= len(digits(m)) <= 19 and check(digits(m))]
    out += [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_match_plain_patterns():
    rnd = random.Random(1)
    for _ in range(4000):
        text = "".join(rnd.choice("0123456789.@-+ a1 2.()4é😀") for _ in range(60))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("a" * 200_000 + "1" * 200_000 + "@" * 200_000 + "." * 200_000) == []
    assert pii.base_spans("1." * 50_000) == plain_spans("1." * 50_000)


def test_gradients():
    rng = np.random.default_rng(0)
    m = pii.Tagger(rng)
    m.t += rng.normal(0, 0.3, m.t.shape)
    x, y = rng.integers(0, pii.SIZE, (3, 12)).astype(np.uint8), np.zeros((3, 12), int)
    y[0, 3], y[0, 4:7], y[1, 0], y[1, 1], y[2, 5] = 1, 2, 3, 4, 7
    _, grads = pii._loss_and_gradients(m, x, y)
    for name in m.names:
        own = getattr(m, name)
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in own.shape)
            if name == "t" and not pii._ALLOWED[at]:
                continue
            old, ends = own[at], []
            for step in (1e-5, -1e-5):
                own[at] = old + step
                ends.append(pii._loss_and_gradients(m, x, y)[0])
            own[at] = old
            assert abs((ends[0] - ends[1]) / 2e-5 - grads[name][at]) < 1e-6


def test_decoding_finds_the_best_path():
    rng = np.random.default_rng(4)
    m = pii.Tagger(rng)
    m.t, m.c = rng.normal(0, 1, m.t.shape), rng.normal(0, 1, m.c.shape)
    d = pii.Decoder(m)
    x = rng.integers(0, pii.SIZE, (40, 7)).astype(np.uint8)
    e, t = d.emissions(x).astype(np.float64), m.transitions()
    for j, spans in enumerate(d.spans(x)):
        best = {0: e[0, 0, j], **{k: e[k, 0, j] for k in range(1, pii.LABELS, 2)}}
        best = {k: (v, [k]) for k, v in best.items()}
        for place in range(1, 7):
            best = {k: max(((v + t[p, k] + e[k, place, j], [*path, k]) for p, (v, path) in best.items()), key=lambda w: w[0]) for k in range(pii.LABELS)}
        labels = max(best.values(), key=lambda w: w[0])[1]
        want = [(i, (k - 1) // 2) for i, k in enumerate(labels) if k % 2]
        assert [(s, k) for s, _, k, _ in spans] == want


@pytest.fixture(scope="module")
def model(spark):
    """Trained on spans of made-up prose, half of the documents; the rest is held out."""
    rnd = random.Random(2)
    words = "the and of that she house river talk under never place garden morning letter water people quiet".split()
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + number(14)
        return next(body + c for c in "0123456789" if pii.luhn(body + c))

    def secret():
        return rnd.choice([
            lambda: f"{rnd.choice(words)}.{number(2)}@mail{number(1)}.example.com", lambda: ".".join(str(rnd.randint(1, 254)) for _ in range(4)), card,
            lambda: f"+1 ({number(3)}) 555-{number(4)}"])()

    docs = []
    for i in range(500):
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 200))]
        for _ in range(rnd.randint(0, 3)):
            text.insert(rnd.randint(0, len(text)), secret())
        docs.append((i, " ".join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return pii.fit(frame.filter("doc_id < 300")), docs[300:]


def test_emissions_take_no_new_memory_for_each_batch():
    """Scores are those of gates written out plainly, saturated ones too, and the arrays of a batch serve the next."""
    rng = np.random.default_rng(8)
    m = pii.Tagger(rng)
    m.o, m.c, m.b[0, 0] = rng.normal(size=m.o.shape), rng.normal(size=pii.LABELS), -200.0
    d, sigmoid = pii.Decoder(m), lambda v: 0.5 * (1 + np.tanh(0.5 * v))
    for count, length in ((5, 40), (3, 17), (7, 40)):
        x = rng.integers(0, pii.SIZE, (count, length)).astype(np.uint8)
        h, c, states = np.zeros((count, 2 * pii.HIDDEN)), np.zeros((count, 2 * pii.HIDDEN)), []
        for t in range(length):
            z = (m.inputs()[x[:, t].astype(int) * pii.SIZE + x[:, length - 1 - t]] + h @ m.recurrent()).reshape(count, 4, -1)
            c = sigmoid(z[:, 1]) * c + sigmoid(z[:, 0]) * np.tanh(z[:, 3])
            h = sigmoid(z[:, 2]) * np.tanh(c)
            states.append(h)
        both = np.concatenate([np.array(states)[:, :, : pii.HIDDEN], np.array(states)[::-1, :, pii.HIDDEN :]], axis=2)
        assert np.allclose(d.emissions(x), (both @ m.o + m.c).transpose(2, 0, 1), atol=1e-4)
    assert np.shares_memory(d.emissions(x), d.emissions(x))
    assert not pickle.loads(pickle.dumps(d)).rooms  # executors get the weights alone


def test_tagger_on_held_out_documents(model):
    tagger, held_out = model
    found = pii.tagged(tagger, [t for _, t in held_out])
    base = [pii.base_spans(t) for _, t in held_out]
    total, hit = sum(map(len, base)), sum(len(set(b) & set(f)) for b, f in zip(base, found))
    wrong = sum(not any(s < e2 and e > s2 for s2, e2, _ in b) for b, f in zip(base, found) for s, e, _ in f)
    assert total > 100 and hit >= 0.85 * total and wrong <= 0.02 * total


def test_spans_beyond_the_patterns(model, spark):
    tagger, _ = model
    rows = [(1, "the people write to quiet.river at example dot com under that house"), (2, "never talk to 10[.]20[.]30[.]40 in the morning"),
            (3, "that garden letter (386) 555-3733 and water"), (4, "on 2024-03-15 at 12:30:45 we met 1,234,567.89 people in version 2.3.4 there"), (5, None), (6, ""), (None, "a@b.cd " * 3), (None, "a@b.cd " * 3)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = pii.find_personal_data(frame, model=tagger).collect()
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[1].startswith("email:") and spans[2] == "ip:14:31" and spans[3] == "phone:19:33" and not spans[4] and not spans[5] and not spans[6]
    assert spans[None] == "email:0:6,email:7:13,email:14:20" and len(got) == len(rows)
    assert all((r["n_added"] > 0) == (r["doc_id"] in (1, 2, 3)) for r in got)


def test_windows_agree_with_one_window(model, monkeypatch):
    tagger, held_out = model
    texts = [" ".join(t for _, t in held_out[i : i + 10]) for i in range(0, 50, 10)]
    parts = pii.tagged(tagger, texts)
    monkeypatch.setattr(pii, "WINDOW", 1 << 20)
    whole = pii.tagged(tagger, texts)
    both, one = sum(len(set(p) & set(w)) for p, w in zip(parts, whole)), sum(map(len, whole))
    assert one > 20 and both >= 0.95 * one


def test_personal_data_without_spans(spark):
    frame = spark.createDataFrame([(1, "no such thing here"), (2, "nor here")], "doc_id long, text string")
    assert [r["spans"] for r in pii.find_personal_data(frame).collect()] == ["", ""]
    assert pii.find_personal_data(frame.limit(0)).count() == 0


def test_reconciled():
    found = [(0, 10, 0, 5.0), (5, 14, 0, 4.0), (12, 20, 2, 3.0), (20, 30, 3, 1.0), (22, 26, 1, 2.0)]
    assert pii.reconciled(found) == [(0, 14, 0), (22, 26, 1)]
    assert pii.reconciled([]) == []


# -- hard negatives

def slow_negatives(rows, asked, k=5, n=3):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = min(good.get(i, (label, [math.floor(256 * x) for x in v])), (label, [math.floor(256 * x) for x in v]))
    out = set()
    for a, (label, v) in good.items():
        if asked(a):
            scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in good.items() if i != a)
            for p, pid, _ in [x for x in scored if x[2] == label][:k]:
                fit = [x for x in scored if x[2] != label and 50 * -p <= 100 * -x[0] <= 95 * -p][:n]
                out |= {(a, pid, r, i, -p, -s) for r, (s, i, _) in enumerate(fit, 1)}
    return out


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 25)
    monkeypatch.setattr(negatives, "ANCHORS", 11)
    monkeypatch.setattr(negatives, "PIVOTS", 5)
    rnd = random.Random(6)
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    rows = [(i, [x + rnd.gauss(0, 0.4) for x in rnd.choice(centres)], rnd.randint(0, 4)) for i in range(300)]
    rows += [(300 + i, rows[3][1], i % 2) for i in range(120)] + [(500 + i, [x * 40 for x in rows[i][1]], 3) for i in range(3)]
    rows += [(600, None, 1), (601, [None] * 16, 1), (602, [float("nan")] * 16, 1), (603, [float("inf")] + [0.0] * 15, 2), (604, [], 2), (605, [1.0, 2.0], 2), (606, rows[0][1], None), (None, rows[0][1], 1), (610, rows[5][1], 9), rows[7], (8, rows[9][1], 0)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, id string, v int")
    as_float = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    got = negatives.hard_negatives(frame, F.col("id") % 10 == 0).collect()
    want = slow_negatives(as_float, lambda i: i % 10 == 0)
    assert len(got) == len(want) > 100 and {tuple(r) for r in got} == want
    assert negatives.hard_negatives(frame.limit(0), F.col("id") >= 0).count() == 0
    few = frame.filter("vec_id in (1, 2, 3)")
    assert {tuple(r) for r in negatives.hard_negatives(few, F.col("id") >= 0).collect()} == slow_negatives([r for r in as_float if r[0] in (1, 2, 3)], lambda i: True)


def test_annuli_leave_out_what_is_far(spark, monkeypatch):
    """Clusters far apart: an anchor's search ends without most rings."""
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "PIVOTS", 8)
    rnd = random.Random(7)
    rows = [(i, [(3.0 if j == i % 8 else 0.0) + rnd.gauss(0, 0.02) for j in range(8)], i // 8 % 2) for i in range(640)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    seen = []
    own = negatives.DistanceIndex._visits
    monkeypatch.setattr(negatives.DistanceIndex, "_visits", lambda self, asked, reach: seen.append((own(self, asked, reach).count(), self.rings.count(), asked.count())) or own(self, asked, reach))
    got = negatives.hard_negatives(frame, F.col("id") % 50 == 0)
    assert {tuple(r) for r in got.collect()} == slow_negatives(rows, lambda i: i % 50 == 0)
    assert sum(n for n, _, _ in seen) < 0.5 * 2 * seen[0][1] * seen[0][2]


def test_hard_negatives_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = queries.op13_negatives(spark, sf)
    want = con.sql(queries.oracle_sql()["op13_negatives"])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
