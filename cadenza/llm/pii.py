"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bounded_batches

KINDS = ("email", "ip", "card", "phone")

#: Documents, by hash, whose pattern matches are the labelled spans, and crops of them at most.
SAMPLE, CROPS = 6000, 3000
#: Units of each direction; characters and crops of a training step, and passes over the crops.
HIDDEN, LENGTH, STEP, EPOCHS = 8, 80, 150, 12
#: Characters of a window and of the part that it shares with the next; windows decoded at a time.
WINDOW, SHARED, BATCH = 512, 64, 512

# The patterns of the kinds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of what the patterns match and the checks let through, in order of start
    and kind; in time proportional to the text."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    out += [(*m.span(), 1) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    out += [(*m.span(), 2) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


# Characters as classes: letters a to z, other ASCII signs and white space by themselves, digits, capitals
# and the rest as one class each; class 0 fills up.
_PUNCT = "\n !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASSES = np.full(1 << 16, 3, np.uint8)
_CLASSES[ord("0") : ord("9") + 1] = 1
_CLASSES[ord("A") : ord("Z") + 1] = 2
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz" + _PUNCT):
    _CLASSES[ord(_c)] = 4 + _i
SIZE = 4 + 26 + len(_PUNCT)


def classes(text: str) -> np.ndarray:
    return _CLASSES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0xFFFF)]


#: Labels: 0 is none; 1 + 2 * kind begins a span, after none, and 2 + 2 * kind goes on with it.
LABELS = 1 + 2 * len(KINDS)
_ALLOWED = np.array([[b == 0 or (a == 0 if b % 2 else (a + 1) // 2 == b // 2) for b in range(LABELS)] for a in range(LABELS)])
_FIRST = np.array([b % 2 == 1 or b == 0 for b in range(LABELS)])


class Tagger:
    """Weights of both LSTMs side by side, of the output layer and of the CRF.

    Gates stand in the order input, forget, output, candidate, each with the units of both
    directions; the backward half reads the text from its end.
    """

    def __init__(self, rng: np.random.Generator):
        n, h = 2 * HIDDEN, HIDDEN
        self.w = rng.normal(0, 0.3, (2, SIZE, 4, h))
        self.u = rng.normal(0, 0.3, (2, h, 4, h))
        self.b = np.zeros((4, n))
        self.b[1] = 1.0
        self.o, self.c = rng.normal(0, 0.3, (n, LABELS)), np.zeros(LABELS)
        self.t = np.zeros((LABELS, LABELS))
        self.names = ("w", "u", "b", "o", "c", "t")

    def recurrent(self) -> np.ndarray:
        """Both directions' recurrent weights as one matrix, which mixes none of them."""
        n, h = 2 * HIDDEN, HIDDEN
        out = np.zeros((n, 4, n))
        out[:h, :, :h], out[h:, :, h:] = self.u
        return out.reshape(n, 4 * n)

    def inputs(self) -> np.ndarray:
        """What a pair of characters, one for each direction, adds to the gates."""
        pairs = np.concatenate([np.broadcast_to(self.w[0][:, None], (SIZE, SIZE, 4, HIDDEN)), np.broadcast_to(self.w[1][None], (SIZE, SIZE, 4, HIDDEN))], axis=3)
        return (pairs + self.b).reshape(SIZE * SIZE, 8 * HIDDEN)

    def transitions(self) -> np.ndarray:
        return np.where(_ALLOWED, self.t, -1e4)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _loss_and_gradients(m: Tagger, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Negative log-likelihood of the labels y of crops x, and its gradients, by hand."""
    count, length = x.shape
    n, u, table = 2 * HIDDEN, m.recurrent(), m.inputs()
    codes = x.astype(np.int64) * SIZE + x[:, ::-1]
    h, c = np.zeros((count, n)), np.zeros((count, n))
    kept = []
    states = np.zeros((length, count, n))
    for t in range(length):
        z = (table[codes[:, t]] + h @ u).reshape(count, 4, n)
        i, f, o = (_sigmoid(z[:, k]) for k in range(3))
        g = np.tanh(z[:, 3])
        last_h, last_c = h, c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        kept.append((i, f, o, g, last_h, last_c, tc))
        states[t] = h
    both = np.concatenate([states[:, :, :HIDDEN], states[::-1, :, HIDDEN:]], axis=2)
    e = both @ m.o + m.c
    # The CRF: forward and backward sums, scaled at each place.
    trans = np.exp(m.transitions())
    emit = np.exp(e - e.max(axis=2, keepdims=True))
    alpha, beta, scale = np.zeros_like(emit), np.ones_like(emit), np.zeros((length, count, 1))
    for t in range(length):
        a = emit[t] * (_FIRST if t == 0 else alpha[t - 1] @ trans)
        scale[t] = a.sum(axis=1, keepdims=True)
        alpha[t] = a / scale[t]
    for t in range(length - 2, -1, -1):
        beta[t] = (emit[t + 1] * beta[t + 1]) @ trans.T / scale[t + 1]
    marginal = alpha * beta
    gold = y.T
    where = np.arange(length)[:, None], np.arange(count)[None], gold
    path = e[where].sum() + m.t[gold[:-1], gold[1:]].sum()
    loss = float(np.log(scale).sum() + e.max(axis=2).sum() - path) / count
    de = marginal
    de[where] -= 1
    de /= count
    pairs = trans * np.einsum("tna,tnb->ab", alpha[:-1], emit[1:] * beta[1:] / scale[1:])
    np.subtract.at(pairs, (gold[:-1], gold[1:]), 1)
    grads = {"t": np.where(_ALLOWED, pairs / count, 0), "c": de.sum(axis=(0, 1)), "o": np.einsum("tnh,tnk->hk", both, de)}
    d_both = de @ m.o.T
    d_states = np.concatenate([d_both[:, :, :HIDDEN], d_both[::-1, :, HIDDEN:]], axis=2)
    du, dh, dc = np.zeros_like(u), np.zeros((count, n)), np.zeros((count, n))
    dz_all = np.zeros((length, count, 4 * n))
    for t in range(length - 1, -1, -1):
        i, f, o, g, last_h, last_c, tc = kept[t]
        dh = dh + d_states[t]
        dc = dc + dh * o * (1 - tc**2)
        dz = np.stack([dc * g * i * (1 - i), dc * last_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1).reshape(count, 4 * n)
        dz_all[t] = dz
        du += last_h.T @ dz
        dh, dc = dz @ u.T, dc * f
    d4 = dz_all.reshape(length, count, 4, n)
    grads["b"] = d4.sum(axis=(0, 1))
    dw = np.zeros_like(m.w)
    np.add.at(dw[0], x.T, d4[..., :HIDDEN])
    np.add.at(dw[1], x.T[::-1], d4[..., HIDDEN:])
    grads["w"] = dw
    du = du.reshape(n, 4, n)
    grads["u"] = np.stack([du[:HIDDEN, :, :HIDDEN], du[HIDDEN:, :, HIDDEN:]])
    return loss, grads


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Tagger:
    """A tagger fitted to crops by Adam, steps of STEP crops, gradients clipped."""
    rng = np.random.default_rng(seed)
    m = Tagger(rng)
    first, second = ({k: np.zeros_like(getattr(m, k)) for k in m.names} for _ in range(2))
    step, total = 0, EPOCHS * max(1, -(-len(x) // STEP))
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(order), STEP):
            some = order[i : i + STEP]
            _, grads = _loss_and_gradients(m, x[some], y[some])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            step += 1
            rate = 0.03 * (1 - 0.9 * step / total)
            for k, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                own = getattr(m, k)
                own -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return m


class Decoder:
    """A trained tagger as the arrays that decoding needs."""

    def __init__(self, m: Tagger):
        n = 2 * HIDDEN
        # sigmoid(z) = 1 / (1 + exp(-z)) and tanh(z) = 2 sigmoid(2 z) - 1: exp takes about half of tanh's time.
        sign = np.array([-1.0, -1.0, -1.0, -2.0])
        # A plane for each gate: contiguous arrays are several times as fast as slices of rows.
        self.table = np.ascontiguousarray((m.inputs().reshape(-1, 4, n).transpose(1, 0, 2) * sign[:, None, None]).astype(np.float32))
        self.u = np.ascontiguousarray((m.recurrent().reshape(n, 4, n).transpose(1, 0, 2) * sign[:, None, None]).astype(np.float32))
        self.o, self.c = m.o.astype(np.float32), m.c.astype(np.float32)
        self.t = m.transitions()
        self.rooms: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rooms": {}}

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array to fill, of memory that the last batch had under this name: new memory is touched page by page."""
        size = int(np.prod(shape))
        if name not in self.rooms or len(self.rooms[name]) < size:
            self.rooms[name] = np.empty(size, np.float32)
        return self.rooms[name][:size].reshape(shape)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores of the labels at each place of windows x: labels, length, windows.  They hold until the next call."""
        count, length = x.shape
        n = 2 * HIDDEN
        codes = np.ascontiguousarray((x.astype(np.intp) * SIZE + x[:, ::-1]).T)
        h, c, new = (np.zeros((count, n), np.float32) for _ in range(3))
        both, z, p = self.room("both", length, count, n), self.room("z", 4, count, n), self.room("p", 4, count, n)
        one = np.float32(1)
        i, f, o, g = z
        with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0, as it should be
            for t in range(length):
                for k in range(4):
                    np.take(self.table[k], codes[t], axis=0, out=z[k], mode="clip")
                np.matmul(h, self.u, out=p)
                z += p
                np.exp(z, out=z)
                z += one
                np.reciprocal(z, out=z)
                g += g
                g -= one
                c *= f
                i *= g
                c += i
                np.tanh(c, out=new)
                np.multiply(new, o, out=h)
                both[t, :, :HIDDEN] = h[:, :HIDDEN]
                both[length - 1 - t, :, HIDDEN:] = h[:, HIDDEN:]
        e = np.matmul(self.o.T, both.reshape(-1, n).T, out=self.room("e", LABELS, length * count))
        e += self.c[:, None]
        return e.reshape(LABELS, length, count)

    def spans(self, x: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        """The best path's spans of each window: (start, end, kind, how much they gain over none).

        Only where the best path beats that of no span at all is it traced back.
        """
        e, t32 = self.emissions(x), self.t.astype(np.float32)
        _, length, count = e.shape
        best = self.room("best", length, LABELS, count)
        best[0] = np.where(_FIRST[:, None], e[:, 0], np.float32(-1e4))
        leave, enter, begun, on = t32[:, :1], t32[0, 1::2, None], t32[range(1, LABELS, 2), range(2, LABELS, 2)][:, None], t32[range(2, LABELS, 2), range(2, LABELS, 2)][:, None]
        for t in range(1, length):
            last, now = best[t - 1], best[t]
            now[0] = (last + leave).max(axis=0)
            now[1::2] = last[0] + enter
            np.maximum(last[1::2] + begun, last[2::2] + on, out=now[2::2])
            now += e[:, t]
        none = e[0].sum(axis=0) + (length - 1) * t32[0, 0]
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in range(count)]
        some = np.flatnonzero(best[-1].max(axis=0) > none + 1e-3)
        at = np.arange(len(some))
        best = best[:, :, some]
        path = np.zeros((length, len(some)), np.int64)
        path[-1] = best[-1].argmax(axis=0)
        for t in range(length - 1, 0, -1):
            path[t - 1] = (best[t - 1] + t32[:, path[t]]).argmax(axis=0)
        for j, row in zip(at.tolist(), some.tolist()):
            labels = path[:, j]
            for s in np.flatnonzero(labels % 2 == 1).tolist():
                end = s + 1
                while end < length and labels[end] == labels[s] + 1:
                    end += 1
                won = float((e[labels[s:end], np.arange(s, end), row] - e[0, s:end, row]).sum())
                out[row].append((s, end, int(labels[s] - 1) // 2, won))
        return out


def reconciled(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Spans of a text from all its windows -> those kept: spans of one kind that overlap become
    one, and of what then overlaps the choice with the highest sum of gains is taken."""
    merged: list[list] = []
    for kind in range(len(KINDS)):
        own: list[list] = []
        for s, e, k, won in sorted(x for x in found if x[2] == kind):
            if own and s < own[-1][1]:
                own[-1][1], own[-1][3] = max(own[-1][1], e), max(own[-1][3], won)
            else:
                own.append([s, e, k, won])
        merged += own
    merged.sort(key=lambda x: (x[1], x[0], x[2]))
    ends = [x[1] for x in merged]
    best, choice = [0.0], []
    for i, (s, _, _, won) in enumerate(merged):
        before = bisect.bisect_right(ends, s, 0, i)
        take = best[before] + max(won, 1e-9)
        choice.append((take > best[i], before))
        best.append(max(take, best[i]))
    out, i = [], len(merged)
    while i:
        taken, before = choice[i - 1]
        if taken:
            out.append(tuple(merged[i - 1][:3]))
        i = before if taken else i - 1
    return out[::-1]


_AT = re.compile(r"\s*(?:\[at\]|\(at\)|\{at\}|<at>|\sat\s|@)\s*", re.I)
_DOT = re.compile(r"\s*(?:\[dot\]|\(dot\)|\{dot\}|<dot>|\sdot\s|\[\.\]|\(\.\)|\s\.\s?|\.)", re.I)


def confirmed(text: str, start: int, end: int, kind: int) -> tuple[int, int] | None:
    """A span as its kind must look: whole runs of digits or, in addresses, of letters; checked by the
    rules of the patterns with other signs between the parts.  None if it isn't one."""
    inside = (lambda c: c.isascii() and c.isalnum()) if kind == 0 else (lambda c: c in "0123456789")
    while start < end and not (inside(text[start]) or kind == 3 and text[start] in "+("):
        start += 1
    while end > start and not inside(text[end - 1]):
        end -= 1
    limit = 64  # no more than so many characters are added at either end
    while start > 0 and limit and start < end and inside(text[start]) and inside(text[start - 1]):
        start, limit = start - 1, limit - 1
    limit = 64
    while end < len(text) and limit and start < end and inside(text[end]):
        end, limit = end + 1, limit - 1
    span = text[start:end]
    if not 7 <= len(span) <= 256:
        return None
    if kind == 0:
        plain = re.sub(r"\s+", "", _DOT.sub(".", _AT.sub("@", span)))
        return (start, end) if _EMAIL.fullmatch(plain) and not re.search(r"\.\.", plain) else None
    digits = _digits(span)
    if kind == 1:
        parts = re.split(r"\s*(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\sdot\s|\.)\s*", span)
        return (start, end) if len(parts) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in parts) else None
    if kind == 2:
        return (start, end) if re.fullmatch(r"[0-9 ./_-]+", span) and 12 <= len(digits) <= 19 and luhn(digits) else None
    return (start, end) if re.fullmatch(r"[0-9 +()./-]+", span) and 9 <= len(digits) <= 15 and span.count("+") <= 1 and not re.fullmatch(r"[0-9]+", span) else None


def variant(span: str, kind: int, words: list[str], rng: np.random.Generator) -> str:
    """A labelled span written in another way that people use, or as it is; half of the addresses
    are made of words of the text around them."""
    way = int(rng.integers(8))
    if kind == 0 and len(words) > 2 and rng.random() < 0.5:
        names = [words[i].lower() for i in rng.integers(0, len(words), 3)]
        span = f"{names[0]}{('.', '_', '', '-')[way % 4]}{names[1]}@{names[2]}.{('com', 'org', 'net', 'de', 'fr', 'es', 'co.uk', 'info')[way]}"
        way = int(rng.integers(8))
    if kind == 0 and way < 5:
        local, _, domain = span.partition("@")
        at = (" at ", " [at] ", "[at]", " (at) ", " @ ")[way]
        dot = (" dot ", " [dot] ", "[dot]", ".", ".")[way]
        return local + at + domain.replace(".", dot)
    if kind == 1 and way < 3:
        return span.replace(".", ("[.]", " . ", "(.)")[way])
    digits = _digits(span)
    if kind == 2 and way < 5:
        return (" ", "-", ".", "/", "  ")[way].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == 3 and way < 6:
        last = digits[-10:]
        own = last[:3], last[3:6], last[6:]
        return (f"({own[0]}) {own[1]}-{own[2]}", "-".join(own), ".".join(own), f"00{digits}", f"({own[0]}) {own[1]} {own[2]}", f"{own[0]} {own[1]} {own[2]}")[way] if way != 3 else f"00{digits[:-10]} {' '.join(own)}"
    return span


def _decoy(rng: np.random.Generator) -> str:
    """Something with digits that is no personal data."""
    r = lambda a, b: int(rng.integers(a, b))
    return (
        f"{r(1900, 2030)}-{r(1, 13):02}-{r(1, 29):02}", f"{r(0, 24):02}:{r(0, 60):02}:{r(0, 60):02}", f"{r(1, 999)},{r(100, 999)},{r(100, 999)}.{r(10, 99)}",
        f"version {r(0, 20)}.{r(0, 40)}.{r(0, 99)}", f"{r(1900, 2000)}-{r(2000, 2030)}", f"{r(1, 1 << 30):x}{r(1, 1 << 30):x}{r(1, 1 << 30):x}",
        f"{r(10, 99)}.{r(10, 99)}.{r(1900, 2030)}", f"pp. {r(1, 300)}-{r(300, 999)}", f"{r(100, 10 ** 8)}", f"at {r(1, 12)} dot {r(1, 99)}",
        f"{r(1, 99)}.{r(1, 99)} ({r(1900, 2030)}) {r(1, 99)}", f"see @ {r(1, 50)}.")[r(0, 12)]


def training_set(crops: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Crops and their spans -> classes and labels of LENGTH characters each."""
    rng = np.random.default_rng(seed)
    xs, ys = np.zeros((len(crops), LENGTH), np.uint8), np.zeros((len(crops), LENGTH), np.int64)
    for row, (text, spans) in enumerate(crops):
        out, labels, at, words = "", [], 0, re.findall("[A-Za-z]{3,}", text)
        for s, e, k in spans:
            if s < at:
                continue
            written = variant(text[s:e], k, words, rng)
            out += text[at:s] + written
            labels += [0] * (s - at) + [1 + 2 * k] + [2 + 2 * k] * (len(written) - 1)
            at = e
        out, labels = out + text[at:], labels + [0] * (len(text) - at)
        if not spans and rng.random() < 0.7 and " " in out:
            cut = out.index(" ", int(rng.integers(0, out.rindex(" ") + 1)))
            decoy = " " + _decoy(rng)
            out, labels = out[:cut] + decoy + out[cut:], labels + [0] * len(decoy)
        first = next((i for i, label in enumerate(labels) if label), len(labels) // 2)
        begin = max(0, min(first - int(rng.integers(2, 40)), len(out) - 1))
        codes = classes(out[begin : begin + LENGTH])
        xs[row, : len(codes)], ys[row, : len(codes)] = codes, labels[begin : begin + LENGTH]
        if ys[row, 0] and ys[row, 0] % 2 == 0:  # begins within a span
            ys[row, 0] -= 1
    return xs, ys


def _crops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to four surroundings of spans of each text, and one without a span."""
    for batch in batches:
        out = []
        for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
            spans = base_spans(text or "")
            for s, e, _ in spans[:4]:
                lo, hi = max(0, s - 48), min(len(text), e + 48)
                inside = [x for x in spans if x[0] < hi and x[1] > lo]
                lo, hi = max(lo, s - 48, *(x[1] for x in inside if x[0] < lo), 0), min(hi, *(x[0] for x in inside if x[1] > hi), len(text))
                out.append((h, lo, text[lo:hi], [f"{a - lo}:{b - lo}:{k}" for a, b, k in inside if a >= lo and b <= hi]))
            if text:
                lo = (h & 0x7FFFFFFF) % len(text)
                hi = min(len(text), lo + 96)
                if not any(x[0] < hi and x[1] > lo for x in spans):
                    out.append((h, lo, text[lo:hi], []))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())))], names=["h", "at", "crop", "spans"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Decoder | None:
    """A tagger trained on the surroundings of pattern matches in SAMPLE documents, CROPS of them at
    most, half with spans and half without; None where no span is found."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.xxhash64(F.col(f"`{id_col}`").cast("long"), text).alias("h"), text.alias("text"))
    sample = rows.select("h").orderBy("h").limit(SAMPLE)
    chosen = rows.join(F.broadcast(sample.distinct()), "h")  # SAMPLE hashes at most
    crops = chosen.mapInArrow(_crops, "h long, at long, crop string, spans array<string>")
    half = CROPS // 2
    found = [r for with_spans in (True, False) for r in crops.filter((F.size("spans") > 0) == with_spans).orderBy("h", "at").limit(half).collect()]
    labelled = [(r["crop"], [tuple(map(int, s.split(":"))) for s in r["spans"]]) for r in found]
    spans = [x for x in labelled if x[1]]
    if not spans:
        return None
    spans *= -(-half // len(spans))  # few of them are written in more ways each
    return Decoder(train(*training_set(spans[:half] + [x for x in labelled if not x[1]])))


def windows(length: int) -> list[tuple[int, int]]:
    out, at = [], 0
    while True:
        out.append((at, min(length, at + WINDOW)))
        if at + WINDOW >= length:
            return out
        at += WINDOW - SHARED


def tagged(model: Decoder, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The model's spans of each text, reconciled over its windows and confirmed."""
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    places, codes = [], []
    for i, text in enumerate(texts):
        if text:
            own = classes(text)
            for a, b in windows(len(text)):
                places.append((b - a, i, a))
                codes.append(own[a:b])
    order = sorted(range(len(places)), key=places.__getitem__)
    for j in range(0, len(order), BATCH):
        some = order[j : j + BATCH]
        width = places[some[-1]][0]
        x = np.zeros((len(some), width), np.uint8)
        for row, k in enumerate(some):
            x[row, : len(codes[k])] = codes[k]
        for k, spans in zip(some, model.spans(x)):
            _, i, a = places[k]
            found[i] += [(a + s, min(a + e, len(texts[i])), kind, won) for s, e, kind, won in spans if a + s < len(texts[i])]
    out = []
    for text, spans in zip(texts, found):
        sure = [(confirmed(text, s, e, k), k) for s, e, k in reconciled(spans)] if spans else []
        out.append(sorted({(*place, k) for place, k in sure if place}, key=lambda x: (x[0], x[2])))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _find(model: Decoder | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                more = tagged(model, texts) if model is not None else [[] for _ in texts]
                rows = []
                for text, extra in zip(texts, more):
                    base = base_spans(text)
                    taken, added = sorted((s, e) for s, e, _ in base), []
                    for s, e, k in extra:
                        j = bisect.bisect_left(taken, (e,))
                        if not any(b > s for _, b in taken[max(0, j - 2) : j]) and not (added and added[-1][1] > s):
                            added.append((s, e, k))
                    rows.append((*(sum(k == kind for _, _, k in base) for kind in range(len(KINDS))), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + added, key=lambda x: (x[0], x[2]))), len(added)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.int64())],
                    names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Decoder | None = None) -> DataFrame:
    """E-mail and IP addresses, card and phone numbers in each text: doc_id, n_email, n_ip, n_card,
    n_phone, base_sha256, spans, n_added.

    The counts and base_sha256 (of `kind:start:end`, comma-joined, code points, end exclusive)
    are those of the patterns; spans has the patterns' and what the tagger adds to them: spans
    that overlap none of the patterns', written with other signs than the patterns know, and that
    hold up as numbers or addresses.  `model` is one from fit(); without it one is trained on
    docs, on a bounded sample.  Decoding covers every character, in windows of WINDOW that share
    SHARED with the next.

    A null or empty text has none.  One row for each row, whatever its id; an empty table gives
    an empty one; other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    with bounded_batches(docs.sparkSession):
        model = fit(docs, id_col, text_col) if model is None else model
    return rows.mapInArrow(_find(model), FOUND)
