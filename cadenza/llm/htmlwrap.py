"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is a tree of elements.  Its host's wrapper is a tree of the same kind in which each child
is required, optional (?), repeated (+) or both (*), and stands for text slots and elements; no
child is ever a choice of two.  Pages are aligned with the wrapper one after another: children
that do not match become optional, neighbours that match each other become repeated.  Alignment
of two wrappers is the same operation, so wrappers of parts of a host's pages merge to its own.

Children are aligned from both ends, then between labels that both have once, and only what is left
by a table.  An element that has gathered over FULL children is condensed: of its optional ones those
that few pages have, and that stand next to each other, become one repeated slot for any element of
their tag.  A wrapper thus doesn't grow with the number of pages, and folding a page takes time in
proportion to the page.
"""

from __future__ import annotations

import bisect
import html
import json
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import if_small, stored
from cadenza.llm.urlfilter import url_host

# Fixed values of HTML: elements without content, with raw text, that end each other, inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

#: Elements that are never main text, and words of class, id or role that mark such elements.
ASIDE = frozenset("head nav header footer aside form script style noscript template iframe svg math button select option textarea menu dialog object canvas".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement adverts promo promoted promotion sponsor sponsored banner sidebar side rail menu nav navbar navigation breadcrumb"
    " breadcrumbs topbar header masthead footer foot bottom copyright legal cookie cookies consent notice notices alert popup modal overlay newsletter"
    " subscribe signup login share sharing social related recommended recommendations more comment comments reply replies respond disqus discussion"
    " reader readers feedback widget toolbar pagination pager search tags hidden contentinfo complementary banners skip".split())
MAIN = frozenset("article main articlebody".split())

#: Elements that may end others; how deep functions may call themselves on nested elements.
ENDERS = frozenset().union(*ENDED_BY.values())
CALLS = 1_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")


#: Children of a wrapper's element beyond which it is condensed; on so small a part of the pages a child is rare.
FULL, RARE = 64, 1 / 32
#: What stands in a label for any words of class, id and role.
ANY = ".*"


class Node:
    """An element of a page: its label, and children that are nodes or strings."""

    __slots__ = ("tag", "label", "kids")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.kids = tag, label, []


def label_of(tag: str, attributes: str) -> str:
    """Tag and the words of class, id, role: what tells elements of one template apart."""
    if not attributes.strip():
        return tag
    words, hidden = set(), False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name in ("class", "id", "role", "itemprop"):
            words.update(_WORDS.findall(value))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return ".".join([tag, *sorted(words | ({"hidden"} if hidden else set()))])


def parse(page: str) -> Node:
    """The tree of a page, however badly or deeply nested: ends are put where HTML lets them be left out."""
    root = Node("", "")
    stack, at, open_ = [root], 0, Counter()

    def close(i: int) -> None:
        for node in stack[i:]:
            open_[node.tag] -= 1
        del stack[i:]

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            for i in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break  # an inline end reaches no further than its block
        elif m[2]:
            tag = m[2].lower()
            if tag in BLOCKS:
                while len(stack) > 1 and stack[-1].tag not in BLOCKS or stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                    close(len(stack) - 1)
            for i in range(len(stack) - 1, 0, -1) if tag in ENDERS else ():
                if stack[i].tag in HOLDS.get(tag, ()):
                    break
                if tag in ENDED_BY.get(stack[i].tag, ()):
                    close(i)
                    break
            node = Node(tag, label_of(tag, m[3]))
            stack[-1].kids.append(node)
            if tag in RAW:
                end = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif tag not in VOID and not m[3].endswith("/"):
                stack.append(node)
                open_[tag] += 1
    if at < len(page):
        stack[-1].kids.append(page[at:])
    return root


# A wrapper is a list [label, mark, slot, children]: mark is "", "?", "+" or "*", and slot is
# [pages, characters, characters in links, hash of the text if it is the same everywhere], of own
# text, whatever its length; the hash is empty where there is no text.


def blocks_of(node: Node) -> tuple[str, int, int, list[Node]]:
    """An element's own text, its characters, those of them in links, and the elements that are no
    part of it: inline elements belong to the text around them."""
    texts, kids, chars, links = [], [], 0, 0
    stack = [(iter(node.kids), node.tag == "a")]
    while stack:
        rest, link = stack[-1]
        for kid in rest:
            if isinstance(kid, str):
                if kid := kid.strip():
                    texts.append(kid)
                    chars += len(kid)
                    links += len(kid) * link
            elif kid.tag in BLOCKS or kid.tag in ASIDE or marked(kid.label):
                kids.append(kid)
            else:
                stack.append((iter(kid.kids), link or kid.tag == "a"))
                break
        else:
            stack.pop()
    return " ".join(texts), chars, links, kids


def skeleton(root: Node) -> list:
    """A page as the wrapper of itself; of menus, forms and the like, which hold no main text, the
    element alone."""
    order, built = [(root, 0)], []
    for node, _ in order:  # grows meanwhile: an element's children come after it, next to each other
        text, chars, links, kids = blocks_of(node)
        order.extend((kid, len(built)) for kid in kids if not marked(node.label))
        built.append([node.label, "", [1, chars, links, _digest(text)], []])
    for (_, parent), own in zip(order[:0:-1], built[:0:-1]):
        own[3] = repeat(own[3][::-1])
        built[parent][3].append(own)
    built[0][3] = repeat(built[0][3][::-1])
    return built[0]


def dumps(wrapper: list) -> str:
    """A wrapper as JSON: its elements from the top, each with its depth, so that no nesting is too deep."""
    flat, stack = [], [(0, wrapper)]
    while stack:
        depth, (label, mark, slot, kids) = stack.pop()
        flat.append((depth, label, mark, slot))
        stack.extend((depth + 1, kid) for kid in reversed(kids))
    return json.dumps(flat)


def loads(text: str) -> list:
    path: list[list] = []
    for depth, label, mark, slot in json.loads(text):
        own = [label, mark, slot, []]
        del path[depth:]
        if path:
            path[-1][3].append(own)
        path.append(own)
    return path[0]


def _mark(optional: bool, repeated: bool) -> str:
    return ("*" if optional else "+") if repeated else ("?" if optional else "")


def repeat(kids: list) -> list:
    """Neighbours of one label, one after another or in turns of up to three, become repeated."""
    for width in (1, 2, 3):
        out: list = []
        for kid in kids:
            out.append(kid)
            last, before = out[-width:], out[-2 * width : -width]
            if len(before) == width and [x[0] for x in last] == [x[0] for x in before] and (width == 1 or len({x[0] for x in last}) > 1):
                out[-2 * width :] = [_same(a, b, True) for a, b in zip(before, last)]
        kids = out
    return kids


def _same(a: list, b: list, repeated: bool = False) -> list:
    """Two wrappers of one label as one."""
    slot = [max(a[2][0], b[2][0]) if repeated else a[2][0] + b[2][0], a[2][1] + b[2][1], a[2][2] + b[2][2], a[2][3] if a[2][3] == b[2][3] else None]
    repeated = repeated or a[1] in "+*" and a[1] != "" or b[1] in "+*" and b[1] != ""
    optional = "?" in (a[1], b[1]) or "*" in (a[1], b[1])
    return [a[0], _mark(optional, repeated), slot, condense(align(a[3], b[3]), slot[0])]


def _optional(x: list) -> list:
    return [x[0], _mark(True, x[1] in ("+", "*")), x[2], x[3]]


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Places of labels that a and b have once each: the longest run of them in the order of both."""
    once_a, once_b = ({x[0]: i for i, x in enumerate(side) if count[x[0]] == 1} for side, count in ((a, Counter(x[0] for x in a)), (b, Counter(x[0] for x in b))))
    pairs = [(i, once_b[label]) for label, i in once_a.items() if label in once_b]
    tails: list[int] = []  # of runs by length, the last place in b
    ends: list[int] = []  # and that pair's number
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tails, j)
        tails[at : at + 1], ends[at : at + 1] = [j], [n]
        before[n] = ends[at - 1] if at else -1
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _between(a: list, b: list, out: list) -> None:
    """Align children of which neither side begins or ends like the other, by a table."""
    if not a or not b:
        out += map(_optional, a or b)
        return
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i][0] == b[j][0]:
            out.append(_same(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    out += map(_optional, a[i:] or b[j:])


def align(a: list, b: list) -> list:
    """Children of two wrappers, matched in order as far as possible; the others are optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [_same(x, y) for x, y in zip(a, b)]
    if len(a) + len(b) <= FULL:
        out: list = []
        _between(a, b, out)
        return repeat(out)
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i][0] != b[i][0]), n)
    tail = next((i for i in range(n - head) if a[-1 - i][0] != b[-1 - i][0]), n - head)
    out = [_same(x, y) for x, y in zip(a[:head], b[:head])]
    ends = [_same(x, y) for x, y in zip(a[len(a) - tail :], b[len(b) - tail :])]
    a, b, i, j = a[head : len(a) - tail], b[head : len(b) - tail], 0, 0
    for x, y in [*_anchors(a, b), (len(a), len(b))]:
        _between(a[i:x], b[j:y], out)
        if x < len(a):
            out.append(_same(a[x], b[y]))
        i, j = x + 1, y + 1
    return repeat(out + ends)


def condense(kids: list, pages: int) -> list:
    """The children of an element that `pages` pages have, without its rare ones if there are many.

    Optional children that are on few pages, hold main text by no name of theirs and stand next to
    each other by tag become one repeated child for any label of the tag.  A child that is met
    again later is a child of its own again, and stays one when enough pages have it.
    """
    if len(kids) <= FULL:
        return kids
    out: list = []
    for kid in kids:
        tag = kid[0].partition(".")[0]
        rare = kid[1] in ("?", "*") and kid[2][0] <= max(1, pages * RARE) and not marked(kid[0]) and not is_main(kid[0])
        if not rare and kid[0] != tag + ANY:
            out.append(kid)
        elif out and out[-1][0] == tag + ANY:
            both = _same(out[-1], [tag + ANY, *kid[1:]], True)
            out[-1] = [tag + ANY, "*", both[2], both[3]]
        else:
            out.append([tag + ANY, "*", kid[2], kid[3]])
    # Those of one tag that only others kept apart are still too many where each page has its own order.
    if len(out) > FULL:
        first: dict[str, int] = {}
        left: list = []
        for kid in out:
            if kid[0].endswith(ANY) and kid[0] in first:
                both = _same(left[first[kid[0]]], kid, True)
                left[first[kid[0]]] = [kid[0], "*", both[2], both[3]]
            else:
                if kid[0].endswith(ANY):
                    first[kid[0]] = len(left)
                left.append(kid)
        out = left
    return out


def marked(label: str) -> bool:
    tag, *words = label.split(".")
    return tag in ASIDE or not MARKS.isdisjoint(words) and tag not in ("html", "body")


def is_main(label: str) -> bool:
    return not MAIN.isdisjoint(label.split("."))


def _digest(text: str) -> str:
    return text and xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


class Slot:
    """An element of a host's wrapper, with what its own text is.

    main: text of pages that have an article or main element with text; other: of other pages.
    """

    __slots__ = ("label", "repeated", "optional", "same", "main", "other", "kids", "at")

    def __init__(self, wrapper: list):
        self.label, mark, (pages, _, _, text), _ = wrapper
        self.repeated, self.optional = mark in ("+", "*"), mark in ("?", "*")
        self.same = text if text and pages > 1 else ""
        self.main = self.other = False
        self.kids: list[Slot] = []
        self.at: dict[str, list[int]] = {}

    def places(self, label: str) -> list[int]:
        """The children that a child of this label may stand for: those of its label, else of its tag."""
        return self.at.get(label) or self.at.get(label.partition(".")[0] + ANY, [])


def slots_of(wrapper: list) -> Slot:
    """The wrapper with main and other decided for each of its elements.

    Elements of menus, forms and the like hold no main text.  Elsewhere text that is the same on
    several pages is of the template.  Inside article and main, which speak for a text, this
    takes three pages and most of those that have the element; outside, a slot that is
    mostly links holds none either.  Where no text of a kind varies, pages are copies of each other,
    and all of it stays.
    """
    inside_, outside = [], []  # (slot, whether its text is the template's, characters)
    root = Slot(wrapper)
    stack = [(wrapper, root, 0)]
    while stack:
        w, slot, holder = stack.pop()
        slot.kids = [Slot(kid) for kid in w[3]]
        for i, kid in enumerate(slot.kids):
            slot.at.setdefault(kid.label, []).append(i)
        if marked(w[0]):
            continue
        pages, chars, links, text = w[2]
        holder = holder or (pages if is_main(w[0]) else 0)
        if holder:
            inside_.append((slot, bool(text) and pages > 2 and 2 * pages > holder, chars))
        if chars and 2 * links <= chars:
            outside.append((slot, bool(slot.same), chars))
        stack.extend((kid, own, holder) for kid, own in zip(w[3], slot.kids))
    for name, found in (("main", inside_), ("other", outside)):
        copies = not any(chars and not same for _, same, chars in found)
        for slot, same, _ in found:
            setattr(slot, name, copies or not same)
    return root


def text_slots(wrapper: list) -> tuple[set[tuple[str, ...]], set[tuple[str, ...]]]:
    """The paths of labels that have a slot of main text: main and other of slots_of()."""
    main, other = set(), set()

    def walk(slot: Slot, path: tuple[str, ...]) -> None:
        path = (*path, slot.label)
        if slot.main:
            main.add(path)
        if slot.other:
            other.add(path)
        for kid in slot.kids:
            walk(kid, path)

    walk(slots_of(wrapper), ())
    return main, other


def fit(kids: list[tuple[str, str]], slot: Slot) -> list[int]:
    """For each of an element's children (label, hash of its text) the child of the wrapper it
    stands for, or -1.

    The children follow the wrapper in order, repeated ones stay where they are or go back to
    the beginning of their turn of up to three.  Of all ways to match, that with most children
    counts, then that in which texts of the template are found where the wrapper has them.
    """
    if all(len(slot.places(label)) == 1 for label, _ in kids):
        return [slot.places(label)[0] for label, _ in kids]
    ends: dict[int, tuple[int, tuple | None]] = {-1: (0, None)}  # place of the last match -> score, way there
    for label, text in kids:
        after = {at: (score, (-1, way)) for at, (score, way) in ends.items()}
        for j in slot.places(label):
            own = slot.kids[j]
            worth = 8 + (0 if not own.same else 2 if own.same == text else -4) + (not own.optional)
            for at, (score, way) in ends.items():
                turn = own.repeated and at >= 0 and 0 <= at - j <= 2 and all(k.repeated for k in slot.kids[j : at + 1])
                if (j > at or turn) and (j not in after or after[j][0] < score + worth):
                    after[j] = (score + worth, (j, way))
        ends = after
    _, way = max(ends.values(), key=lambda x: x[0])
    out = []
    while way is not None:
        out.append(way[0])
        way = way[1]
    return out[::-1]


def matched(root: Node, wrapper: Slot) -> tuple[set[Node], set[Node]]:
    """The elements of a page whose text is main text, by the wrapper's main and other slots.

    An element that fits nowhere in the wrapper counts as text there if its parent does or it
    is an article or main element.
    """
    main, other = set(), set()
    stack: list[tuple[Node, Slot | None, list[Node], tuple[bool, bool]]] = [(root, wrapper, blocks_of(root)[3], (False, False))]
    while stack:
        node, slot, parts, was = stack.pop()
        open_ = (slot.main, slot.other) if slot else (was[0] or is_main(node.label), was[1])
        if open_[0]:
            main.add(node)
        if open_[1]:
            other.add(node)
        parts = [kid for kid in parts if not marked(kid.label)]
        inner = [blocks_of(kid) for kid in parts]
        if slot is None:
            places = [-1] * len(parts)
        else:
            ambiguous = any(len(slot.places(kid.label)) > 1 for kid in parts)
            places = fit([(kid.label, _digest(own[0]) if ambiguous else "") for kid, own in zip(parts, inner)], slot)
        stack.extend((kid, slot.kids[at] if at >= 0 else None, own[3], open_) for kid, own, at in zip(parts, inner, places))
    return main, other


def has_main(root: Node) -> bool:
    """Whether a page has text in an article or main element."""
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        for kid in node.kids:
            if isinstance(kid, str):
                if inside and kid.strip():
                    return True
            elif kid.tag not in RAW and not marked(kid.label):
                stack.append((kid, inside or kid.tag in BLOCKS and is_main(kid.label)))
    return False


def extract(root: Node, slots: set[Node]) -> str:
    """The text of those elements of a page, a line for each block."""
    lines, held = [], []

    def close() -> None:
        if line := " ".join(html.unescape("".join(held)).split()):
            lines.append(line)
        held.clear()

    stack = [(iter(root.kids), root in slots, True)]
    while stack:
        rest, open_, block = stack[-1]
        for kid in rest:
            if isinstance(kid, str):
                if open_:
                    held.append(kid)
            elif kid.tag in BLOCKS or kid.tag in ASIDE or marked(kid.label):
                if not marked(kid.label):
                    close()
                    stack.append((iter(kid.kids), kid in slots, True))
                    break
            elif kid.tag not in RAW:
                if kid.tag == "br":
                    held.append(" ")
                stack.append((iter(kid.kids), open_, False))
                break
        else:
            stack.pop()
            if block:
                close()
    return "\n".join(lines)


def page_text(page: str, wrapper: Slot) -> str:
    """The main text of a page, matched with its host's wrapper."""
    root = parse(page)
    main, other = matched(root, wrapper)
    return extract(root, main if has_main(root) else other)


def _wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages -> a wrapper of each host for its pages of this task."""
    sys.setrecursionlimit(max(CALLS, sys.getrecursionlimit()))
    known: dict[str, list] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(known), pa.string()), pa.array([dumps(w) for w in known.values()], pa.string())], names=["host", "wrapper"])

    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                own = skeleton(parse(page or ""))
                known[host] = _same(known[host], own) if host in known else own
            if len(known) > 2000:
                yield out()
                known.clear()
    yield out()


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    sys.setrecursionlimit(max(CALLS, sys.getrecursionlimit()))
    whole = None
    for w in map(loads, sorted(group["wrapper"])):
        whole = w if whole is None else _same(whole, w)
    return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [dumps(whole)]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, html) -> one wrapper (JSON) for each host.

    Each task folds its pages to a wrapper for each of its hosts, and only these are shuffled:
    a host with a third of all pages gives no more rows than there are tasks.  Where a host has
    many, they are merged in about the square root of their number of parts first.
    """
    parts = stored(pages.mapInArrow(_wrappers, "host string, wrapper string"), "html-parts")
    most = parts.groupBy("host").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    salts = math.isqrt(most)
    if salts > 1:
        salt = F.pmod(F.xxhash64("wrapper"), F.lit(salts)).alias("salt")
        parts = parts.groupBy("host", salt).applyInPandas(_merged, "host string, wrapper string")
    return parts.groupBy("host").applyInPandas(_merged, "host string, wrapper string")


def _texts(known: Broadcast | None):
    """Pages with their wrapper, or their host and the wrappers of all hosts, to main texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[str, Slot] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = []
                for name, page in zip(part.column("of").to_pylist(), part.column("html").to_pylist()):
                    if name not in slots:
                        if len(slots) > 2000:
                            slots.clear()
                        slots[name] = slots_of(loads(name if known is None else known.value[name]))
                    texts.append(page_text(page or "", slots[name]))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each page: page_id, url, text, n_chars, one row for each row.

    Character references are decoded, white space inside a block is one space, and blocks are
    joined by one line feed in page order.  A null or empty page, or one without main text, has
    an empty text.  Pages whose URL is null or has no host share a wrapper.  Null and repeated
    ids stay; an empty table gives an empty one; other columns are not read.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(url_host(F.col(url_col).cast("string")), F.lit("")).alias("host"), F.col(html_col).cast("string").alias("html"))
    wrappers = stored(infer_wrappers(rows.select("host", "html")), "html-wrappers")
    schema = "page_id long, url string, text string"
    if if_small(wrappers) is wrappers:
        texts = rows.join(wrappers, "host").select("page_id", "url", "html", F.col("wrapper").alias("of")).mapInArrow(_texts(None), schema)
    else:  # BROADCAST_BYTES at most: once to each executor, not beside each page
        known = pages.sparkSession.sparkContext.broadcast(dict(map(tuple, wrappers.collect())))
        texts = rows.select("page_id", "url", "html", F.col("host").alias("of")).mapInArrow(_texts(known), schema)
    return texts.withColumn("n_chars", F.length("text").cast("long"))
