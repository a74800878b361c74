"""Main text of web pages by wrappers inferred per host (operator 7).

A wrapper is a union-free regular expression over the token stream of a host's pages: elements in order, each
possibly optional or repeated, with constant texts and text slots. Pages are aligned with it one after the other: a
token that only one side has becomes optional, a run of like elements becomes a repeated group. Whether a text is a
constant or a slot is decided per place, the elements that lead to it: a text is constant if every page that has the
place has it there, and ``FEW`` different pages show it. That is an intersection of sets, so it is the same in whatever
order and over however many tasks pages are dealt, which alignment alone is not. Every task folds its pages of a host
into one wrapper, and wrappers of a host are folded in two steps. All pages take part.

A slot is main text if it lies in the page's content region and in no boilerplate element. The region is every article
of the page, whatever its class and place, else every main, else the element that holds most of the text that varies
between the host's pages, else (a host with other templates) the page's own element with most text. Pages are then
matched with their host's wrapper and the texts of main slots are returned, block by block: a block of constant texts
only is part of the template and left out, unless it is a heading, a table head, a term or a caption. A page whose
region holds nothing else keeps them.

Boilerplate is told by tag and role, and by whole class or id names: outside articles one such name is enough, inside
them all names of an element must be such. An element that holds an article, or more than half of the page's text, is
none, whatever its names; reader comments always are.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molweave.session import materialise

from .common import table

#: levels of a wrapper; what lies deeper is read like any other text and belongs to the place at this level
DEPTH = 100
#: rows per host that are folded at once in the second step
SALTS = 16
#: bytes of all wrappers up to which they are sent to every task (measured); beyond it pages meet them in a join
SEND_BYTES = 32 << 20

#: fixed values: HTML element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table tbody thead tfoot article section main body nav aside footer header div form blockquote".split())
BOILERPLATE = frozenset("head nav footer aside form button select dialog menu title input".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr "
    "notice notices alert alerts popup modal overlay menu menus nav navbar navigation sidebar breadcrumb breadcrumbs footer header masthead "
    "comment comments replies reply respond disqus share shares sharing social related newsletter subscribe subscription signup login widget widgets".split()
)
#: the names of reader comments, which are left out whatever they hold
COMMENTS = frozenset("comment comments replies reply respond disqus".split())
#: words that make a name of several words no other thing
NEUTRAL = frozenset("entry article user reader site page main top bottom left right bar box list container wrapper wrap area section block links buttons icons inner outer form posts post global primary secondary the and of by".split())
#: blocks of these stay, even if all pages of a host have them
KEPT = frozenset("h1 h2 h3 h4 h5 h6 th dt caption figcaption summary legend".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu alert dialog".split())

#: different pages (by their text outside boilerplate) that must share a text before it counts as constant
FEW = 3
#: items of a repeated group at most
PERIOD = 4
#: item pairs up to which the table of an alignment is held whole; beyond it rows are computed twice
CELLS = 250_000

TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"""
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>|(?P<text>[^<]+|<)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Element:
    __slots__ = ("key", "tag", "children")

    def __init__(self, key: str, tag: str):
        self.key, self.tag, self.children = key, tag, []


def _key(tag: str, rest: str) -> str:
    """Name, class, id and role; numbers in them are left out."""
    if not rest or "=" not in rest:
        return tag
    found = sorted((m[1].lower(), m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest))
    return tag + "".join(f"|{name}={re.sub(r'[0-9]+', '', value)}" for name, value in found)


def parse(page: str | None) -> Element:
    """The page as nested elements; texts are strings. Missing end tags are supplied."""
    root = Element("", "")
    stack = [root]
    text = page or ""
    at, size = 0, len(text)
    while at < size:
        m = TOKEN.match(text, at)
        at = m.end()
        if m["text"]:
            here = stack[-1].children
            if here and isinstance(here[-1], str):
                here[-1] += m["text"]
            else:
                here.append(m["text"])
            continue
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        rest = m["rest"] if m["tag"] else m["rest2"]
        if m["close"] or m["close2"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in HOLDS and tag in INLINE | {"p"}:
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(text, at) if not rest.endswith("/") else None
            at = end.end() if end else at if rest.endswith("/") else size
            continue
        ends = CLOSES.get(tag) or ({"p"} if tag not in INLINE and tag not in VOID - {"hr"} else ())
        for k in range(len(stack) - 1, 0, -1) if ends else ():
            if stack[k].tag in ends:
                del stack[k:]
                break
            if stack[k].tag in HOLDS and stack[k].tag not in ends:
                break
        node = Element(_key(tag, rest), tag)
        stack[-1].children.append(node)
        if tag not in VOID and not rest.endswith("/"):
            stack.append(node)
    return root


# A wrapper item: [key, optional, repeated, items]; key "#" is a text.
KEY, OPTIONAL, REPEATED, ITEMS = range(4)

def _hash(words: str) -> int:
    return int.from_bytes(blake2b(words.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def _merge(x: list, y: list) -> list:
    """One item for two of the same key."""
    return [x[KEY], x[OPTIONAL] or y[OPTIONAL], x[REPEATED] or y[REPEATED], align(x[ITEMS], y[ITEMS])]


def _collapse(items: list) -> list:
    """Runs of like items, and of like groups of up to ``PERIOD`` items, become repeated ones."""
    out: list = []
    for item in items:
        out.append(item)
        shrunk = True
        while shrunk:
            shrunk = False
            for p in range(1, min(PERIOD, len(out) // 2) + 1):
                if all(out[-k][KEY] == out[-k - p][KEY] for k in range(1, p + 1)):
                    last = [_merge(x, y) for x, y in zip(out[-2 * p : -p], out[-p:], strict=True)]
                    for x in last:
                        x[REPEATED] = True
                    out[-2 * p :] = last
                    shrunk = p > 1
                    break
    return out


def _identity(page: Element, dropped: set[int]) -> int:
    """A hash of the texts outside boilerplate: copies of a page say nothing about its host."""
    found = 0
    stack = [page]
    while stack:
        for child in stack.pop().children:
            if isinstance(child, str):
                found = crc32(" ".join(child.split()).encode("utf-8", "surrogatepass"), found)
            elif id(child) not in dropped:
                stack.append(child)
    return found


@lru_cache(1 << 14)
def _names(key: str) -> tuple[bool, bool, bool, bool]:
    """Of an element: boilerplate by tag or role; has a boilerplate name; has no other names; is named as comments."""
    tag, *marks = key.split("|")
    values = dict(m.partition("=")[::2] for m in marks)
    if tag in BOILERPLATE or values.get("role", "").lower() in ROLES and tag not in ("body", "html", "article", "main"):
        return True, True, True, False
    found = [_words(n) for kind in ("class", "id") for n in values.get(kind, "").lower().split()]
    good = [bool(words & NAMES) and words <= NAMES | NEUTRAL for words in found]
    plain = [words <= NEUTRAL for words in found]
    comments = any(g and words & COMMENTS for g, words in zip(good, found, strict=True))
    return False, any(good), any(good) and all(g or p for g, p in zip(good, plain, strict=True)), comments


def _words(name: str) -> set[str]:
    return {w for w in re.split(r"[^a-z]+", name) if w}


def boilerplate(page: Element) -> set[int]:
    """The elements (by ``id``) that are left out with all below them."""
    order, parents = [page], [-1]
    for at, element in enumerate(order):
        for child in element.children:
            if not isinstance(child, str):
                order.append(child)
                parents.append(at)
    # text and articles below every element, from the leaves up; what tags leave out does not count
    size, named = [0] * len(order), [False] * len(order)
    for at in range(len(order) - 1, 0, -1):
        element = order[at]
        size[at] += sum(len(c) - c.count(" ") - c.count("\n") for c in element.children if isinstance(c, str))
        if not _names(element.key)[0]:
            size[parents[at]] += size[at]
            named[parents[at]] |= named[at] or _article(element.key) is not None and not _names(element.key)[1]
    everything = size[0] + sum(len(c) for c in page.children if isinstance(c, str))
    dropped: set[int] = set()
    inside = [False] * len(order)
    for at in range(1, len(order)):
        element, up = order[at], parents[at]
        inside[at] = inside[up] or _article(element.key) is not None
        always, some, only, comments = _names(element.key)
        # in a page with an article, what holds most of the text need not be it
        holds = named[at] or not named[0] and 2 * size[at] > everything
        if element.tag in ("body", "html", "article", "main") and not always:
            continue
        if always or comments or not holds and (only if inside[at] else some):
            dropped.add(id(element))
    return dropped


def generalise(element: Element, depth: int = 0) -> list:
    """The items of one page's element."""
    items = []
    for child in element.children if depth < DEPTH else _below(element):
        if isinstance(child, str):
            words = " ".join(child.split())
            if words:
                items.append(["#", False, False, []])
        else:
            items.append([child.key, False, False, generalise(child, depth + 1) if depth < DEPTH else []])
    return _collapse(items)


def _below(element: Element) -> Iterator:
    """Everything below an element, in page order."""
    stack = [iter(element.children)]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            continue
        yield child
        if not isinstance(child, str):
            stack.append(iter(child.children))


# A place of a host's pages: [pages, characters, constants {hash: length}, identities, places below by key].
SEEN, CHARS, FIXED, PAGES, BELOW = range(5)


def places_of(page: Element, dropped: set[int]) -> list:
    """The places of one page, each with its texts."""
    identity = _identity(page, dropped)
    root = [1, 0, {}, [identity], {}]
    stack = [(page, root, 0)]
    while stack:
        element, place, depth = stack.pop()
        for child in element.children:
            if isinstance(child, str):
                words = " ".join(child.split())
                if words and (h := str(_hash(words))) not in place[FIXED]:
                    place[FIXED][h] = len(words)
                    place[CHARS] += len(words)
            elif id(child) not in dropped:
                here = place
                if depth < DEPTH:
                    here = place[BELOW].setdefault(child.key, [1, 0, {}, [identity], {}])
                stack.append((child, here, depth + 1))
    return root


def add_places(a: list, b: list) -> list:
    """The places of both sets of pages: texts that all pages of a place share stay constant."""
    pages = a[PAGES] if a[PAGES] == b[PAGES] else sorted({*a[PAGES], *b[PAGES]})[:FEW]
    fixed = {h: n for h, n in a[FIXED].items() if h in b[FIXED]}
    below = dict(a[BELOW])
    for key, place in b[BELOW].items():
        below[key] = add_places(below[key], place) if key in below else place
    return [a[SEEN] + b[SEEN], a[CHARS] + b[CHARS], fixed, pages, below]


def settled(place: list) -> list:
    """The same without constants that too few different pages show."""
    fixed = place[FIXED] if len(place[PAGES]) >= FEW else {}
    return [place[SEEN], place[CHARS], fixed, place[PAGES], {k: settled(x) for k, x in place[BELOW].items()}]


def _rows(keys_a: list, keys_b: list) -> tuple[np.ndarray, np.ndarray]:
    known: dict = {}
    return tuple(np.array([known.setdefault(k, len(known)) for k in keys], np.int64) for keys in (keys_a, keys_b))


def _table(a: np.ndarray, b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Lengths of common sequences of the ends of ``a`` and ``b``; ``last`` is the row after the last of ``a``."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    table[-1] = last
    for i in range(len(a) - 1, -1, -1):
        row = table[i + 1].copy()
        np.maximum(row[:-1], np.where(b == a[i], table[i + 1, 1:] + 1, 0), out=row[:-1])
        table[i] = np.maximum.accumulate(row[::-1])[::-1]
    return table


def matched(keys_a: list, keys_b: list) -> list[tuple[int | None, int | None]]:
    """Pairs of places of a longest common sequence, with the places that only one side has, in order.

    Equal keys that meet are paired; else what costs nothing of the rest is passed over, on the left first. Above
    ``CELLS`` pairs only some rows of the table are kept and the others computed again, with the same pairs.
    """
    a, b = _rows(keys_a, keys_b)
    n, m = len(a), len(b)
    step = max(n, 1) if n * m <= CELLS else max(1, math.isqrt(n))
    ends, last = [np.zeros(m + 1, np.int32)], n
    cuts = list(range(0, n, step)) or [0]
    for begin in reversed(cuts[1:]):
        ends.append(_table(a[begin:last], b, ends[-1])[0].copy())
        last = begin
    pairs: list[tuple[int | None, int | None]] = []
    i = j = 0
    for begin in cuts:
        end = min(begin + step, n)
        table = _table(a[begin:end], b, ends.pop())
        while i < end:
            if j < m and a[i] == b[j]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif j == m or table[i + 1 - begin, j] >= table[i - begin, j + 1]:
                pairs.append((i, None))
                i += 1
            else:
                pairs.append((None, j))
                j += 1
    return pairs + [(None, k) for k in range(j, m)]


def align(a: list, b: list) -> list:
    """One regular expression for both: their longest common sequence of items, everything else optional."""
    keys_a, keys_b = [x[KEY] for x in a], [x[KEY] for x in b]
    if keys_a == keys_b:
        return _collapse([_merge(x, y) for x, y in zip(a, b, strict=True)])
    out = []
    for i, j in matched(keys_a, keys_b):
        one = _merge(a[i], b[j]) if i is not None and j is not None else a[i] if j is None else b[j]
        out.append([one[KEY], one[OPTIONAL] or i is None or j is None, *one[REPEATED:]])
    return _collapse(out)


def _article(key: str) -> str | None:
    """``article`` or ``main`` for an element that holds the content by its name or role."""
    tag = key.split("|")[0]
    return tag if tag in ("article", "main") else "main" if "|role=main" in key else None


#: elements that are parts of a content region and none themselves
PARTS = INLINE | frozenset("p li td tr h1 h2 h3 h4 h5 h6 html".split())


def _densest(mass: dict[tuple, int], everything: int) -> tuple[str, ...] | None:
    """The deepest element that still holds most of the text."""
    good = [p for p, n in mass.items() if 2 * n > everything]
    return max(good, key=lambda p: (len(p), mass[p])) if good else None


def region_of(places: list) -> tuple[str, ...] | None:
    """The path where most varying text of a host is; None if some of its pages have an article or main: what they
    share with the others is too wide, so the others go by their own texts."""
    mass: dict[tuple, int] = {}
    named: list[tuple] = []

    def walk(place: list, path: tuple) -> int:
        total = place[CHARS] - sum(place[FIXED].values()) * place[SEEN]
        for key, below in place[BELOW].items():
            tag = key.split("|")[0]
            here = path if tag in INLINE and not _article(key) else (*path, key)
            inside = walk(below, here)
            if _article(key):
                named.append(here)
            elif tag not in PARTS:
                mass[here] = mass.get(here, 0) + inside
            total += inside
        return total

    everything = walk(places, ())
    return None if named else _densest(mass, everything)


def blocks_of(page: Element, places: list, dropped: set[int]) -> Iterator[tuple[tuple, str, bool]]:
    """(path, text, whether it is a slot's or stays anyway) of a page's blocks; a constant of its place is no slot."""
    nothing = [0, 0, {}, [], {}]
    path: tuple = ()
    parts, slot = [], False
    # an element's children, its place in the wrapper, its depth, the path to go back to, and whether it stays
    stack = [(iter(page.children), places, 0, path, False)]
    while stack:
        children, place, depth, _, stays = stack[-1]
        child = next(children, None)
        if isinstance(child, str):
            parts.append(child)
            if not slot and (words := " ".join(child.split())):
                slot = stays or str(_hash(words)) not in place[FIXED]
            continue
        if child is not None:
            if child.tag == "br":
                parts.append(" ")
                continue
            if id(child) in dropped:
                continue
            below = place[BELOW].get(child.key, nothing) if depth < DEPTH else place
            inline = child.tag in INLINE and not _article(child.key)
            stack.append((iter(child.children), below, depth + 1, path, stays or child.tag in KEPT))
            if inline:
                continue
        # a block begins or ends here
        if child is None:
            back = stack.pop()[3]
            if back == path and stack:
                continue
        if parts and (text := " ".join(entities.unescape("".join(parts)).split())):
            yield path, text, slot
        parts, slot = [], False
        if child is None:
            path = back
        elif depth < DEPTH or _article(child.key):
            path = (*path, child.key)
        else:  # deeper blocks share a path that only tells them from their neighbours
            path = (*path[:-1], "//") if path[-1:] == ("/",) else (*path[:-1], "/") if path[-1:] == ("//",) else (*path, "/")


def extract(page: Element, places: list, region: tuple[str, ...] | None) -> str:
    """The main text of a page: its tokens matched with the wrapper's, texts of main slots in blocks.

    The region is every article of the page (one with a class or id such as `comment` only if there is no other), else
    every main, else the host's ``region`` if it occurs in the page, else the page's own element with most of the
    text, else the page. A block goes if all its texts are constants of their place; an element that the wrapper
    lacks is an optional one of the same wrapper and has none.
    """
    texts = list(blocks_of(page, places, boilerplate(page)))
    above: dict[tuple, list[tuple]] = {}
    for path, _, _ in texts:
        if path not in above:
            above[path] = [path[:k] for k in range(1, len(path) + 1)]
    held = {p for paths in above.values() for p in paths}
    named: dict[tuple[str, bool], set] = {}
    for p in held:
        if kind := _article(p[-1]):
            named.setdefault((kind, _names(p[-1])[1]), set()).add(p)
    chosen = next((named[k] for k in (("article", False), ("article", True), ("main", False), ("main", True)) if k in named), None)
    if chosen is None and region in held:
        chosen = {region}
    if chosen is None:
        mass: dict[tuple, int] = {}
        varying = [t for t in texts if t[2]] or texts
        for path, text, _ in varying:
            for p in above[path]:
                if p[-1].split("|")[0] not in PARTS:
                    mass[p] = mass.get(p, 0) + len(text)
        own = _densest(mass, sum(len(text) for _, text, _ in varying))
        chosen = {own} if own else None
    main = [(text, slot) for path, text, slot in texts if chosen is None or any(p in chosen for p in above[path])]
    return "\n".join([text for text, slot in main if slot] or [text for text, _ in main])


def host_of(url: Column) -> Column:
    """The lower-case host of an address, empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, places) from rows (host, html), all of them; both are JSON."""

    def pack(host: str, items: list, places: list, salt: int) -> pa.RecordBatch:
        values = [host], [json.dumps(items)], [json.dumps(places)], [salt]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values[:3]] + [pa.array(values[3], pa.int32())], names=["host", "wrapper", "places", "salt"])

    def fold(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        found: dict[str, tuple] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parsed = parse(page.as_py())
                items, places = generalise(parsed), places_of(parsed, boilerplate(parsed))
                if host in found:
                    items, places = align(found[host][0], items), add_places(found[host][1], places)
                found[host] = items, places
        for host, (items, places) in found.items():
            yield pack(host, items, places, TaskContext.get().partitionId() % SALTS)

    def join(last: bool):
        def run(rows: pa.Table) -> pa.Table:
            items, places = None, None
            for wrapper, place in sorted(zip(rows["wrapper"].to_pylist(), rows["places"].to_pylist(), strict=True)):
                one, other = json.loads(wrapper), json.loads(place)
                items, places = (one, other) if items is None else (align(items, one), add_places(places, other))
            return pa.Table.from_batches([pack(rows["host"][0].as_py(), items, settled(places) if last else places, 0)])

        return run

    schema = "host string, wrapper string, places string, salt int"
    parts = pages.where("html is not null").select("host", "html").mapInArrow(fold, schema)
    # a host on every task is folded in two steps
    some = parts.groupBy("host", "salt").applyInArrow(join(False), schema)
    return some.groupBy("host").applyInArrow(join(True), schema).drop("salt")


def main_text(pages: DataFrame, url: str = "url", html: str = "html", output: str = "text") -> DataFrame:
    """``pages`` with the main text of every page in ``output``, the ``html`` column left out.

    A null or empty page has an empty text; pages without a host share one wrapper. Pages of any length are read
    whole, repeated rows get equal texts, an empty table gives an empty one, an input column named ``output`` is replaced.
    """
    kept = [c for c in pages.columns if c not in (html, output)]
    source = pages.select(*kept, host_of(F.col(url).cast("string")).alias("__host"), F.col(html).alias("__html"))
    wrappers = materialise(infer_wrappers(source.select(F.col("__host").alias("host"), F.col("__html").alias("html"))), "wrappers")
    size = wrappers.agg(F.sum(F.length("places") + F.length("host"))).first()[0] or 0
    side = wrappers.select(F.col("host").alias("__host"), F.col("places").alias("__places"))
    few = size <= SEND_BYTES
    if few:
        # pages name their host, and tasks look its places up
        sent = pages.sparkSession.sparkContext.broadcast(dict(side.toPandas().itertuples(index=False)))
        joined = source.select(*kept, "__html", "__host")
    else:
        joined = source.join(side, "__host", "left").select(*kept, "__html", "__places")
    schema = source.select(*kept, F.lit("").alias(output)).schema

    def run(batches: Iterator) -> Iterator:
        ready: dict[str | None, tuple] = {}
        for batch in batches:
            texts = []
            for page, key in zip(batch.column(len(kept)), batch.column(len(kept) + 1).to_pylist(), strict=True):
                if key not in ready:
                    if len(ready) > 1_000:
                        ready.clear()
                    found = sent.value.get(key) if few else key
                    places = json.loads(found) if found else [0, 0, {}, [], {}]
                    ready[key] = places, region_of(places)
                texts.append(extract(parse(page.as_py()), *ready[key]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(texts, pa.string())], names=[*kept, output])

    return joined.mapInArrow(run, schema)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
