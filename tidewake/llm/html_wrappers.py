"""Main text of web pages by wrappers, union-free regular expressions that are inferred per host.

A page is read as the sequence of its text blocks, each with the path of elements that it stands in.  Runs of one block, or
of one sequence of blocks, are folded into repeated groups.  What is left of a host's pages are a few shapes; they are aligned one by one, the
commonest first: groups of one content match, and so does a single run of it; what one side lacks becomes optional.  Each
item of the wrapper then gets its texts' counts: a text that is on most of the pages that have its path, and on
TEMPLATE_PAGES at least, is a constant, everything else is a slot.

The wrapper decides what is main text.  Its main element is found by going down from the page's root to the child with the
most text in slots, links not counted, for as long as that child has half of it and its parent has no prose of its own;
an article or main element ends the way down.  A page's main text are the blocks inside that element that are no constants.
Where no article or main element tells, and most of that text is prose, texts that vary from page to page but stand apart from
it, as footers and teasers do, are told by the page's elements: only what is inside one that has paragraphs or headings of its
own is main text.
Only a host of fewer than TEMPLATE_PAGES pages, or a page that has nothing in that element, falls back on elements: its
article or main element, or everything, by the same rule.  Never taken are the blocks of menus, footers, asides, forms, adverts, comments and
the like, told by element, or by a class, id or role all of whose words say so.

Shapes, texts and paths are counted by Spark, and every host's shapes are aligned in one order, so that the result does
not depend on how pages are dealt to tasks; a host's pages never meet in one task, only its different shapes and paths do.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored

TEMPLATE_PAGES = 3
TEMPLATE_SHARE = 0.5
MAIN_SHARE = 0.5
BROADCAST_BYTES = 32 << 20
"""Rules of hosts of up to so many bytes in all, which are summed first, are broadcast, so that pages need no shuffle."""
HELD_HOSTS = 2000
LONGEST_GROUP = 12
"""Blocks in a repeated group at most; longer ones stay unfolded."""
EXACT_ALIGNMENT = 40_000
"""Stretches are aligned by comparing all items while the product of their lengths is at most this; longer ones by the
items that are once in either first."""

# Elements of HTML by their role here.
BREAKING = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
OUTSIDE = frozenset("head nav aside footer form menu dialog".split())
RAW = frozenset("script style textarea title iframe noscript".split())
WHOLE = frozenset("template object svg math canvas select button".split())
ENCLOSED = RAW | WHOLE
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
CONTENT = frozenset("article main".split())
CLOSED_BY = {"p": BREAKING - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
OUTSIDE_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent discussion disqus footer form gdpr masthead menu menus nav navbar navigation newsletter notice notices pagination pager popup modal promo promoted promotion reactions related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split())
BESIDE_NAMES = frozenset("area bar block body box btn button buttons col column container content footer group head header holder inner item items left line link links list main outer panel placeholder right row section slot top unit wrap wrapper zone".split())


_TAG = re.compile(r"""<[!?/]?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*+>|<[!?/]?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")


def _digest(text: str) -> int:
    """64 bits, as a signed integer."""
    x = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def tokens(page: str) -> Iterator[tuple[str, str | None]]:
    """(text or tag, the tag's name in lower case or None) in order, comments and declarations left out, and with RAW and
    WHOLE elements whole.  Each is looked for once: an element that nothing closes is not searched for again."""
    at, size, unclosed = 0, len(page), set()
    while at < size:
        start = page.find("<", at)
        if start < 0:
            yield page[at:], None
            return
        if start > at:
            yield page[at:start], None
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        m = _TAG.match(page, start)
        if m is None:
            yield "<", None
            at = start + 1
            continue
        tag, at = m[0], m.end()
        if tag[1] in "!?":
            continue
        name = _NAME.match(tag)[1].lower()
        if tag[1] != "/" and name in ENCLOSED and not tag.endswith("/>") and name not in unclosed:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if close is None:
                unclosed.add(name)
            else:
                at = close.end()
                continue
        if name in RAW and tag[1] != "/":
            if not tag.endswith("/>"):  # holds no markup, and ends with the page
                return
            continue
        yield tag, name


@dataclass(slots=True)
class Element:
    path: int
    parent: int
    name: str
    outside: bool
    header: bool
    content: bool
    inside: bool
    above: Element | None = None
    held: bool = False
    """Has prose of its own, or is in an element that has"""


@dataclass(slots=True)
class Text:
    """path; whether in an element that is never main text, in an article or main element, in the wrapper's main element;
    in a header outside of both; how many of its characters are links; the element it stands in."""

    path: int
    text: str
    outside: bool
    content: bool
    inside: bool
    header: bool
    linked: int
    element: Element


def _tells(names: list[str]) -> bool:
    """Whether a class, id or role says that its element is beside the main text: all its words do, or name a mere part."""
    for name in " ".join(names).split():
        words = {w.lower() for w in _PARTS.findall(name) if not w.isdigit()}
        if words & OUTSIDE_NAMES and words <= OUTSIDE_NAMES | BESIDE_NAMES:
            return True
    return False


def blocks(page: str | None, main: int = 0, elements: dict[int, Element] | None = None) -> list[Text]:
    """The blocks of text, in order; ``main`` is the path of the wrapper's main element.  Markup that is not closed ends with
    what it stands in, or with the page.  ``elements`` is given the elements by path."""
    out: list[Text] = []
    root = Element(0, 0, "", False, False, False, False)
    stack, open_names, every = [root], Counter(), [root]
    parts: list[str] = []
    links, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                e = stack[-1]
                out.append(Text(e.path, text, e.outside, e.content, e.inside, e.header, min(linked, len(text)), e))
            linked = 0

    for token, name in tokens(page or ""):
        if name is None:
            parts.append(token)
            if links:
                linked += len(token)
            continue
        if name == "a":
            links = 1 if token[1] != "/" else 0
            continue
        if name not in BREAKING:
            continue
        flush()
        if token[1] == "/":
            links = 0
            if open_names[name]:
                while True:
                    e = stack.pop()
                    open_names[e.name] -= 1
                    if e.name == name:
                        break
            continue
        if name in VOID:
            continue
        while len(stack) > 1 and name in CLOSED_BY.get(stack[-1].name, ()):
            open_names[stack.pop().name] -= 1
        above = stack[-1]
        names = [x for n in _NAMED.findall(token) for x in n if x]
        label = ".".join([name, *sorted(_DIGITS.sub("0", " ".join(names)).split())[:3]])
        path = _digest(f"{above.path}/{label}")
        outside = above.outside or name in OUTSIDE or (name not in ("html", "body", "article", "main") and _tells(names))
        content = (above.content or name in CONTENT or "main" in names and name != "nav") and not outside
        inside = above.inside or path == main
        header = above.header or (name == "header" and not content and not inside)
        e = Element(path, above.path, name, outside, header, content, inside, above)
        above.held |= name in PROSE and not outside
        every.append(e)
        if elements is not None:
            elements.setdefault(path, e)
        stack.append(e)
        open_names[name] += 1
    flush()
    for e in every[1:]:  # each after the one it stands in
        e.held |= e.above.held
    return out


@dataclass(slots=True)
class Item:
    """A path, or a group of several that repeats as a whole; optional; on how many pages."""

    paths: tuple[int, ...]
    repeated: bool
    optional: bool = False
    pages: int = 1


def folded(paths: list[int]) -> list[Item]:
    """A page's shape: runs of one path, then runs of up to LONGEST_GROUP items, become repeated items."""
    items: list[Item] = []
    for p in paths:
        if items and items[-1].paths == (p,):
            items[-1].repeated = True
        else:
            items.append(Item((p,), False))
    for k in range(2, LONGEST_GROUP + 1):
        keys, out, i = [x.paths for x in items], [], 0
        while i < len(items):
            end = i + k
            while end + k <= len(items) and keys[end : end + k] == keys[i : i + k]:
                end += k
            if end > i + k:
                out.append(Item(tuple(p for key in keys[i : i + k] for p in key), True))
                i = end
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _gathered(items: list[Item], groups: set[tuple[int, ...]]) -> list[Item]:
    """items with single runs of a group's content taken for the group."""
    by_first: dict[int, list[tuple[int, ...]]] = {}
    for g in sorted(groups, key=lambda g: (-len(g), g)):
        by_first.setdefault(g[0], []).append(g)
    out, i = [], 0
    while i < len(items):
        for g in by_first.get(items[i].paths[0], ()):
            if len(items[i].paths) == 1 and tuple(p for x in items[i : i + len(g)] for p in x.paths) == g:
                part = items[i : i + len(g)]
                out.append(Item(g, True, all(x.optional for x in part), max(x.pages for x in part)))
                i += len(g)
                break
        else:
            out.append(items[i])
            i += 1
    return out


def _matches(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal keys, ascending in both."""
    if len(a) * len(b) <= EXACT_ALIGNMENT:
        found = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        return [(m.a + i, m.b + i) for m in found for i in range(m.size)]
    once_a, once_b = Counter(a), Counter(b)
    at_b = {k: j for j, k in enumerate(b) if once_b[k] == 1}
    anchors = [(i, at_b[k]) for i, k in enumerate(a) if once_a[k] == 1 and k in at_b]
    tails: list[int] = []  # the longest ascending chain of anchors, by patience
    before: list[int] = []
    ends: list[int] = []
    for n, (_, j) in enumerate(anchors):
        low, high = 0, len(tails)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if tails[mid] < j else (low, mid)
        before.append(ends[low - 1] if low else -1)
        tails[low:], ends[low:] = ([j], [n]) if low == len(tails) else ([j, *tails[low + 1 :]], [n, *ends[low + 1 :]])
    chain, n = [], ends[-1] if ends else -1
    while n >= 0:
        chain.append(anchors[n])
        n = before[n]
    out, i0, j0 = [], 0, 0
    for i, j in [*reversed(chain), (len(a), len(b))]:
        if chain and (i - i0) * (j - j0) <= EXACT_ALIGNMENT:
            out += [(i0 + x, j0 + y) for x, y in _matches(a[i0:i], b[j0:j])]
        if i < len(a):
            out.append((i, j))
        i0, j0 = i + 1, j + 1
    return out


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """The wrapper that covers both."""
    groups = {x.paths for x in (*a, *b) if len(x.paths) > 1}
    a, b = _gathered(a, groups), _gathered(b, groups)
    out, i0, j0 = [], 0, 0
    for i, j in [*_matches([x.paths for x in a], [x.paths for x in b]), (len(a), len(b))]:
        for x in (*a[i0:i], *b[j0:j]):
            if out and out[-1].paths == x.paths:  # a longer run of the same
                out[-1] = Item(x.paths, True, out[-1].optional, max(out[-1].pages, x.pages))
            else:
                out.append(Item(x.paths, x.repeated, True, x.pages))
        if i < len(a):
            x, y = a[i], b[j]
            out.append(Item(x.paths, x.repeated or y.repeated, x.optional or y.optional, x.pages + y.pages))
        i0, j0 = i + 1, j + 1
    return out


def dumped(items: list[Item]) -> str:
    return json.dumps([[list(x.paths), x.repeated, x.optional, x.pages] for x in items], separators=(",", ":"))


def loaded(text: str) -> list[Item]:
    return [Item(tuple(p), *rest) for p, *rest in json.loads(text)]


@dataclass
class Host:
    """What is known of a host's pages: its wrapper, its elements, and by path the characters in slots."""

    wrapper: list[Item] = field(default_factory=list)
    elements: dict[int, tuple[int, bool, bool, bool]] = field(default_factory=dict)
    """By path: parent, whether outside, whether an article or main element, whether prose."""
    slots: dict[int, int] = field(default_factory=dict)
    constants: list[tuple[int, int]] = field(default_factory=list)

    def main(self) -> tuple[int, bool]:
        """The path of the main element, 0, the whole page, if no slot has text; whether most of its text is prose."""
        own = {p: self.slots.get(p, 0) for x in self.wrapper for p in x.paths}
        own = {p: n for p, n in own.items() if n and p in self.elements and not self.elements[p][1]}
        mass, prose, below = Counter(), Counter(), {}
        for p, n in sorted(own.items()):
            written = n * self.elements[p][3]
            while p in self.elements:
                parent = self.elements[p][0]
                below.setdefault(parent, set()).add(p)
                mass[p] += n
                prose[p] += written
                p = parent
            mass[0] += n
            prose[0] += written
        at = 0
        while children := below.get(at):
            if any(self.elements[c][3] for c in children) or at in self.elements and self.elements[at][2]:
                break
            best = max(sorted(children), key=lambda c: mass[c])
            if mass[best] < MAIN_SHARE * sum(mass[c] for c in children):
                break
            at = best
        return at, prose[at] > MAIN_SHARE * mass[at]


def host_of(url: F.Column) -> F.Column:
    """The url's host, lower-cased; the empty string without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


_FOUND = "kind int, host string, path long, digest long, page long, n long, linked long, flags int, shape string"
_TEXT, _ELEMENT, _SHAPE, _CONSTANT, _SLOT = range(5)


def _read(pages: DataFrame) -> DataFrame:
    """Of every page its texts, its elements and its shape, a row each; copies of a page, told by their longest text, count
    as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _FOUND.split(", ")]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        for b in batches:
            texts: list[tuple] = []
            known: dict[tuple, tuple] = {}
            shapes: Counter = Counter()
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                elements: dict[int, Element] = {}
                found = blocks(page, elements=elements)
                if not found:
                    continue
                longest = _digest(max((t.text for t in found), key=lambda t: (len(t), t)))
                texts += [(_TEXT, host, t.path, _digest(t.text), longest, len(t.text), t.linked, 0, None) for t in found]
                shapes[host, dumped(folded([t.path for t in found]))] += 1
                for p in {t.path for t in found}:
                    while p in elements and (host, p) not in known:
                        e = elements[p]
                        flags = (e.outside or e.header) + 2 * e.content + 4 * (e.name in PROSE)
                        known[host, p] = (_ELEMENT, host, p, e.parent, 0, 0, 0, flags, None)
                        p = e.parent
            rows = texts + list(known.values()) + [(_SHAPE, host, 0, 0, 0, n, 0, 0, shape) for (host, shape), n in shapes.items()]
            for at in range(0, len(rows), 20_000):
                columns = list(zip(*rows[at : at + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, _FOUND)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, pages (different ones), main (the path of the main element), prose (whether most of its text is), constants (array of
    path and digest) and wrapper (JSON), of the hosts of TEMPLATE_PAGES different pages or more."""
    found = stored(_read(pages), "page-parts")
    texts = found.where(F.col("kind") == _TEXT)
    hosts = texts.groupBy("host").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= TEMPLATE_PAGES)
    hosts = small(stored(hosts, "page-hosts"))
    each = texts.join(hosts.select("host"), "host", "left_semi").groupBy("host", "path", "digest", "page").agg(F.max("n").alias("n"), F.max("linked").alias("linked"))
    each = stored(each, "page-texts")
    paths = each.groupBy("host", "path").agg(F.countDistinct("page").alias("path_pages"))
    text_pages = each.groupBy("host", "path", "digest").agg(F.count("*").alias("pages"), F.sum(F.col("n") - F.col("linked")).alias("n"))
    constant = (F.col("pages") >= TEMPLATE_PAGES) & (F.col("pages") > TEMPLATE_SHARE * F.col("path_pages"))
    text_pages = text_pages.join(paths, ["host", "path"]).withColumn("constant", constant)
    row = lambda kind, **c: [F.lit(kind).alias("kind"), "host", *(c.get(x, F.lit(0).cast(t)).alias(x) for x, t in (("path", "long"), ("digest", "long"), ("n", "long"), ("flags", "int"), ("shape", "string")))]
    parts = text_pages.where("constant").select(*row(_CONSTANT, path=F.col("path"), digest=F.col("digest")))
    slots = text_pages.where("not constant").groupBy("host", "path").agg(F.sum("n").alias("n"))
    parts = parts.unionByName(slots.select(*row(_SLOT, path=F.col("path"), n=F.col("n"))))
    elements = found.where(F.col("kind") == _ELEMENT).groupBy("host", "path").agg(F.min("digest").alias("digest"), F.max("flags").alias("flags"))
    parts = parts.unionByName(elements.select(*row(_ELEMENT, path=F.col("path"), digest=F.col("digest"), flags=F.col("flags"))))
    shapes = found.where(F.col("kind") == _SHAPE).groupBy("host", "shape").agg(F.sum("n").alias("n"))
    parts = parts.unionByName(shapes.select(*row(_SHAPE, n=F.col("n"), shape=F.col("shape"))))
    parts = parts.join(hosts, "host")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by host, then kind, the commonest shapes first."""
        host, pages, held = None, 0, Host()

        def out() -> pa.RecordBatch:
            pairs, (main, prose) = sorted(held.constants), held.main()
            return pa.RecordBatch.from_arrays(
                [pa.array([host], pa.string()), pa.array([pages], pa.int64()), pa.array([main], pa.int64()), pa.array([prose], pa.bool_()), pa.array([[x for pair in pairs for x in pair]], pa.list_(pa.int64())), pa.array([dumped(held.wrapper)], pa.string())],
                names=["host", "pages", "main", "prose", "constants", "wrapper"],
            )

        for b in batches:
            for kind, h, path, digest, n, flags, shape, different in zip(*(b.column(i).to_pylist() for i in range(8))):
                if h != host:
                    if host is not None:
                        yield out()
                    host, held = h, Host()
                pages = different
                if kind == _ELEMENT:
                    held.elements[path] = (digest, bool(flags & 1), bool(flags & 2), bool(flags & 4))
                elif kind == _SLOT:
                    held.slots[path] = n
                elif kind == _CONSTANT:
                    held.constants.append((path, digest))
                else:
                    new = [Item(x.paths, x.repeated, x.optional, n) for x in loaded(shape)]
                    held.wrapper = align(held.wrapper, new) if held.wrapper else new
        if host is not None:
            yield out()

    ordered = parts.select("kind", "host", "path", "digest", "n", "flags", "shape", "pages").repartition("host").sortWithinPartitions("host", "kind", F.desc("n"), "shape", "path", "digest")
    return ordered.mapInArrow(merge, "host string, pages long, main long, prose boolean, constants array<long>, wrapper string")


def _with_prose(texts: list[Text]) -> list[Text]:
    """The texts of article and main elements and inside elements that have prose of their own; all, if there are none."""
    return [t for t in texts if t.content or t.element.held] or texts


def main_text(page: str | None, rules: tuple[int, bool, frozenset[tuple[int, int]]] | None) -> tuple[str, bool]:
    """The main text, and whether the wrapper decided it; rules are a wrapper's main element, whether that is prose, and its
    constants."""
    if rules is not None:
        main, prose, constants = rules
        kept = [t for t in blocks(page, main) if (t.inside or not main) and not t.outside and not t.header and (t.path, _digest(t.text)) not in constants]
        if kept:
            return " ".join(t.text for t in (_with_prose(kept) if prose else kept)), True
    free = [t for t in blocks(page) if not t.outside and not t.header]
    content = [t for t in free if t.content]
    if not content and sum(len(t.text) for t in free if t.element.name in PROSE) > MAIN_SHARE * sum(len(t.text) for t in free):
        content = _with_prose(free)
    return " ".join(t.text for t in content or free), False


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and by_wrapper (whether a wrapper decided) of each row: null and empty pages, and pages
    without main text, have text ''.  Pages without a host share a wrapper; repeated rows stay repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules: dict[str, tuple[int, bool, frozenset[tuple[int, int]]]] = {}
        for b in batches:
            found = []
            for page, host, main, prose, constants in zip(*(b.column(i).to_pylist() for i in range(2, 7))):
                if main is None:
                    found.append(main_text(page, None))
                    continue
                if host not in rules:
                    if len(rules) > HELD_HOSTS:
                        rules.clear()
                    rules[host] = (main, prose, frozenset(zip(constants[::2], constants[1::2])))
                found.append(main_text(page, rules[host]))
            texts = [t for t, _ in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([w for _, w in found], pa.bool_())], names=["page_id", "url", "text", "n_chars", "by_wrapper"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    known = stored(wrappers(pages), "wrappers").select("host", "main", "prose", "constants")
    size = known.agg(F.coalesce(F.sum(F.size("constants") * 8 + F.length("host") + 16), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host", "left").select("page_id", "url", "html", "host", "main", "prose", "constants")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, by_wrapper boolean")
