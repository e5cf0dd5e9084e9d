"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page becomes a well-formed stream of block elements and text (implied ends are added, inline tags
are formatting). Aligning two streams resolves each mismatch in one of three ways: texts that
differ become a text slot; an element or a sequence of elements that follows itself becomes a repeated group,
in which its occurrences are aligned in turn; what only one side has becomes an optional group. The result is again an
expression of that kind, the wrapper of both, so wrappers of more pages come from aligning wrappers:
first the pages of a partition, then the partitions' wrappers of a host in rounds of RADIX. No
task sees more than RADIX wrappers of a host, and pages are never brought together.

An element whose content has more than MOST_ITEMS parts becomes a repeated group of one optional
part for each kind, ``(a? b? c?)+``, which accepts all orders of them: a wrapper is bounded by the
kinds of elements of its host and not by its pages.

A wrapper marks its text slots once: main text is what stands in an article (else in the main
element, else in the element with most running text that is not the same on all pages), less
elements that their name, class, id or role calls menu, header, footer, sidebar, notice, advert,
form or comment. A page is then matched with the wrapper of its host, by the position automaton of
the expression, and gives the texts of marked slots.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Wrappers of one host that a task aligns.
RADIX = 64
#: Parts of an element's content from which it becomes a group of optional parts.
MOST_ITEMS = 32
#: Lengths of sequences that are looked for as repeated groups.
SQUARES = (2, 3, 4)
#: Text that is the same on all of so many pages of a host is part of the template, outside articles.
TEMPLATE_PAGES = 3
#: Elements nested deeper than this are read as formatting.
MOST_DEPTH = 120
#: Hosts whose wrappers a task holds before it writes them.
HOSTS_HELD = 2_000
#: Bytes of wrappers up to which they are broadcast; beyond, those of the hosts with most pages are.
BROADCAST_BYTES = 32 << 20

# Element names of HTML, and words by which pages name what is not main text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select".split())
NOT_TEXT = frozenset("nav header footer aside form script style noscript template textarea title iframe svg math object canvas select button dialog menu head fieldset".split())
CALLED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay dialog "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar header masthead topbar footer copyright contentinfo complementary comment comments discussion disqus respond reply replies "
    "share sharing social related recommended newsletter subscribe signup login search pagination pager toolbar widget skip".split()
)
#: What an opening element ends: elements of these names above the nearest of the others.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}

_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
#: A comment, an element whose content is no markup (up to its end), a tag, a tag with an odd quote.
_TOKEN = re.compile(
    rf"(<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?i:({'|'.join(sorted(RAW))}))(?=[\s/>]){_ATTRIBUTES}(?:(?<=/)>|>.*?</(?i:\2)[^>]*(?:>|\Z)|.*?\Z)"
    rf"|</?[a-zA-Z]{_ATTRIBUTES}(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z))",
    re.S,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")


class Element:
    """A block element of a page: signature, whether it holds no main text, and its content."""

    __slots__ = ("children", "excluded", "name", "sig")

    def __init__(self, name: str, sig: str, excluded: bool):
        self.name, self.sig, self.excluded, self.children = name, sig, excluded, []


def _signature(name: str, tag: str) -> tuple[str, bool]:
    """The name with classes, id and role, digits left out; whether it names something that is not main text."""
    excluded, sig = name in NOT_TEXT, name
    for m in _NAMED.finditer(tag, len(name) + 1):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
        if kind == "hidden":
            excluded, sig = True, sig + " hidden"
            continue
        if name not in ("html", "body", "main"):
            excluded = excluded or any(p.lower() in CALLED for p in _PARTS.findall(value))
        value = _DIGITS.sub("", value)
        if value:
            sig += f" {kind}={' '.join(sorted(value.split()))}"
    return sig, excluded


def _tag(tag: str) -> tuple:
    """What a tag does: (action, name, signature, excluded)."""
    m = _NAME.match(tag)
    if m is None:
        return "", "", "", False
    name = m[1].lower()
    if name in RAW:
        return "", name, "", False
    if tag[1] == "/":
        return "close" if name in INLINE else "" if name in VOID else "end", name, "", False
    if name == "br":
        return "blank", name, "", False
    if name in INLINE:
        return "" if name in VOID else "open", name, "", _signature(name, tag)[1]
    return "break" if name in VOID else "whole" if tag.endswith("/>") else "start", name, *_signature(name, tag)


class _Reader:
    """Builds the well-formed stream of one page."""

    def __init__(self):
        self.root = Element("", "", False)
        self.open = [self.root]
        self.restart()

    def restart(self) -> None:
        self.text: list[str] = []
        self.linked = self.plain = False

    def flush(self) -> None:
        if self.text:
            text = "".join(self.text)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                self.open[-1].children.append((text, self.linked and not self.plain))
            self.restart()

    def close(self, names, until=()) -> None:
        """Ends the open elements down to the last one of these names, if one is open above ``until``."""
        stack = self.open
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                self.flush()
                del stack[k:]
                return
            if stack[k].name in until:
                return

    def start(self, name: str, sig: str, excluded: bool, whole: bool) -> None:
        self.flush()
        self.close(("p",))
        if name in ENDS:
            names, until = ENDS[name]
            for _ in names:
                self.close(names, until)
        if len(self.open) > MOST_DEPTH:
            return
        element = Element(name, sig, excluded)
        self.open[-1].children.append(element)
        if not whole:
            self.open.append(element)


def read_page(page: str) -> Element:
    """The root of the well-formed stream of a page."""
    out, link, mute = _Reader(), 0, None
    pieces = _TOKEN.split(page)
    for k in range(0, len(pieces), 3):
        text = pieces[k]
        if text and mute is None:
            out.text.append(text)
            if link:
                out.linked = out.linked or not text.isspace()
            elif not out.plain:
                out.plain = not text.isspace()
        if k + 1 == len(pieces):
            break
        tag = pieces[k + 1]
        known = _TAGS.get(tag)
        if known is None:
            if len(_TAGS) > 20_000:
                _TAGS.clear()
            known = _TAGS[tag] = _tag(tag)
        action, name, sig, excluded = known
        if action == "open":
            link += name == "a"
            if excluded and mute is None:
                mute = name
        elif action == "close":
            link = max(link - (name == "a"), 0)
            if name == mute:
                mute = None
        elif action == "blank":
            out.text.append(" ")
        elif action:
            link, mute = 0, None
            if action == "end":
                out.close((name,))
            elif action == "break":
                out.flush()
            else:
                out.start(name, sig, excluded, action == "whole")
    out.flush()
    return out.root


_TAGS: dict[str, tuple] = {}


# Parts of a wrapper are lists, as they travel as JSON: [kind, optional, repeated, ...] with
#   "e": signature, excluded, content      an element
#   "t": digest or null, characters, link  a text, fixed or (null) a slot
#   "g": content                           a group


def _key(item) -> str:
    return item[3] if item[0] == "e" else "#" if item[0] == "t" else "(" + "|".join(map(_key, item[3])) + ")"


def _either(a, b, optional: bool | None = None):
    """One part that stands for either of two of the same key."""
    flags = [a[0], int((a[1] or b[1]) if optional is None else optional), int(a[2] or b[2])]
    if a[0] == "e":
        return [*flags, a[3], a[4], aligned(a[5], b[5])]
    if a[0] == "t":
        return [*flags, a[3] if a[3] == b[3] else None, a[4] + b[4], int(a[5] and b[5])]
    return [*flags, [_either(x, y) for x, y in zip(a[3], b[3], strict=True)]]


def _optional(item):
    return item if item[1] else [item[0], 1, *item[2:]]


def aligned(a: list, b: list) -> list:
    """The parts that both contents are instances of."""
    ka, kb = [_key(x) for x in a], [_key(x) for x in b]
    if ka == kb:
        return [_either(x, y) for x, y in zip(a, b, strict=True)]
    a, b = _grouped(a, b), _grouped(b, a)
    ka, kb = [_key(x) for x in a], [_key(x) for x in b]
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i, j] = best[i + 1, j + 1] + 1 if ka[i] == kb[j] else max(best[i + 1, j], best[i, j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and ka[i] == kb[j]:
            out.append(_either(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1, j] >= best[i, j + 1]):
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return folded(out)


def _grouped(a: list, b: list) -> list:
    """``a`` with sequences that are a group of ``b`` made that group."""
    for group in b:
        if group[0] != "g":
            continue
        keys = [_key(x) for x in group[3]]
        free = all(x[1] for x in group[3])  # any order of optional parts
        out, i = [], 0
        while i < len(a):
            j = i
            if free:
                while j < len(a) and a[j][0] != "g" and _key(a[j]) in keys:
                    j += 1
            elif [_key(x) for x in a[i : i + len(keys)]] == keys and not any(x[1] for x in a[i : i + len(keys)]):
                j = i + len(keys)
            if j == i:
                out.append(a[i])
                i += 1
                continue
            parts = _by_kind(a[i:j], [[*x[:1], 1, *x[2:]] for x in group[3]]) if free else a[i:j]
            out.append(["g", int(free and all(x[1] for x in a[i:j])), 1, parts])
            i = j
        a = folded(out)
    return a


def _by_kind(items: list, parts: list) -> list:
    """``parts`` (optional parts, one of a kind) aligned with items of their kinds."""
    parts = list(parts)
    places = {_key(x): k for k, x in enumerate(parts)}
    for x in items:
        k = places.get(_key(x))
        if k is None:
            places[_key(x)] = len(parts)
            parts.append(_optional(x))
        else:
            parts[k] = _either(parts[k], x, optional=True)
    return parts


def folded(items: list) -> list:
    """Parts that follow themselves made repeated ones, sequences too; too many made a group of optional ones."""
    out: list = []
    for x in items:
        if out and _key(out[-1]) == _key(x):
            both = _either(out[-1], x, optional=out[-1][1] and x[1])
            both[2] = 1
            out[-1] = both
        else:
            out.append(x)
    for width in SQUARES:
        i = 0
        while i + 2 * width <= len(out):
            keys = [_key(x) for x in out[i : i + width]]
            j = i + width
            while [_key(x) for x in out[j : j + width]] == keys:
                j += width
            if j > i + width and not any(x[1] or x[0] == "g" for x in out[i:j]):
                unit = out[i : i + width]
                for k in range(i + width, j, width):
                    unit = [_either(x, y) for x, y in zip(unit, out[k : k + width], strict=True)]
                out[i:j] = [["g", 0, 1, unit]]
            i += 1
    if len(out) > MOST_ITEMS:
        flat = [y for x in out for y in (x[3] if x[0] == "g" else [x])]
        return [["g", 1, 1, _by_kind(flat, [])]]
    return out


def wrapper_of(element: Element) -> list:
    """The content of one page's element as parts."""
    items = []
    for child in element.children:
        if isinstance(child, tuple):
            text, linked = child
            items.append(["t", 0, 0, blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest(), len(text), int(linked)])
        else:
            items.append(["e", 0, 0, child.sig, int(child.excluded), wrapper_of(child)])
    return folded(items)


class Wrapper:
    """A wrapper with its text slots marked and the position automata of its elements."""

    def __init__(self, content: list, pages: int):
        self.content = content
        template = lambda t: pages >= TEMPLATE_PAGES and t[3] is not None
        articles = self._found(content, lambda name: name == "article") or self._found(content, lambda name: name == "main")
        self.marked: set[int] = set()
        for part in articles:
            self.marked.update(id(t) for t in self._slots(part[5]))
        if not articles:
            dense, mass = None, 0
            for part in [["e", 0, 0, "", 0, content], *self._elements(content)]:
                own = sum(t[4] for t in self._near(part[5]) if not template(t) and not t[5])
                if own > mass:
                    dense, mass = part, own
            if dense is not None:
                self.marked.update(id(t) for t in self._slots(dense[5]) if not template(t) and not t[5])
        self.automata: dict[int, tuple] = {}

    def _elements(self, items) -> Iterator[list]:
        for x in items:
            if x[0] == "g":
                yield from self._elements(x[3])
            elif x[0] == "e" and not x[4]:
                yield x
                yield from self._elements(x[5])

    def _found(self, items, wanted) -> list:
        """The outermost elements of a name."""
        out = []
        for x in items:
            if x[0] == "g":
                out += self._found(x[3], wanted)
            elif x[0] == "e" and not x[4]:
                out += [x] if wanted(x[3].split(" ", 1)[0]) else self._found(x[5], wanted)
        return out

    def _slots(self, items) -> Iterator[list]:
        for x in items:
            if x[0] == "t":
                yield x
            elif x[0] == "g":
                yield from self._slots(x[3])
            elif not x[4]:
                yield from self._slots(x[5])

    def _near(self, items, below: bool = True) -> Iterator[list]:
        """Text slots of an element and of the elements right in it."""
        for x in items:
            if x[0] == "t":
                yield x
            elif x[0] == "g":
                yield from self._near(x[3], below)
            elif below and not x[4]:
                yield from self._near(x[5], False)

    def _automaton(self, items) -> tuple:
        """(parts by position, keys, first positions, last positions, whether empty, positions that follow each)."""
        have = self.automata.get(id(items))
        if have is None:
            parts: list = []
            follow: list[set[int]] = []

            def build(of) -> tuple[set[int], set[int], bool]:
                first: set[int] = set()
                last: set[int] = set()
                empty = True
                for x in of:
                    if x[0] == "g":
                        f, z, e = build(x[3])
                    else:
                        f, z, e = {len(parts)}, {len(parts)}, False
                        parts.append(x)
                        follow.append(set())
                    if x[2]:
                        for p in z:
                            follow[p] |= f
                    e = e or bool(x[1])
                    for p in last:
                        follow[p] |= f
                    first = first | f if empty else first
                    last = last | z if e else z
                    empty = empty and e
                return first, last, empty

            first, last, empty = build(items)
            have = self.automata[id(items)] = (parts, [_key(x) for x in parts], first, last, empty, follow)
        return have

    def match(self, items: list, element: Element, out: list[str]) -> bool:
        """Whether the content of ``element`` is an instance of ``items``; texts of marked slots go to ``out``."""
        parts, keys, first, last, empty, follow = self._automaton(items)
        children = element.children
        if not children:
            return empty or not items
        allowed, steps = first, []
        for child in children:
            key = "#" if isinstance(child, tuple) else child.sig
            now = {p for p in allowed if keys[p] == key}
            if not now:
                return False
            steps.append(now)
            allowed = follow[next(iter(now))] if len(now) == 1 else set().union(*(follow[p] for p in now))
        now = steps[-1] & last
        if not now:
            return False
        chosen = [min(now)]
        for k in range(len(children) - 2, -1, -1):
            chosen.append(min(p for p in steps[k] if chosen[-1] in follow[p]))
        for child, p in zip(children, reversed(chosen), strict=True):
            if isinstance(child, tuple):
                if id(parts[p]) in self.marked:
                    out.append(child[0])
            elif not self.match(parts[p][5], child, out):
                return False
        return True


def main_text(page: str, wrapper: Wrapper | None) -> str:
    """The main text of a page by the wrapper of its host, or by its own where that does not accept it."""
    root = read_page(page)
    out: list[str] = []
    if wrapper is None or not wrapper.match(wrapper.content, root, out):
        wrapper, out = Wrapper(wrapper_of(root), 1), []
        wrapper.match(wrapper.content, root, out)
    return "\n\n".join(out)


_WRAPPERS = "host string, wrapper string, pages long, part long"


def _first_wrappers(batches: Iterator[pa.RecordBatch]):
    from pyspark import TaskContext

    place, held, sent = TaskContext.get().partitionId() << 24, {}, 0
    for batch in batches:
        for small in common.sliced(iter([batch])):
            for host, page in zip(common.column(small, "host"), common.column(small, "html"), strict=True):
                own = wrapper_of(read_page(page))
                content, n = held.get(host, (None, 0))
                held[host] = (own if content is None else aligned(content, own), n + 1)
        if len(held) > HOSTS_HELD:
            yield _wrapper_rows(held, place + sent)
            sent, held = sent + 1, {}
    if held:
        yield _wrapper_rows(held, place + sent)


def _wrapper_rows(held: dict, part: int) -> pa.RecordBatch:
    content, pages = zip(*held.values(), strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(held, pa.string()), pa.array([json.dumps(c, separators=(",", ":")) for c in content], pa.string()), pa.array(pages, pa.int64()), pa.array([part] * len(pages), pa.int64())],
        names=["host", "wrapper", "pages", "part"],
    )


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    """The wrapper of the wrappers of a group, taken in the order of their parts."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "wrapper", "pages")), strict=True))
    content = None
    for _, text, _ in rows:
        own = json.loads(text)
        content = own if content is None else aligned(content, own)
    return pa.Table.from_batches([_wrapper_rows({key[0].as_py(): (content, sum(r[2] for r in rows))}, key[1].as_py())])


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper, pages of a table (host, html): one wrapper for each host, staged."""
    found = common.staged(pages.where("host is not null and html is not null").mapInArrow(_first_wrappers, _WRAPPERS), "wrappers")
    while (most := found.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        buckets = -(-most // RADIX)
        below = found
        grouped = below.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(buckets)).cast("long")).groupBy("host", "bucket")
        found = common.staged(grouped.applyInArrow(_merged, _WRAPPERS), "wrappers")
        common.discard(below)
    return found


def _extracted(batches: Iterator[pa.RecordBatch]):
    known: dict[str, Wrapper] = {}
    for batch in batches:
        for small in common.sliced(iter([batch])):
            texts = []
            for page, text, n in zip(*(common.column(small, c) for c in ("html", "wrapper", "pages")), strict=True):
                wrapper = None
                if text is not None and page is not None:
                    wrapper = known.get(text)
                    if wrapper is None:
                        if len(known) > HOSTS_HELD:
                            known.clear()
                        wrapper = known[text] = Wrapper(json.loads(text), n)
                texts.append(main_text(page, wrapper) if page is not None else "")
            yield pa.RecordBatch.from_arrays([small.column(0), small.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_of(url):
    """The host of a URL, in lower case; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    return F.when(host != "", host)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages``.

    The text is that of the blocks of main text in page order, joined by two line feeds; in a block,
    character references are decoded and each run of white space (as Unicode has it) is one blank. A page
    without main text, and a null one, has the empty text. A page without host, and one that its host's wrapper does not
    accept, is its own wrapper. Null ids and repeated rows are treated like
    others; an empty table gives an empty result; other columns are not read.

    The wrappers are joined by host: all are broadcast up to BROADCAST_BYTES together, beyond that
    those of hosts with so many pages that no more than BROADCAST_BYTES can have them, and the others,
    of which none is hot, by a shuffle.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    found = infer_wrappers(pages.select("host", "html")).select(F.col("host").alias("of_host"), "wrapper", "pages")
    size = found.agg(F.sum(F.octet_length("wrapper")).alias("all"), F.max(F.octet_length("wrapper")).alias("most"), F.sum("pages").alias("pages")).first()
    match = F.col("host") == F.col("of_host")
    if (size["all"] or 0) <= BROADCAST_BYTES:
        joined = pages.join(F.broadcast(found), match, "left")
    else:
        hot = F.col("pages") * (BROADCAST_BYTES // size["most"]) >= size["pages"]
        few = F.broadcast(found.where(hot))
        joined = pages.join(few, match).unionByName(pages.join(few, match, "left_anti").join(found.where(~hot), match, "left"))
    schema = "page_id long, url string, text string, n_chars long"
    return joined.select("page_id", "url", "html", "wrapper", "pages").mapInArrow(_extracted, schema)
