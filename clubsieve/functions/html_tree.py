"""Small per-page helpers for what regular expressions cannot nest: elements, tables, ancestors.

They run inside mapInPandas batches; everything after them is built-in Spark.
"""
from __future__ import annotations

import json
import re
from array import array
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import accumulate

import numpy as np

from . import fixed_values as fv

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# A new one of these closes an open one of the same set first, as browsers do.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Blocks end an open paragraph.
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}
HIDDEN = {"script", "style"}


# A closing tag, an opening one with quoted attributes, a comment or a document type, none with another bracket or an entity inside.
_TAG = re.compile(r"""(<(?:/([a-z][a-z0-9-]*)|([a-z][a-z0-9-]*)((?:[ \t\n]+[a-z][a-z0-9-]*=(?:"[^"<>&]*"|'[^'<>&]*'))*)[ \t\n]*|!--(?!-?>)[^<>&]*--|![dD][oO][cC][tT][yY][pP][eE][^<>&]*)>)""")
_ATTRIBUTE = re.compile(r"""([a-z][a-z0-9-]*)=(?:"([^"]*)"|'([^']*)')""")
#: What was read of so many tags of so many characters at most is kept for when they come again.
KNOWN_TAGS, SHORT_TAG = 4096, 80
_BRACKETS = re.compile("<[^>]*>")
# The parser reads what these hold by rules of its own.
OPAQUE = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp"}


class Elements:
    """The elements of a page in order as one list per property, the page itself first; no object per element.

    What lies below element i is i + 1 to beyond[i]; its text is a stretch of the page's pieces of text, first[i] to last[i].
    """

    __slots__ = ("tag", "said", "parent", "start", "end", "first", "last", "text_start", "text_end", "beyond", "raw", "stripped")

    def __init__(self):
        self.tag, self.said, self.parent, self.start, self.end, self.beyond = [""], [""], [-1], [0], [-1], [1]
        self.first, self.last, self.raw = [0], [0], []

    def measure(self):
        """What follows from the pieces of text, once all are there."""
        for late in (self.end, self.last, self.beyond):
            del late[len(self.tag):]
        self.stripped = list(map(str.strip, self.raw))
        places = [0, *accumulate(map(len, self.stripped))]
        self.text_start, self.text_end = [places[k] for k in self.first], [places[k] for k in self.last]

    def text(self, i: int) -> str:
        """Stripped pieces of text, joined without a space."""
        return "".join(self.stripped[self.first[i]:self.last[i]])

    def find(self, i: int, *tags) -> list[int]:
        return [k for k in range(i + 1, self.beyond[i]) if self.tag[k] in tags]

    def attrs(self, i: int) -> dict:
        said = self.said[i]
        if isinstance(said, str):
            return {k: a or b for k, a, b in _ATTRIBUTE.findall(said)}
        return {k: v or "" for k, v in said}


class Node:
    """One element of a page."""

    __slots__ = ("of", "at")

    def __init__(self, of: Elements, at: int):
        self.of, self.at = of, at

    tag = property(lambda self: self.of.tag[self.at])
    attrs = property(lambda self: self.of.attrs(self.at))
    start = property(lambda self: self.of.start[self.at])
    end = property(lambda self: self.of.end[self.at])
    text_start = property(lambda self: self.of.text_start[self.at])
    text_end = property(lambda self: self.of.text_end[self.at])
    text = property(lambda self: self.of.text(self.at))
    raw_text = property(lambda self: "".join(self.of.raw[self.of.first[self.at]:self.of.last[self.at]]))
    children = property(lambda self: [n for n in self.walk() if self.of.parent[n.at] == self.at])

    def walk(self):
        """This element and all below it in order."""
        return (Node(self.of, k) for k in range(self.at, self.of.beyond[self.at]))

    def find(self, *tags):
        return [Node(self.of, k) for k in self.of.find(self.at, *tags)]


class _Builder(HTMLParser):
    """One pass over a page. What the parser cannot take ends the page there: `error` says why, the rest stands.

    Plain markup, where every "<" begins a tag with quoted attributes, is cut at its tags by one pattern and handed to
    the same methods; the parser takes several times as long and reads all other pages.
    """

    def __init__(self, html: str, quick: bool = True):
        self.html, self.error, self.line_starts, self.found, self.here = html, None, None, Elements(), 0
        self.cut = cut = _plain(html) if quick else None
        try:
            if cut is None:
                self._parse()
            else:
                self._take(*cut)
        except (AssertionError, ValueError, IndexError, RecursionError) as e:
            self.error = f"{type(e).__name__}: {e}"
        self._shut(0, len(html))
        self.found.measure()

    def _parse(self):
        super().__init__(convert_charrefs=True)
        self.line_starts, at = [0], self.html.find("\n")
        while at >= 0:
            self.line_starts.append(at + 1)
            at = self.html.find("\n", at + 1)
        self.feed(self.html)
        self.close()

    def _take(self, lead: str, insides: list[str], texts: list[str], known: list[tuple]):
        """What feeding the parser comes to, in one loop: handle_starttag and handle_data in place."""
        found, at, end, here = self.found, len(lead), self.handle_endtag, 0
        tags, raw, room = found.tag, found.raw, [-1] * len(known)
        for late in (found.end, found.last, found.beyond):
            late += room
        add_tag, add_said, add_parent, add_start, add_first, add_text = (x.append for x in (tags, found.said, found.parent, found.start, found.first, raw))
        if lead:
            add_text(lead)
        for inside, text, (closed, opened, said, shuts) in zip(insides, texts, known):
            if closed:
                self.place = at
                end(closed)
                here = self.here
            elif opened:
                if tags[here] in shuts:
                    self._shut(here, at)
                    if opened == "tr" and tags[self.here] == "tr":
                        self._shut(self.here, at)
                    here = self.here
                add_parent(here)
                self.here = here = len(tags)
                add_tag(opened)
                add_said(said)
                add_start(at)
                add_first(len(raw))
                if opened in VOID:
                    self._shut(here, at + len(inside) + 1)
                    here = self.here
            at += len(inside) + 1
            if text:
                at += len(text)
                if tags[here] not in HIDDEN:
                    add_text(text)

    def parse_marked_section(self, i, report=1):
        """Sections of any name, known or not, are left out up to their end, else up to the next bracket."""
        end = self.rawdata.find("]]>", i)
        if end >= 0:
            return end + 3
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def _at(self) -> int:
        line, column = self.getpos()
        return self.line_starts[line - 1] + column

    def _shut(self, i: int, end: int):
        """Ends element i and those open in it."""
        found, here = self.found, self.here
        last, beyond, until = len(found.raw), len(found.tag), found.parent[i]
        while here != until:
            found.end[here], found.last[here], found.beyond[here] = end, last, beyond
            here = found.parent[here]
        self.here = here

    def handle_starttag(self, tag, attrs):
        at, tags = self._at(), self.found.tag
        over = tags[self.here]
        if over == "p" and tag in BLOCKS or over in CLOSES and tag in CLOSES and over in CLOSES[tag]:
            self._shut(self.here, at)
            # An opened row ends the row around the cell it ended, too; a block that ended a paragraph is in no such set.
            if tag == "tr" and tags[self.here] == "tr":
                self._shut(self.here, at)
        found = self.found
        for values, value in ((found.tag, tag), (found.said, attrs), (found.parent, self.here), (found.start, at), (found.first, len(found.raw)),
                              (found.end, -1), (found.last, -1), (found.beyond, -1)):
            values.append(value)
        self.here = len(found.tag) - 1
        if tag in VOID:
            self._shut(self.here, at + len(self.get_starttag_text() or ""))

    def handle_endtag(self, tag):
        i, found = self.here, self.found
        tags = found.tag
        while i and tags[i] != tag:
            i = found.parent[i]
        if i:
            end = (self.place if self.line_starts is None else self._at()) + len(tag) + 3
            if i != self.here:
                self._shut(i, end)
                return
            found.end[i], found.last[i], found.beyond[i] = end, len(found.raw), len(tags)
            self.here = found.parent[i]

    def handle_data(self, data):
        if self.found.tag[self.here] not in HIDDEN:
            self.found.raw.append(data)


_known_tags: dict[str, tuple] = {}
_NOTHING = frozenset()
_SHUT_BY = {t: frozenset({over for over, by in CLOSES.items() if t in CLOSES and over in CLOSES[t]} | ({"p"} if t in BLOCKS else _NOTHING)) for t in {*CLOSES, *BLOCKS}}


def _read_tag(inside: str) -> tuple | None:
    """The name of a plain tag if it closes, its name if it opens, its attributes and which open elements it ends; null if it is not
    plain. Most tags of a page have no attributes or the same as others.
    """
    tag = _TAG.fullmatch(f"<{inside[1:]}>") if inside[:1] == "\0" else None
    if tag is None:
        return None
    _, closed, opened, said = tag.groups()
    known = closed, opened, said, _SHUT_BY.get(opened, _NOTHING)
    if len(inside) <= SHORT_TAG:
        if len(_known_tags) >= KNOWN_TAGS:
            _known_tags.clear()
        _known_tags[inside] = known
    return known


def _plain(html: str) -> tuple[str, list, list, list] | None:
    """Plain markup cut at its tags: the text before the first, what stands in each tag's brackets, the text after each, and what was
    read of each tag. Null for other pages.

    No plain tag holds a bracket, so each runs from a "<" to the next ">". A mark behind each "<" tells it from a ">".
    """
    if "&" in html or "\0" in html:
        return None
    n, marked = html.count("<"), html.replace("<", "<\0")
    if html.count(">") == n:
        cut = marked.replace(">", "<").split("<")
        lead, insides, texts = cut[0], cut[1::2], cut[2::2]
    else:  # texts hold more
        lead, *pieces = marked.split("<")
        cut = [p.partition(">") for p in pieces]
        if not all(end for _, end, _ in cut):
            return None
        insides, texts = [p for p, _, _ in cut], [p for _, _, p in cut]
    known = list(map(_known_tags.get, insides))
    if None in known:
        for i, k in enumerate(known):
            if k is None:
                known[i] = k = _read_tag(insides[i])
                if k is None:
                    return None
    opened = [k[1] for k in known]
    if not OPAQUE.isdisjoint(opened) and ("plaintext" in opened or any(
            n in OPAQUE and closed != n for n, closed in zip(opened, [*[k[0] for k in known[1:]], None]))):
        return None
    return lead, insides, texts, known


def parse(html: str | None) -> Node:
    return Node(_Builder(html or "").found, 0)


@dataclass
class Page:
    """A parsed page: its elements, the stripped pieces of text joined, what ended the parse early, if anything, and its source
    without what stands in brackets.
    """

    found: Elements
    text: str
    error: str | None
    untagged: str

    @property
    def root(self) -> Node:
        return Node(self.found, 0)


def _untagged(html: str) -> str:
    """What pages.strip_tags leaves before it reads entities. Behind the last ">" no tag ends, so no search runs on from there in vain."""
    end = html.rfind(">") + 1
    return _BRACKETS.sub("", html[:end]) + html[end:]


def page(html: str | None) -> Page:
    built = _Builder(html or "")
    untagged = _untagged(html or "") if built.cut is None else built.cut[0] + "".join(built.cut[2])
    return Page(built.found, "".join(built.found.stripped), built.error, untagged)


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
# What pages.prices takes of a text: the sign and the spaces that PRICE_PATTERN has before it may be missing.
_AMOUNT = re.compile(r"(\d+(?:,\d{3})*(?:\.\d{2})?)", re.ASCII)
KINDS = ("unknown", "team_fee", "individual_fee")
_KINDS = (("team", 1), ("individual", 2), ("player", 2))


def _lowered(text: str) -> str:
    """The text with small letters for A to Z, each character at its place."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def _places(low: str, word: str) -> np.ndarray:
    """Where the word begins, overlapping ones too."""
    at, found = low.find(word), []
    while at >= 0:
        found.append(at)
        at = low.find(word, at + 1)
    return np.array(found, np.int64)


def _holds(places: np.ndarray, size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the stretches hold one of the words of this size that begin at these places: the next one ends before they do."""
    if not len(places):
        return np.zeros(len(start), bool)
    return np.append(places, np.iinfo(np.int64).max - size)[np.searchsorted(places, start)] + size <= end


class ElementTexts:
    """Where the elements of several pages stand in text and source. Pages are added one at a time, so that one tree is held at a time."""

    def __init__(self):
        self.counts, self.tags, self.texts, self.bounds = [], [], [], tuple(array("i") for _ in range(4))

    def add(self, parsed: Page):
        found = parsed.found
        self.counts.append(len(found.tag))
        self.tags += found.tag
        self.texts.append(parsed.text)
        for kept, values in zip(self.bounds, (found.text_start, found.text_end, found.start, found.end)):
            kept.fromlist(values)


class WordedElements:
    """The elements of these tags whose text has one of the words, page after page, each page's in order, as one array per property.

    An element's text is a stretch of its page's text, so words are looked up once in all texts and each element only
    asks whether one lies between its bounds. Nested elements share the text instead of repeating it.
    """

    def __init__(self, of: ElementTexts, tags, words, least: int = 5, longest: int = 500):
        self.tags, self.words = list(tags), list(words)
        # No word or amount has a line end, so none reaches from page to page.
        self.text = "\n".join(of.texts)
        self.low = _lowered(self.text)
        codes = {t: i for i, t in enumerate(self.tags)}
        tag = np.array([codes.get(t, -1) for t in of.tags], np.int32)
        listed = np.flatnonzero(tag >= 0)
        page = np.repeat(np.arange(len(of.counts)), of.counts)[listed]
        start, end, source, source_end = (np.frombuffer(b, np.intc)[listed].astype(np.int64) if len(b) else np.zeros(0, np.int64) for b in of.bounds)
        shift = np.cumsum([0, *[len(t) + 1 for t in of.texts]])[page]
        order = np.arange(len(listed)) - np.searchsorted(page, np.arange(len(of.counts) + 1))[page]
        word, open_ = np.full(len(listed), -1, np.int32), np.flatnonzero(end - start >= least)
        for i, w in enumerate(self.words):
            held = _holds(_places(self.low, w), len(w), (start + shift)[open_], (end + shift)[open_])
            word[open_[held]] = i
            open_ = open_[~held]
        kept = word >= 0
        self.page, self.order, self.tag, self.word = page[kept], order[kept], tag[listed][kept], word[kept]
        self.start, self.size, self.shift = start[kept], (end - start)[kept], shift[kept]
        self.source, self.source_size = source[kept], np.minimum(source_end - source, longest)[kept]

    def price_hints(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(page, kind of fee, amount, tag, word) of the amounts in the elements with a price keyword, kind, tag and word by
        number, best elements first: what pages.prices and pages.price_kind say of each element's text, in the order
        of mining.best_elements.

        Amounts and words are looked up once in all texts. Only an element that begins or ends inside an amount of the
        page, as pieces of text are joined without a space, is searched by itself. Lower case of other letters than A to Z
        makes no letter of the words.
        """
        scores = np.outer([fv.ELEMENT_TAG_WEIGHTS[t] for t in self.tags], [fv.ELEMENT_WORD_WEIGHTS[w] for w in self.words])
        rank = np.unique(-scores, return_inverse=True)[1].reshape(scores.shape)
        priced = np.flatnonzero(np.isin(self.word, [i for i, w in enumerate(self.words) if w in fv.PRICE_WORDS]))
        priced = priced[np.argsort(self.page[priced] * scores.size + rank[self.tag[priced], self.word[priced]], kind="stable")]
        start, end = (self.start + self.shift)[priced], (self.start + self.shift + self.size)[priced]
        cut = _AMOUNT.split(self.text)  # text, amount, text and so on
        bounds, amounts = np.cumsum([len(c) for c in cut]), cut[1::2]
        begins, ends = bounds[:-1:2], np.concatenate(([0], bounds[1::2]))
        first, last = np.searchsorted(begins, start), np.searchsorted(begins, end)
        for i in np.flatnonzero((ends[first] > start) | (ends[last] > end)):
            own = _AMOUNT.findall(self.text, start[i], end[i])
            first[i], last[i] = len(amounts), len(amounts) + len(own)
            amounts += own
        kind = np.zeros(len(priced), np.int32)
        for word, code in reversed(_KINDS):
            kind[_holds(_places(self.low, word), len(word), start, end)] = code
        n = last - first
        each = np.repeat(np.arange(len(priced)), n)
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        values = np.array(list(map(float, " ".join(amounts).replace(",", "").split())))
        which = priced[each]
        return self.page[which], kind[each], values[at], self.tag[which], self.word[which]


def elements(root: Node, tags: set[str]) -> list[Node]:
    return [n for n in root.walk() if n.tag in tags]


@dataclass
class Table:
    headers: list[str]
    rows: list[list[str]]
    row_count: int
    text: str


def tables(root: Node) -> list[Table]:
    """Headers from thead or from a first row with th cells; data rows with any filled cell."""
    out, of = [], root.of
    tag, beyond, first, last, stripped = of.tag, of.beyond, of.first, of.last, of.stripped
    cells = lambda row, *kinds: ["".join(stripped[first[c]:last[c]]) for c in range(row + 1, beyond[row]) if tag[c] in kinds]
    for t in of.find(root.at, "table"):
        below = range(t + 1, beyond[t])
        names = tag[t + 1:beyond[t]]
        rows = [k for k, name in zip(below, names) if name == "tr"]
        if not rows:
            continue
        headers = []
        if "thead" in names:
            headers = [c for row in of.find(below[names.index("thead")], "tr")[:1] for c in cells(row, "th", "td")]
        if not headers:
            headers = cells(rows[0], "th")
        if "tbody" in names:
            body = below[names.index("tbody")]
            data = [k for k in rows if body < k < beyond[body]]
        else:
            data = rows[1 if headers else 0:]
        filled = [c for c in (cells(r, "td", "th") for r in data) if any(c)]
        out.append(Table(headers, filled, len(rows), "".join(of.raw[of.first[t]:of.last[t]])))
    return out


def anchors(html: str | None) -> list[tuple[str, str, str]]:
    """(href, text, context) of each anchor; the context is the nearest telling ancestor of five."""
    out, of = [], parse(html).of
    for a in of.find(0, "a"):
        attrs = of.attrs(a)
        if "href" not in attrs:
            continue
        context, up = "body", of.parent[a]
        for _ in range(5):
            if up <= 0:
                break
            said = f"{of.tag[up]} {of.attrs(up).get('class', '')}".lower()
            hit = next((w for w in ("footer", "nav", "header") if w in said), None)
            if hit:
                context = hit
                break
            up = of.parent[up]
        out.append((attrs["href"], of.text(a), context))
    return out


def load_tree(tree: str | None) -> tuple[list, str | None]:
    """The top nodes of a JSON tree, or none and why it cannot be read. A null tree has none."""
    if not isinstance(tree, str):
        return [], None
    try:
        parsed = json.loads(tree)
    except (ValueError, RecursionError) as e:
        return [], f"{type(e).__name__}: {e}"
    return parsed if isinstance(parsed, list) else [parsed], None


def visit(top: list):
    """(path, node, around) in document order, whatever the depth; around is (siblings, place, the same one level up).

    A path is sibling numbers joined by dots. Lists inside lists are a level of their own; what is neither
    object nor list is no node.
    """
    level = lambda nodes, path, outer: [(n, f"{path}.{i}", (nodes, i, outer)) for i, n in enumerate(nodes)]
    waiting = level(top, "0", None)[::-1]
    while waiting:
        node, path, around = waiting.pop()
        below = node
        if isinstance(node, dict):
            yield path, node, around
            below = node.get("children")
        if isinstance(below, list):
            waiting.extend(reversed(level(below, path, around)))


def _said(node, key: str) -> str | None:
    value = node.get(key) if isinstance(node, dict) else None
    return value if isinstance(value, str) else None


def flatten(tree: str | None) -> list[tuple]:
    """(path, parent, sibling, role, name, url) of all nodes."""
    return [(path, path.rpartition(".")[0], around[1], _said(n, "role"), _said(n, "name"), _said(n, "url")) for path, n, around in visit(load_tree(tree)[0])]


def sibling_label(siblings: list, skip: int) -> str:
    """Name of the first heading beside a node, else of the first short telling neighbour."""
    named = [(_said(n, "role") or "", (_said(n, "name") or "").strip()) for i, n in enumerate(siblings) if i != skip]
    heading = next((t for role, t in named if role in ("h1", "h2", "h3", "h4", "h5", "h6") and t), "")
    return heading or next((t for _, t in named if 3 < len(t) < 60 and t.lower() not in fv.GENERIC_ANCHORS), "")


def tree_links(tree: str | None) -> list[tuple[str, str, str]]:
    """(path, anchor text, url) of the links of a tree, generic anchors named by their surroundings."""
    out = []
    for path, n, around in visit(load_tree(tree)[0]):
        text, url = (_said(n, "name") or "").strip(), (_said(n, "url") or "").strip()
        if n.get("role") in ("a", "link") and text and url:
            if text.lower() in fv.GENERIC_ANCHORS:
                levels, at = [], around
                while at is not None and len(levels) < 3:
                    levels.append(at[:2])
                    at = at[2]
                label = next(filter(None, (sibling_label(*level) for level in levels)), "")
                text = f"{label} - {text}" if label else text
            out.append((path, text, url))
    return out
