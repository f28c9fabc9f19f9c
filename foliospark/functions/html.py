"""A tolerant page tree on the standard tokenizer, with the few selectors the extractors need. Pages of plain markup are cut by
one pattern instead, with the same tree; whatever that does not know sends the page to the tokenizer.

The tree has no implied end tags: an unclosed paragraph contains what follows it, and an end tag closes up to
its nearest open match. Elements remember where their inner markup lies in the source.

Elements are numbered in document order, so what an element contains is an interval of numbers; text nodes stand in one
flat list, and an element's text is an interval of that. Selectors keep the numbers that match and look intervals up by
bisection. Building a page and any number of look-ups are linear in the page, however deep it nests; only text that is
asked for more than once, as that of nested paragraphs, is copied more than once.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import parser as standard
from html import unescape
from html.entities import html5
from html.parser import HTMLParser
from itertools import accumulate

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Strings inside these belong to the tag itself, not to its parents' text: each has a list of its own.
OPAQUE = frozenset(("script", "style", "template"))


class Page:
    """The columns of a page's elements; element 0 is the page. ``last`` is the number after an element's last descendant.
    ``shade`` names the list of strings that the element's text is in, the page's or that of the nearest opaque element;
    ``lo`` and ``hi`` are its interval there, ``at`` where it begins in its parent's list. A line break is None in the list."""

    __slots__ = ("tags", "attrs", "parent", "last", "begin", "end", "shade", "at", "lo", "hi", "strings", "_tags", "_classes", "_found", "_clean", "_texts")

    def __init__(self):
        self.tags, self.attrs, self.parent, self.last, self.begin, self.end = [""], [{}], [-1], [1], [0], [0]
        self.shade, self.at, self.lo, self.hi = [0], [0], [0], [0]
        self.strings: dict[int, list[str | None]] = {0: []}
        self._tags: dict[str, list[int]] | None = None
        self._classes: dict[str, list[int]] = {}
        self._found: dict[tuple, list[int]] = {}
        self._clean: dict[int, tuple[list[str], list[int]]] = {}
        self._texts: dict[tuple[int, str], str] = {}

    def matches(self, tag: str = "", cls: str = "", attr: tuple[str, str] | None = None) -> list[int]:
        """Numbers of the elements with this tag, class and attribute, in order."""
        if self._tags is None:
            self._tags, self._classes = defaultdict(list), defaultdict(list)
            for k, name in enumerate(self.tags):
                if k:
                    self._tags[name].append(k)
                    if attrs := self.attrs[k]:
                        for c in dict.fromkeys(attrs.get("class", "").split()):
                            self._classes[c].append(k)
        key = tag, cls, attr
        if key not in self._found:
            some = self._classes.get(cls, []) if cls else self._tags.get(tag, []) if tag else range(1, len(self.tags))
            if cls and tag:
                some = [k for k in some if self.tags[k] == tag]
            self._found[key] = some if attr is None else [k for k in some if self.attrs[k].get(attr[0]) == attr[1]]
        return self._found[key]

    def below(self, k: int, **selector) -> list[int]:
        """Those of the matches that ``k`` contains."""
        found = self.matches(**selector)
        return found[bisect_right(found, k) : bisect_left(found, self.last[k])]

    def clean(self, shade: int) -> tuple[list[str], list[int]]:
        """The stripped non-empty strings of a list, and how many of them stand before each place of it."""
        if shade not in self._clean:
            self._clean[shade] = _stripped(self.strings[shade])
        return self._clean[shade]

    def text(self, k: int, sep: str = "") -> str:
        if (k, sep) not in self._texts:
            kept, place = self.clean(self.shade[k])
            self._texts[k, sep] = sep.join(kept[place[self.lo[k]] : place[self.hi[k]]])
        return self._texts[k, sep]

    def gone(self, k: int, tags: frozenset[str]) -> list[tuple[int, int]]:
        """Intervals of the elements that ``k`` loses with all elements of some tags."""
        out, c = [], k + 1
        while c < self.last[k]:
            if self.tags[c] in tags:
                out.append((c, self.last[c]))
                c = self.last[c]
            else:
                c += 1
        return out

    def _pieces(self, k: int, without: frozenset[str], nested: bool) -> Iterator[tuple[int, list[str], list[tuple[int, int]]]]:
        """Of each paragraph in ``k``, elements of some tags left out: its list of strings, as its number and the stripped ones
        of it, and the intervals of these that it has. A nested paragraph is part of those around it too, or with
        ``nested=False`` only itself."""
        gone: dict[int, list[tuple[int, int]]] = defaultdict(list)
        inside, at = [], k + 1
        for c, end in [*self.gone(k, without), (self.last[k], 0)]:
            inside += [p for p in range(at, c) if self.tags[p] == "p"]
            at = end
            if end and self.shade[c] != c:
                gone[self.shade[c]].append((self.lo[c], self.hi[c]))
        lists: dict[int, tuple[list[str], list[int]]] = {}
        for shade in {self.shade[c] for c in inside}:
            strings = self.strings[shade]
            if gone[shade]:
                strings = strings.copy()
                for lo, hi in gone[shade]:
                    strings[lo:hi] = [None] * (hi - lo)
            lists[shade] = _stripped(strings)
        holes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if not nested:
            around: list[int] = []
            for c in inside:
                while around and self.last[around[-1]] <= c:
                    around.pop()
                if around and self.shade[around[-1]] == self.shade[c]:
                    holes[around[-1]].append((self.lo[c], self.hi[c]))
                around.append(c)
        for c in inside:
            kept, place = lists[self.shade[c]]
            at, some = self.lo[c], []
            for lo, hi in [*holes.get(c, ()), (self.hi[c], 0)]:
                some.append((place[at], place[lo]))
                at = hi
            yield self.shade[c], kept, some

    def paragraphs(self, k: int, without: frozenset[str], sep: str = "", nested: bool = True) -> list[str]:
        """Texts of the paragraphs in ``k``."""
        return [sep.join([s for lo, hi in some for s in kept[lo:hi]]) for _, kept, some in self._pieces(k, without, nested)]

    def words(self, k: int, without: frozenset[str], sep: str = "", nested: bool = True) -> int:
        """How many words the texts of the paragraphs in ``k`` have together, in time with the page: no text is made."""
        before: dict[int, list[int]] = {}
        seam, total = len(f"x{sep}x".split()) - 2, 0  # what joining two strings adds
        for shade, kept, some in self._pieces(k, without, nested):
            if shade not in before:
                before[shade] = [0, *accumulate(len(s.split()) for s in kept)]
            total += sum(before[shade][hi] - before[shade][lo] for lo, hi in some) + seam * max(0, sum(hi - lo for lo, hi in some) - 1)
        return total


def _stripped(strings: list[str | None]) -> tuple[list[str], list[int]]:
    kept: list[str] = []
    place = [0]
    for s in strings:
        if s is not None and (s := s.strip()):
            kept.append(s)
        place.append(len(kept))
    return kept, place


class Node:
    """An element of a page."""

    __slots__ = ("page", "k")

    def __init__(self, page: Page, k: int):
        self.page, self.k = page, k

    @property
    def tag(self) -> str:
        return self.page.tags[self.k]

    @property
    def attrs(self) -> dict[str, str]:
        return self.page.attrs[self.k]

    @property
    def inner(self) -> slice:
        """Where the inner markup lies in the source."""
        return slice(self.page.begin[self.k], self.page.end[self.k])

    def walk(self) -> Iterator[Node]:
        """Descendant elements in document order."""
        return (Node(self.page, k) for k in range(self.k + 1, self.page.last[self.k]))

    def children(self) -> Iterator[Node | str]:
        """Elements and text nodes directly below."""
        p, k = self.page, self.k
        strings, at, c = p.strings[p.shade[k]], p.lo[k], k + 1
        while c < p.last[k]:
            yield from strings[at : p.at[c]]
            yield Node(p, c)
            at = p.hi[c] if p.shade[c] == p.shade[k] else p.at[c]
            c = p.last[c]
        yield from strings[at : p.hi[k]]

    def strings(self) -> list[str]:
        """Stripped non-empty text nodes below, those of scripts and styles left out unless this is one."""
        p, k = self.page, self.k
        kept, place = p.clean(p.shade[k])
        return kept[place[p.lo[k]] : place[p.hi[k]]]

    def text(self, sep: str = "") -> str:
        """``strings``, joined."""
        return self.page.text(self.k, sep)

    def lines(self, after: Node | None = None) -> list[str]:
        """Text between line breaks, the text nodes of a line joined by a blank; scripts and styles left out. Optionally
        only what stands after a child."""
        p, k = self.page, self.k
        at = p.lo[k] if after is None else p.hi[after.k]
        out: list[list[str]] = [[]]
        for s in p.strings[p.shade[k]][at : p.hi[k]]:
            if s is None:
                out.append([])
            else:
                out[-1].append(s)
        return [" ".join(line) for line in out]

    def all(self, tag: str = "", cls: str = "", attr: tuple[str, str] | None = None) -> list[Node]:
        return [Node(self.page, k) for k in self.page.below(self.k, tag=tag, cls=cls, attr=attr)]

    def first(self, tag: str = "", cls: str = "", attr: tuple[str, str] | None = None) -> Node | None:
        found = self.page.matches(tag, cls, attr)
        i = bisect_right(found, self.k)
        return Node(self.page, found[i]) if i < len(found) and found[i] < self.page.last[self.k] else None

    def within(self, outer: dict, inner: dict) -> Node | None:
        """The first match of ``inner`` that has an ancestor matching ``outer``."""
        around, i, reach = self.page.matches(**outer), 0, 0
        for k in self.page.below(self.k, **inner):
            while i < len(around) and around[i] < k:
                reach = max(reach, self.page.last[around[i]])
                i += 1
            if reach > k:
                return Node(self.page, k)
        return None


class Found(Exception):
    """Enough of the page has been read."""


#: How the standard tokenizer reads references in the values of attributes.
_unescape_value = getattr(standard, "_unescape_attrvalue", None) or unescape
#: Text, an end tag, or a start tag with its attributes, as long as nothing about them is unusual.
_TOKEN = re.compile(r"""([^<]++)|</([a-zA-Z][a-zA-Z0-9]*+)>|<([a-zA-Z][a-zA-Z0-9]*+)((?:[ \t\n\r\f]++[a-zA-Z][a-zA-Z0-9:_-]*+(?:="[^"]*+")?)*+)[ \t\n\r\f]*+(/?)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9:_-]*+)(?:="([^"]*+)")?""")
_DOCTYPE = re.compile(r"<!(?:doctype|DOCTYPE) [^<>\[]*>")
_SCRIPT_END = {tag: re.compile(rf"</\s*{tag}", re.I) for tag in ("script", "style")}
#: Elements whose content the tokenizer may read in its own way. Other than scripts they are taken if no tag is in them.
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext".split())
_SCREENS = range(0xE000, 0xF900)
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")


def _screened(source: str) -> tuple[str, str]:
    """The source with a character that it does not have in place of each ampersand that begins no closed reference, and that
    character."""
    screen = next(c for c in map(chr, _SCREENS) if c not in source)
    closed = lambda m: m[1] and (m[1][0] == "#" or m[1] in html5)
    return _REFERENCE.sub(lambda m: m[0] if closed(m) else screen + m[0][1:], source), screen


def _plain(source: str, until: str | None) -> Page | None:
    """The tree of a page of plain markup, None if it has anything else."""
    page = Page()
    tags, attrs, parent, last, begin, end = page.tags, page.attrs, page.parent, page.last, page.begin, page.end
    shades, ats, los, his = page.shade, page.at, page.lo, page.hi
    now, depth, shade, strings, at, size, match = [0], defaultdict(int), 0, page.strings[0], 0, len(source), _TOKEN.match

    def close(where: int) -> str:
        k = now.pop()
        last[k], his[k], end[k] = len(tags), len(page.strings[shades[k]]), max(where, begin[k])
        depth[tags[k]] -= 1
        return tags[k]

    while at < size:
        m = match(source, at)
        if m is None:
            if m := _DOCTYPE.match(source, at):
                at = m.end()
                continue
            stop = source.find("-->", at + 4)
            if not source.startswith("<!--", at) or stop < 0 or source.startswith((">", "->"), at + 4) or source.find("--!>", at + 4, stop) >= 0:
                return None
            at = stop + 3
            continue
        text, closing, tag, inside, slash = m.groups()
        begun, at = at, m.end()
        if text is not None:
            strings.append(unescape(text) if "&" in text else text)
            continue
        if closing is not None:
            closing = closing.lower()
            if depth[closing]:
                while close(begun) != closing:
                    pass
                shade = shades[now[-1]]
                strings = page.strings[shade]
                if closing == until:
                    break
            continue
        tag = tag.lower()
        if tag in _RAW:
            found = _SCRIPT_END[tag].search(source, at) if tag in _SCRIPT_END else None
            stop = found.start() if found else source.find("<", at)
            if slash or not source.startswith(f"</{tag}>", stop) or tag not in ("title", "textarea", *_SCRIPT_END) and stop > at:
                return None
        values: dict[str, str] = {}
        if inside:
            for name, value in _ATTRIBUTE.findall(inside):
                values[name.lower()] = _unescape_value(value) if "&" in value else value
        k = len(tags)
        tags.append(tag)
        attrs.append(values)
        parent.append(now[-1])
        last.append(k + 1)
        begin.append(at)
        end.append(at)
        ats.append(len(strings))
        if tag in OPAQUE:
            shade, strings = k, []
            page.strings[k] = strings
        elif tag == "br":
            strings.append(None)
        shades.append(shade)
        los.append(len(strings))
        his.append(len(strings))
        if tag in VOID:
            continue
        now.append(k)
        depth[tag] += 1
        if slash:
            close(begun)
            shade = shades[now[-1]]
            strings = page.strings[shade]
            if tag == until:
                break
        elif tag in _SCRIPT_END:
            if stop > at:  # nothing in it is a reference
                strings.append(source[at:stop])
            at = stop
    while now:
        close(size)
    return page


class _Builder(HTMLParser):
    def __init__(self, source: str, until: str | None):
        super().__init__(convert_charrefs=True)
        self.page, self.open, self.until = Page(), [0], until
        self.depth: dict[str, int] = defaultdict(int)
        self.starts = [0]
        for line in source.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)

    def here(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag, attrs):
        values: dict[str, str] = {}
        for name, v in attrs:
            values[name] = v or ""
        p, k, shade = self.page, len(self.page.tags), self.page.shade[self.open[-1]]
        begin = self.here() + len(self.get_starttag_text() or "")
        p.tags.append(tag)
        p.attrs.append(values)
        p.parent.append(self.open[-1])
        p.last.append(k + 1)
        p.begin.append(begin)
        p.end.append(begin)
        p.at.append(len(p.strings[shade]))
        if tag in OPAQUE:
            shade, p.strings[k] = k, []
        if tag == "br":
            p.strings[shade].append(None)
        p.shade.append(shade)
        p.lo.append(len(p.strings[shade]))
        p.hi.append(len(p.strings[shade]))
        if tag not in VOID:
            self.open.append(k)
            self.depth[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.depth[tag]:
            at = self.here()
            while self._close(at) != tag:
                pass
            if tag == self.until:
                raise Found

    def _close(self, at: int) -> str:
        p, k = self.page, self.open.pop()
        p.last[k], p.hi[k], p.end[k] = len(p.tags), len(p.strings[p.shade[k]]), max(at, p.begin[k])
        self.depth[p.tags[k]] -= 1
        return p.tags[k]

    def parse_marked_section(self, i, report=1):
        """Sections other than the known ones are comments, as browsers read them."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)

    def handle_data(self, data):
        p = self.page
        p.strings[p.shade[self.open[-1]]].append(data)


def parse(source: str | None, until: str | None = None, unclosed: bool = True) -> Node:
    """The tree of a page, or of its beginning to where the first element with the tag ``until`` ends. References without
    their semicolon are read as browsers do, or with ``unclosed=False`` stay as they are written."""
    source, screen = source or "", ""
    if not unclosed and "&" in source:
        source, screen = _screened(source)
    page = _plain(source, until) if "\0" not in source else None
    if page is None:
        page = _tolerant(source, until)
    if screen:
        shown = lambda s: s and s.replace(screen, "&")
        page.strings = {k: [shown(s) for s in some] for k, some in page.strings.items()}
        page.attrs = [{k: shown(v) for k, v in values.items()} for values in page.attrs]
    return Node(page, 0)


def _tolerant(source: str, until: str | None) -> Page:
    """The tree of any page."""
    builder = _Builder(source, until)
    try:
        builder.feed(source)
        builder.close()
    except Found:
        pass
    while builder.open:
        builder._close(len(source))
    return builder.page
