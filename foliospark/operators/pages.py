"""The page parsers: one Arrow-batched function per kind of page, giving raw strings and arrays only.

Each is marked nondeterministic so that filters on its output stay above it and it runs once per row. A page that cannot be
read at all, or not within ``seconds``, fails alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from foliospark.functions import text
from foliospark.functions.deadline import Deadline
from foliospark.functions.html import OPAQUE, Node, Page, parse

_DATE = ("property", "dc:date")
BOILERPLATE = frozenset("script style nav header footer".split())
#: A page that takes longer is given up; None waits for ever.
SECONDS = 60.0
#: So many pages and what is read off them are Python objects at a time.
PIECE = 128

LISTING = (
    "array<struct<has_main:boolean,has_side:boolean,has_title:boolean,has_date:boolean,date_content:string,date_text:string,heading:string,"
    "title_text:string,block_text:string,has_link:boolean,href:string,label:string,has_related:boolean,related_text:string,related_href:string,"
    "link:string,related_link:string>>"
)
#: What can be asked of a document page, and what always comes with it.
DETAIL = {"title": "string", "date": "string", "speaker": "string", "speaker_title": "string", "paragraphs": "array<string>", "words": "bigint", "video": "boolean"}
DEBATE = "struct<title:string,date:string,has_content:boolean,inner_html:string,labels:array<struct<label:string,bold:string,lines:array<string>,rest:array<string>>>,strings:array<string>,blocks:array<string>,failed:boolean>"
PAGING = "struct<last_href:string,hrefs:array<string>,document_rows:int>"


def _text(n: Node | None) -> str | None:
    return None if n is None else n.text()


#: Links that are plain paths of a site without one, for which joining is putting one behind the other.
_PLAIN_SITE, _PLAIN_PATH = re.compile(r"https?://[a-z0-9.-]+", re.A), re.compile(r"(?:/[A-Za-z0-9_-]+)+", re.A)


def _joined(site: str, href: str) -> str:
    return site + href if _PLAIN_PATH.fullmatch(href) and _PLAIN_SITE.fullmatch(site) else urljoin(site, href)


def _listing_row(row: Node, site: str) -> dict:
    main, side = row.first("div", "col-sm-8"), row.first("div", "col-sm-4")
    title = main and main.first("div", "field-title")
    date = main and main.first("span", attr=_DATE)
    link = title and title.first("a")
    label, related = side and side.first("div", "label-above"), side and side.first("a")
    href = link.attrs.get("href", "") if link else None
    related_href = related.attrs.get("href", "") if related else None
    return {
        "has_main": main is not None, "has_side": side is not None, "has_title": title is not None, "has_date": date is not None,
        "date_content": date.attrs.get("content") if date else None, "date_text": _text(date),
        "heading": _text(main.first("h4")) if main else None,
        "title_text": _text(link), "block_text": _text(title), "has_link": link is not None, "href": href,
        "label": _text(label), "has_related": related is not None, "related_text": _text(related), "related_href": related_href,
        "link": None if href is None else _joined(site, href), "related_link": None if related_href is None else _joined(site, related_href),
    }


def _each(pages: Iterable[str | None], one: Callable, seconds: float | None, failed: Callable) -> list:
    """``one`` of every page, ``failed()`` for those that it cannot do in time."""
    out = []
    with Deadline(seconds) as limit:
        for page in pages:
            try:
                with limit.turn():
                    done = one(page)
            except Exception:  # noqa: BLE001  costs no other page
                done = failed()
            out.append(done)
    return out


def _column(html: Column, kind: str, one: Callable, seconds: float | None, failed: Callable) -> Column:
    """``one`` of every page, as values of a type. Some pages at a time are Python objects; what came of the others of a batch
    is an Arrow array."""
    arrow = to_arrow_type(T.DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def read(pages: pa.Array) -> pa.Array:
        some = (pages.slice(at, PIECE).to_pylist() for at in range(0, len(pages), PIECE))
        return pa.concat_arrays([pa.array([], arrow), *(pa.array(_each(piece, one, seconds, failed), arrow) for piece in some)])

    return read.asNondeterministic()(html)


def listing_rows(html: Column, site: str, nested: bool = True, seconds: float | None = SECONDS) -> Column:
    """Every ``div.row`` of a page in order; a row that fails to parse is left out. ``nested=False`` leaves out rows that
    contain rows."""

    def one(page):
        out = []
        for row in parse(page).all("div", "row"):
            if not nested and row.first("div", "row"):
                continue
            try:
                out.append(_listing_row(row, site))
            except ValueError:  # an address that cannot be joined must not lose the page
                continue
        return out

    return _column(html, LISTING, one, seconds, list)


def _first(root: Node, *choices) -> Node | None:
    return next((n for n in (c(root) for c in choices) if n is not None), None)


def _date(root: Node) -> str | None:
    date = _first(
        root,
        lambda r: r.first("span", attr=_DATE),
        lambda r: r.within({"cls": "field-docs-start-date-time"}, {"tag": "span"}),
        lambda r: r.first(cls="date-display-single"),
    )
    return date and (date.attrs.get("content") or date.text())


def _video(root: Node, content: Node | None) -> bool:
    """A player anywhere but in what is left out of the content."""
    gone = content.page.gone(content.k, BOILERPLATE) if content else []
    players = [*(n for n in root.all("iframe") if any(x in n.attrs.get("src", "") for x in ("youtube", "vimeo"))), *root.all(cls="embedded-video")]
    return any(not any(a <= n.k < b for a, b in gone) for n in players)


_TITLE_BLOCK = "field-ds-doc-title"
#: How the fields are read off a page.
_READ: dict[str, Callable[[Node], object]] = {
    "title": lambda r: _text(_first(r, lambda r: r.within({"cls": _TITLE_BLOCK}, {"tag": "h1"}), lambda r: r.first("h1"))),
    "date": _date,
    "speaker": lambda r: _text(_first(r, *(lambda r, o=o: r.within(o, {"tag": "a"}) for o in ({"cls": "field-title"}, {"cls": "diet-title"}, {"tag": "h3"})))),
    "speaker_title": lambda r: _text(_first(r, lambda r: r.first(cls="diet-by-line"), lambda r: r.first(cls="field-resuable-byline"))),
}


def _selector(container: str) -> dict:
    tag, _, cls = container.partition(".")
    return {"tag": tag, "cls": cls}


def document_detail(
    html: Column, container: str = ".field-docs-content", inline_sep: str = "", fields: Iterable[str] = tuple(DETAIL), nested: bool = True, seconds: float | None = SECONDS,
    unclosed: bool = True,
) -> Column:
    """Raw fields of a document page, of which only those asked for are computed. ``container``: 'tag', '.class' or
    'tag.class' of the body. Nested paragraphs, as unclosed ones are, stand in all that contain them, so the paragraphs can
    grow with the square of the page; ``nested=False`` gives each its own text only. ``unclosed``: as in ``html.parse``."""
    where, asked = _selector(container), [f for f in DETAIL if f in set(fields)]
    if unknown := set(fields) - DETAIL.keys():
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")

    def paragraphs(root: Node, what: Callable = Page.paragraphs) -> list[str] | int | None:
        content = root.first(**where)
        return None if content is None else what(content.page, content.k, BOILERPLATE, inline_sep, nested)

    read = _READ | {"paragraphs": paragraphs, "words": lambda root: paragraphs(root, Page.words), "video": lambda root: _video(root, root.first(**where))}

    def one(page):
        # the first h1 is all that a title needs if nothing on the page can be a block of titles
        early = asked == ["title"] and page and _TITLE_BLOCK not in page and "&" not in page.partition("<h1")[0]
        root = parse(page, until="h1" if early and "&#" not in page else None, unclosed=unclosed)
        return {f: read[f](root) for f in asked} | {"failed": False}

    return _column(html, f"struct<{','.join(f'{f}:{DETAIL[f]}' for f in asked)}{',' if asked else ''}failed:boolean>", one, seconds, lambda: {"failed": True})


def _labelled(p: Node) -> dict:
    """A paragraph's bold label, and its lines with and without a plain bold tag that it begins with."""
    bold = p.first("b")
    lead = next((c for c in p.children() if not isinstance(c, str) or c.strip()), None)
    inside = list(lead.children()) if isinstance(lead, Node) and lead.tag == "b" and not lead.attrs else [None]
    plain = all(isinstance(c, str) for c in inside)
    lines = p.lines()
    return {"label": bold.text().rstrip(":").lower() if bold else None, "bold": "".join(inside) if plain else None, "lines": lines, "rest": p.lines(lead) if plain else lines}


def label_items(block: Column, label: str) -> Column:
    """The entries of a block of ``debate_detail``: its bold label goes only if it is followed by a colon in the tag."""
    named = F.coalesce(F.lower(block["bold"]).rlike(rf"^\s*{label}\s*:\s*$"), F.lit(False))
    return text.label_items(F.when(named, block["rest"]).otherwise(block["lines"]))


def label_block(html: Column, label: str) -> Column:
    """Inner markup of a labelled paragraph to its entries."""
    kind = "struct<label:string,bold:string,lines:array<string>,rest:array<string>>"
    return label_items(_column(html, kind, lambda p: _labelled(parse(p)), SECONDS, lambda: _labelled(Node(Page(), 0))), label)


def _labels(content: Node, names: tuple[str, ...]) -> list[dict]:
    """The labelled paragraphs that begin with one of the names, of each name no more than up to the first that says
    something after its label."""
    out, open_names = [], set(names)
    for p in content.all("p"):
        bold = p.first("b")
        mine = {n for n in open_names if bold.text().rstrip(":").lower().startswith(n)} if bold else ()
        if mine:
            out.append(block := _labelled(p))
            if any(line.strip(" ;\n") and not line.isspace() for line in block["rest"]):
                open_names -= mine
        if not open_names:
            break
    return out


def _debate(page: str | None, main: dict, container: dict, names: tuple[str, ...], unclosed: bool = True) -> dict:
    root = parse(page, unclosed=unclosed)
    head = root.first(**main)
    date = head and head.first("span", attr=_DATE)
    content = root.first(**container)
    labels, strings, blocks, inner = [], None, None, None
    if content is not None:
        inner = (page or "")[content.inner]
        labels, strings = _labels(content, names), content.strings()
        blocks = [t for c in content.children() if (t := c.strip() if isinstance(c, str) else "" if c.tag in OPAQUE else c.text("\n"))]
    return {
        "title": _text(head and head.first("h1")), "date": date and (date.attrs.get("content") or date.text()),
        "has_content": content is not None, "inner_html": inner, "labels": labels, "strings": strings, "blocks": blocks, "failed": False,
    }


def debate_detail(html: Column, main: str = "div.col-sm-8", container: str = "div.field-docs-content", names: tuple[str, ...] = ("participants", "moderators"), seconds: float | None = SECONDS, unclosed: bool = True) -> Column:
    """Raw fields of a debate page, with the labelled paragraphs of these names. ``unclosed``: as in ``html.parse``."""
    head, where = _selector(main), _selector(container)
    return _column(html, DEBATE, lambda page: _debate(page, head, where, names, unclosed), seconds, lambda: {"failed": True})


def _paging(page: str | None) -> dict:
    root = parse(page)
    pager = root.first("ul", "pagination")
    last = pager and pager.first("li", "pager-last")
    anchor = last and last.first("a")
    rows = sum(1 for r in root.all("div", "row") if (m := r.first("div", "col-sm-8")) and m.first("div", "field-title"))
    return {"last_href": anchor and anchor.attrs.get("href"), "hrefs": [a.attrs.get("href", "") for a in pager.all("a")] if pager else [], "document_rows": rows}


def paging_links(html: Column, seconds: float | None = SECONDS) -> Column:
    """Pagination links of a listing page and how many document rows it has."""
    return _column(html, PAGING, _paging, seconds, lambda: {"last_href": None, "hrefs": [], "document_rows": 0})


def anchors(html: Column, seconds: float | None = SECONDS) -> Column:
    """All link targets of a page in order."""
    return _column(html, "array<string>", lambda p: [a.attrs["href"] for a in parse(p).all("a") if "href" in a.attrs], seconds, list)
