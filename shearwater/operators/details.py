"""Parts of listing and detail pages that need the page's structure: labelled fields, blocks under headings, rows, cells."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from html import escape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..session import cut
from .extract import EMPTY_ROW, _table

HEADINGS = ("h2", "h3", "h4")
# fixed values: characters of an unfilled date cell, attributes and elements of a tidied page
DATE_TEMPLATE = "月日時分"
KEPT_ATTRS = ("class", "id", "href", "src", "alt", "title")
UNSEEN = ("script", "style", "noscript", "iframe", "svg")
# fixed values: words and marks of a link to the next page, in order
NEXT_WORDS = ("次へ", "次のページ", "Next", "next", ">>", "›", "次")
NEXT_MARKS = ("next", "pagination-next")


def _elements(n: H.Node, *tags: str) -> list[H.Node]:
    return [k for k in n.walk() if k.tag in tags]


def _squeezed(n: H.Node) -> str:
    """Text of an element, its parts trimmed and joined without blanks."""
    return "".join(_pieces(n))


def _pieces(n: H.Node) -> Iterator[str]:
    stack = list(reversed(n.kids))
    while stack:
        k = stack.pop()
        if isinstance(k, H.Node):
            stack += reversed(k.kids)
        elif k.strip():
            yield k.strip()


def _defined(root: H.Node) -> Iterator[tuple[str, str]]:
    """Terms with the definition that follows them among their siblings."""
    for term in _elements(root, "dt"):
        kids = term.parent.kids
        at = next(i for i, k in enumerate(kids) if k is term)
        value = next((k for k in kids[at + 1 :] if isinstance(k, H.Node) and k.tag == "dd"), None)
        if value is not None:
            yield _squeezed(term), _squeezed(value)


def _tabled(root: H.Node) -> Iterator[tuple[str, str]]:
    """Of each row the header cell with the first data cell, or the first two data cells."""
    for row in _elements(root, "tr"):
        cells = _elements(row, "th")[:1] + _elements(row, "td")
        if len(cells) > 1:
            yield _squeezed(cells[0]), _squeezed(cells[1])


def _said(lines: Sequence[str], labels: Sequence[str]) -> str:
    """The rest of the first line that goes on after a label; brackets are no part of it."""
    for line in lines:
        for label in labels:
            m = re.search(rf"{re.escape(label)}[\s：:]*(.+)", line, re.IGNORECASE)
            value = re.sub(r"[()（）\[\]【】]", "", m[1]).strip() if m else ""
            if value:
                return value
    return ""


def fields(pages: DataFrame, labels: Mapping[str, Sequence[str]]) -> DataFrame:
    """(page_id, one column a field, text): definition lists, then table rows, then lines of text.

    A label counts where a term, header or line contains it.  The first hit of
    a rung decides; an empty value leads to the next rung, and '' comes out
    where none has any.
    """

    def row(i, u, r, _):
        rungs, lines = (list(_defined(r)), list(_tabled(r))), list(_pieces(r))
        out = []
        for names in labels.values():
            hits = (next((v for label, v in rung if any(n in label for n in names)), "") for rung in rungs)
            out.append(next(filter(None, hits), "") or _said(lines, names))
        return [(i, *out, " ".join(lines))]

    shape = ", ".join(["page_id long", *(f"{f} string" for f in labels), "text string"])
    return _table(pages, row, shape, [pa.int64(), *[pa.string()] * (len(labels) + 1)])


def blocks(pages: DataFrame, selector: str) -> DataFrame:
    """(page_id, pos, text, heading, species) of each selected element.

    ``heading`` is the nearest h2-h4 before it.  ``species`` comes from the
    nearest that names a dog or a cat, not beyond the nearest h2.
    """

    def row(i, u, r, _):
        wanted, out, heading, species = {id(n) for n in H.select(r, selector)}, [], "", ""
        for n in r.walk():
            if n.tag in HEADINGS:
                heading = n.text()
                named = next((k for k in "犬猫" if k in heading), "")
                species = named if named or n.tag == "h2" else species
            elif id(n) in wanted:
                out.append((i, len(out), n.text(), heading, species))
        return out

    return _table(pages, row, "page_id long, pos int, text string, heading string, species string", [pa.int64(), pa.int32(), *[pa.string()] * 3])


def header_records(pages: DataFrame, labels: Mapping[str, Sequence[str]]) -> DataFrame:
    """(page_id, n_table, n_row, one column a field): rows of tables whose first row names columns.

    A column is a field's if its label holds one of the field's words; the
    first such column counts.  Tables whose first row names no field give
    nothing; a cell that isn't there is ''.
    """

    def row(i, u, r, _):
        out = []
        for k, table in enumerate(_elements(r, "table")):
            rows = [_elements(n, "td", "th") for n in _elements(table, "tr")]
            heads = [_squeezed(c) for c in rows[0]] if rows else []
            at = {f: next((x for x, h in enumerate(heads) if any(w in h for w in words)), None) for f, words in labels.items()}
            if any(x is not None for x in at.values()):
                for y, cells in enumerate(rows[1:], 1):
                    out.append((i, k, y, *("" if x is None or x >= len(cells) else cells[x].text() for x in at.values())))
        return out

    shape = ", ".join(["page_id long", "n_table int", "n_row int", *(f"{f} string" for f in labels)])
    return _table(pages, row, shape, [pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * len(labels)])


def placed(pages: DataFrame, selector: str, sections: Mapping[str, str] | None = None) -> DataFrame:
    """(page_id, pos, text, by_section, by_caption, by_heading, by_text, species) of each selected element.

    ``by_section`` comes from the class of the nearest element around it that
    ``sections`` names, ``by_caption`` from the caption of the table around it,
    ``by_heading`` as in ``blocks``, ``by_text`` from its own words.  The first
    that names a species decides, else その他; '' stands for none.
    """
    sections = dict(sections or {})

    def named(text: str) -> str:
        return next((k for k in "犬猫" if k in text), "")

    def row(i, u, r, _):
        wanted, out, heading = {id(n) for n in H.select(r, selector)}, [], ""
        for n in r.walk():
            if n.tag in HEADINGS:
                own = named(n.text())
                heading = own if own or n.tag == "h2" else heading
            elif id(n) in wanted:
                section, caption, up = "", "", n.parent
                while up is not None:
                    section = section or next((sections[c] for c in up.attrs.get("class", "").split() if c in sections), "")
                    if up.tag == "table" and not caption:
                        caption = named(next((c.text() for c in _elements(up, "caption")), ""))
                    up = up.parent
                text = n.text()
                found = (section, caption, heading, named(text))
                out.append((i, len(out), text, *found, next(filter(None, found), "その他")))
        return out

    return _table(pages, row, "page_id long, pos int, text string, by_section string, by_caption string, by_heading string, by_text string, species string", [pa.int64(), pa.int32(), *[pa.string()] * 6])


def row_kinds(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, n_cells) of each table row: header, blank, template, message or data.

    Blank rows hold no text, template rows only unfilled dates beside that,
    header rows no data cell, message rows a single cell that says the list is
    empty.
    """
    message = re.compile(EMPTY_ROW)

    def kind(cells: list[H.Node]) -> str:
        said = [t for t in (re.sub(r"\s", "", c.text()) for c in cells) if t]
        if not said:
            return "blank"
        if all(set(t) <= set(DATE_TEMPLATE) for t in said):
            return "template"
        if all(c.tag == "th" for c in cells):
            return "header"
        return "message" if len(said) == 1 and message.search(said[0]) else "data"

    def row(i, u, r, _):
        rows = [_elements(n, "td", "th") for n in _elements(r, "tr")]
        return [(i, k, kind(cells), len(cells)) for k, cells in enumerate(rows)]

    return _table(pages, row, "page_id long, pos int, kind string, n_cells int", [pa.int64(), pa.int32(), pa.string(), pa.int32()])


def cell_images(pages: DataFrame) -> DataFrame:
    """(page_id, row, cell, src): images inside each table cell, their URLs absolute."""

    def row(i, u, r, _):
        return [
            (i, y, x, urljoin(u, img.attrs["src"]))
            for y, tr in enumerate(_elements(r, "tr")) for x, cell in enumerate(_elements(tr, "td", "th"))
            for img in _elements(cell, "img") if img.attrs.get("src")
        ]

    return _table(pages, row, "page_id long, row int, cell int, src string", [pa.int64(), pa.int32(), pa.int32(), pa.string()])


def _markup(n: H.Node) -> str:
    """An element as markup, with kept attributes only and without elements nobody sees."""
    out: list[str] = []
    stack: list[H.Node | str] = [n]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
        elif k.tag not in UNSEEN:
            attrs = "".join(f' {a}="{escape(v)}"' for a, v in k.attrs.items() if a in KEPT_ATTRS)
            out.append(f"<{k.tag}{attrs}>" if k.tag[0] != "#" else "")
            stack.append(f"</{k.tag}>" if k.tag[0] != "#" and k.tag not in H.VOID else "")
            stack += [escape(x, quote=False) if isinstance(x, str) else x for x in reversed(k.kids)]
    return "".join(out)


def tidied(pages: DataFrame, anchor: str, window: int = 5000) -> DataFrame:
    """(page_id, html, sample): the body with few attributes, and a window of it around ``anchor``.

    Without the anchor the sample is the head of the body; a page without a
    body is taken whole.
    """

    def row(i, u, r, _):
        body = next(iter(_elements(r, "body")), r)
        text = re.sub(r"\n\s*\n", "\n", _markup(body))
        at = text.find(anchor)
        low = max(0, at - window // 2)
        return [(i, text, text[low : at + window // 2] if at >= 0 else text[:window])]

    return _table(pages, row, "page_id long, html string, sample string", [pa.int64(), pa.string(), pa.string()])


def _whole(n: H.Node) -> str:
    """Text of an element that holds one string and nothing beside it, however deep; '' for others."""
    while len(n.kids) == 1 and isinstance(n.kids[0], H.Node):
        n = n.kids[0]
    return n.kids[0] if len(n.kids) == 1 else ""


def next_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, next_url): the link to the following page by its words, then by class or rel; null without any.

    Of each word the first link that holds it counts, if it leads anywhere.
    """

    def row(i, u, r, _):
        found = _elements(r, "a")
        marked = lambda a, how: next((n for n in found if a in n.attrs.get(how, "").split()), None)
        tried = [next((n for n in found if w in _whole(n)), None) for w in NEXT_WORDS]
        tried += [marked(m, "class") or marked(m, "rel") for m in NEXT_MARKS]
        href = next((n.attrs["href"] for n in tried if n is not None and n.attrs.get("href")), None)
        return [(i, u, None if href is None else urljoin(u, href))]

    return _table(pages, row, "page_id long, url string, next_url string", [pa.int64(), pa.string(), pa.string()])


def walked(links: DataFrame, starts: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(start, step, url): pages reached from each start over ``links`` (url, next_url), at most ``max_pages`` a start.

    All starts go on together, one join by URL a step; a walk ends at a page
    that isn't there, that leads nowhere, or that the walk has met before.
    Repeated URLs count once, with the smallest next one.
    """
    if max_pages is not None and max_pages < 1:
        raise ValueError("max_pages is at least 1")
    links = cut(links.groupBy("url").agg(F.min("next_url").alias("next_url")))
    at = starts.select(F.col("url").alias("start"), "url").distinct().join(links, "url")
    at = cut(at.select("start", F.lit(0).alias("step"), "url", "next_url"))
    done, step = at, 1
    while not at.isEmpty() and (max_pages is None or step < max_pages):
        ahead = at.select("start", F.col("next_url").alias("url")).where("url is not null").join(links, "url")
        at = cut(ahead.join(done, ["start", "url"], "left_anti").select("start", F.lit(step).alias("step"), "url", "next_url"))
        done, step = done.union(at), step + 1
    return done.select("start", "step", "url")
