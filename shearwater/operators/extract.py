"""From pages to records: one parse a page, everything after it in Catalyst."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..session import ready


@dataclass(frozen=True)
class Spec:
    """A declarative extractor: a selector for rows, and for each field a selector below it or a cell number."""

    rows: str
    fields: dict[str, str | int]
    skip_first: bool = False
    attrs: dict[str, str] | None = None

    def __post_init__(self) -> None:
        """U03."""
        if not self.rows or not self.fields:
            raise ValueError("an extractor needs a row selector and fields")

    def records(self, root: H.Node) -> list[dict[str, str]]:
        out = []
        for n in H.select(root, self.rows)[int(self.skip_first) :]:
            cells = [k for k in n.kids if isinstance(k, H.Node) and k.tag in ("td", "th")]
            rec = {}
            for name, how in self.fields.items():
                if isinstance(how, int):
                    rec[name] = cells[how].text() if how < len(cells) else ""  # X02: beyond the row's width
                else:
                    hit = n if how == "." else next(iter(H.select(n, how)), None)
                    attr = (self.attrs or {}).get(name)
                    rec[name] = "" if hit is None else hit.attrs.get(attr, "") if attr else hit.text()
            out.append(rec)
        return out


#: Extractors by site name.
REGISTRY: dict[str, Spec] = {}


def register(name: str, spec: Spec) -> None:
    """Each name once."""
    if name in REGISTRY:
        raise ValueError(f"{name} is registered twice")
    REGISTRY[name] = spec


#: Characters of pages whose rows a worker holds before it hands them on.
CHUNK = 4 << 20


def _table(pages: DataFrame, row: Callable[[int, str, H.Node, str], list[tuple]], schema: str, types: list[pa.DataType], references: Collection[str] | None = None) -> DataFrame:
    ready(pages.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html")]
            out, held = [], 0
            for k in range(batch.num_rows):
                page_id, url, text = (c[k].as_py() for c in columns)
                root = H.parse(text, references)
                out += row(page_id, url or "", root, text or "")
                H.release(root)
                held += len(text or "")
                if out and (held >= CHUNK or k + 1 == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out, held = [], 0

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def links(pages: DataFrame, selector: str = "a[href]") -> DataFrame:
    """(page_id, pos, href, label)."""
    return _table(pages, lambda i, u, r, _: [(i, *x) for x in H.links(r, u, selector)], "page_id long, pos int, href string, label string", [pa.int64(), pa.int32(), pa.string(), pa.string()])


def texts(pages: DataFrame, limit: int | None = None, references: Collection[str] | None = None) -> DataFrame:
    """(page_id, title, text); of character references all are decoded, or only the named ones."""
    def row(i, u, r, _):
        title = next(iter(H.select(r, "title")), None)
        return [(i, title.text() if title else "", H.main_text(r, limit))]

    return _table(pages, row, "page_id long, title string, text string", [pa.int64(), pa.string(), pa.string()], references)


# fixed values: phrases that say a list is empty, and what hints at entries of one
EMPTY_LIST = (
    r"現在[^。]{0,20}(収容|登録|保護)[^。]{0,20}(無|なし|いません|ありません|0\s*[頭匹件])",
    r"該当[^。]{0,15}(無|なし|ありません|データはありません)",
    r"(犬|猫|動物|該当する|お知らせするもの)[^。]{0,15}(はいません|はありません|ございません)",
    r"(保護|収容|譲渡|登録)[^。]{0,20}(犬|猫|動物)?[^。]{0,10}(0\s*[頭匹件]|無し|なし)",
    r"現在[^。]{0,15}(掲載|公開)[^。]{0,15}(無|なし|ありません)",
    r"情報は[^。]{0,10}ありません",
    r"見つかりませんでした",
)
EMPTY_MESSAGE = (
    r"(現在|只今|ただいま)[、,]?.{0,25}(ありません|いません)",
    r"該当する.{0,15}(情報|動物)?.{0,3}ありません",
    r"対象.{0,10}(動物|犬|猫).{0,5}いません",
    r"収容.{0,15}(動物|情報|犬|猫)?.{0,5}(ありません|いません)",
)
ENTRY_IMAGE = r"(犬|猫|オス|メス|♂|♀|保護犬|保護猫|収容|譲渡|迷子)"
ENTRY_LINK = r"(detail|/animal/|/animals/|/inu/|/neko/|/dog/|/cat/|/stray/|/hogo/|/jyoto/|/jouto/|/info\d|infoid=)"
EMPTY_ROW = r"(該当.{0,10}(なし|ありません)|現在.{0,10}(いません|ありません)|お知らせ)"
#: Elements whose text nobody reads.
NOISE_TEXT = frozenset({"script", "style"})
# fixed values: elements of a page's frame, by tag, role, class and id, and how many signals make a list suspicious
NOISE_TAGS = {"header", "footer", "nav", "aside", "script", "style", "noscript"}
NOISE_ROLES = {"navigation", "banner", "contentinfo"}
NOISE_CLASSES = {"header", "footer", "nav", "menu", "sidebar", "breadcrumb", "gnav", "global-nav", "side-menu", "pankuzu"}
NOISE_IDS = {"header", "footer", "nav", "sidebar", "menu", "breadcrumb"}
MANY_IMAGES, MANY_LINKS, MANY_ROWS, MANY_FILES = 3, 5, 8, 2


def is_noise(node) -> bool:
    """Whether an element belongs to the page's frame, not to its list."""
    a = node.attrs
    return node.tag in NOISE_TAGS or a.get("role") in NOISE_ROLES or a.get("id") in NOISE_IDS or not NOISE_CLASSES.isdisjoint(a.get("class", "").split())


def signals(pages: DataFrame) -> DataFrame:
    """What an empty listing page shows, and what that means, in one pass over each page.

    Frame elements (with all they hold) count for the zero phrases only.
    Entry links are those of the page's own host below its own path.
    ``zero_class``: many images of animals come before a zero phrase, then
    links, filled rows and PDF files; null pages are ``unreachable``.
    """
    import re
    from urllib.parse import urljoin, urlparse

    empty, image, link, blank = (re.compile(p) for p in ("|".join(EMPTY_LIST), ENTRY_IMAGE, "(?i)" + ENTRY_LINK, EMPTY_ROW))
    message = [re.compile(p) for p in EMPTY_MESSAGE]

    def entry(href: str, url: str) -> bool:
        at, own = urlparse(urljoin(url, href)), urlparse(url)
        inside = at.path.startswith(own.path.rsplit("/", 1)[0] or "/") if at.path else True
        return bool(link.search(href)) and at.netloc in ("", own.netloc) and inside

    def row(i, u, r, text):
        whole = r.text(NOISE_TEXT)
        body = H.pruned(r, is_noise)
        images = [n for n in body if n.tag == "img"]
        found = [
            len(images), sum(bool(image.search(n.attrs.get("alt") or n.attrs.get("title") or "")) for n in images),
            sum(entry(n.attrs["href"], u) for n in body if n.tag == "a" and "href" in n.attrs),
            sum(not blank.search(n.text()) for n in body if n.tag == "tr"), sum(n.tag == "a" and n.attrs.get("href", "").endswith(".pdf") for n in body),
        ]
        said = bool(empty.search(whole))
        kind = (
            "unreachable" if not text else "suspicious" if found[1] >= MANY_IMAGES else "true_zero" if said
            else "suspicious" if found[2] >= MANY_LINKS or found[3] >= MANY_ROWS or found[4] >= MANY_FILES else "maybe_zero"
        )
        return [(i, *found, said, any(p.search(whole) for p in message), bool(H.select(r, "article h1")), kind)]

    kinds = [pa.int64(), *[pa.int32()] * 5, *[pa.bool_()] * 3, pa.string()]
    shape = "page_id long, n_images int, entry_images int, entry_links int, filled_rows int, pdf_links int, says_empty boolean, empty_message boolean, has_article boolean, zero_class string"
    return _table(pages, row, shape, kinds)


def records(pages: DataFrame, spec: Spec) -> DataFrame:
    """(page_id, pos, key, field, value) in long form; the key is ``url#row=pos``."""
    def row(i, u, r, _):
        return [(i, k, f"{u.split('#')[0]}#row={k}", f, v) for k, rec in enumerate(spec.records(r)) for f, v in rec.items()]

    return _table(pages, row, "page_id long, pos int, key string, field string, value string", [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()])


def record_rows(pages: DataFrame, spec: Spec) -> DataFrame:
    """(page_id, pos, key, one column a field): a row a record, without a shuffle."""
    def row(i, u, r, _):
        return [(i, k, f"{u.split('#')[0]}#row={k}", *rec.values()) for k, rec in enumerate(spec.records(r))]

    return _table(pages, row, ", ".join(["page_id long", "pos int", "key string", *(f"{f} string" for f in spec.fields)]), [pa.int64(), pa.int32(), *[pa.string()] * (1 + len(spec.fields))])


def row_number(key):
    """N of ``#row=N``, null elsewhere."""
    return F.regexp_extract(key, r"#row=(\d+)$", 1).try_cast("int")


def robots(pages: DataFrame, rules: str, agent: str = "*") -> DataFrame:
    """(page_id, allowed) under one robots text; an empty text allows all, a URL without a host is denied."""
    from urllib.parse import urlparse
    from urllib.robotparser import RobotFileParser

    parser = RobotFileParser()

    def row(i, u, r, _):
        if not parser.mtime():  # once a task
            parser.parse(rules.splitlines())
            parser.modified()
        return [(i, bool(urlparse(u).netloc) and (not rules.strip() or parser.can_fetch(agent, u)))]

    return _table(pages.withColumn("html", F.lit("")), row, "page_id long, allowed boolean", [pa.int64(), pa.bool_()])
