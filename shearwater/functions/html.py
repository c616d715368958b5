"""HTML parsing with the standard library, for use inside Arrow-batched table functions."""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# fixed values: elements that say nothing about a record
BOILERPLATE = {"script", "style", "nav", "footer", "header", "iframe", "noscript", "svg", "meta", "link"}
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None = None
    kids: list = field(default_factory=list)

    def walk(self):
        """All elements below, in document order; no recursion, so deep pages are fine."""
        stack = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def text(self, skip: set[str] = frozenset()) -> str:
        out, stack = [], list(reversed(self.kids))
        while stack:
            k = stack.pop()
            if isinstance(k, str):
                out.append(k)
            elif k.tag not in skip:
                stack += list(reversed(k.kids))
                out.append(" ")
        return re.sub(r"\s+", " ", "".join(out)).strip()


def pruned(root: Node, drop) -> list[Node]:
    """All elements below ``root`` in document order, without those that ``drop`` takes and what they hold."""
    out, stack = [], [k for k in reversed(root.kids) if isinstance(k, Node)]
    while stack:
        n = stack.pop()
        if not drop(n):
            out.append(n)
            stack += [k for k in reversed(n.kids) if isinstance(k, Node)]
    return out


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {})

    def handle_starttag(self, tag, attrs):
        n = self.at
        while n.parent and n.tag in CLOSES.get(tag, ()):
            n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, n)
        n.kids.append(node)
        self.at = n if tag in VOID else node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        n = self.at
        while n and n.tag != tag:
            n = n.parent
        if n and n.parent:
            self.at = n.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str | None, references: Collection[str] | None = None) -> Node:
    """The tree of a page.  Of character references all that HTML knows are decoded, or only the named ones, with their semicolon."""
    text = html or ""
    if references is not None:
        text = re.sub(rf"&(?!(?:{'|'.join(references)});)" if references else "&", "&amp;", text)
    b = _Builder()
    b.feed(text)
    b.close()
    return b.root


def release(root: Node) -> None:
    """Cut a tree that nobody needs any more, so that it goes at once and not with a later collection of cycles."""
    for n in root.walk():
        n.parent = None


_SIMPLE = re.compile(r"([a-zA-Z0-9*]*)((?:[.#][\w-]+|\[[\w-]+(?:[~^*$]?=\"?[^\]\"]*\"?)?\])*)$")
_COND = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:([~^*$]?=)\"?([^\]\"]*)\"?)?\]")


def matches(n: Node, simple: str) -> bool:
    m = _SIMPLE.match(simple)
    if not m:
        raise ValueError(f"selector {simple!r} is not supported")
    if m[1] not in ("", "*") and n.tag != m[1]:
        return False
    for mark, name, attr, op, value in _COND.findall(m[2]):
        if mark == ".":
            ok = name in n.attrs.get("class", "").split()
        elif mark == "#":
            ok = n.attrs.get("id") == name
        else:
            have = n.attrs.get(attr)
            ok = have is not None and (not op or {"=": have == value, "*=": value in have, "^=": have.startswith(value), "$=": have.endswith(value), "~=": value in have.split()}[op])
        if not ok:
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Elements by a descendant selector of tags, classes, ids and attributes."""
    chain = selector.split()
    out = []
    for n in root.walk():
        if not matches(n, chain[-1]):
            continue
        up, i = n.parent, len(chain) - 2
        while up and i >= 0:
            i -= matches(up, chain[i])
            up = up.parent
        if i < 0:
            out.append(n)
    return out


def links(root: Node, base: str, selector: str = "a[href]") -> list[tuple[int, str, str]]:
    """(position, absolute URL, text), each URL once at its first place."""
    seen: dict[str, tuple[int, str, str]] = {}
    for n in select(root, selector):
        url = urljoin(base, n.attrs.get("href", ""))
        seen.setdefault(url, (len(seen), url, n.text()))
    return list(seen.values())


def main_text(root: Node, limit: int | None = None) -> str:
    """Text without boilerplate elements."""
    text = root.text(BOILERPLATE)
    return text[:limit] if limit else text


def plain(text: str) -> str:
    """Entities only where there is no tag, else the text of the fragment."""
    return unescape(text) if "<" not in text else parse(text).text({"script", "style"})


def pairs(root: Node) -> list[tuple[str, str]]:
    """Label-value pairs of definition lists and header cells."""
    out = []
    for a, b in (("dt", "dd"), ("th", "td")):
        for n in select(root, a):
            sibs = [k for k in n.parent.kids if isinstance(k, Node)]
            at = next(i for i, k in enumerate(sibs) if k is n)
            if at + 1 < len(sibs) and sibs[at + 1].tag == b:
                out.append((n.text(), sibs[at + 1].text()))
    return out


def labelled(found: list[tuple[str, str]], label: str) -> str:
    """Exact labels first, then labels that contain it; the first non-empty value."""
    for test in (lambda x: x == label, lambda x: label in x):
        for name, value in found:
            if test(name) and value:
                return value
    return ""
