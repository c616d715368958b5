"""Secret scan: fixed patterns plus assignment-aware lexing.

A scanner reads source and configuration syntax into tokens: strings with
escapes (single, double, back-quoted, triple), comments, brackets, bare words.
From them come name-literal pairs: ``name = literal``, ``"name": "literal"``,
``table["name"] = ...``, ``name: literal`` with YAML blocks, ``export
NAME=literal``, ``<name>literal</name>``; literals joined by ``+`` or side by
side are one.  A bare name on the right stands for the literal it was given
earlier, while its block (braces, or indentation) lasts.  Each literal is
scored by how sensitive its target's name is and how random it looks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, kernels

BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: Runs of 32 hex digits are rare; this finds the texts worth a full pass.
_LONG_HEX = re.compile(r"[0-9a-f]{32}")
#: Quantifiers are possessive, so no part is read twice; no length is bounded.
_TOKEN = re.compile(
    r"""[ \t\r]*+(?:(?P<line>\n)|(?P<note>(?:\#(?<![^\s]\#)|//(?<![^\s]//))[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)"""
    r"""|\"{3}(?P<t1>(?:[^"\\]++|\\.|"(?!""))*+)\"{3}|'{3}(?P<t2>(?:[^'\\]++|\\.|'(?!''))*+)'{3}"""
    r"""|"(?P<s1>(?:[^"\\\n]++|\\.)*+)"|'(?P<s2>(?:[^'\\\n]++|\\.)*+)'|`(?P<s3>(?:[^`\\\n]++|\\.)*+)`"""
    r"""|(?P<sep>=>|:=|[=!<>]=|[=:])|(?P<word>[^\s"'`=:,;(){}\[\]<>+]++(?:'[^\W\d_]++)*+)|(?P<mark>[^\s]))""",
    re.S,
)
_STRINGS = ("t1", "t2", "s1", "s2", "s3")
_BARE = re.compile(r"""[^\s"',;(){}\[\]<>]++""")
_NAME = re.compile(r"(?<![A-Za-z0-9_.$@-])[A-Za-z0-9_.$@-]++\Z")
_BLOCK = re.compile(r"[ \t]*[>|][+-]?[ \t]*\r?\n")
_XML = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*+)(?:\s[^<>]*+)?>\s*+([^<>\s]++)\s*+</\1\s*>")
_ESCAPE = re.compile(r"\\(.)", re.S)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: How much a part of a name says about its literal.
WEIGHT = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "pass": 0.7, "auth": 0.6, "bearer": 0.8, "key": 0.5, "api": 0.4,
    "access": 0.3, "private": 0.5, "signing": 0.4, "signature": 0.4, "encryption": 0.4, "client": 0.1, "db": 0.1,
}
PLACEHOLDER = re.compile(r"(?i)(?:change_?me|example|placeholder|your[_-].*|xxx+|\*+|<.*>|\$\{.*\}|null|none|true|false|undefined|https?://.*)\Z")
THRESHOLD = 0.6
MIN_LITERAL = 8


#: A text without any of these can't hold a name that scores: parts of names that don't hold another one.
_HINTS = [w for w, x in WEIGHT.items() if x >= 0.3 and not any(v in w for v, y in WEIGHT.items() if y >= 0.3 and v != w)]


def name_score(name: str) -> float:
    """0 to 1: sensitivity of an assignment's target, from the parts of its name."""
    parts = [p.lower() for chunk in re.split(r"[_.-]+", name) for p in _PART.findall(chunk) or [chunk.lower()]]
    return min(1.0, sum({p: WEIGHT.get(p, 0.0) for p in parts}.values()))


def literal_score(text: str) -> float:
    """0 to 1: bits a character of the literal carry, against four bits of hex; words and placeholders get 0."""
    if len(text) < MIN_LITERAL or PLACEHOLDER.match(text) or " " in text:
        return 0.0
    kinds = sum(bool(re.search(k, text)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if kinds < 2:
        return 0.0
    n = len(text)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    return min(1.0, bits / 3.0)


class Names:
    """Literals that names stand for, until the block they were given in ends."""

    def __init__(self):
        self.now: dict[str, tuple[int, int, str]] = {}
        self.undo: list[tuple[int, int, str, tuple[int, int, str] | None]] = []

    def give(self, depth: int, indent: int, name: str, literal: tuple[int, int, str | None]) -> None:
        self.undo.append((depth, indent, name, self.now.get(name)))
        self.now[name] = literal

    def leave(self, depth: int, indent: int) -> None:
        while self.undo and (self.undo[-1][0] > depth or self.undo[-1][1] > indent):
            _, _, name, before = self.undo.pop()
            if before is None:
                del self.now[name]
            else:
                self.now[name] = before


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end): kind is line, string (its content), sep, word or mark; comments are left out."""
    out, at = [], 0
    while m := _TOKEN.match(text, at):
        kind = m.lastgroup
        if kind != "note":
            out.append(("string" if kind in _STRINGS else kind, m.start(kind), m.end(kind)))
        at = m.end()
    return out


def _block(text: str, at: int, indent: int) -> tuple[int, int, str] | None:
    """The YAML block scalar whose first line starts at ``at``: lines indented by more than ``indent``."""
    start = end = None
    parts = []
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop]
        body = line.strip()
        if body:
            lead = len(line) - len(line.lstrip())
            if lead <= indent:
                break
            start, end = at + lead if start is None else start, at + lead + len(body)
            parts.append(body)
        at = stop + 1
    return None if start is None else (start, end, "".join(parts))


def pairs(text: str) -> list[tuple[str, int, int, str | None]]:
    """(name, start, end, value) of all assignments of literals; names on the right are followed.

    A bare literal is as it stands (value None).  It may hold further signs;
    what they would assign inside it counts only while no sensitive name has it.
    """
    found = [(m[1], m.start(2), m.end(2), m[2]) for m in _XML.finditer(text)]
    toks, known = tokens(text), Names()
    depth = indent = stop = 0
    taken = False  # whether the bare literal that ends at ``stop`` has a sensitive name
    for i, (kind, a, b) in enumerate(toks):
        if kind == "line" or i == 0:
            j = i + (kind == "line")
            if j < len(toks) and toks[j][0] != "line":
                begin = b if kind == "line" else 0
                indent = len(text[begin : toks[j][1]].rstrip("\"'`"))
                known.leave(depth, indent)
        if kind == "mark" and text[a] in "{}":
            depth = depth + 1 if text[a] == "{" else max(0, depth - 1)
            known.leave(depth, indent)
        if kind != "sep" or text[a:b] not in ("=", ":", "=>", ":=") or not i:
            continue
        before = i - 1 - (toks[i - 1][0] == "mark" and text[toks[i - 1][1]] == "]" and i > 1)
        if toks[before][0] not in ("word", "string"):
            continue
        m = _NAME.search(text[toks[before][1] : toks[before][2]])
        if not m:
            continue
        name = m[0]
        inside = b < stop
        if inside and taken:
            continue
        literal = _value(text, toks, i + 1, b, indent, known, stop)
        if literal and literal[2] is None and not (inside and literal[1] < stop):
            stop, taken = max(stop, literal[1]), name_score(name) >= THRESHOLD
        if literal:
            known.give(depth, indent, name, literal)
            found.append((name, *literal))
    return found


def _value(text: str, toks: list[tuple[str, int, int]], i: int, at: int, indent: int, known: Names, stop: int) -> tuple[int, int, str | None] | None:
    """(start, end, value) of what stands right of a sign that ends at ``at``; ``i`` is the next token.

    ``stop`` is the end of the last bare literal: one that starts before it ends there too.
    """
    if m := _BLOCK.match(text, at):
        return _block(text, m.end(), indent)
    parts: list[tuple[int, int, str]] = []
    while i < len(toks):
        kind, a, b = toks[i]
        if kind == "string":
            parts.append((a, b, _ESCAPE.sub(r"\1", text[a:b])))
        elif kind == "word" and text[a:b] in known.now:
            parts.append(known.now[text[a:b]])
        elif kind in ("word", "mark") and not parts:
            end = stop if a < stop else m.end() if (m := _BARE.match(text, a)) else a
            while end > a and text[end - 1] in ".,":
                end -= 1
            return (a, end, None) if end > a else None
        else:
            break
        i += 1
        if i < len(toks) and toks[i][0] == "mark" and text[toks[i][1]] == "+":
            i += 1
        elif i >= len(toks) or toks[i][0] != "string":
            break
    if len(parts) < 2:
        return parts[0] if parts else None
    return min(p[0] for p in parts), max(p[1] for p in parts), "".join(text[p[0] : p[1]] if p[2] is None else p[2] for p in parts)


def lexed(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of literals whose target's name makes them secrets; constants are followed."""
    low = text.lower()
    if not any(w in low for w in _HINTS) or not any(c in text for c in ":=<"):
        return []
    out: dict[tuple[int, int], tuple[str, float]] = {}
    for name, a, b, value in pairs(text):
        sure = name_score(name)
        score = sure * literal_score(text[a:b] if value is None else value) if sure >= THRESHOLD else 0.0
        if score >= THRESHOLD and score > out.get((a, b), ("", 0.0))[1]:
            out[a, b] = (name, score)
    return [(a, b, *v) for (a, b), v in sorted(out.items())]


def base(text: str) -> list[tuple[str, int, int]]:
    found = []
    for kind, pattern, group, least in BASE:
        if kind == "access" and "AKIA" not in text or kind == "hex" and not _LONG_HEX.search(text):
            continue
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return found


_ORDER = {"assign": 0, "access": 1, "hex": 2, "lexed": 3}


def spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start, then kind.  A lexed literal inside a base span adds nothing."""
    if not text:
        return [], []
    first = sorted(base(text), key=lambda x: (x[1], _ORDER[x[0]]))
    more = [("lexed", a, b) for a, b, _, _ in lexed(text) if not any(s <= a and b <= e for _, s, e in first)]
    return first, sorted(first + more, key=lambda x: (x[1], _ORDER[x[0]]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redacted(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every span (overlaps united) replaced by ``mark``."""
    found = spans(text)[1]
    if not found:
        return text
    out, at = [], 0
    for _, a, b in sorted(found, key=lambda x: x[1:]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """Secrets in every text: counts by base kind, a digest of the base spans and all spans.

    One row per input row, repeated rows too; null and empty texts have no
    spans; a null doc_id stays null; an empty table gives no rows; texts,
    names and literals may have any length; other columns are ignored.  Spans
    that start together come in the order assign, access, hex, lexed.
    """
    common.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.chunks(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                first, every = spans(text)
                kinds = Counter(k for k, _, _ in first)
                rows.append((doc_id, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(joined(first).encode()).hexdigest(), joined(every)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()] * 2)], [x.split()[0] for x in SCHEMA.split(", ")])

    return common.texts(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with the secrets of a text column masked; all rows, repeated ones and nulls too, and columns stay."""
    common.ready(docs.sparkSession)
    at, schema = docs.columns.index(column), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.chunks(batches, column):
            new = pa.array([redacted(x) for x in batch.column(column).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    return docs.mapInArrow(run, schema)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
