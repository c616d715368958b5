"""Feeds and reports as a data source: one document a group, streamed from sorted partitions.

``df.write.format("documents")`` takes rows (name, head, body, foot, position)
that are partitioned by name and sorted by (name, position): a document is its
first row's head, every row's body and its last row's foot.  Documents get
their names when all tasks have ended well, together with a manifest; a failed
write leaves none of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..session import ready
from .files import inside, opened

SCHEMA = "name string, head string, body string, foot string, position long"


@dataclass
class Written(WriterCommitMessage):
    """The documents of a task: (name, items, bytes), below a folder of its own."""

    folder: str
    documents: list[tuple[str, int, int]]


class DocumentWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.job = root, f".{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        fs, top = opened(self.root)
        folder = f"{self.job}/{uuid.uuid4().hex}"
        done: list[tuple[str, int, int]] = []
        seen: set[str] = set()
        name, out, foot, items, size = None, None, "", 0, 0

        def close() -> None:
            nonlocal size
            if out is not None:
                size += out.write((foot or "").encode())
                out.close()
                done.append((name, items, size))

        for row in rows:
            if row.name != name:
                close()
                name, items, size = inside(row.name), 0, 0
                if name in seen:
                    raise ValueError(f"rows of {name} are apart: partition by name and sort by (name, position)")
                seen.add(name)
                at = f"{top}/{folder}/{name}"
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(at)
                size += out.write((row.head or "").encode())
            size += out.write((row.body or "").encode())
            foot, items = row.foot, items + (row.body is not None)
        close()
        return Written(folder, done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = opened(self.root)
        every = sorted((name, items, size, m.folder) for m in messages if m for name, items, size in m.documents)
        twice = {a[0] for a, b in zip(every, every[1:]) if a[0] == b[0]}
        if twice:
            self.abort(messages)
            raise ValueError(f"rows of {min(twice)} are in two tasks: partition by name")
        for name, _, _, folder in every:
            fs.create_dir(f"{top}/{name}".rsplit("/", 1)[0], recursive=True)
            fs.move(f"{top}/{folder}/{name}", f"{top}/{name}")
        lines = "".join(json.dumps({"name": n, "items": i, "bytes": b}, ensure_ascii=False) + "\n" for n, i, b, _ in every)
        held = f"{top}/{self.job}-manifest"
        with fs.open_output_stream(held) as out:
            out.write(lines.encode())
        fs.move(held, f"{top}/manifest.jsonl")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, top = opened(self.root)
        at = f"{top}/{self.job}"
        if fs.get_file_info(at).type.name == "Directory":
            fs.delete_dir(at)


class Documents(DataSource):
    """``format("documents")``, with the option ``path``: a folder that all executors share, or a URI."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        if "path" not in self.options:
            raise ValueError("documents are written to a path")
        if not overwrite:
            raise ValueError("documents replace those of their name: mode overwrite")
        return DocumentWriter(self.options["path"])


def write(rows: DataFrame, path: str) -> DataFrame:
    """Write (name, head, body, foot, position) as documents and read the manifest: (name, items, bytes).

    A group's rows are written by one task as they stream by, so a document of
    any length takes no memory.  Rows without a body make a document without
    items; equal positions come in the order of their bodies.
    """
    spark = ready(rows.sparkSession)
    spark.dataSource.register(Documents)
    ordered = rows.select("name", "head", "body", "foot", "position").repartition("name").sortWithinPartitions("name", "position", "body")
    ordered.write.format("documents").mode("overwrite").option("path", path).save()
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, items long, bytes long").json(f"{path}/manifest.jsonl")


def escaped(c: Column) -> Column:
    """Text as XML character data."""
    out = F.coalesce(c, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")


def rss(items: DataFrame, name: Column, title: Column, link: Column, position: str, ttl: int = 60) -> DataFrame:
    """Items (title, link, guid, pub_date, description) as rows of RSS documents."""
    tag = lambda t, c: F.concat(F.lit(f"<{t}>"), escaped(c), F.lit(f"</{t}>"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel>'), tag("title", title), tag("link", link), F.lit(f"<ttl>{ttl}</ttl>"))
    guid = F.concat(F.lit('<guid isPermaLink="false">'), escaped(F.col("guid")), F.lit("</guid>"))
    body = F.concat(F.lit("<item>"), tag("title", F.col("title")), tag("link", F.col("link")), guid, tag("pubDate", F.col("pub_date")), tag("description", F.col("description")), F.lit("</item>"))
    return items.select(name.alias("name"), head.alias("head"), body.alias("body"), F.lit("</channel></rss>").alias("foot"), F.col(position).cast("long").alias("position"))


def markdown(cards: DataFrame, name: Column, title: Column, heading: Column, facts: dict[str, Column], position: str) -> DataFrame:
    """Cards (a heading and labelled facts, empty ones skipped) as rows of Markdown reports."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c.cast("string"), r"[\r\n]+", " "), r"([\\`*_\[\]<>#|])", r"\\$1")
    lines = [F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"- {label}: "), plain(c), F.lit("\n"))).otherwise("") for label, c in facts.items()]
    body = F.concat(F.lit("\n## "), plain(F.coalesce(heading, F.lit(""))), F.lit("\n\n"), *lines)
    return cards.select(name.alias("name"), F.concat(F.lit("# "), plain(title), F.lit("\n")).alias("head"), body.alias("body"), F.lit("").alias("foot"), F.col(position).cast("long").alias("position"))


def html(cards: DataFrame, name: Column, title: Column, heading: Column, facts: dict[str, Column], hints: dict[str, Column], link: Column, position: str) -> DataFrame:
    """Cards as rows of HTML review sheets: a heading, hints that help to find the entry, labelled facts, the source.

    Empty hints are left out; an empty fact is marked as missing; the row
    number of a list's entry (``#row=N`` of the link) is a hint of its own.
    """
    tag = lambda t, c: F.concat(F.lit(f"<{t}>"), escaped(c.cast("string")), F.lit(f"</{t}>"))
    filled = lambda c: c.isNotNull() & (c.cast("string") != "")
    row = F.regexp_extract(link, r"#row=(\d+)$", 1)
    found = F.array_compact(F.array(*(F.when(filled(c), F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in {**hints, "row": row}.items())))
    seek = F.when(F.size(found) > 0, F.concat(F.lit('<p class="seek">'), escaped(F.array_join(found, " / ")), F.lit("</p>"))).otherwise("")
    told = F.concat(*(F.concat(tag("dt", F.lit(k)), F.when(filled(c), tag("dd", c)).otherwise('<dd class="missing"></dd>')) for k, c in facts.items()))
    source = F.when(filled(link), F.concat(F.lit('<a href="'), escaped(link), F.lit('">source</a>'))).otherwise("")
    body = F.concat(F.lit("<article>"), tag("h2", F.coalesce(heading, F.lit(""))), seek, F.lit("<dl>"), told, F.lit("</dl>"), source, F.lit("</article>\n"))
    head = F.concat(F.lit('<!doctype html><html lang="ja"><head><meta charset="utf-8">'), tag("title", title), F.lit("</head><body>"), tag("h1", title), F.lit("\n"))
    return cards.select(name.alias("name"), head.alias("head"), body.alias("body"), F.lit("</body></html>\n").alias("foot"), F.col(position).cast("long").alias("position"))
