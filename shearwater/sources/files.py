"""Files put, moved, deleted and counted by executors, one result row a file, safe to repeat.

Paths are URIs of any file system that pyarrow knows (or plain paths of a
folder that all executors share).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ready

# fixed values: first bytes of the image types that are stored
IMAGE_TYPES = (("image/jpeg", b"\xff\xd8\xff"), ("image/png", b"\x89PNG\r\n\x1a\n"), ("image/gif", b"GIF87a"), ("image/gif", b"GIF89a"))
RESULT = "path string, status string, bytes long, error string"


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a root and the root's path in it."""
    fs, path = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:/") else (pafs.LocalFileSystem(), root)
    return fs, path.rstrip("/")


def content_type(content: bytes | None, name: str = "") -> str | None:
    """The type of the first bytes; None for what is no known image."""
    head = (content or b"")[:16]
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "image/webp"
    return next((kind for kind, mark in IMAGE_TYPES if head.startswith(mark)), None)


def inside(path: str | None) -> str:
    """A relative path that stays below its root."""
    parts = (path or "").split("/")
    if not path or path.startswith("/") or ".." in parts or "" in parts:
        raise ValueError(f"not a path below the root: {path!r}")
    return path


def _each(rows: DataFrame, columns: list[str], act: Callable[..., tuple[str, int | None]]) -> DataFrame:
    """(path, status, bytes, error) of ``act`` on each row, done and stored at once; a failure is its row's status, never its task's."""
    ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                try:
                    out.append((row[0], *act(*row), None))
                except Exception as e:
                    out.append((row[0], "failed", None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string()))], ["path", "status", "bytes", "error"])

    return cut(rows.select(*columns).mapInArrow(run, RESULT))


def _write(fs: pafs.FileSystem, to: str, content: bytes) -> None:
    """The file appears whole or not at all: under a name of its own first, then moved."""
    import uuid

    fs.create_dir(to.rsplit("/", 1)[0], recursive=True)
    held = f"{to}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(held) as out:
        out.write(content)
    fs.move(held, to)


def put(rows: DataFrame, root: str, path: str = "path", content: str = "content", allowed: tuple[str, ...] | None = ("image/jpeg", "image/png", "image/gif", "image/webp")) -> DataFrame:
    """Write each row's bytes to its path: ``stored``, ``present`` (same size there already) or ``rejected``.

    The type is told by the first bytes, against ``allowed`` (None: anything).
    Empty contents are rejected.  Repeated rows write the same file again.
    """

    def act(name: str, data: bytes | None) -> tuple[str, int | None]:
        fs, top = opened(root)
        if not data or (allowed is not None and content_type(data) not in allowed):
            return "rejected", len(data or b"")
        to = f"{top}/{inside(name)}"
        info = fs.get_file_info(to)
        if info.type == pafs.FileType.File and info.size == len(data):
            return "present", len(data)
        _write(fs, to, bytes(data))
        return "stored", len(data)

    return _each(rows.select(F.col(path).alias("path"), F.col(content).alias("content")), ["path", "content"], act)


def move(rows: DataFrame, root: str, archive: str, path: str = "path") -> DataFrame:
    """Move files below ``root`` to the same paths below ``archive``: ``moved``, ``there`` (moved before) or ``missing``."""

    def act(name: str) -> tuple[str, int | None]:
        fs, top = opened(root)
        to_fs, to_top = opened(archive)
        a, b = f"{top}/{inside(name)}", f"{to_top}/{inside(name)}"
        here, there = fs.get_file_info(a), to_fs.get_file_info(b)
        if here.type != pafs.FileType.File:
            return ("there", there.size) if there.type == pafs.FileType.File else ("missing", None)
        if fs.equals(to_fs):
            fs.create_dir(b.rsplit("/", 1)[0], recursive=True)
            fs.move(a, b)
        else:
            with fs.open_input_stream(a) as data:
                _write(to_fs, b, data.read())
            fs.delete_file(a)
        return "moved", here.size

    return _each(rows.select(F.col(path).alias("path")).distinct(), ["path"], act)


def delete(rows: DataFrame, root: str, path: str = "path") -> DataFrame:
    """``deleted`` or ``missing``."""

    def act(name: str) -> tuple[str, int | None]:
        fs, top = opened(root)
        at = f"{top}/{inside(name)}"
        info = fs.get_file_info(at)
        if info.type != pafs.FileType.File:
            return "missing", None
        fs.delete_file(at)
        return "deleted", info.size

    return _each(rows.select(F.col(path).alias("path")).distinct(), ["path"], act)


def exists(rows: DataFrame, root: str, path: str = "path") -> DataFrame:
    """``present`` with its size, or ``missing``."""

    def act(name: str) -> tuple[str, int | None]:
        fs, top = opened(root)
        info = fs.get_file_info(f"{top}/{inside(name)}")
        return ("present", info.size) if info.type == pafs.FileType.File else ("missing", None)

    return _each(rows.select(F.col(path).alias("path")).distinct(), ["path"], act)


def usage(rows: DataFrame, root: str, prefix: str = "prefix") -> DataFrame:
    """Files and bytes below each prefix of ``rows``, listed by executors and summed; (prefix, files, bytes).

    Prefixes must not hold each other.  A prefix that isn't there counts 0.
    """
    ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name in batch.column("prefix").to_pylist():
                fs, top = opened(root)
                found = fs.get_file_info(pafs.FileSelector(f"{top}/{inside(name)}", allow_not_found=True, recursive=True))
                files = [i.size for i in found if i.type == pafs.FileType.File and not i.path.endswith(".tmp")]
                out.append((name, len(files), sum(files)))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))], ["prefix", "files", "bytes"])

    return rows.select(F.col(prefix).alias("prefix")).distinct().mapInArrow(run, "prefix string, files long, bytes long")
