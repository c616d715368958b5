"""Parts of the exact set-similarity joins over token sets: one pass that also
counts tokens, prefix lengths, pairs inside sorted groups, and verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, kernels

#: Jaccard bound 4/5, kept as integers so that no comparison rounds.
NUM, DEN = 4, 5


def at_least(n):
    """Smallest overlap that a set of n tokens has with any set it is similar to (n: number, array or column)."""
    if isinstance(n, Column):
        return F.ceil(NUM * n / DEN).cast("int")
    return (NUM * n + DEN - 1) // DEN


def prefix(n):
    """So many of the first tokens in rarity order hold one that any similar set shares."""
    return n - at_least(n) + 1


def overlap(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Smallest overlap of two similar sets of these sizes: J >= 4/5 is overlap >= 4/9 of both sizes together."""
    return (NUM * (na + nb) + NUM + DEN - 1) // (NUM + DEN)


def counted(docs: DataFrame, rows: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], shape: str, width: int, name: str) -> tuple[DataFrame, np.ndarray]:
    """One pass over texts that writes rows of ``shape`` and counts token hashes.

    ``rows(batch, counts)`` returns the batch's rows and adds to ``counts``.
    The counts are a fixed array of ``width`` hash buckets: rarity over all
    documents at a size that doesn't depend on the corpus.
    """
    names = [x.split()[0] for x in shape.split(", ")]
    step = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width, np.int64)
        types = None
        for batch in kernels.chunks(batches):
            out = rows(batch, counts)
            types = out.schema.types
            nulls = [pa.nulls(out.num_rows, pa.int32()), pa.nulls(out.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([*out.columns, *nulls], [*names, "block", "data"])
        if types is not None:
            at = [b for b in range(0, width, step) if counts[b : b + step].any()]
            data = [pa.array([b // step for b in at], pa.int32()), pa.array([counts[b : b + step].astype(np.uint32).tobytes() for b in at], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(at), t) for t in types), *data], [*names, "block", "data"])

    both = common.table(docs.mapInArrow(run, f"{shape}, block int, data binary"), name)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(step, np.int64)
        for batch in batches:
            for raw in batch.column("data"):
                part = np.frombuffer(raw.as_py(), np.uint32)
                total[: len(part)] += part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "data"])

    counts = np.zeros(width, np.int64)
    merged = both.where("block is not null").select("block", "data").groupBy("block").applyInArrow(merge, "block int, data binary")
    for row in merged.toLocalIterator():  # at most width / 4096 rows
        counts[row.block * step : (row.block + 1) * step] = np.frombuffer(bytes(row.data), np.int64)[: width - row.block * step]
    return both.where("block is null").drop("block", "data"), counts


def group_bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each group, size of each group) in sorted keys."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return start, np.diff(np.append(start, len(key)))


def close_pairs(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs i < j inside groups laid end to end, one distance j - i at a time."""
    return pairs_within(np.repeat(np.cumsum(size), size) - np.arange(int(size.sum())))  # rows from here to the group's end


def pairs_within(left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs i < j < i + left[i], one distance j - i at a time."""
    at, d = np.flatnonzero(left > 1), 1
    while len(at):
        yield at, at + d
        d += 1
        at = at[left[at] > d]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, inter, na, nb) for candidate pairs (a, b), a written table.

    ``sets`` has (cls, keys): distinct tokens.  Both joins are by class and use
    one exchange of the sets, hot ones of a are spread apart, and the
    intersection is counted in the JVM.
    """
    one = sets.select(F.col("cls").alias("a"), F.col("keys").alias("ka"))
    two = sets.select(F.col("cls").alias("b"), F.col("keys").alias("kb"))
    return (
        common.apart_join(pairs, one, "a", "b").join(two, "b")
        .select("a", "b", F.size(F.array_intersect("ka", "kb")).cast("long").alias("inter"), F.size("ka").cast("long").alias("na"), F.size("kb").cast("long").alias("nb"))
    )


def enough(inter: str = "inter") -> str:
    return f"{DEN} * {inter} >= {NUM} * (na + nb - {inter})"
