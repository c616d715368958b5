"""Approximate nearest neighbours by stable projections and kd-trees.

Unit vectors are projected to a few Gaussian dimensions.  A projected squared
distance over the true one follows a chi-square law, so a search walks
neighbours by projected distance, verifies their true distance, and stops when
the chance that a nearer vector still lies beyond is small enough.

The index holds every vector.  The top of the kd-tree is fitted on a bounded
sample and cuts the projected space into cells; a cell with many vectors (or
many equal ones) is split into blocks by a hash.  A query first searches its
own cell, and then only the cells that its stopping test leaves open.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Projected dimensions, and the chance at which the stopping test holds.
DIMENSIONS, CONFIDENCE = 6, 0.98
#: The top of the tree is fitted on at most this many vectors (smallest hash of vec_id).
SAMPLE = 20_000
BLOCK, LEAF, QUERY_BLOCK, SEED = 8192, 64, 2048, 11


def chi_square(x: float, m: int = DIMENSIONS) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for k in range(1, m // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(p: float, m: int = DIMENSIONS) -> float:
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, m) < p else (lo, mid)
    return hi


REACH = quantile(CONFIDENCE)


def projection(width: int, m: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(SEED + width).standard_normal((width, m))


def grow(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Leaves of a kd-tree (row numbers): median cuts along the widest dimension."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        part = points[rows]
        axis = int(np.argmax(part.max(0) - part.min(0)))
        half = len(rows) // 2
        order = np.argpartition(part[:, axis], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def cuts(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A complete tree of ``depth`` levels as (axis, threshold) in heap order."""
    tree: list[tuple[int, float]] = [(0, 0.0)] * (2**depth - 1)
    rows = {0: np.arange(len(points))}
    for node in range(2**depth - 1):
        mine = rows.pop(node)
        if len(mine):
            part = points[mine]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            at = float(np.median(part[:, axis]))
            tree[node] = (axis, at)
            left = part[:, axis] < at
        else:
            left = np.zeros(0, bool)
        rows[2 * node + 1], rows[2 * node + 2] = mine[left], mine[~left]
    return tree


def locate(points: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    axis, at = (np.array(x) for x in zip(*tree)) if tree else (np.zeros(0, np.int64), np.zeros(0))
    while len(node) and node[0] < len(tree):
        right = points[np.arange(len(points)), axis[node]] >= at[node]
        node = 2 * node + 1 + right
    return node - len(tree)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, each scaled by the power of two that brings its largest component to [0.5, 1).

    Cosines stay exactly what they are, and no square overflows or vanishes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if x.size else x


def boxes(cells: list, depth: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length the lower and upper corners of the tree's nodes in heap order, from those of its cells."""
    out = {}
    for width in {r["width"] for r in cells}:
        low, high = np.full((2 ** (depth + 1) - 1, DIMENSIONS), np.inf), np.full((2 ** (depth + 1) - 1, DIMENSIONS), -np.inf)
        for r in cells:
            if r["width"] == width:
                node = r["cell"] + 2**depth - 1
                low[node], high[node] = [r[f"lo_p{i}"] for i in range(DIMENSIONS)], [r[f"hi_p{i}"] for i in range(DIMENSIONS)]
        for level in range(depth - 1, -1, -1):
            at = np.arange(2**level - 1, 2 ** (level + 1) - 1)
            low[at], high[at] = np.minimum(low[2 * at + 1], low[2 * at + 2]), np.maximum(high[2 * at + 1], high[2 * at + 2])
        out[width] = low, high
    return out


def reached(points: np.ndarray, limit: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the cells whose box is within a point's squared distance ``limit``: level by level down the tree."""
    row, node = np.arange(len(points)), np.zeros(len(points), np.int64)
    for level in range(depth + 1):
        gap = np.maximum(np.maximum(low[node] - points[row], points[row] - high[node]), 0)
        near = (gap * gap).sum(1) <= limit[row]
        row, node = row[near], node[near]
        if level < depth:
            row, node = np.repeat(row, 2), np.stack([2 * node + 1, 2 * node + 2], 1).ravel()
    return row, node - (2**depth - 1)


def projected(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x * x).sum(1, keepdims=True))) @ projection(x.shape[1])


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v array<double>): vectors that are not null or zero and hold only finite numbers."""
    v = F.col(vector_column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad).where(F.exists("v", lambda x: x != 0))
    )


def nearest_in_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores), each (query, k): incremental search of one block's kd-tree.

    ``bound`` is the k-th best score known so far (-2: none).  Leaves come in
    order of projected distance; a query stops when the next leaf fails its
    chi-square test.  Places without a result hold id -1 and score -inf.
    """
    p, q = projected(vectors), projected(queries)
    leaves = grow(p, LEAF)
    width = max(map(len, leaves))
    rows = np.full((len(leaves), width), -1)
    for i, r in enumerate(leaves):
        rows[i, : len(r)] = r
    low, high = (np.array([f(p[r], axis=0) for r in leaves]) for f in (np.min, np.max))
    norm, qnorm = np.sqrt((vectors * vectors).sum(1)), np.sqrt((queries * queries).sum(1))
    best_id, best = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf)
    for s in range(0, len(q), 64):
        part = slice(s, min(s + 64, len(q)))
        gap = np.maximum(np.maximum(low[None] - q[part, None], q[part, None] - high[None]), 0)
        gap = (gap * gap).sum(2)
        order = np.argsort(gap, axis=1, kind="stable")
        on = np.arange(gap.shape[0])
        for step in range(len(leaves)):
            leaf = order[on, step]
            known = np.maximum(bound[part][on], best[part][on, -1])
            far = np.where(known > -2, np.maximum(2 - 2 * known, 0), np.inf)
            on, leaf = (x[gap[on, leaf] <= far * REACH + 1e-9] for x in (on, leaf))
            if not len(on):
                break
            cand = rows[leaf]
            score = np.einsum("qd,qld->ql", queries[part][on], vectors[cand]) / (qnorm[part][on, None] * norm[cand])
            cid = np.where(cand >= 0, ids[cand], -1)
            score = np.where((cand < 0) | (cid == own[part][on, None]), -np.inf, score)
            cid, score = np.concatenate([best_id[part][on], cid], 1), np.concatenate([best[part][on], score], 1)
            top = np.lexsort((cid, -score), axis=1)[:, :k]
            best_id[s + on], best[s + on] = np.take_along_axis(cid, top, 1), np.take_along_axis(score, top, 1)
    best_id[np.isneginf(best)] = -1
    return best_id, best


def search(points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's best of every block (cell, sub, width) that it is sent to."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, scores = np.zeros((0, k), np.int64), np.zeros((0, k))
        own = right.column("query_id").to_numpy()
        if left.num_rows and right.num_rows:
            ids, scores = nearest_in_block(
                matrix(left.column("v")), left.column("vec_id").to_numpy(), matrix(right.column("q")), own, right.column("bound").to_numpy(), k,
            )
        ok = ids >= 0
        own = np.repeat(own[:, None], k, 1)[: len(ids)]
        return pa.table({"query_id": own[ok], "vec_id": ids[ok], "score": scores[ok]})

    keys = ["cell", "sub", "width", "turn"]
    return points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, is_query: Callable, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Each query's k nearest by cosine: query_id, rank, vec_id, score.

    ``is_query`` makes the filter from the id column.  Rows that share the
    query's id never count as its neighbours; other rows that repeat an id
    count each.  A query id with several vectors asks with the shortest, of
    those the smallest component by component.  Unusable vectors (null, zero,
    or with null or non-finite components) take no part, however large or small
    the others are; vectors of another length are never neighbours.  Of equal
    scores the smaller vec_id comes first.  With fewer than k candidates all
    come back; an empty table gives no rows.
    """
    spark = common.ready(vectors.sparkSession)
    sc = spark.sparkContext
    good = usable(vectors, id_column, vector_column)

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                column, size = batch.column("v"), batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
                out = np.zeros((batch.num_rows, DIMENSIONS))
                for w in np.unique(size):
                    at = np.flatnonzero(size == w)
                    out[at] = projected(matrix(column.take(pa.array(at))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), column, pa.array(size, pa.int32()), *(pa.array(out[:, i]) for i in range(DIMENSIONS))],
                    ["vec_id", "v", "width", *axes],
                )

    axes = [f"p{i}" for i in range(DIMENSIONS)]
    based = good.mapInArrow(project, "vec_id long, v array<double>, width int, " + ", ".join(f"{a} double" for a in axes))
    total = good.count()
    fitted = np.array([tuple(r) for r in based.orderBy(F.xxhash64("vec_id"), "vec_id").select(*axes).limit(SAMPLE).collect()]).reshape(-1, DIMENSIONS)
    depth = min(16, max(0, math.ceil(math.log2(max(1, total / BLOCK)))))
    tree = sc.broadcast(cuts(fitted, depth))

    def assign(batches):
        for batch in batches:
            p = np.stack([batch.column(a).to_numpy() for a in axes], 1)
            yield batch.append_column("cell", pa.array(locate(p, tree.value), pa.int64()))

    placed = common.table(based.mapInArrow(assign, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in based.schema) + ", cell long"), "vectors")
    bounds = [f(a).alias(f"{n}{a}") for a in axes for f, n in ((F.min, "lo_"), (F.max, "hi_"))]
    cells = common.table(placed.groupBy("cell", "width").agg(F.count("*").alias("n"), *bounds).withColumn("subs", F.ceil(F.col("n") / BLOCK)), "cells")
    least = F.min(F.struct("width", F.col("v").alias("q"), "cell", *axes)).alias("least")
    queries = common.table(placed.where(is_query(F.col("vec_id"))).groupBy(F.col("vec_id").alias("query_id")).agg(least).select("query_id", "least.*"), "queries")

    # at most 2^16 cells for each vector length
    sized = placed.join(F.broadcast(cells.select("cell", "width", "subs")), ["cell", "width"]).withColumn(
        "sub", F.pmod(F.xxhash64("vec_id"), F.col("subs")),
    ).select("cell", "sub", "width", "vec_id", "v")

    def ask(sent: DataFrame) -> DataFrame:
        """Queries by block and turn, and the blocks again for each turn that has queries."""
        turns = sent.groupBy("cell", "width").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("turns"))
        right = (
            sent.join(F.broadcast(turns), ["cell", "width"]).join(F.broadcast(cells.select("cell", "width", "subs")), ["cell", "width"])
            .withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")))
            .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
            .select("cell", "sub", "width", "turn", "query_id", "q", "bound")
        )
        left = sized.join(F.broadcast(turns), ["cell", "width"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        return search(left.select("cell", "sub", "width", "turn", "vec_id", "v"), right, k)

    home = common.table(best(ask(queries.select("cell", "width", "query_id", "q", F.lit(-2.0).alias("bound"))), k), "home")
    known = queries.join(home.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound")), "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0)))
    # at most 2^16 cells for each vector length; a query walks down their tree and leaves what its test closes
    nodes = sc.broadcast(boxes(cells.collect(), depth))

    def open_cells(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p = np.stack([batch.column(a).to_numpy() for a in axes], 1)
            limit = np.maximum(2 - 2 * batch.column("bound").to_numpy(), 0.0) * REACH + 1e-9
            width = batch.column("width").to_numpy()
            for w in np.unique(width):
                mine = np.flatnonzero(width == w)
                for s in range(0, len(mine), 256):
                    part = mine[s : s + 256]
                    row, to = reached(p[part], limit[part], *nodes.value[int(w)], depth)
                    out = to != batch.column("cell").to_numpy()[part][row]
                    sent = batch.select(["width", "query_id", "q", "bound"]).take(pa.array(part[row[out]]))
                    yield pa.RecordBatch.from_arrays([pa.array(to[out]), *sent.columns], ["cell", *sent.schema.names])

    sent = common.table(known.mapInArrow(open_cells, "cell long, width int, query_id long, q array<double>, bound double"), "sent")
    away = ask(sent)
    every = home.select("query_id", "vec_id", "score").unionByName(away)
    return best(every, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op3_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda c: c % 50 == 0)
