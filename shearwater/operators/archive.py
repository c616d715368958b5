"""The archive job: settled rows move from the active table to the archive, batch by batch, both in one commit."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.store import Store

#: Rows a batch.
BATCH = 100_000
#: Commits a run makes at most: each rewrites the buckets of the active table that it touches, so of many batches several share one.
COMMITS = 8


@dataclasses.dataclass(frozen=True)
class Outcome:
    """What a run did; ``store`` is its last version, whose table of failures holds an error a row that stayed."""

    store: Store
    batches: int
    processed: int
    moved: int
    failed: int


def create(store: Store, active: DataFrame, key: str = "id", buckets: int = 64) -> Store:
    """The tables ``active``, ``archive`` (with archived_at) and ``failures`` (key, error, run) in one commit."""
    none = active.limit(0)
    failures = none.select(key, F.lit("").alias("error"), F.lit("").alias("run"))
    archive = none.withColumn("archived_at", F.lit(None).cast("date"))
    return store.commit([store.put("active", active, key, buckets), store.put("archive", archive, key, buckets), store.put("failures", failures, key, buckets)])


def settled(rows: DataFrame, as_of: str, retention: int = 180, changed: str = "status_changed_at") -> DataFrame:
    """adopted or returned, and unchanged for ``retention`` days."""
    return rows.where(F.col("status").isin("adopted", "returned") & (F.col(changed) <= F.date_sub(F.lit(as_of).cast("date"), retention)))


def _ends(moving: DataFrame, batch: int) -> list[tuple]:
    """(last place, batches, rows, errors) of up to COMMITS groups of whole batches, in order.

    ``moving`` is sorted and stored: a row's number is its place in its
    partition after the rows of the partitions before, so only counts by
    partition and the last rows of groups come to the driver.
    """
    sizes = dict(moving.groupBy(F.spark_partition_id()).count().collect())
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    if not total:
        return []
    step = -(-(-(-total // batch)) // COMMITS) * batch
    first = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.spark_partition_id())
    number = first + F.monotonically_increasing_id() % (1 << 33)
    groups = moving.select("__place", "__error", F.floor(number / step).alias("g")).groupBy("g").agg(F.max("__place").alias("p"), F.count("*").alias("n"), F.count("__error").alias("bad"))
    return [(r.p, -(-r.n // batch), r.n, r.bad) for r in groups.orderBy("g").collect()]


def run(store: Store, as_of: str, error: Column, batch: int = BATCH, retention: int = 180, changed: str = "status_changed_at", run_id: str | None = None) -> Outcome:
    """Move settled rows in batches of ``batch`` in the order of (changed, key).

    ``error`` is null for rows that may go; others stay active, are written to
    ``failures`` and aren't tried again in this run.  Settled rows are sorted
    and stored once.  A batch's rows leave the one table and enter the other by
    one commit, with the place it came to; beyond COMMITS batches, several that
    follow each other share a commit.  A run that died goes on behind its last
    commit under the same ``run_id`` and doubles nothing.  Of a commit only its
    last row's place and counts come to the driver.
    """
    key = store.manifest["tables"]["active"]["key"]
    run_id = run_id or as_of
    note = store.manifest.get("note", {})
    mine = note.get("run") == run_id
    after = note["after"] if mine else None
    counts = note["counts"] if mine else [0, 0, 0, 0]
    kind = store.schema("active")[key].dataType
    at = lambda when, value: F.struct(when.cast("string").alias("at"), value.cast(kind).alias("key"))
    rows = settled(store.read("active"), as_of, retention, changed).withColumn("__place", at(F.col(changed), F.col(key)))
    if after is not None:
        rows = rows.where(F.col("__place") > at(F.lit(after[0]), F.lit(after[1])))
    rows = rows.join(store.read("failures").where(F.col("run") == run_id).select(key), key, "left_anti")
    moving = cut(rows.withColumn("__error", error).repartitionByRange("__place").sortWithinPartitions("__place"))
    for last, batches, n, failed in _ends(moving, batch):
        part = moving.where(F.col("__place") <= at(F.lit(last.at), F.lit(last.key)))
        if after is not None:
            part = part.where(F.col("__place") > at(F.lit(after[0]), F.lit(after[1])))
        good, bad = part.where("__error is null").drop("__error", "__place"), part.where("__error is not null")
        after = [last.at, last.key]
        counts = [counts[0] + batches, counts[1] + n, counts[2] + n - failed, counts[3] + failed]
        changes = []
        if n > failed:
            changes = [store.append("archive", good.withColumn("archived_at", F.lit(as_of).cast("date"))), store.delete("active", good.select(key))]
        if failed:
            changes.append(store.append("failures", bad.select(key, F.col("__error").alias("error"), F.lit(run_id).alias("run"))))
        store = store.commit(changes, {"run": run_id, "after": after, "counts": counts})
    return Outcome(store, *counts)
