"""Structured Streaming forms of the folds and merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready

_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """Events as a stream of files, with a zoned timestamp that watermarks accept."""
    stream = spark.readStream.schema(_SCHEMA).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def streaks(stream: DataFrame, key: str = "user_id") -> DataFrame:
    """W01 as keyed state: (key, streak, runs) after each batch; events of a batch are taken in event_id order."""
    ready(stream.sparkSession)

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak, runs = state.get if state.exists else (0, 0)
        failed = pd.concat(list(frames)).sort_values("event_id")["event_type"].eq("error").to_numpy()
        fine = np.flatnonzero(~failed)
        streak, runs = (len(failed) - 1 - int(fine[-1]) if len(fine) else streak + len(failed)), runs + len(failed)
        state.update((int(streak), int(runs)))
        yield pd.DataFrame({key: [k[0]], "streak": [int(streak)], "runs": [int(runs)]})

    return stream.select(key, "event_id", "event_type").groupBy(key).applyInPandasWithState(
        fold, f"{key} long, streak long, runs long", "streak long, runs long", "update", "NoTimeout",
    )


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Gap sessions under a watermark."""
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def windows(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Fixed windows for rate limits."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), (F.col("user_id") % 4).alias("ip")).agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def upserted(stream: DataFrame, target: str, key: str, order: str, checkpoint: str):
    """M01 by micro-batch over whole versions: each batch is reduced to its last row a key and merged into a new one.

    Versions are numbered by batch, so a batch that runs again after a failure
    writes the same version again.  A version that is gone is an error.
    ``stored`` rewrites only what a batch touches.
    """
    from ..operators.reconcile import latest
    from ..sources import tables
    from ..sources.store import Missing

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, key, order)
        old_path = f"{target}/version={n - 1}"
        if n and not tables.exists(spark, old_path):
            raise Missing(f"version {n - 1} under {target} is gone")
        old = spark.read.parquet(old_path) if n else spark.createDataFrame([], new.schema)
        tables.write_version(tables.merged(old, new, key), target, str(n))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(stream: DataFrame, root: str, table: str, order: str, checkpoint: str, history: str | None = None, name: str = "stream"):
    """Each batch's last row a key goes into a table of a store, all its rows into a history, by one commit.

    The commit holds the batch's number, so a batch that runs again changes
    nothing, and one that doesn't follow the last is an error.
    """
    from ..operators.reconcile import latest
    from ..sources.store import Missing, Store

    def merge(batch: DataFrame, n: int) -> None:
        store = Store.open(batch.sparkSession, root)
        done = store.manifest["streams"].get(name, -1)
        if n <= done:
            return
        if n > done + 1:
            raise Missing(f"batch {n} of {name} would follow {done}: a version under {root} is gone")
        batch = batch.persist()
        try:
            changes = [store.upsert(table, latest(batch, store.manifest["tables"][table]["key"], order).select(store.schema(table).names))]
            if history:
                changes.append(store.append(history, batch.select(store.schema(history).names)))
            store.commit(changes, {"batch": n}, (name, n))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
