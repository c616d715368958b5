"""Answers kept for a while by key, with an entity tag of their body: 304 for who holds it already.

The stream keeps (tag, saved) of each key in state and drops it by a timer when
its time is over; the batch form reads the same requests in the order of key
and time, and holds no more than one key's state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ready

#: Seconds an answer is kept.
TTL = 300
ANSWER = "key string, at timestamp, id long, status int, etag string, cached boolean"


def etag(body: str | None) -> str:
    return f'"{hashlib.md5((body or "").encode(), usedforsecurity=False).hexdigest()}"'


def answer(kept: tuple[str, int] | None, at: int, body: str | None, held: str | None, ttl: int) -> tuple[tuple[str, int], int, bool]:
    """(what is kept now, status, whether it was kept before) of a request at microsecond ``at``.

    A kept answer stands for ``ttl`` seconds whatever the body is meanwhile;
    then the body of the next request is kept.  304 if the client holds the
    tag of the answer.
    """
    cached = kept is not None and at < kept[1] + ttl * 1_000_000
    now = kept if cached else (etag(body), at)
    return now, 304 if held is not None and held == now[0] else 200, cached


class Answers(StatefulProcessor):
    """Answers requests of a key in the order of time inside each batch; late ones are the watermark's."""

    def __init__(self, ttl: int = TTL):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "etag string, saved long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        kept = self.kept.get() if self.kept.exists() else None
        kept = first = tuple(kept) if kept else None
        out = []
        for at, number, body, held in zip(every["at"], every["id"], every["body"], every["held"]):
            kept, status, cached = answer(kept, at.value // 1000, body, held if isinstance(held, str) else None, self.ttl)
            out.append((key[0], at, number, status, kept[0], cached))
        if kept != first:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer(kept[1] // 1000 + self.ttl * 1000)
            self.kept.update(kept)
        yield pd.DataFrame(out, columns=["key", "at", "id", "status", "etag", "cached"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield from ()

    def close(self) -> None:
        pass


def answered_stream(requests: DataFrame, ttl: int = TTL, late: str = "10 minutes") -> DataFrame:
    """Answers to a stream of (key, at, id, body, held); needs the RocksDB state store.

    A batch's requests of one key are sorted in one task: bound batches by the
    source (``maxFilesPerTrigger``).
    """
    ready(requests.sparkSession)
    keyed = requests.select("key", "at", "id", "body", "held").withWatermark("at", late).groupBy("key")
    return keyed.transformWithStateInPandas(Answers(ttl), ANSWER, "append", "eventTime")


def answered(requests: DataFrame, ttl: int = TTL) -> DataFrame:
    """The same answers to a table of requests; a request without a time or key isn't answered.

    Rows stream through in the order of key and time, so a frequent key costs
    time but no memory.
    """
    ready(requests.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys, held = batch.column("key").to_pylist(), batch.column("held").to_pylist()
            times = batch.column("at").cast(pa.timestamp("us", batch.schema.field("at").type.tz)).cast(pa.int64()).to_pylist()
            status, tags, cached = [], [], []
            for key, at, body, mine in zip(keys, times, batch.column("body").to_pylist(), held):
                kept = kept if key == last else None
                kept, s, c = answer(kept, at, body, mine, ttl)
                last = key
                status.append(s)
                tags.append(kept[0])
                cached.append(c)
            made = [batch.column("key"), batch.column("at"), batch.column("id"), pa.array(status, pa.int32()), pa.array(tags, pa.string()), pa.array(cached, pa.bool_())]
            yield pa.RecordBatch.from_arrays(made, ["key", "at", "id", "status", "etag", "cached"])

    rows = requests.where("key is not null and at is not null").select("key", "at", "id", "body", "held")
    return rows.repartition("key").sortWithinPartitions("key", "at", "id").mapInArrow(run, ANSWER)
