"""Work of one host in sequence, of different hosts in parallel: hosts are dealt to tasks by weight, longest first."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ready

#: Hosts that are placed one by one; the rest is placed by as many hash groups.
PLACED = 4096


def longest_first(weights: list[tuple[object, int]], tasks: int) -> dict[object, int]:
    """A task for each item: in the order of falling weight, each to the task with least so far."""
    heap = [(0, t) for t in range(tasks)]
    out = {}
    for item, weight in sorted(weights, key=lambda w: (-w[1], str(w[0]))):
        load, task = heapq.heappop(heap)
        out[item] = task
        heapq.heappush(heap, (load + weight, task))
    return out


def planned(rows: DataFrame, host: str, tasks: int, weight: F.Column | None = None) -> DataFrame:
    """``rows`` with the column ``task``; a host is in one task only.

    The PLACED heaviest hosts are placed one by one, all others as PLACED
    groups by a hash, so at most 2 * PLACED items come to the driver whatever
    the number of hosts, and no light group outweighs a heavy host by more than
    its share.  Where no item is larger than the mean of the tasks, the largest
    task is within 4/3 of the mean, or nearly.  Null hosts are a host of their own.
    """
    if tasks < 1:
        raise ValueError("there is at least one task")
    if "task" in rows.columns:
        raise ValueError("the rows have a column task already")
    name = F.coalesce(F.col(host), F.lit(""))
    sums = rows.groupBy(name.alias("h")).agg(F.sum(F.lit(1) if weight is None else weight).cast("long").alias("w"))
    heavy = [(r.h, r.w) for r in sums.orderBy(F.desc("w"), "h").limit(PLACED).collect()]
    spark = rows.sparkSession
    one = F.broadcast(spark.createDataFrame([(h,) for h, _ in heavy], "h string"))  # PLACED rows
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(PLACED)).cast("int")
    light = [(r.g, r.w) for r in sums.join(one, "h", "left_anti").groupBy(group(F.col("h")).alias("g")).agg(F.sum("w").alias("w")).collect()]
    place = longest_first([(("host", h), w) for h, w in heavy] + [(("group", g), w) for g, w in light], tasks)
    hosts = F.broadcast(spark.createDataFrame([(k, t) for (kind, k), t in place.items() if kind == "host"], "__h string, __t int"))
    groups = F.broadcast(spark.createDataFrame([(k, t) for (kind, k), t in place.items() if kind == "group"], "__g int, __u int"))
    dealt = rows.join(hosts, name == F.col("__h"), "left").join(groups, F.col("__h").isNull() & (group(name) == F.col("__g")), "left")
    return dealt.select(*(rows[c] for c in rows.columns), F.coalesce("__t", "__u").alias("task"))


def in_turn(rows: DataFrame, host: str, order: str, tasks: int, weight: F.Column | None = None) -> DataFrame:
    """Rows of ``planned`` in their tasks, each host's together and in order.  (A task's number is its partition's.)"""
    return planned(rows, host, tasks, weight).repartitionById(tasks, F.col("task")).sortWithinPartitions("task", host, order)


def worked(rows: DataFrame, host: str, order: str, tasks: int, work: Callable[[object, Iterator[dict]], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """``work(host, rows)`` for one host after the other in each task; rows stream through, in order.

    ``work`` may stop reading a host early; it never sees two hosts at a time.
    """
    ready(rows.sparkSession)
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in batch.to_pylist())
        ahead = next(stream, None)

        def of(name) -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead[host] == name:
                row, ahead = ahead, next(stream, None)
                yield row

        held = []
        while ahead is not None:
            name = ahead[host]
            mine = of(name)
            for made in work(name, mine):
                held.append(made)
                if len(held) >= 4000:
                    yield pa.RecordBatch.from_pylist(held, shape)
                    held = []
            for _ in mine:  # what work left unread
                pass
        if held:
            yield pa.RecordBatch.from_pylist(held, shape)

    return in_turn(rows, host, order, tasks).mapInArrow(run, kind)
