"""Work that may fail row by row: failures are values, some are tried again, the rest are dead letters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut, ready


class NetworkError(Exception):
    """Worth another attempt."""


class ParsingError(Exception):
    """The page isn't what it should be; another attempt gives the same."""


#: What ``attempted`` puts beside a row.
OUTCOME = "ok boolean, kind string, error string, attempt int, wait int"


def once(rows: DataFrame, work: Callable[[dict, int], dict | None], result: T.StructType, attempt: int, retry: tuple[type[Exception], ...] = (NetworkError,)) -> DataFrame:
    """One attempt at every row: the columns of OUTCOME and ``result`` (a struct, null where it failed) come beside it.

    ``wait`` is the number of seconds until the next attempt, 2 to the power of
    this one; null where there is nothing to wait for.
    """
    outcome = T._parse_datatype_string(OUTCOME)
    kind = to_arrow_type(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                try:
                    done.append((True, None, None, attempt, None, work(row, attempt)))
                except Exception as e:  # one row's failure is its own, never its batch's or task's
                    again = isinstance(e, retry)
                    done.append((False, "retryable" if again else "final", f"{type(e).__name__}: {e}", attempt, 2**attempt if again else None, None))
            cols = list(zip(*done)) or [()] * 6
            types = [pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.int32(), kind]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(cols, types))], [*batch.schema.names, *outcome.names, "result"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *outcome.fields, T.StructField("result", result)]))


def attempted(rows: DataFrame, work: Callable[[dict, int], dict | None], result: T.StructType, attempts: int = 3, retry: tuple[type[Exception], ...] = (NetworkError,)) -> DataFrame:
    """Every row once, with its last outcome; ``work(row, attempt)`` gives a result or raises.

    Rows that fail with an error of ``retry`` are tried again, ``attempts``
    times at most; other errors (a page that can't be parsed) are final at
    once.  Each round is stored, and only what is to be tried again is read by
    the next: a lost executor repeats its own rows of one round.  Names of the
    outcome mustn't be among the columns.
    """
    if attempts < 1:
        raise ValueError("there is at least one attempt")
    taken = {*T._parse_datatype_string(OUTCOME).names, "result"} & set(rows.columns)
    if taken:
        raise ValueError(f"the rows have columns {', '.join(sorted(taken))} already")
    ready(rows.sparkSession)
    done, todo = [], rows
    for attempt in range(1, attempts + 1):
        tried = cut(once(todo, work, result, attempt, retry))
        again = tried.where("kind = 'retryable'")
        if attempt == attempts or again.isEmpty():
            done.append(tried)
            break
        done.append(tried.where("kind is null or kind <> 'retryable'"))
        todo = again.select(rows.columns)
    return reduce(DataFrame.unionByName, done)


def dead_letters(tried: DataFrame) -> DataFrame:
    """Rows that never came through, with how often they were tried and why they failed."""
    return tried.where("not ok").drop("result", "ok", "wait")


def summary(tried: DataFrame) -> DataFrame:
    """(outcome, attempt, n): ok, final or given up, by the attempt that decided."""
    outcome = F.when(F.col("ok"), "ok").when(F.col("kind") == "final", "final").otherwise("given up")
    return tried.groupBy(outcome.alias("outcome"), "attempt").agg(F.count("*").alias("n"))
