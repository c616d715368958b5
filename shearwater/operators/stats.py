"""Aggregates of dashboards and alerts: one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_filled(df: DataFrame, column: str, known: tuple[str, ...]) -> DataFrame:
    """Counts of a column with zero rows for known values; unknown values are kept."""
    names = df.sparkSession.createDataFrame([(k,) for k in known], f"{column} string")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return names.join(counts, column, "full_outer").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def missing_ratio(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(field, ratio) in long form from one aggregate; an empty table gives 0."""
    total = F.count("*")
    ratios = [F.coalesce(F.round(F.try_divide(F.count_if(t), total), 4), F.lit(0.0)).alias(k) for k, t in tests.items()]
    row = df.agg(*ratios)
    return row.select(F.inline(F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).alias("ratio")) for k in tests))))


def percentiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact p50, p95, p99 with linear interpolation, and the mean."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    rows = df.groupBy(*by).agg(p.alias("p"), F.avg(value).alias("mean"))
    return rows.select(*by, *(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))), F.round("mean", 6).alias("mean"))


def error_level(rate: Column, p95: Column) -> Column:
    """A26."""
    return F.when(rate >= 0.2, "critical").when((rate >= 0.05) | (p95 > 5), "warning").otherwise("ok")


def run_level(total: Column, failed: Column, signals: Column) -> Column:
    """Null where there is nothing to say."""
    return F.when((failed == total) | (failed / total > 0.2), "CRITICAL").when((signals > 0) | (failed > 0), "WARNING")


def quantile_bin(value: Column, sorted_values: Column, bins: int) -> Column:
    """Number of thresholds (element floor(n * i / bins) of the sorted non-zero values) that the value reaches; 0 for zero."""
    n = F.size(sorted_values)
    at = [F.get(sorted_values, F.floor(n * F.lit(i) / F.lit(bins)).cast("int")) for i in range(1, bins)]
    return F.when(value <= 0, 0).otherwise(sum((F.when(value >= t, 1).otherwise(0) for t in at), F.lit(1)))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement (all, if there are fewer) by the order of a digest of key and seed: the same at any partitioning."""
    order = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed))))
    return rows.orderBy(order, key).limit(n)
