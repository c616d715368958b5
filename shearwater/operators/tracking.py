"""Run-over-run state as window folds: streaks, baselines, drift, transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The allowed status changes.
TRANSITIONS = (
    ("sheltered", "adopted"), ("sheltered", "returned"), ("sheltered", "deceased"), ("adopted", "returned"), ("adopted", "deceased"), ("returned", "adopted"), ("returned", "deceased"),
)


def failure_streaks(runs: DataFrame, site: str = "site", order: str = "run", failed: str = "failed") -> DataFrame:
    """``runs`` with the failures in a row up to each run (islands between successes)."""
    w = Window.partitionBy(site).orderBy(order)
    island = runs.withColumn("_i", F.sum(F.when(~F.col(failed), 1).otherwise(0)).over(w))
    inside = Window.partitionBy(site, "_i").orderBy(order)
    return island.withColumn("streak", F.sum(F.col(failed).cast("long")).over(inside)).drop("_i")


def auto_skip(streak, threshold: int, last_failed, as_of, grace_days: int | None):
    """failing often enough, and not outside the grace period."""
    within = F.lit(True) if grace_days is None else last_failed.isNull() | (F.datediff(as_of, last_failed) <= grace_days)
    return (streak >= threshold) & within


def baseline(runs: DataFrame, site: str = "site", order: str = "run", count: str = "n") -> DataFrame:
    """Last non-zero count, high water and zero runs in a row after each run."""
    w = Window.partitionBy(site).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    c = F.col(count)
    rows = runs.withColumn("last_nonzero", F.last(F.when(c > 0, c), ignorenulls=True).over(w)).withColumn("high_water", F.max(c).over(w)).withColumn("_i", F.sum(F.when(c > 0, 1).otherwise(0)).over(w))
    inside = Window.partitionBy(site, "_i").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("zero_runs", F.sum(F.when(c == 0, 1).otherwise(0)).over(inside)).drop("_i")


def final(rows: DataFrame, site: str, order: str, *columns: str) -> DataFrame:
    """The last row of each site, by a partial aggregate."""
    return rows.groupBy(site).agg(F.max_by(F.struct(*columns), order).alias("s")).select(site, "s.*")


def regressions(state: DataFrame, runs: int = 2) -> DataFrame:
    """Had records once, none for some runs."""
    return state.where((F.coalesce("last_nonzero", F.lit(0)) >= 1) & (F.col("zero_runs") >= runs))


def persistent_zeros(state: DataFrame, runs: int = 14) -> DataFrame:
    """W04."""
    return state.where((F.coalesce("last_nonzero", F.lit(0)) == 0) & (F.col("zero_runs") >= runs))


def drift(history: DataFrame, keys: list[str], order: str, rate: str, jump: float = 0.2) -> DataFrame:
    """Rows whose rate rose by ``jump`` or more since the run recorded before."""
    w = Window.partitionBy(*keys).orderBy(order)
    return history.withColumn("previous", F.lag(rate).over(w)).where(F.col(rate) - F.col("previous") >= jump - 1e-12)


def last_n(rows: DataFrame, keys: list[str], order: str, n: int = 10) -> DataFrame:
    """W05, W10."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def transitions(log: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """(key, order, old, new, allowed) for every change in a status log."""
    w = Window.partitionBy(key).orderBy(order)
    edges = F.array(*(F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in TRANSITIONS))
    moved = log.withColumn("old", F.lag(status).over(w)).where(F.col("old").isNotNull() & (F.col("old") != F.col(status)))
    return moved.select(key, order, "old", F.col(status).alias("new"), F.array_contains(edges, F.struct(F.col("old"), F.col(status).alias("new"))).alias("allowed"))
