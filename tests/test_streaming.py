import pytest
from pyspark.sql import functions as F

from shearwater.operators import reconcile, tracking
from shearwater.plans.bridge import events
from shearwater.streaming import state

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in three files."""
    d = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id")
    for k in range(3):
        e.where(f"event_id div 334 = {k}").coalesce(1).write.mode("append").parquet(d)
    return d


def drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_streaks_equal_batch(spark, parts):
    got = drain(state.streaks(state.source(spark, parts)), "streaks", "update")
    final = {r.user_id: r.streak for r in got.groupBy("user_id").agg(F.max_by("streak", "runs").alias("streak")).collect()}
    runs = events(spark, SF).select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
    batch = tracking.failure_streaks(runs, "user_id", "event_id").groupBy("user_id").agg(F.max_by("streak", "event_id").alias("s"))
    assert final == {r.user_id: r.s for r in batch.collect()}


def test_upserts_equal_batch(spark, parts, tmp_path):
    stream = state.source(spark, parts).select("user_id", "event_id", "event_type")
    q = state.upserted(stream, str(tmp_path / "t"), "user_id", "event_id", str(tmp_path / "c"))
    q.awaitTermination(120)
    last = max((tmp_path / "t").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    want = reconcile.latest(spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "event_type"), "user_id", "event_id")
    assert sorted(map(tuple, spark.read.parquet(str(last)).select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_windows_and_duplicates(spark, parts):
    n = drain(state.windows(state.source(spark, parts)), "w", "complete").agg(F.sum("n")).first()[0]
    assert n == 1000
    assert drain(state.deduplicated(state.source(spark, parts)), "d", "append").count() == 1000
    assert drain(state.sessions(state.source(spark, parts)), "s", "complete").agg(F.sum("n")).first()[0] == 1000
