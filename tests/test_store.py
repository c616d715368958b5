import json
import os

import pytest
from pyspark.sql import functions as F

from shearwater.operators import archive
from shearwater.plans.relational import board
from shearwater.sources.store import Conflict, Missing, Store
from shearwater.streaming import state

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture()
def store(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([(k, f"v{k}", None) for k in range(100)], "id long, v string, path string")
    log = spark.createDataFrame([], "id long, what string")
    return s.commit([s.put("t", df, "id", 8), s.put("log", log, "id", 4)])


def test_changes_rewrite_only_touched_buckets(spark, store):
    one = spark.createDataFrame([(3, "p3")], "id int, path string")  # another type of key lands in the same bucket
    before = store.manifest["tables"]["t"]["files"]
    change = store.update("t", one)
    after = store.commit([change])
    assert change.rewritten == 1 and sum(before[b] != after.manifest["tables"]["t"]["files"][b] for b in before) == 1
    assert rows_of(after.read("t").where("id in (3, 4)")) == [(3, "v3", "p3"), (4, "v4", None)]
    assert rows_of(store.read("t").where("id = 3")) == [(3, "v3", None)]  # who opened the version before keeps it
    gone = after.delete("t", spark.createDataFrame([(3,), (500,)], "id long"))
    assert gone.rewritten <= 2
    after = after.commit([gone, after.append("log", spark.createDataFrame([(3, "deleted"), (3, "again")], "id long, what string"))])
    assert after.read("t").count() == 99 and after.read("log").count() == 2
    assert after.append("log", after.read("log")).rewritten == 0
    new = after.upsert("t", spark.createDataFrame([(4, "new"), (777, "added")], "id long, v string"))
    after = after.commit([new])
    assert new.rewritten <= 2 and rows_of(after.read("t").where("id in (4, 777)")) == [(4, "new", None), (777, "added", None)] and after.read("t").count() == 100
    assert rows_of(after.absent("t", spark.createDataFrame([(3,), (5,)], "id long"))) == [(3,)]


def test_whole_buckets_can_empty(spark, store):
    s = store.commit([store.delete("t", store.read("t").select("id"))])
    assert s.read("t").count() == 0 and s.read("t").columns == ["id", "v", "path"]
    s = s.commit([s.upsert("t", spark.createDataFrame([(1, "x", "y")], "id long, v string, path string"))])
    assert rows_of(s.read("t")) == [(1, "x", "y")]
    nothing = s.delete("t", s.read("t").where("false").select("id"))
    assert nothing.rewritten == 0 and s.commit([nothing]).read("t").count() == 1


def test_bad_changes(spark, store):
    with pytest.raises(Exception, match="id is null"):
        store.upsert("t", spark.createDataFrame([(None, "x")], "id long, v string"))
    with pytest.raises(KeyError):
        store.read("nothing")
    with pytest.raises(ValueError):
        c = store.delete("t", store.read("t").limit(1).select("id"))
        store.commit([c, c])


def test_versions_conflicts_and_gaps(spark, store):
    root = store.root
    other = Store.open(spark, root)
    store.commit([store.delete("t", store.read("t").where("id < 50").select("id"))])
    with pytest.raises(Conflict):
        other.commit([other.delete("t", other.read("t").where("id >= 50").select("id"))])
    assert Store.open(spark, root).read("t").count() == 50  # the late writer changed nothing
    with pytest.raises(Conflict):
        Store.create(spark, root)
    assert Store.open(spark, root, 1).read("t").count() == 100
    now = Store.open(spark, root)
    now.vacuum(keep=1)
    assert Store.versions(spark, root) == [2] and Store.open(spark, root).read("t").count() == 50
    with pytest.raises(Missing):
        Store.open(spark, root, 0)
    now = Store.open(spark, root)
    now = now.commit([]).commit([])
    os.remove(f"{root}/versions/{now.version - 1:09d}.json")
    with pytest.raises(Missing, match="are gone"):
        Store.open(spark, root)
    with pytest.raises(Missing):
        Store.open(spark, f"{root}/nowhere")


def test_a_writer_that_dies_leaves_the_version(spark, store, monkeypatch):
    change = store.delete("t", store.read("t").select("id"))
    assert change.rewritten == 8 and Store.open(spark, store.root).read("t").count() == 100
    assert store.vacuum() >= 0 and Store.open(spark, store.root).read("t").count() == 100


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id")
    for k in range(3):
        e.where(f"event_id div 334 = {k}").coalesce(1).write.mode("append").parquet(d)
    return d


def streamed(spark, parts, tmp_path, store):
    return state.stored(state.source(spark, parts).select("user_id", "event_id", "event_type"), store.root, "users", "event_id", str(tmp_path / "c"), "log")


def test_stream_goes_once_into_table_and_history(spark, parts, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"))
    e = spark.read.parquet(parts).select("user_id", "event_id", "event_type")
    s = s.commit([s.put("users", e.limit(0), "user_id", 8), s.put("log", e.limit(0), "user_id", 8)])
    streamed(spark, parts, tmp_path, s).awaitTermination(180)
    s = Store.open(spark, s.root)
    assert s.version == 4 and s.manifest["streams"] == {"stream": 2}
    want = {r.user_id: r.e for r in e.groupBy("user_id").agg(F.max("event_id").alias("e")).collect()}
    # files may come in any order: a user's row is the last of the last batch that has the user
    assert {r.user_id for r in s.read("users").collect()} == set(want) and s.read("users").count() == len(want)
    assert rows_of(s.read("log")) == rows_of(e)
    # all batches again under the same name change nothing
    (tmp_path / "again").mkdir()
    streamed(spark, parts, tmp_path / "again", s).awaitTermination(180)
    assert Store.open(spark, s.root).version == 4


def test_stream_refuses_a_store_that_lost_a_version(spark, parts, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"))
    e = spark.read.parquet(parts).select("user_id", "event_id", "event_type")
    s = s.commit([s.put("users", e.limit(0), "user_id", 4), s.put("log", e.limit(0), "user_id", 4)])
    streamed(spark, parts, tmp_path, s).awaitTermination(180)
    last = f"{s.root}/versions/000000004.json"
    held = json.load(open(last))
    os.remove(last)
    os.remove(f"{s.root}/versions/000000003.json")  # the store now ends before the second batch
    e.where("event_id < 5").coalesce(1).write.mode("append").parquet(parts)
    q = streamed(spark, parts, tmp_path, s)
    with pytest.raises(Exception, match="is gone"):
        q.awaitTermination(180)
    assert held["streams"] == {"stream": 2}


def test_whole_versions_refuse_a_gap(spark, parts, tmp_path):
    import shutil

    stream = state.source(spark, parts).select("user_id", "event_id", "event_type")
    state.upserted(stream, str(tmp_path / "t"), "user_id", "event_id", str(tmp_path / "c")).awaitTermination(180)
    last = max((tmp_path / "t").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    shutil.rmtree(last)
    spark.read.parquet(f"{SF}/events.parquet").limit(5).coalesce(1).write.mode("append").parquet(parts)
    with pytest.raises(Exception, match="is gone"):
        state.upserted(stream, str(tmp_path / "t"), "user_id", "event_id", str(tmp_path / "c")).awaitTermination(180)


# ---- archive -----------------------------------------------------------------------------------


def settled_board(spark):
    return board(spark, SF).withColumn("status_changed_at", F.col("shelter_date").cast("timestamp"))


def wrong():
    return F.when(F.col("id") % 10 == 3, "no location")


def sides(store):
    return {t: {r.id for r in store.read(t).collect()} for t in ("active", "archive", "failures")}


@pytest.mark.parametrize("batch", [100, 100_000])
def test_archive_moves_each_row_once(spark, tmp_path, batch):
    rows = settled_board(spark)
    old = {r.id for r in archive.settled(rows, "1998-01-01").collect()}
    done = archive.run(archive.create(Store.create(spark, str(tmp_path / "a")), rows, buckets=4), "1998-01-01", wrong(), batch)
    assert done.batches == -(-len(old) // batch) and done.processed == len(old) == done.moved + done.failed
    got = sides(done.store)
    assert got["archive"] == {k for k in old if k % 10 != 3} and got["failures"] == {k for k in old if k % 10 == 3}
    assert got["active"] == {r.id for r in rows.collect()} - got["archive"] and done.store.read("archive").count() == done.moved
    # the run again has nothing to do; another run tries the failed rows once more, and no others
    assert archive.run(done.store, "1998-01-01", wrong(), batch).store.version == done.store.version
    next_ = archive.run(done.store, "1998-01-01", wrong(), batch, run_id="next")
    assert (next_.processed, next_.moved, next_.failed) == (done.failed, 0, done.failed)


def test_archive_goes_on_after_a_kill(spark, tmp_path, monkeypatch):
    rows = settled_board(spark)
    store = archive.create(Store.create(spark, str(tmp_path / "a")), rows, buckets=4)
    old = archive.settled(rows, "1998-01-01").count()
    commit, left, batch = Store.commit, [2], old // 4

    def dies(self, *a, **k):
        if not left[0]:
            raise KeyboardInterrupt
        left[0] -= 1
        return commit(self, *a, **k)

    monkeypatch.setattr(Store, "commit", dies)
    with pytest.raises(KeyboardInterrupt):
        archive.run(store, "1998-01-01", wrong(), batch)
    monkeypatch.undo()
    half = Store.open(spark, store.root)
    assert 0 < half.read("archive").count() <= 2 * batch and half.read("archive").join(half.read("active"), "id").count() == 0
    done = archive.run(half, "1998-01-01", wrong(), batch)
    assert done.processed == old and done.store.read("archive").count() == done.moved == old - done.failed
    assert done.store.read("archive").select("id").distinct().count() == done.moved and done.store.read("failures").count() == done.failed


def test_archive_of_many_batches_makes_few_commits(spark, tmp_path):
    rows = settled_board(spark)
    old = {r.id for r in archive.settled(rows, "1998-01-01").collect()}
    store = archive.create(Store.create(spark, str(tmp_path / "a")), rows, buckets=4)
    done = archive.run(store, "1998-01-01", wrong(), 3)
    assert done.batches == -(-len(old) // 3) > 2 * archive.COMMITS and done.store.version - store.version <= archive.COMMITS
    assert (done.processed, sides(done.store)["archive"]) == (len(old), {k for k in old if k % 10 != 3})
