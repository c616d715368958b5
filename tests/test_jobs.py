import hashlib
import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shearwater.operators import attempts, hosts
from shearwater.sources import database, documents, files
from shearwater.streaming import cache

# ---- answers kept for a while -----------------------------------------------------------------


def brute_answers(rows, ttl):
    out, kept = {}, {}
    for key, at, i, body, held in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], r[2])):
        tag, saved = kept.get(key, (None, None))
        fresh = saved is not None and (at - saved).total_seconds() < ttl
        if not fresh:
            tag, saved = f'"{hashlib.md5((body or "").encode()).hexdigest()}"', at
        kept[key] = (tag, saved)
        out[i] = (304 if held == tag else 200, tag, fresh)
    return out


@pytest.fixture(scope="module")
def requests():
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    tags = [f'"{hashlib.md5(f"b{k}".encode()).hexdigest()}"' for k in range(3)]
    rows = [(rng.choice(["x", "y", "z"]), start + timedelta(seconds=rng.randrange(4000)), i, f"b{rng.randrange(3)}", rng.choice([None, *tags])) for i in range(400)]
    return rows + [("x", start, 400, None, None), ("x", start, 401, "b0", None)]


REQUEST = "key string, at timestamp, id long, body string, held string"


def test_answers_match_brute_force(spark, requests):
    odd = [(None, requests[0][1], 900, "b", None), ("x", None, 901, "b", None)]
    df = spark.createDataFrame(requests + odd, REQUEST).withColumn("status", F.lit("other column"))
    got = {r.id: (r.status, r.etag, r.cached) for r in cache.answered(df.repartition(5)).collect()}
    assert got == brute_answers(requests, 300)
    assert {v[0] for v in got.values()} == {200, 304} and cache.answered(df.where("false")).count() == 0
    # exactly at the end of its time an answer is no longer kept
    start = requests[0][1]
    edge = spark.createDataFrame([("k", start + timedelta(seconds=s), i, f"b{i}", None) for i, s in enumerate((0, 299, 300))], REQUEST)
    assert [r.cached for r in cache.answered(edge).orderBy("id").collect()] == [False, True, False]


def test_stream_answers_as_the_batch(spark, requests, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        ordered = sorted(requests, key=lambda r: (r[1], r[2]))
        for k in range(4):
            part = ordered[k * 101 : (k + 1) * 101]
            spark.createDataFrame(part, REQUEST).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if k < 3:
                import time

                time.sleep(1.1)  # files are taken in the order of their time
        stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = cache.answered_stream(stream, 300, "1 second").writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        got = {r.id: (r.status, r.etag, r.cached) for r in spark.table("answers").collect()}
        want = brute_answers(requests, 300)
        assert got == {i: want[i] for i in got} and len(got) > 390  # a request at a batch's very edge may be late
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


# ---- databases --------------------------------------------------------------------------------

DERBY = "org.apache.derby.jdbc.EmbeddedDriver"
TYPES = "k bigint, s varchar(20), d date, x double"


@pytest.fixture(scope="module")
def url(spark):
    where = f"jdbc:derby:memory:t{random.randrange(10**9)};create=true"
    df = spark.range(1000).selectExpr("id as k", "if(id % 3 = 0, 'a', 'b') as s", "if(id < 0, null, date_add(date '2020-01-01', cast(id as int))) as d", "if(id % 7 = 0, null, id / 2) as x")
    database.append(df, where, "items", TYPES)
    return where


def test_scan_in_ranges_with_pushed_query(spark, url):
    df = database.scan(spark, url, "items", "k", 8)
    assert df.rdd.getNumPartitions() == 8
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(counts) == 8 and max(counts) <= 130 and sum(counts) == 1000
    some = df.where("s = 'a' and x > 100").select("k")
    plan = database.pushed(some)
    assert "PushedFilters: [" in plan and "EqualTo(s,a)" in plan.replace("*", "") or "S = 'a'" in plan
    assert "ReadSchema: struct<k:bigint>" in plan and "d#" not in plan.split("Scan")[1]
    assert sorted(r.k for r in some.collect()) == [k for k in range(1000) if k % 3 == 0 and k % 7 and k / 2 > 100]
    assert database.scan(spark, url, "items", "d", 4).count() == 1000 and database.scan(spark, url, "items").rdd.getNumPartitions() == 1
    hot = database.scan_by(spark, url, "items", ['"k" < 10', '"k" >= 10'])
    assert hot.rdd.getNumPartitions() == 2 and hot.count() == 1000
    with pytest.raises(ValueError):
        database.scan(spark, url, "items; drop table items")


def test_merge_is_once_a_batch(spark, url):
    new = spark.createDataFrame([(5, "new", None, 1.0), (5000, "added", None, None)], "k long, s string, d date, x double")
    assert database.merged(new, url, "items", "k", "job", 1, TYPES) == 2
    assert database.merged(new.withColumn("s", F.lit("late")), url, "items", "k", "job", 1, TYPES) == 0
    rows = {r.k: r for r in database.scan(spark, url, "items", "k").where("k in (5, 6, 5000)").collect()}
    assert rows[5].s == "new" and rows[5].d is None and rows[5000].s == "added" and rows[6].s == "a" and len(rows) == 3
    with database.Database(spark, url) as db:
        assert db.one("select count(*) from sys.systables where tablename like 'STAGE%'") == 0  # stages are gone


def test_failed_merge_changes_nothing(spark, url):
    two = spark.createDataFrame([(6, "x"), (7, "y" * 50)], "k long, s string")
    with pytest.raises(Exception):
        database.merged(two, url, "items", "k", "job", 2, "k bigint, s varchar(100)")  # too long for the table
    assert {r.s for r in database.scan(spark, url, "items", "k").where("k in (6, 7)").collect()} == {"a", "b"}
    with database.Database(spark, url) as db:
        assert db.one(f"select batch from {database.LOG} where stream = 'job' and batch = 2") is None


def test_stream_into_a_database(spark, url, tmp_path):
    database.append(spark.createDataFrame([], "k long, s string"), url, "sunk", "k bigint not null, s varchar(20)")
    for part in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        spark.createDataFrame(part, "k long, s string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for where in ("c1", "c2"):  # the second run repeats all batches
        stream = spark.readStream.schema("k long, s string").parquet(str(tmp_path / "in"))
        database.merged_stream(stream, url, "sunk", "k", "s", str(tmp_path / where), types="k bigint, s varchar(20)").awaitTermination(180)
    assert sorted(map(tuple, database.scan(spark, url, "sunk").collect())) == [(1, "a"), (2, "c"), (3, "d")]


# ---- attempts ---------------------------------------------------------------------------------

SQUARE = T.StructType([T.StructField("n", T.LongType())])


def work(row, attempt):
    if row["k"] % 5 == 0:
        raise attempts.ParsingError("five")
    if row["k"] % 7 == 0 and attempt <= row["k"] // 7:
        raise attempts.NetworkError("seven")
    if row["k"] % 11 == 0:
        raise KeyError("other")
    return {"n": row["k"] ** 2}


def test_attempts_match_brute_force(spark):
    rows = [(k, "x") for k in range(1, 60)] + [(3, "again")]
    tried = attempts.attempted(spark.createDataFrame(rows, "k long, key string").repartition(3), work, SQUARE)
    got = sorted((r.k, r.ok, r.kind, r.attempt, r.wait, r.result and r.result.n) for r in tried.collect())

    def brute(k):
        for attempt in (1, 2, 3):
            try:
                return (k, True, None, attempt, None, work({"k": k}, attempt)["n"])
            except attempts.NetworkError:
                last = (k, False, "retryable", attempt, 2**attempt, None)
            except Exception:
                return (k, False, "final", attempt, None, None)
        return last

    assert sorted(got, key=str) == sorted((brute(k) for k, _ in rows), key=str)
    dead = attempts.dead_letters(tried)
    assert dead.columns == ["k", "key", "kind", "error", "attempt"] and dead.where("k = 11").first().error == "KeyError: 'other'"
    n = {(r.outcome, r.attempt): r.n for r in attempts.summary(tried).collect()}
    assert n["ok", 2] == 1 and n["ok", 3] == 1 and n["given up", 3] == sum(k % 7 == 0 and k >= 21 and k % 5 != 0 for k in range(60))


def test_attempts_at_the_edges(spark):
    assert attempts.attempted(spark.createDataFrame([], "k long"), work, SQUARE).count() == 0
    one = attempts.attempted(spark.createDataFrame([(7,)], "k long"), work, SQUARE, attempts=1).first()
    assert (one.ok, one.kind, one.attempt) == (False, "retryable", 1)
    with pytest.raises(ValueError):
        attempts.attempted(spark.createDataFrame([(7, 1)], "k long, attempt int"), work, SQUARE)
    with pytest.raises(ValueError):
        attempts.attempted(spark.createDataFrame([(7,)], "k long"), work, SQUARE, attempts=0)


# ---- turns of hosts ---------------------------------------------------------------------------


def turns(host, rows):
    for k, row in enumerate(rows):
        if k == 3 and host == "h1":
            return  # the rest of a host may stay unread
        yield {"host": host, "k": row["k"], "turn": k, "task": row["task"]}


def sample_hosts(spark, heavy):
    rng = random.Random(5)
    names = [f"h{int(rng.paretovariate(1.1))}" for _ in range(3000)] + ["hot"] * heavy + [None] * 5
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "host string, k long").repartition(6)


@pytest.mark.parametrize("placed", [4096, 5])
def test_hosts_keep_together_in_order_and_even(spark, monkeypatch, placed):
    monkeypatch.setattr(hosts, "PLACED", placed)
    df = sample_hosts(spark, 0)
    out = hosts.worked(df, "host", "k", 6, turns, "host string, k long, turn long, task int").toPandas()
    whole = df.toPandas()
    for name, part in out.groupby("host", dropna=False):
        assert part.task.nunique() == 1
        keys = sorted(whole[whole.host.isna() if name is None or name != name else whole.host == name].k)
        assert part.sort_values("turn").k.tolist() == (keys[:3] if name == "h1" else keys)
    load = hosts.planned(df, "host", 6).groupBy("task").count().toPandas()["count"]
    most = max(len(whole) / 6 * 4 / 3, whole.host.value_counts().max())
    assert load.sum() == len(whole) and (placed < 100 or load.max() <= most)
    placed_by = hosts.in_turn(df, "host", "k", 6).withColumn("p", F.spark_partition_id())
    assert placed_by.where("p <> task").count() == 0


def test_longest_first_and_bad_calls(spark):
    weights = [(f"h{k}", w) for k, w in enumerate([7, 7, 6, 6, 5, 5, 4, 4, 4])]
    task = hosts.longest_first(weights, 3)
    load = [sum(w for h, w in weights if task[h] == t) for t in range(3)]
    assert max(load) <= 4 / 3 * 16 and sum(load) == 48
    assert hosts.planned(spark.createDataFrame([], "host string, k long"), "host", 3).count() == 0
    with pytest.raises(ValueError):
        hosts.planned(sample_hosts(spark, 0), "host", 0)
    with pytest.raises(ValueError):
        hosts.planned(sample_hosts(spark, 0).withColumn("task", F.lit(1)), "host", 2)


# ---- documents --------------------------------------------------------------------------------


def test_documents_by_group_with_manifest(spark, tmp_path):
    rows = [(f"a/{k % 3}.txt", f"<{k % 3}>", f"[{k}]", "</>", k) for k in range(50)] + [("empty.txt", "head", None, "foot", 0)]
    df = spark.createDataFrame(rows, documents.SCHEMA).withColumn("other", F.lit(1)).repartition(7)
    got = {r.name: (r["items"], r.bytes) for r in documents.write(df, str(tmp_path)).collect()}
    for k in range(3):
        want = f"<{k}>" + "".join(f"[{i}]" for i in range(50) if i % 3 == k) + "</>"
        assert (tmp_path / f"a/{k}.txt").read_text() == want and got[f"a/{k}.txt"] == (len([i for i in range(50) if i % 3 == k]), len(want))
    assert (tmp_path / "empty.txt").read_text() == "headfoot" and got["empty.txt"] == (0, 8) and len(got) == 4
    assert [p for p in os.listdir(tmp_path) if p.startswith(".")] == []
    again = documents.write(df.where("position < 3"), str(tmp_path))
    assert {r.name for r in again.collect()} == {"a/0.txt", "a/1.txt", "a/2.txt", "empty.txt"} and (tmp_path / "a/0.txt").read_text() == "<0>[0]</>"


def test_aborted_write_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k}.txt", "h", "b", "f", 0) for k in range(20)], documents.SCHEMA)
    bad = rows.withColumn("name", F.when(F.col("name") == "7.txt", "../out.txt").otherwise(F.col("name")))
    for df in (bad, rows.withColumn("body", F.when(F.col("name") == "7.txt", F.raise_error(F.lit("broken"))).otherwise(F.col("body")))):
        with pytest.raises(Exception):
            documents.write(df, str(tmp_path))
        left = [f for d, _, names in os.walk(tmp_path) for f in names]
        assert left == [] and not (tmp_path.parent / "out.txt").exists()
    assert documents.write(rows.where("false"), str(tmp_path)).count() == 0


def test_rss_and_markdown_escape(spark, tmp_path):
    import xml.etree.ElementTree as ET

    items = spark.createDataFrame([(1, "a <b> & \"c\"", "https://x/?a=1&b=2", "g", "2026", "\x01d]]>", "s"), (2, None, None, None, None, None, "s")], "id long, title string, link string, guid string, pub_date string, description string, site string")
    df = documents.rss(items, F.concat("site", F.lit(".xml")), F.lit("t & t"), F.lit("https://x"), "id")
    documents.write(df, str(tmp_path))
    channel = ET.parse(tmp_path / "s.xml").getroot()[0]
    assert [i.findtext("title") or "" for i in channel.iter("item")] == ["a <b> & \"c\"", ""] and channel.findtext("title") == "t & t" and channel.find("item").findtext("link") == "https://x/?a=1&b=2"
    cards = documents.markdown(items, F.lit("r.md"), F.lit("all"), F.col("title"), {"link": F.col("link"), "none": F.lit(None)}, "id")
    documents.write(cards, str(tmp_path))
    assert (tmp_path / "r.md").read_text() == '# all\n\n## a \\<b\\> & "c"\n\n- link: https://x/?a=1&b=2\n\n## \n\n'
    assert [json.loads(x)["name"] for x in open(tmp_path / "manifest.jsonl")] == ["r.md"]


# ---- files ------------------------------------------------------------------------------------


def test_file_actions_can_be_repeated(spark, tmp_path):
    root, old = str(tmp_path / "root"), f"file://{tmp_path}/old"
    rows = [(f"x/{k}.png", b"\x89PNG\r\n\x1a\n" + b"." * k) for k in range(10)] + [("x/t.txt", b"text"), ("x/none", None), ("../up.png", b"\xff\xd8\xff"), ("/abs.png", b"GIF89a")]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    status = lambda out: {r.path: r.status for r in out.collect()}
    first, second = status(files.put(df, root)), status(files.put(df, root))
    assert {first[f"x/{k}.png"] for k in range(10)} == {"stored"} and {second[f"x/{k}.png"] for k in range(10)} == {"present"}
    assert first["x/t.txt"] == first["x/none"] == "rejected" and first["../up.png"] == first["/abs.png"] == "failed"
    assert status(files.put(df.where("path = 'x/t.txt'"), root, allowed=None)) == {"x/t.txt": "stored"}
    use = files.usage(spark.createDataFrame([("x",), ("y",)], "prefix string"), root)
    assert {r.prefix: (r["files"], r.bytes) for r in use.collect()} == {"x": (11, sum(8 + k for k in range(10)) + 4), "y": (0, 0)}
    some = df.where("path in ('x/1.png', 'x/2.png', 'x/none')")
    assert status(files.move(some, root, old)) == {"x/1.png": "moved", "x/2.png": "moved", "x/none": "missing"}
    assert status(files.move(some, root, old)) == {"x/1.png": "there", "x/2.png": "there", "x/none": "missing"}
    assert status(files.exists(some, old)) == {"x/1.png": "present", "x/2.png": "present", "x/none": "missing"}
    assert status(files.delete(df.where("path = 'x/3.png'"), root)) == {"x/3.png": "deleted"} and status(files.delete(df.where("path = 'x/3.png'"), root)) == {"x/3.png": "missing"}
    assert sorted(os.listdir(tmp_path / "old/x")) == ["1.png", "2.png"] and not (tmp_path / "up.png").exists()
    assert files.put(df.where("false"), root).count() == 0


def test_content_types():
    assert [files.content_type(b) for b in (b"\xff\xd8\xff\xe0", b"RIFF\0\0\0\0WEBPVP8", b"GIF87a", b"<html>", b"", None)] == ["image/jpeg", "image/webp", "image/gif", None, None, None]
