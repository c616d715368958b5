import duckdb
import pytest
from pyspark.sql import functions as F

from shearwater.functions import dates, rules, sql, text, web
from shearwater.operators import details, extract, feeds, listing, reconcile, stats
from shearwater.plans import relational

SF = "/root/testdata/sf0.001"


# ---- rules in SQL -----------------------------------------------------------------------------


def test_sql_functions_equal_the_rules(spark):
    sql.register(spark)
    said = ["柴犬", "CAT", "03-1234-5678", "０９０１２３４５６７８ 内線 3", "a@b.jp '\\\\", "令和7年3月4日", "2歳3ヶ月", "7kg", "", None, "お散歩が好き。0312345678まで"]
    df = spark.createDataFrame([(s, k) for k, s in enumerate(said)], "said string, k int").withColumn("today", F.lit("2026-01-15").cast("date"))
    df.createOrReplaceTempView("said_rows")
    got = spark.sql("select k, normalize_phone(said) p, public_phone(said) q, found_phone(said) f, normalize_species(said) s, normalize_sex(said) x, normalize_size(said) z, normalize_date(said, today) d, redact(said) r, is_missing(said) m, coarse_location(said, 'lost') l, url_host(said) h, url_species(said) u, normalize_age(said, today) a from said_rows")
    c, today = F.col("said"), F.col("today")
    want = dates.with_age(df, "said", "a", today).select("k", web.phone(c).alias("p"), web.public_phone(c).alias("q"), web.found_phone(c).alias("f"), text.species(c).alias("s"), text.sex(c).alias("x"), text.size(c).alias("z"), dates.shelter_date(c, today).alias("d"), text.redact(c).alias("r"), text.missing(c).alias("m"), text.coarse_location(c, F.lit("lost")).alias("l"), web.host(c).alias("h"), web.url_species(c).alias("u"), "a")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    assert got.where("a is not null").count() > 0


def test_sql_functions_are_inlined_and_pushed(spark):
    sql.define(spark, "is_open", "s string", "boolean", lambda s: s == "O")
    spark.read.parquet(f"{SF}/orders.parquet").createOrReplaceTempView("some_orders")
    plan = spark.sql("select o_orderkey from some_orders where is_open(o_orderstatus)")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,O)" in plan and "Python" not in plan and "is_open" not in plan
    with pytest.raises(ValueError):
        sql.define(spark, "x; drop", "s string", "boolean", lambda s: s == "O")


# ---- small rules ------------------------------------------------------------------------------


def test_addresses_of_any_script_are_masked(spark):
    rows = ["連絡先taro@x.jp まで", "太郎@例え.jp", "a.b+c@d-e.f.gh, x", "not@one", "x@y.z"]
    got = [r.r for r in spark.createDataFrame([(x,) for x in rows], "s string").select(text.redact(F.col("s")).alias("r")).collect()]
    assert got == ["███ まで", "███", "███, x", "not@one", "███"]


def test_complete_rows(spark):
    df = spark.createDataFrame([("2025/1/1", "", "x"), ("2025/1/1", None, " "), (None, "a", "b"), ("　", "a", "b")], "d string, a string, b string")
    assert [r.v for r in df.select(rules.complete_row(F.col("d"), F.col("a"), F.col("b")).alias("v")).collect()] == [True, False, False, False]


def test_feed_requests():
    assert listing.feed_request({"species": "犬", "sex": None, "q": "x"}) == {"species": "犬", "q": "x"}
    for bad in ({"q": "x" * 1001}, {"q": "a<b"}, {"q": "DROP it"}, {"species": "鳥"}, {"status": "gone"}, {"sex": "m"}, {"category": "deceased"}):
        with pytest.raises(ValueError):
            listing.feed_request(bad)
    for n in (0, 101):
        with pytest.raises(ValueError):
            listing.feed_request({}, n)


def page(spark, html):
    return spark.createDataFrame([(1, "https://x.jp/a", html)], "page_id long, url string, html string")


def test_header_records(spark):
    html = "<table><tr><th>管理番号</th><th>毛色</th><th>その他の色</th></tr><tr><td>1</td><td>白</td><td>黒</td></tr><tr><td>2</td></tr></table><table><tr><td>x</td></tr></table><table></table><table><tr><td>色</td></tr></table>"
    got = details.header_records(page(spark, html), {"number": ("番号",), "color": ("色",), "age": ("年齢",)}).collect()
    assert [tuple(r)[1:] for r in got] == [(0, 1, "1", "白", ""), (0, 2, "2", "", "")]
    assert details.header_records(page(spark, None), {"a": ("b",)}).count() == 0


def test_species_of_blocks(spark):
    html = "<h2>猫たち</h2><div class='s x'><p><i>一匹</i></p></div><table><caption>犬の表</caption><tr><td><i>二</i></td></tr></table><i>三</i><h3>犬</h3><i>猫</i><h2>別</h2><i>四</i><i>子犬</i>"
    got = [tuple(r)[3:] for r in details.placed(page(spark, html), "i", {"s": "その他の鳥"}).orderBy("pos").collect()]
    assert got == [("その他の鳥", "", "猫", "", "その他の鳥"), ("", "犬", "猫", "", "犬"), ("", "", "猫", "", "猫"), ("", "", "犬", "猫", "犬"), ("", "", "", "", "その他"), ("", "", "", "犬", "犬")]


def test_robots_are_read_once_and_record_rows(spark):
    pages = spark.createDataFrame([(k, u, "<ul><li><a href='x'>A</a></li></ul>") for k, u in enumerate(("https://x.jp/a", "https://x.jp/private/b", "no url", None))], "page_id long, url string, html string")
    got = lambda text_: [r.allowed for r in extract.robots(pages, text_).orderBy("page_id").collect()]
    assert got("User-agent: *\nDisallow: /private/") == [True, False, False, False] and got("") == [True, True, False, False] and got("nothing here") == [True, True, False, False]
    spec = extract.Spec("li", {"label": "a", "href": "a"}, attrs={"href": "href"})
    out = extract.record_rows(pages, spec)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and [tuple(r) for r in out.where("page_id = 0").collect()] == [(0, 0, "https://x.jp/a#row=0", "A", "x")]


# ---- joins and candidates ---------------------------------------------------------------------


def prefs_of(spark, rows):
    return spark.createDataFrame(rows, "user_id long, p_species string, prefectures array<string>, age_min int, age_max int, p_size string, p_sex string")


def test_matches_by_class_equal_all_pairs(spark, monkeypatch):
    import random

    rng = random.Random(7)
    pick = lambda *v: rng.choice(v)
    people = [(u, pick(None, "犬", "猫"), pick(None, [], ["東", "西"], ["西", "東", "西"], ["南"]), pick(None, 5), pick(None, 9), pick(None, "大"), pick(None, "f")) for u in range(120)]
    animals = [(i, f"u{i}", pick("犬", "猫", "その他"), pick("東町", "西東町", "北", None), pick(3, 5, 9, 30, None), pick("大", "小", None), pick("f", "m")) for i in range(80)]
    records = spark.createDataFrame(animals, "id long, source_url string, species string, location string, age_months int, size string, sex string")
    prefs = prefs_of(spark, people)

    def fits(p, a):
        _, sp, places, lo, hi, size, sex = p
        _, _, species, where, age, asize, asex = a
        return (sp is None or sp == species) and (not places or where is not None and any(x in where for x in places)) and (lo is None or age is not None and age >= lo) and (hi is None or age is not None and age <= hi) and (size is None or size == asize) and (sex is None or sex == asex)

    want = {(p[0], a[0]) for p in people for a in animals if fits(p, a)}
    for most in (20_000, 3):
        monkeypatch.setattr(reconcile, "CLASSES", most)
        classes, members = reconcile.criteria_classes(prefs)
        m = reconcile.class_matches(records, classes)
        assert {(r.user_id, r.id) for r in m.join(members, "class_id").collect()} == want
        assert members.count() == 120 and classes.count() < 100 and classes.agg(F.sum("users")).first()[0] == 120
    told = {(u, f"u{i}") for u, i in rng.sample(sorted(want), 200)} | {(1, "nobody"), (999, "u1")}
    history = spark.createDataFrame(sorted(told) + sorted(told)[:5], "user_id long, source_url string")
    left = {}
    for u, i in want:
        left[u] = left.get(u, 0) + ((u, f"u{i}") not in told)
    assert {r.user_id: r.n for r in reconcile.unnotified(m, members, history).collect()} == {u: n for u, n in left.items() if n}
    # the same history told to whole groups: user 7 and above 100 are in none
    groups = spark.createDataFrame([(u, u % 5) for u in range(100) if u != 7], "user_id long, group int")
    by_group = [(g, f"u{i}") for g in range(5) for i in range(80) if (g + i) % 3 == 0]
    shared = {}
    for u, i in want:
        shared[u] = shared.get(u, 0) + (u == 7 or u >= 100 or (u % 5 + i) % 3 != 0)
    got = reconcile.unnotified(m, members, spark.createDataFrame(by_group + by_group[:9], "group int, source_url string"), groups=groups)
    assert {r.user_id: r.n for r in got.collect()} == {u: n for u, n in shared.items() if n}
    ok = spark.createDataFrame([(u, u % 3 > 0) for u in range(0, 120, 2)], "user_id long, ok boolean")
    total = reconcile.notified(m, members, history, ok).first()
    sent = sum(n for u, n in left.items() if u % 2 == 0 and u % 3 > 0)
    assert (total.matches, total.skipped, total.sent, total.failed) == (len(want), len(want) - sum(left.values()), sent, sum(left.values()) - sent)
    none = reconcile.criteria_classes(prefs.where("false"))
    empty = reconcile.class_matches(records, none[0])
    assert tuple(reconcile.notified(empty, none[1], history, ok).first()) == (0, 0, 0, 0)


def test_reuse_merge_candidates_and_sources(spark):
    known = spark.createDataFrame([("a", 1), ("b", 2)], "url string, v int")
    listed = spark.createDataFrame([("b",), ("c",), ("b",), ("c",)], "url string")
    again, new = reconcile.reused(listed, known, "url")
    assert [tuple(r) for r in again.collect()] == [("b", 2)] and [tuple(r) for r in new.collect()] == [("c",)]
    both = reconcile.right_wins(known, spark.createDataFrame([("b", None), ("z", 9)], "url string, v int"), "url")
    assert sorted(map(tuple, both.collect()), key=str) == [("a", 1), ("b", None), ("z", 9)]
    parts = [spark.createDataFrame(r, "k string, pos long") for r in ([("x", 2), ("y", 1)], [("y", 0), ("w", 5), ("v", 4), ("u", 6)])]
    tried = spark.createDataFrame([("x",)], "k string")
    got = {r.k: (r.part, r.pos, r.target) for r in reconcile.capped(parts, "k", "pos", 2, tried).collect()}
    assert got == {"y": (0, 1, True), "x": (0, 2, False), "v": (1, 4, True), "w": (1, 5, False), "u": (1, 6, False)}
    assert not any(r.target for r in reconcile.capped(parts, "k", "pos", enabled=False).collect())
    sites = spark.createDataFrame([(3, "p", "n"), (1, "p", "n"), (2, None, "n"), (5, None, "n"), (4, "p", "m")], "id int, place string, name string")
    assert sorted(r.id for r in reconcile.first_of(sites, ["place", "name"], "id").collect()) == [1, 2, 4]


def test_prefixes_keep_repeated_rows_and_any_columns(spark):
    rows = spark.createDataFrame([("https://x.jp/a/1", {"k": 1})] * 2 + [("https://x.jp/b", {"k": 2}), ("https://y.jp/a", None), (None, None)], "url string, m map<string,int>")
    lists = spark.createDataFrame([("https://x.jp/", 2), ("https://x.jp/a/", 1), ("https://x.jp/a", 1), ("https://z.jp/", 0)], "list_url string, o int")
    got = sorted(tuple(r) for r in reconcile.prefix_attribution(rows, lists, "url", "list_url", "o").select("url", "list_url").collect())
    assert got == [("https://x.jp/a/1", "https://x.jp/a")] * 2 + [("https://x.jp/b", "https://x.jp/")]


def test_numbers_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "NUMBERED", 10)
    rows = spark.createDataFrame([(f"k{i}", i if i < 5 else None) for i in range(100)], "k string, id long")
    got = reconcile.numbered(rows.repartition(7), "id", "k").collect()
    again = reconcile.numbered(rows.repartition(2), "id", "k").collect()
    assert sorted(r.id for r in got if int(r.k[1:]) >= 5) == list(range(5, 100)) and {tuple(r) for r in got} == {tuple(r) for r in again}
    assert reconcile.numbered(rows.where("id is not null"), "id", "k").count() == 5 and reconcile.numbered(rows.where("false"), "id", "k").count() == 0


def test_samples_and_payloads(spark):
    df = spark.range(100).withColumn("x", F.lit(1))
    one = {r.id for r in stats.seeded_sample(df.repartition(9), "id", 7, 1).collect()}
    assert one == {r.id for r in stats.seeded_sample(df, "id", 7, 1).collect()} != {r.id for r in stats.seeded_sample(df, "id", 7, 2).collect()} and len(one) == 7
    assert stats.seeded_sample(df, "id", 1000, 1).count() == 100
    r = spark.createDataFrame([(2, "犬", None, "s"), (1, "猫", "f", "s")], "id long, species string, sex string, site string")
    for c, t in (("age_months", "int"), ("color", "string"), ("size", "string"), ("shelter_date", "date"), ("location", "string"), ("phone", "string"), ("image_urls", "array<string>"), ("source_url", "string"), ("category", "string")):
        r = r.withColumn(c, F.lit(None).cast(t))
    row = feeds.payload(r.withColumn("shelter_date", F.lit("2026-01-02").cast("date")), ["site"], "c", "t").first()
    import json

    body = json.loads(row.payload)
    assert row.animals == 2 and [a["species"] for a in body["animals"]] == ["猫", "犬"] and body["animals"][0]["shelter_date"] == "2026-01-02" and body["animals"][1]["sex"] is None and body["source"] == "c" and len(body["animals"][0]) == 11


def test_dates_of_sources(spark):
    rows = [("any", "令和 8 年 3月13日", "2026-03-13"), ("any", "2025-1-2", "2025-01-02"), ("any", "3月13日", ""), ("era_text", "x 令和8年　3月 13日（金）", "令和8年3月13日"), ("era_text", "2025年1月2日", ""), ("labelled", "2020年1月1日【収容日】2026年5月12日", "2026-05-12"), ("labelled", "2020年1月1日", ""), ("past_day", "1月15日", "2026-01-15"), ("past_day", "1月16日", "2025-01-16"), ("past_day", "2月30日", ""), ("full", "5月10日", ""), ("full", "2025/5/10", "2025-05-10"), ("other", "2025/5/10", ""), ("any", None, "")]
    df = spark.createDataFrame(rows, "form string, said string, want string").withColumn("got", rules.source_date(F.col("said"), F.col("form"), F.lit("2026-01-15").cast("date")))
    assert [(r.said, r.got) for r in df.collect()] == [(s, w) for _, s, w in rows]


def test_subscriber_match_holds_every_pair(spark):
    found = relational.subscriber_match(spark, SF)
    con = duckdb.connect()
    for t in ("part", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(f"{relational._MATCH} select user_id, id, source_url from m").fetchall()
    users = found.where("user_id is not null").select("class_id", "user_id")
    got = users.join(found.where("id is not null").select("class_id", "id", "source_url"), "class_id").select("user_id", "id", "source_url").collect()
    assert len(want) > 1000 and sorted(map(tuple, got)) == sorted(want)
