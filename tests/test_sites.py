import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from shearwater.functions import html as H
from shearwater.operators import extract, sites

LIST = "<nav><ul><li><a href='/a?x=1'>A</a></li><li><a href='b'>B</a></li></ul></nav>"
DETAIL = "<dl><dt>特色</dt><dd>白</dd><dt>色</dt><dt>x</dt><dd>黒</dd></dl><table><tr><th>性別</th><td></td></tr><tr><th>動物の性別</th><th>y</th><td>オス</td></tr></table><h1 id='t'>名</h1>"
ROWS = sites.Rows("li", {"name": {"selector": "a"}, "href": {"selector": "a", "attr": "href"}}, post=("absolute_links",))
ONE = sites.Detail({"name": {"selector": "h1"}, "color": {"label": ("色",)}, "sex": {"label": ("性別", "雌雄")}, "mark": {"selector": "h1", "attr": "id"}}, post=("species_from_url",))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://a.jp/x/#f", LIST), (2, "https://b.jp/dog/1", DETAIL), (3, "https://b.jp/2", "<p>none</p>"), (4, "https://c.jp/3", DETAIL), (5, None, LIST), (6, "https://a.jp/y", None), (7, "https://a.jp/z", "<p>no list</p>"), (8, "https://d.jp/", LIST), (9, "https://e.jp/", LIST), (10, "https://f.jp/", "")]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, share string")


@pytest.fixture(scope="module")
def tables(spark):
    hosts = spark.createDataFrame([("a.jp", "list"), ("b.jp", "one"), ("d.jp", "broken"), ("e.jp", "hookless"), ("f.jp", "one"), ("a.jp", "zz"), ("g.jp", "nothing")], "host string, name string")
    extra = spark.createDataFrame([("broken", "rows", '{"rows": ""}'), ("hookless", "rows", sites.Rows("li", {"name": "a"}, post=("nobody",)).text())], "name string, kind string, spec string")
    return hosts, sites.registry(spark, {"list": ROWS, "one": ONE}).unionByName(extra)


def test_records_by_host(pages, tables):
    out = sites.extracted(pages, *tables, ["name", "href", "color", "sex", "species", "mark"])
    assert out.columns == ["page_id", "host", "kind", "pos", "key", "name", "href", "color", "sex", "species", "mark", "error"]
    got = {(r.page_id, r.pos): r for r in out.collect()}
    assert [(k, got[k].name, got[k].href, got[k].key) for k in ((1, 0), (1, 1))] == [((1, 0), "A", "https://a.jp/a?x=1", "https://a.jp/x/#row=0"), ((1, 1), "B", "https://a.jp/x/b", "https://a.jp/x/#row=1")]
    one = got[2, 0]
    # the equal label before the one that holds it; the next definition among the siblings; an empty value is passed over
    assert (one.name, one.color, one.sex, one.species, one.mark, one.key, one.error) == ("名", "黒", "オス", "犬", "t", "https://b.jp/dog/1", None)
    errors = {k[0]: r.error for k, r in got.items() if r.error}
    assert errors[3] == "no field was found" and errors[4] == errors[5] == "no strategy for this host" and errors[6] == "no page" and errors[10] == "no field was found"
    assert errors[8].startswith("invalid strategy") and errors[9] == "no hook is called nobody"
    assert len(got) == 2 + 1 + 7  # page 7 is an empty list: no row


def test_sql_with_own_hook(spark, pages, tables):
    sites.register(spark, {"loud": lambda record, url, root: {k: v.upper() for k, v in record.items()}, "fails": lambda *_: 1 / 0})
    pages.where("page_id = 1").createOrReplaceTempView("site_pages")
    ask = "select r.* from site_pages p, lateral site_records('rows', '{}', p.url, p.html, 'name') r order by pos"
    assert [tuple(r)[2:] for r in spark.sql(ask.format(sites.Rows("li", {"name": "a"}, post=("loud",)).text())).collect()] == [("A", None), ("B", None)]
    failed = spark.sql(ask.format(sites.Rows("li", {"name": "a"}, post=("fails",)).text())).collect()
    assert [r.error for r in failed] == ["ZeroDivisionError: division by zero"]
    with pytest.raises(AnalysisException, match="constant list"):
        spark.sql("select r.* from site_pages p, lateral site_records('rows', '{}', p.url, p.html, p.url) r")
    with pytest.raises(AnalysisException, match="no column"):
        spark.sql("select * from site_check(table(site_pages) partition by page_id)")


def test_no_shuffle_of_pages(pages, tables):
    plan = sites.extracted(pages, *tables, ["name"])._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDTF" in plan and plan.count("BroadcastHashJoin") >= 1


def test_check_of_hosts(pages, tables, monkeypatch):
    want = {"a.jp": ("rows", 3, 2, 1, "fetch_error"), "b.jp": ("detail", 2, 1, 1, "detail_error"), "c.jp": (None, 1, 0, 1, "no_adapter"), None: (None, 1, 0, 1, "no_adapter"), "d.jp": ("rows", 1, 0, 1, "init_error"), "e.jp": ("rows", 1, 0, 1, "init_error"), "f.jp": ("detail", 1, 0, 1, "detail_error")}
    for size in (5000, 1):  # one task a host, and hosts spread over several
        monkeypatch.setattr(sites, "PAGES_A_TASK", size)
        got = {r.host: (r.kind, r.pages, r.records, r.errors, r.status) for r in sites.checked(pages, *tables).collect()}
        assert {k: (v[0], v[1], v[2], v[3], v[4]) for k, v in got.items()} == {**want, "b.jp": ("detail", 2, 1, 1, "detail_error")}


def test_strategies_name_themselves():
    with pytest.raises(TypeError):
        type("Nameless", (sites.Strategy,), {"records": lambda *a: [], "text": lambda s: ""})
    with pytest.raises(ValueError, match="twice"):
        type("Again", (sites.Strategy,), {"kind": "rows", "records": lambda *a: [], "text": lambda s: ""})
    assert sites.Strategy.kinds["rows"] is sites.Rows
    for bad in (lambda: sites.Rows("", {"a": "b"}), lambda: sites.Rows("li", {}), lambda: sites.Detail({}), lambda: sites.Detail({"a": {"attr": "x"}}), lambda: sites.Detail({"a": {"selector": "a:hover"}})):
        with pytest.raises(ValueError):
            bad()
    assert sites.Strategy.from_text("detail", ONE.text()).records(H.parse(DETAIL), "") == ONE.records(H.parse(DETAIL), "")


def test_empty_table(pages, tables):
    assert sites.extracted(pages.where("false"), *tables, ["name"]).count() == 0
    assert sites.checked(pages.where("false"), *tables).count() == 0
    assert sites.extracted(pages, tables[0].where("false"), tables[1], ["name"]).where(F.col("error").isNull()).count() == 0


def test_references_that_are_decoded(spark):
    shape, html = "page_id long, url string, html string", "<title>a&amp;b &quot;c&quot; &amp;lt; d&am</title><body>&lt;e&gt; &copy; f&amp</body>"
    page = spark.createDataFrame([(1, "u", html)], shape)
    texts = lambda *names: tuple(extract.texts(page, None, names or None).select("title", "text").first())
    assert texts("amp") == ("a&b &quot;c&quot; &lt; d&am", "a&b &quot;c&quot; &lt; d&am &lt;e&gt; &copy; f&amp")
    assert texts("amp", "lt", "gt", "quot")[1] == 'a&b "c" &lt; d&am <e> &copy; f&amp'
    assert texts() == ('a&b "c" &lt; d&am', 'a&b "c" &lt; d&am <e> © f&')
    assert H.parse("a&amp;b&lt;", ()).text() == "a&amp;b&lt;"
    one = spark.createDataFrame([(1, "https://a.jp/1", "<h1>a&amp;b&quot;&amp</h1>")], shape)
    names = [
        sites.extracted(one, spark.createDataFrame([("a.jp", "x")], "host string, name string"), sites.registry(spark, {"x": sites.Detail({"name": {"selector": "h1"}}, references=known)}), ["name"]).first().name
        for known in (("amp",), None)
    ]
    assert names == ["a&b&quot;&amp", 'a&b"&']
