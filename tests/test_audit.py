import pytest
from pyspark.sql import functions as F

from shearwater.functions import text, web
from shearwater.operators import extract, reconcile


def page(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


CASES = [
    (page("<p>現在、収容している犬はいません。</p>"), "true_zero"),
    (page("<p>検索 10件の結果</p>"), "maybe_zero"),
    (page("<p>該当するデータはありません</p>" + '<img alt="保護犬" src="a">' * 3), "suspicious"),
    (page("<p>該当するデータはありません</p>" + '<img alt="保護犬" src="a">' * 2), "true_zero"),
    (page('<a href="/list/detail/1">x</a>' * 5), "suspicious"),
    (page('<a href="/other/detail/1">x</a>' * 9), "maybe_zero"),
    (page('<a href="http://else.example/list/detail/1">x</a>' * 9), "maybe_zero"),
    (page('<div class="side-menu"><a href="/list/detail/1">x</a></div>' * 9), "maybe_zero"),
    (page("<table>" + "<tr><td>1</td></tr>" * 8 + "</table>"), "suspicious"),
    (page("<table>" + "<tr><td>1</td></tr>" * 7 + "<tr><td>お知らせ</td></tr></table>"), "maybe_zero"),
    (page('<a href="a.pdf">x</a><a href="b.pdf">y</a>'), "suspicious"),
    (page('<nav><p>見つかりませんでした</p></nav>'), "true_zero"),
    (None, "unreachable"), ("", "unreachable"),
]


def test_zero_audit(spark):
    rows = spark.createDataFrame([(i, "http://a.example/list/index.html", h) for i, (h, _) in enumerate(CASES)], "page_id long, url string, html string")
    got = {r.page_id: r.zero_class for r in extract.signals(rows).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


@pytest.mark.parametrize("raw, want", [
    ("04–7190–1234", "04-7190-1234"), ("088−826−2364", "088-826-2364"), ("088—826—2364", "088-826-2364"), ("088-826-2364／夜間", "088-826-2364"),
    ("0888262364", "088-826-2364"), ("88-8262-3641", "888-262-3641"), ("(088)826-2364内線123", "088-826-2364"), ("０３１２３４５６７８", "03-1234-5678"), ("", ""), (None, ""),
])
def test_phone_forms(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "p string").select(web.phone(F.col("p")).alias("p")).first().p == want


@pytest.mark.parametrize("raw, kept", [
    ("tel 088-826-2364 ok", "tel {} ok"), ("09012345678", "{}"), ("0888262364", "{}"), ("(03)1234-5678", "{}"), ("090 1234 5678", "{}"), ("+81 90 1234 5678", "{}"),
    ("２０２６－００１", "２０２６－００１"), ("2026.5.12", "2026.5.12"), ("5.5kg", "5.5kg"),
])
def test_masked_phones(spark, raw, kept):
    assert spark.createDataFrame([(raw,)], "p string").select(text.redact(F.col("p")).alias("p")).first().p == kept.format(text.MASK)


def test_prefix_attribution_keeps_repeated_rows_and_maps(spark):
    rows = spark.createDataFrame([(1, "http://a/x/1", {"k": 1}), (1, "http://a/x/1", {"k": 1}), (2, "http://b/q", {})], "id long, url string, m map<string,int>")
    lists = spark.createDataFrame([("http://a/", 2), ("http://a/x", 1), ("http://c/", 0)], "list_url string, o int")
    got = reconcile.prefix_attribution(rows, lists, "url", "list_url", "o").collect()
    assert [(r.id, r.list_url, r.m) for r in got] == [(1, "http://a/x", {"k": 1})] * 2
