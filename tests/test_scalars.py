import datetime as dt

import pytest
from pyspark.sql import functions as F

from shearwater.functions import dates, html, rules, text, web

TODAY = "2026-01-15"


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def check(spark, fn, cases):
    assert apply(spark, fn, [k for k, _ in cases]) == [v for _, v in cases]


def test_age(spark):
    cases = [("1歳", 12), ("2歳6ヶ月", 30), ("11才", 132), ("13才くらい", 156), ("2才半", 24), ("推定12週齢", 3), ("幼齢", 3), ("高齢", 120), ("1年", 12), ("不明", None), ("", None), ("82歳", None), ("31歳", None), ("1歳 (2025/4/1 収容)", 12), ("２歳", 24), (None, None), ("2025/2/30", None), ("2024-01-16", 23)]
    df = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(cases)], "i int, v string")
    got = dates.with_age(df, "v", "o", F.to_date(F.lit(TODAY))).orderBy("i").collect()
    assert [r.o for r in got] == [v for _, v in cases]


def test_dates(spark):
    d = dt.date
    cases = [("令和7年12月31日", d(2025, 12, 31)), ("2025/12/31", d(2025, 12, 31)), ("2026-01-05", d(2026, 1, 5)), ("2025年12月31日", d(2025, 12, 31)), ("R6 9/27", d(2024, 9, 27)), ("R6　9/27　午後3時頃", d(2024, 9, 27)), ("R0.1.1", None), ("invalid date", None), ("12/1", d(2025, 12, 1)), ("12月1日", d(2025, 12, 1)), ("2/1", d(2026, 2, 1)), (None, None), ("2026-02-30", None)]
    check(spark, lambda c: dates.shelter_date(c, F.to_date(F.lit(TODAY))), cases)


def test_phones(spark):
    cases = [("0312345678", "03-1234-5678"), ("0442002000", "044-200-2000"), ("04-7190-1234", "04-7190-1234"), ("(088)123-4567", "088-123-4567"), ("０９０－１２３４－５６７８", "090-1234-5678"), ("12345678", ""), (None, ""), ("03-1234-5678 内線 12", "03-1234-5678")]
    check(spark, web.phone, cases)
    check(spark, lambda c: web.public_phone(web.phone(c)), [("09012345678", None), ("0881234567", "088-123-4567"), ("", None)])
    check(spark, web.found_phone, [("call 09012345678 now", "090-1234-5678"), ("tel 0881234567", "088-123-4567"), ("x 03 1234 5678", "03-1234-5678"), ("none", "")])


def test_size_and_location(spark):
    check(spark, text.size, [("小", "小型"), ("中型\t\t（推定11kg）", "中型"), ("7.5kg", None), ("Sサイズ", "Sサイズ"), ("大きめ(3kg（x）)", "大型"), ("", None), (None, None)])
    check(spark, lambda c: text.coarse_location(c, F.lit("lost")), [("大村市東大村２丁目付近", "大村市東大村"), ("吾妻町牧場の里付近", "吾妻町牧場の里"), ("付近", "付近"), ("高知市", "高知市")])
    check(spark, lambda c: text.coarse_location(c, F.lit("adoption")), [("大村市東大村２丁目付近", "大村市東大村２丁目付近")])


def test_redaction(spark):
    m = text.MASK
    cases = [("090-1234-5678", m), ("０９０－１２３４－５６７８", m), ("tel 09012345678!", f"tel {m}!"), ("(03)1234-5678", m), ("090 1234 5678", m), ("+81 90 1234 5678", m), ("a.b@example.co.jp です", f"{m} です"), ("2026-001", "2026-001"), ("2026.5.12", "2026.5.12"), ("5.5kg", "5.5kg"), (None, None)]
    check(spark, text.redact, cases)


def test_species_and_sex(spark):
    check(spark, text.species, [("柴犬", "犬"), ("Dog and cat", "犬"), ("三毛ねこ", "猫"), ("うさぎ", "その他"), ("", "その他")])
    check(spark, text.sex, [("female", "女の子"), ("Male", "男の子"), ("♀", "女の子"), ("牡", "男の子"), ("", "不明")])


def test_images(spark):
    fn = lambda c: F.array_join(web.images(F.split(c, " ")), " ")
    check(spark, fn, [("http://a/x.jpg http://a/x.jpg data:1 http://a/logo.png", "http://a/x.jpg"), ("http://a/common/x.png http://a/y.pdf", "http://a/common/x.png"), ("ftp://x", "")])


def test_hosts(spark):
    check(spark, web.host, [("https://WWW.kochi-apc.com:80/a#pdf=a b", "www.kochi-apc.com"), ("nothing", None)])
    check(spark, web.prefecture, [("https://pref.kagawa.lg.jp/x?y=ehime", "香川県"), ("https://x.jp/ehime", None)])
    check(spark, lambda c: web.license_of(c, ("deny.lg.jp",)), [("a.lg.jp", "gov_standard"), ("deny.lg.jp", "unknown"), ("x.com", "unknown")])


def test_missing_and_human_age(spark):
    check(spark, text.missing, [(" 不明 ", True), ("－", True), ("x", False), (None, True)])
    check(spark, lambda c: text.human_age(c.cast("int")), [("5", "5ヶ月"), ("24", "約2歳"), ("30", "約2歳6ヶ月")])
    assert text.kana_variants("チワわ") == ["チワわ", "ちわわ", "チワワ"]


def test_html_parsing():
    root = html.parse("<title>A &amp; B</title><script>x()</script><nav><a href='/a'>1</a><a href='/a'>2</a></nav><table><tr><th>犬種<td>柴<tr><th>性別 (推定)<td>オス</table><p>one<p>two")
    assert html.links(root, "https://h/x/y") == [(0, "https://h/a", "1")]
    assert html.labelled(html.pairs(root), "性別") == "オス" and html.labelled(html.pairs(root), "犬種") == "柴" and html.labelled(html.pairs(root), "無") == ""
    assert "x()" not in html.main_text(root) and "two" in html.main_text(root)
    assert html.plain("a &lt; b") == "a < b" and html.plain("<b>x</b> y") == "x y"
    with pytest.raises(ValueError):
        html.select(root, "a > b:first-child")
    html.parse("<div>" * 5000 + "deep").text()


def test_site_texts(spark):
    df = spark.createDataFrame([("道南 函館市", "識別番号／A1:2", "種類：雑種\n種類：柴\n備考: \n性別など：オス"), ("x", "無し", "長い長い長いラベル名：x。種類:\n備考:110"), (None, None, None)], "place string, head string, said string")
    said = rules.said_fields(F.col("said"), {"種類": "breed", "性別": "sex", "備考": "note"})
    got = df.select(rules.first_keyword(F.col("place"), {"函館市": "1", "道南": "2"}).alias("phone"), rules.serial_number(F.col("head")).alias("n"), *(c.alias(f) for f, c in said.items())).collect()
    assert [tuple(r) for r in got] == [("1", "A1:2", "雑種", "オス", None), ("", "", None, None, "110"), ("", "", None, None, None)]
    broken = "迷子の動物".encode().decode("latin-1")
    again = spark.createDataFrame([(broken,), ("犬" + broken,), ("café",), ("",), (None,)], "t string").select(rules.decoded_again(F.col("t")).alias("t"))
    assert [r.t for r in again.collect()] == ["迷子の動物", "犬" + broken, "café", "", None]
