"""Deterministic projections of the fixture tables into listing records.

The same SQL text runs in Spark and in DuckDB; operators never share logic
with their oracles beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Today" of every query over the bridge, and of every query over events.
AS_OF, EVENTS_AS_OF = "2026-01-15", "2024-02-01"

RECORDS = """
select
  p_partkey as id,
  case p_partkey % 5 when 0 then '柴犬' when 1 then '三毛ねこ' when 2 then 'Dog MIX' when 3 then 'うさぎ' else 'CAT' end as species,
  case p_partkey % 6 when 0 then 'オス' when 1 then 'メス' when 2 then 'male' when 3 then 'Female' when 4 then '♂' else '' end as sex,
  case p_size % 11
    when 0 then concat(cast(p_size as varchar(9)), '歳') when 1 then concat(cast(p_size % 9 as varchar(9)), '歳', cast(p_size % 12 as varchar(9)), 'ヶ月')
    when 2 then concat(cast(p_size as varchar(9)), 'か月') when 3 then concat(cast(p_size as varchar(9)), '週齢') when 4 then '幼齢' when 5 then ''
    when 6 then '２才くらい' when 7 then concat('20', cast(10 + p_size % 15 as varchar(9)), '/', cast(1 + p_size % 12 as varchar(9)), '/15生') when 8 then '高齢'
    when 9 then concat('令和', cast(1 + p_size % 6 as varchar(9)), '年', cast(1 + p_size % 12 as varchar(9)), '月') else concat('推定', cast(p_size as varchar(9)), '年') end as age,
  case p_partkey % 4 when 0 then '茶色' when 1 then ' 白黒 ' when 2 then concat('黒 090-1234-', cast(1000 + p_partkey % 9000 as varchar(9))) else '' end as color,
  case p_partkey % 9 when 0 then '小' when 1 then '中型（推定11kg）' when 2 then '大きめ' when 3 then '7.5kg' when 4 then 'Sサイズ' when 5 then '' when 6 then '超小型(2kg（子）)' when 7 then '体重：不明' else '大' end as size,
  case p_partkey % 8
    when 0 then concat('令和7年', cast(1 + p_partkey % 12 as varchar(9)), '月', cast(1 + p_partkey % 31 as varchar(9)), '日')
    when 1 then concat('2025/', cast(1 + p_partkey % 12 as varchar(9)), '/', cast(1 + p_partkey % 31 as varchar(9)))
    when 2 then concat('2025-', case when p_partkey % 12 < 9 then '0' else '' end, cast(1 + p_partkey % 12 as varchar(9)), '-', cast(10 + p_partkey % 19 as varchar(9)))
    when 3 then concat('2025年', cast(1 + p_partkey % 12 as varchar(9)), '月', cast(1 + p_partkey % 28 as varchar(9)), '日')
    when 4 then concat('R6 ', cast(1 + p_partkey % 12 as varchar(9)), '/', cast(1 + p_partkey % 28 as varchar(9)))
    when 5 then concat(cast(1 + p_partkey % 12 as varchar(9)), '/', cast(1 + p_partkey % 28 as varchar(9)))
    when 6 then concat(cast(1 + p_partkey % 12 as varchar(9)), '月', cast(1 + p_partkey % 28 as varchar(9)), '日')
    else 'invalid date' end as shelter_date,
  concat(case p_partkey % 3 when 0 then '大村市東大村２丁目付近' when 1 then '吾妻町牧場の里付近' else '高知市中央センター' end, '') as location,
  case p_partkey % 7
    when 0 then concat('03', cast(10000000 + p_partkey as varchar(12))) when 1 then concat('(088)', '123-', cast(1000 + p_partkey % 9000 as varchar(9)))
    when 2 then concat('０９０－１２３４－', cast(1000 + p_partkey % 9000 as varchar(9))) when 3 then concat('044', cast(2000000 + p_partkey % 99999 as varchar(12)))
    when 4 then '12345678' when 5 then '04-7190-1234 内線 12' else '' end as phone,
  concat(
    'https://h', cast(p_partkey % 10 as varchar(9)), '.example.jp/uploads/', cast(p_partkey as varchar(12)), '.jpg ',
    case p_partkey % 5 when 0 then 'https://x.example.jp/common/logo.png' when 1 then 'data:image/png;base64,AA' when 2 then 'https://x.example.jp/files/a.pdf'
      when 3 then concat('https://h', cast(p_partkey % 10 as varchar(9)), '.example.jp/uploads/', cast(p_partkey as varchar(12)), '.jpg') else 'http://x.example.jp/i/icon_b.PNG?x=1' end) as imgs,
  case p_partkey % 3 when 0 then 'adoption' when 1 then 'lost' else 'sheltered' end as category,
  case p_partkey % 6 when 0 then '雑種' when 1 then 'チワワ' when 2 then 'ちわわ' when 3 then '柴犬よりやや大きめ' when 4 then '' else 'トイプードル' end as breed,
  case p_partkey % 4 when 0 then concat('ポチ', cast(p_partkey as varchar(12))) when 1 then 'タマ※譲渡手続き中' when 2 then '' else p_name end as name,
  case p_partkey % 5 when 0 then 'tel (03)1234-5678 です' when 1 then 'mail to a.b@example.com &amp; more' when 2 then '<b>太字</b> 2026-001' when 3 then '+81 90 1234 5678' else '元気' end as description,
  concat('2026-', cast(p_partkey as varchar(12))) as management_number,
  concat('https://', case p_partkey % 6 when 0 then 'WWW.kochi-apc.com' when 1 then 'douai-tokushima.com' when 2 then 'pref.kagawa.lg.jp:8080' when 3 then 'city.ehime.jp' else concat('site', cast(p_partkey % 25 as varchar(9)), '.example.jp') end,
    case p_partkey % 4 when 0 then '/dog/' when 1 then '/neko/' else '/a/' end, cast(p_partkey as varchar(12))) as source_url,
  concat('site', cast(p_partkey % 25 as varchar(9))) as source_site,
  case p_partkey % 10 when 0 then 'adopted' when 1 then 'returned' when 2 then 'deceased' when 3 then null else 'sheltered' end as status,
  p_retailprice as price
from {part}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listing records, one for each row of ``part``."""
    return spark.sql(RECORDS, part=table(spark, sf_dir, "part"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a zoned timestamp (UTC) and their day."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.to_date("ts"))


#: For oracles: the records as a CTE over DuckDB's view of ``part``.
RECORDS_CTE = f"records as ({RECORDS.replace('{part}', 'part')})"
