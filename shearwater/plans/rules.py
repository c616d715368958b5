"""Queries over the rules of single sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from .bridge import AS_OF, records, table
from .registry import query
from .scalars import W


def today():
    return F.lit(AS_OF).cast("date")


_T = "case id % 9 when 0 then '' when 1 then concat(id % 12 + 1, '歳') when 2 then concat('生年月日：', 2015 + id % 9, '/3/5') when 3 then '誕生日：3/20' when 4 then '誕生日：1/10' when 5 then concat(id % 4 + 1, '〜', id % 4 + 5, '歳') when 6 then '成犬です' when 7 then '年齢わかりません' else '仔猫' end"


@query(f"""{W} select id, case id % 9 when 0 then '3歳' when 1 then concat(id % 12 + 1, '歳') when 2 then concat((2026 - (2015 + id % 9)) - 1, '歳') when 3 then '10ヶ月' when 4 then '0ヶ月' when 5 then concat((2 * (id % 4) + 6) // 2, '歳') when 6 then '3歳' when 7 then '3歳' else '3ヶ月' end as age from records where not (id % 9 = 2 and 2015 + id % 9 > 2024)""")
def legacy_age_rules(spark, sf_dir):
    """X26 P18."""
    r = records(spark, sf_dir).select("id", F.expr(_T.replace("concat(id % 12 + 1, '歳')", "concat(cast(id % 12 + 1 as string), '歳')")).alias("t"))
    return rules.with_legacy_age(r, "t", "age", today()).select("id", "age")


@query(f"""{W} select id, case id % 4 when 0 then case when id % 12 + 1 > 1 then concat('2025-', lpad(cast(id % 12 + 1 as varchar), 2, '0'), '-10') else '2026-01-10' end
when 1 then case when id % 12 + 1 > 1 then concat('2025-', lpad(cast(id % 12 + 1 as varchar), 2, '0'), '-10') else '2026-01-10' end when 2 then case when id % 12 + 1 > 1 then concat('2025-', lpad(cast(id % 12 + 1 as varchar), 2, '0'), '-10') else '令和8年1月10日' end else 'no date' end as day from records""")
def future_date_fix(spark, sf_dir):
    """X27."""
    m = (F.col("id") % 12 + 1).cast("string")
    t = (
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("R8 "), m, F.lit("/10 夕方"))).when(F.col("id") % 4 == 1, F.concat(m, F.lit("/10　午後")))
        .when(F.col("id") % 4 == 2, F.concat(F.lit("令和8年"), m, F.lit("月10日"))).otherwise("no date")
    )
    return records(spark, sf_dir).select("id", rules.not_ahead(t, today()).alias("day"))


@query(f"""{W} select id, case id % 3 when 0 then '令和7年3月4日' when 1 then '2025/3/4' else '高知市のみ' end as day, case id % 3 when 0 then '高知市' when 1 then '香美市' else '' end as place,
case when id % 2 = 0 then '柴犬' else '雑種' end as kind, case when id % 2 = 0 then '♂' end as mark, case when id % 12 + 1 > 6 or (id % 12 + 1 = 6 and 20 > 15) then make_date(2024, cast(id % 12 + 1 as int), 20) else make_date(2025, cast(id % 12 + 1 as int), 20) end as completed,
case id % 4 when 0 then 'sex' when 1 then 'age' when 2 then 'color' else 'breed' end as role, case when id % 2 = 0 then '2020年3月1日' else '2020年3月5日' end as born from records""")
def site_rules_cells(spark, sf_dir):
    """P06 P07 P10 P13 P17."""
    k = F.col("id")
    cell = F.when(k % 3 == 0, "令和7年3月4日　高知市").when(k % 3 == 1, "2025/3/4 香美市").otherwise("高知市のみ")
    kind = F.when(k % 2 == 0, "柴犬 ♂ (済)").otherwise("雑種")
    token = F.when(k % 4 == 0, "オス").when(k % 4 == 1, "3歳").when(k % 4 == 2, "茶白").otherwise("雑種")
    born = F.when(k % 2 == 0, "2020年3月").otherwise("2020年3月5日")
    day, place = rules.date_and_place(cell)
    name, mark = rules.kind_and_sex(kind)
    return records(spark, sf_dir).select(
        "id", day.alias("day"), place.alias("place"), name.alias("kind"), mark.alias("mark"), rules.completed_year((k % 12 + 1).cast("int"), F.lit(20), F.lit("2025-06-15").cast("date")).alias("completed"),
        rules.token_role(token).alias("role"), rules.birth_month(born).alias("born"),
    )


@query("""with c as (select p_partkey, unnest([['種類', p_type], ['大きさ', cast(p_size as varchar)], ['備考', p_brand]]) as kv from part) select p_partkey, max(case when kv[1] = '種類' then kv[2] end) as species, max(case when kv[1] = '大きさ' then kv[2] end) as size from c group by 1""")
def site_rules_columns(spark, sf_dir):
    """Header labels choose the fields; blank rows go."""
    p = table(spark, sf_dir, "part").withColumn("cells", F.array("p_type", F.col("p_size").cast("string"), "p_brand"))
    p = p.where(F.exists("cells", lambda c: F.trim(c) != "")).select("p_partkey", F.posexplode("cells").alias("i", "value"))
    heads = F.array(F.lit("種類"), F.lit("大きさ"), F.lit("備考"))
    field = F.when(F.get(heads, F.col("i")).contains("種類"), "species").when(F.get(heads, F.col("i")).contains("大きさ"), "size")
    return p.withColumn("field", field).groupBy("p_partkey").pivot("field", ["species", "size"]).agg(F.max("value"))


@query("""select l_orderkey, l_linenumber, p_brand as photo from lineitem left join (select p_partkey, p_brand from part where p_partkey % 3 = 0) on l_partkey = p_partkey""")
def photo_join(spark, sf_dir):
    """A photo table joined to records by number; records without a photo stay."""
    photos = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select("p_partkey", F.col("p_brand").alias("photo"))
    line = table(spark, sf_dir, "lineitem")
    return line.join(photos, line.l_partkey == photos.p_partkey, "left").select("l_orderkey", "l_linenumber", "photo")


@query("""with b as (select s_suppkey, s_nationkey, case when contains(s_name, '1') then '088-1' when contains(s_name, '2') then '088-2' else '088-0' end as phone from supplier), r as (select *, row_number() over (partition by s_nationkey order by s_suppkey) as pos from b) select s_suppkey, phone, pos from r""")
def facility_phones(spark, sf_dir):
    """The first keyword in order decides; sources of a place in order."""
    phone = rules.first_keyword(F.col("s_name"), {"1": "088-1", "2": "088-2"}, "088-0")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", phone.alias("phone"))
    return s.withColumn("pos", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))).select("s_suppkey", "phone", "pos")


@query(f"""{W} select id, case when contains(source_url, '/dog/') then '犬' when contains(source_url, '/neko/') then '猫' else '' end as by_path, shelter_date <> '' and (species <> '' or sex <> '') as valid,
translate(phone, '０１２３４５６７８９－', '0123456789-') as folded from records""")
def source_variants(spark, sf_dir):
    """Species by path, validity of parsed rows, full-width folding."""
    from ..functions import text, web

    return records(spark, sf_dir).select(
        "id", web.url_species(F.col("source_url")).alias("by_path"), rules.complete_row(F.col("shelter_date"), F.col("species"), F.col("sex")).alias("valid"),
        F.translate(text.fold_digits(F.col("phone")), "－", "-").alias("folded"),
    )


@query("""select s_suppkey, case s_suppkey % 3 when 0 then '犬' when 1 then '猫' else '' end as species, s_name as place, case when s_suppkey % 2 = 0 then cast(s_nationkey as varchar) end as color, 'メス。' as sex, 'A' || s_suppkey as number, case when s_suppkey % 2 = 0 then '保護犬 ' || s_name else s_name || 'é' end as title from supplier""")
def site_texts(spark, sf_dir):
    """Species by site name, fields said in free text, numbers of headings, texts decoded again."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    site = F.concat(name, F.when(k % 3 == 0, "（迷子犬）").when(k % 3 == 1, "（迷子猫）").otherwise(""))
    said = F.concat(F.lit("収容場所： "), name, F.lit("\n毛色など:"), F.when(k % 2 == 0, F.col("s_nationkey").cast("string")).otherwise(""), F.lit("\n元気です。性別：メス。収容場所：別"))
    head = F.concat(F.when(k % 2 == 0, "識別番号／ A").otherwise("番号: A"), k.cast("string"))
    title = F.when(k % 2 == 0, F.decode(F.encode(F.concat(F.lit("保護犬 "), name), "UTF-8"), "ISO-8859-1")).otherwise(F.concat(name, F.lit("é")))
    fields = rules.said_fields(said, {"場所": "place", "毛色": "color", "性別": "sex"})
    return table(spark, sf_dir, "supplier").select(
        k, rules.species_by_name(site).alias("species"), *(c.alias(f) for f, c in fields.items()),
        rules.serial_number(head).alias("number"), rules.decoded_again(title).alias("title"),
    )


@query("select o_orderkey, make_date(2024, cast(1 + o_orderkey % 12 as int), cast(1 + o_orderkey % 28 as int)) as day from orders")
def source_dates(spark, sf_dir):
    """Dates as single sources write them, through the general rule."""
    from ..functions import dates

    m, d = (1 + F.col("o_orderkey") % 12).cast("string"), (1 + F.col("o_orderkey") % 28).cast("string")
    t = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("令和6年"), m, F.lit("月"), d, F.lit("日頃"))).otherwise(F.concat(F.lit("R6."), m, F.lit("."), d))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", dates.folded(t).alias("t"))
    return rows.select("o_orderkey", dates.shelter_date(F.col("t"), today(), ready=True).alias("day"))


_FORMS = """with d as (select o_orderkey as k, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d from {orders})
select k, y, m, d, case k % 5 when 0 then 'any' when 1 then 'era_text' when 2 then 'labelled' when 3 then 'past_day' else 'full' end as form,
case k % 5 when 0 then case when k % 2 = 0 then concat('令和', y - 1990, '年 ', m, '月', d, '日 収容') else concat('収容 ', y, '/', m, '/', d) end when 1 then concat('収容日　令和 ', y - 1990, ' 年', m, '月 ', d, '日（金）')
when 2 then concat('備考 2020年1月1日【収容日】', y, '年', m, '月', d, '日') when 3 then concat(m, '月', d, '日に保護') else concat(case when k % 2 = 0 then concat(y, '年') else '' end, m, '月', d, '日') end as said from d"""


@query(f"""with f as ({_FORMS.replace('{orders}', 'orders')}), p as (select *, try_cast(concat('2026-', lpad(cast(m as varchar), 2, '0'), '-', lpad(cast(d as varchar), 2, '0')) as date) as this, try_cast(concat('2025-', lpad(cast(m as varchar), 2, '0'), '-', lpad(cast(d as varchar), 2, '0')) as date) as last from f)
select k, coalesce(case form when 'any' then concat(case when k % 2 = 0 then y + 28 else y end, '-', lpad(cast(m as varchar), 2, '0'), '-', lpad(cast(d as varchar), 2, '0')) when 'era_text' then concat('令和', y - 1990, '年', m, '月', d, '日')
when 'labelled' then concat(y, '-', lpad(cast(m as varchar), 2, '0'), '-', lpad(cast(d as varchar), 2, '0')) when 'past_day' then strftime(case when this > date '2026-01-15' then last else this end, '%Y-%m-%d') else case when k % 2 = 0 then concat(y, '-', lpad(cast(m as varchar), 2, '0'), '-', lpad(cast(d as varchar), 2, '0')) end end, '') as day from p""")
def source_date_forms(spark, sf_dir):
    """Order dates as five kinds of sources write them, each read by its own rule."""
    said = spark.sql(_FORMS, orders=table(spark, sf_dir, "orders"))
    return said.select("k", rules.source_date(F.col("said"), F.col("form"), today()).alias("day"))


@query("select count(*) as archivable, min(cast(o_orderdate as date)) as oldest, count(*) filter (where cast(o_orderdate as date) <= date '1996-01-01') as overdue from orders where o_orderstatus = 'F' and cast(o_orderdate as date) <= date '1998-01-01' - 180")
def archive_report(spark, sf_dir):
    """The daily report of what can be archived."""
    from ..operators import listing
    from .relational import _settled

    old = listing.archivable(_settled(spark, sf_dir), "1998-01-01")
    day = F.col("shelter_date")
    return old.agg(F.count("*").alias("archivable"), F.min(day).alias("oldest"), F.count_if(day <= F.lit("1996-01-01").cast("date")).alias("overdue"))


@query("with s as (select s_suppkey, s_name, case when s_suppkey % 6 = 0 then 0 when s_suppkey % 4 = 0 then 1 else 2 end as severity from supplier) select s_suppkey, s_name, severity, row_number() over (order by severity, s_name, s_suppkey) as place from s order by severity, s_name, s_suppkey")
def sites_by_health(spark, sf_dir):
    """By severity, then name in the site's collation."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k, "s_name", F.when(k % 6 == 0, 0).when(k % 4 == 0, 1).otherwise(2).alias("severity"))
    name = F.collate("s_name", "ja")
    own = s.withColumn("at", F.row_number().over(Window.partitionBy("severity").orderBy(name, "s_suppkey")))
    before = s.groupBy("severity").agg(F.count("*").alias("n")).withColumn("ahead", F.sum("n").over(Window.orderBy("severity")) - F.col("n"))  # three rows
    return own.join(F.broadcast(before.select("severity", "ahead")), "severity").select("s_suppkey", "s_name", "severity", (F.col("at") + F.col("ahead")).alias("place"))
