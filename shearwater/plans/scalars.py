"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text, web
from ..operators import normalize
from .bridge import AS_OF, RECORDS_CTE, records, table
from .registry import query

W = f"with {RECORDS_CTE}"
_SPECIES = """case when regexp_matches(lower(trim(species)), '犬|いぬ|イヌ|inu|dog') then '犬' when regexp_matches(lower(trim(species)), '猫|ねこ|ネコ|neko|cat') then '猫' else 'その他' end"""
_SEX = """case when regexp_matches(lower(sex), '女の子|オンナノコ|メス|めす|雌|牝|♀|female') then '女の子' when regexp_matches(lower(sex), '男の子|オトコノコ|オス|おす|雄|牡|♂|male') then '男の子' else '不明' end"""
_HOST = "lower(regexp_extract(source_url, '^https?://([^/:#?]+)', 1))"
_PREF = f"case when contains({_HOST}, 'kochi-apc.com') then '高知県' when contains({_HOST}, 'douai-tokushima.com') then '徳島県' when contains({_HOST}, 'kagawa') then '香川県' when contains({_HOST}, 'ehime') then '愛媛県' end"


@query(f"{W} select coalesce({_PREF}, '(未分類)') as prefecture, {_SPECIES} as species, {_SEX} as sex, count(*) as n from records where coalesce(status, 'sheltered') = 'sheltered' group by 1, 2, 3")
def stats_by_prefecture(spark, sf_dir):
    """Sheltered records by prefecture."""
    r = normalize.normalized(records(spark, sf_dir), AS_OF).where("status = 'sheltered'")
    return r.groupBy(F.coalesce("prefecture", F.lit("(未分類)")).alias("prefecture"), "species", "sex").agg(F.count("*").alias("n"))


@query(f"{W} select id, {_SPECIES} as species, {_SEX} as sex, true as valid from records")
def normalize_species_sex(spark, sf_dir):
    """N01 N02 N21."""
    r = normalize.rejects(normalize.normalized(records(spark, sf_dir), AS_OF))
    return r.select("id", "species", "sex", F.col("reject_reason").isNull().alias("valid"))


_MB = lambda d: f"case when {d} <= date '{AS_OF}' then greatest(0, (2026 - year({d})) * 12 + 1 - month({d}) - case when 15 < day({d}) then 1 else 0 end) end"


@query(f"""{W}, s as (select id, replace(translate(age, '０１２３４５６７８９', '0123456789'), '才', '歳') as a from records),
m as (select id, a, case
  when regexp_matches(a, '[0-9]+歳[0-9]+ヶ月') then cast(regexp_extract(a, '([0-9]+)歳', 1) as integer) * 12 + cast(regexp_extract(a, '歳([0-9]+)ヶ月', 1) as integer)
  when regexp_matches(a, '[0-9]+歳') then cast(regexp_extract(a, '([0-9]+)歳', 1) as integer) * 12
  when regexp_matches(a, '[0-9]+か月') then cast(regexp_extract(a, '([0-9]+)か月', 1) as integer)
  when regexp_matches(a, '[0-9]+週齢') then cast(regexp_extract(a, '([0-9]+)週齢', 1) as integer) // 4
  when a = '幼齢' then 3 when a = '高齢' then 120
  when regexp_matches(a, '^20[0-9]+/') then {_MB("make_date(cast(regexp_extract(a, '^([0-9]{4})/', 1) as integer), cast(regexp_extract(a, '/([0-9]+)/', 1) as integer), 15)")}
  when regexp_matches(a, '令和') then {_MB("make_date(2018 + cast(regexp_extract(a, '令和([0-9]+)', 1) as integer), cast(regexp_extract(a, '年([0-9]+)月', 1) as integer), 1)")}
  when regexp_matches(a, '[0-9]+年') then cast(regexp_extract(a, '([0-9]+)年', 1) as integer) * 12 end as n from s)
select id, cast(case when n <= 360 then n end as integer) as age_months from m""")
def normalize_age(spark, sf_dir):
    """N03 N04 N05 N06."""
    return dates.with_age(records(spark, sf_dir), "age", "age_months", F.to_date(F.lit(AS_OF))).select("id", "age_months")


@query(f"""{W}, p as (select id, shelter_date as s, p0 as k from (select *, id % 8 as p0 from records)),
d as (select id, case k
  when 0 then try_cast(concat('2025-', lpad(regexp_extract(s, '年([0-9]+)月', 1), 2, '0'), '-', lpad(regexp_extract(s, '月([0-9]+)日', 1), 2, '0')) as date)
  when 1 then try_cast(concat('2025-', lpad(regexp_extract(s, '/([0-9]+)/', 1), 2, '0'), '-', lpad(regexp_extract(s, '/([0-9]+)$', 1), 2, '0')) as date)
  when 2 then try_cast(s as date)
  when 3 then try_cast(concat('2025-', lpad(regexp_extract(s, '年([0-9]+)月', 1), 2, '0'), '-', lpad(regexp_extract(s, '月([0-9]+)日', 1), 2, '0')) as date)
  when 4 then try_cast(concat('2024-', lpad(regexp_extract(s, ' ([0-9]+)/', 1), 2, '0'), '-', lpad(regexp_extract(s, '/([0-9]+)$', 1), 2, '0')) as date)
  when 5 then try_cast(concat('2026-', lpad(regexp_extract(s, '^([0-9]+)/', 1), 2, '0'), '-', lpad(regexp_extract(s, '/([0-9]+)$', 1), 2, '0')) as date)
  when 6 then try_cast(concat('2026-', lpad(regexp_extract(s, '^([0-9]+)月', 1), 2, '0'), '-', lpad(regexp_extract(s, '月([0-9]+)日', 1), 2, '0')) as date) end as d, k from p),
y as (select id, case when k in (5, 6) and d > date '{AS_OF}' + 30 then cast(d - interval 1 year as date) else d end as d from d)
select id, case when d is null or d > date '{AS_OF}' then date '{AS_OF}' else d end as shelter_date, d is null or d > date '{AS_OF}' as estimated from y""")
def normalize_date(spark, sf_dir):
    """N06 N07 N08 N09."""
    today = F.to_date(F.lit(AS_OF))
    r = records(spark, sf_dir).withColumn("_day", dates.folded(F.col("shelter_date"))).withColumn("_day", dates.shelter_date(F.col("_day"), today, ready=True))
    day, estimated = dates.clamped(F.col("_day"), today)
    return r.select("id", day.alias("shelter_date"), estimated.alias("estimated"))


@query(f"""{W}, s as (select id, regexp_replace(translate(phone, '０１２３４５６７８９－()', '0123456789-'), ' *内線.*$', '') as p from records),
d as (select id, p, regexp_replace(p, '[^0-9]', '', 'g') as d from s),
n as (select id, d, case when length(d) not in (10, 11) then '' when regexp_matches(p, '^[0-9]{{2,5}}-[0-9]{{1,4}}-[0-9]{{3,4}}$') then p
  when length(d) = 11 then concat(substr(d, 1, 3), '-', substr(d, 4, 4), '-', substr(d, 8, 4))
  when substr(d, 1, 2) in ('03', '06') then concat(substr(d, 1, 2), '-', substr(d, 3, 4), '-', substr(d, 7, 4)) else concat(substr(d, 1, 3), '-', substr(d, 4, 3), '-', substr(d, 7, 4)) end as phone from d)
select id, phone, nullif(case when length(d) = 11 and substr(d, 1, 3) in ('070', '080', '090', '050') then '' else phone end, '') as public_phone from n""")
def normalize_phone(spark, sf_dir):
    """N10 N11 X11."""
    r = records(spark, sf_dir).select("id", web.phone(F.col("phone")).alias("phone"))
    return r.select("id", "phone", web.public_phone(F.col("phone")).alias("public_phone"))


_PII = r"(?:[0-9０-９]){2,4}[\s　]*[-－‐ー][\s　]*(?:[0-9０-９]){2,4}[\s　]*[-－‐ー][\s　]*(?:[0-9０-９]){3,4}|0[5789]0[0-9]{8}|0[0-9]{9}|[(（][\s　]*0[0-9]{1,3}[\s　]*[)）][\s　]*[0-9]{1,4}[\s　]*[-－‐ー.\s　][\s　]*[0-9]{3,4}|0[5789]0[.\s　][0-9]{4}[.\s　][0-9]{4}|[+]81[-－‐ー\s　]?[1-9][0-9]{0,3}[-－‐ー\s　.]?[0-9]{1,4}[-－‐ー\s　.]?[0-9]{3,4}"
_RED = lambda c: rf"regexp_replace(regexp_replace({c}, '{_PII}', '███', 'g'), '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+(?:[.][\p{{L}}\p{{N}}_-]+)+', '███', 'g')"


@query(f"select doc_id, md5({_RED('text')}) as redacted_md5, cast((length({_RED('text')}) - length(replace({_RED('text')}, '███', ''))) // 3 as bigint) as n_masks from documents")
def redact_pii(spark, sf_dir):
    """N12 over whole documents."""
    red = text.redact(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", red.alias("r"))
    masks = ((F.length("r") - F.length(F.replace("r", F.lit(text.MASK), F.lit("")))) / 3).cast("long")
    return d.select("doc_id", F.md5("r").alias("redacted_md5"), masks.alias("n_masks"))


@query(f"""{W} select id, nullif(trim({_RED("color")}), '') as color,
case id % 9 when 0 then '小型' when 1 then '中型' when 2 then '大型' when 3 then null when 4 then 'Sサイズ' when 5 then null when 6 then '小型' when 7 then null else '大型' end as size,
nullif(breed, '') as breed, nullif(name, '') as name, management_number from records""")
def normalize_size_cap(spark, sf_dir):
    """N13 N14 N15."""
    r = normalize.normalized(records(spark, sf_dir), AS_OF)
    return r.select("id", "color", "size", "breed", "name", "management_number")


@query(f"""{W}, u as (select id, list_distinct(list_filter(string_split(imgs, ' '), lambda x: starts_with(x, 'http') and not regexp_matches(lower(x), '[.]pdf$'))) as a from records),
g as (select id, a, list_filter(a, lambda x: not regexp_matches(regexp_replace(lower(x), '[?#].*$', ''), '/common/|icon_b')) as good from u)
select id, array_to_string(list_sort(case when len(good) > 0 then good else a end), ' ') as images from g""")
def filter_images(spark, sf_dir):
    """N17 X08 J21."""
    return records(spark, sf_dir).select("id", F.array_join(F.array_sort(web.images(F.split("imgs", " "))), " ").alias("images"))


@query(f"""{W} select id, case when category <> 'lost' then location when regexp_matches(location, '２丁目') then '大村市東大村' when regexp_matches(location, '付近') then '吾妻町牧場の里' else location end as location from records""")
def coarsen_location(spark, sf_dir):
    """N18."""
    return records(spark, sf_dir).select("id", text.coarse_location(F.col("location"), F.col("category")).alias("location"))


@query(f"""{W}, p as (select id, source_site, {_PREF} as pref, source_url from records)
select id, coalesce(nullif(pref, ''), case when contains(source_url, 'site5.example') then '沖縄県' when contains(source_url, 'site10.example') then '熊本県' end, n_name) as prefecture
from p left join nation on source_site = concat('site', cast(n_nationkey as varchar))""")
def infer_prefecture_backfill(spark, sf_dir):
    """By host, then by URL, then by the site's own entry."""
    r = records(spark, sf_dir).select("id", "source_url", "source_site", web.prefecture(F.col("source_url")).alias("p"))
    r = r.withColumn("p", normalize.backfilled(F.col("p"), F.col("source_url"), (("site5.example", "沖縄県"), ("site10.example", "熊本県"))))
    sites = table(spark, sf_dir, "nation").select(F.concat(F.lit("site"), F.col("n_nationkey").cast("string")).alias("source_site"), "n_name")  # 25 rows
    return r.join(F.broadcast(sites), "source_site", "left").select("id", F.coalesce("p", "n_name").alias("prefecture"))


@query("""select page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as host, regexp_extract(url, '^https?://([^/?#]+)', 1) as authority,
case when lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) = 'thelyre.example.com' then 'unknown' when regexp_matches(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '[.]lg[.]jp$|[.]go[.]jp$|[.]pref[.]|[.]city[.]|[.]metro[.]') then 'gov_standard' else 'unknown' end as license from pages""")
def license_by_host(spark, sf_dir):
    """N25 N27."""
    h = web.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", h.alias("host"), web.authority(F.col("url")).alias("authority"), web.license_of(h, ("thelyre.example.com",)).alias("license"))


@query("""select page_id, sha256(url) as url_sha256, sha1(html) as content_sha1, md5(url) as guid, not exists (select 1 from pages q where q.page_id % 3 = 0 and q.url = pages.url) as is_new from pages""")
def hash_keys(spark, sf_dir):
    """Hashes, and whether a URL was registered before."""
    pages = table(spark, sf_dir, "pages")
    known = pages.where("page_id % 3 = 0").select(F.sha2("url", 256).alias("url_sha256")).distinct().withColumn("old", F.lit(True))
    new = pages.select("page_id", F.sha2("url", 256).alias("url_sha256"), F.sha1("html").alias("content_sha1"), F.md5("url").alias("guid"))
    return new.join(known, "url_sha256", "left").select("page_id", "url_sha256", "content_sha1", "guid", F.col("old").isNull().alias("is_new"))


@query(f"""{W} select id, case when contains(source_url, '/dog/') then '犬' when contains(source_url, '/neko/') then '猫' else '' end as url_species,
case when contains(name, '※') then split_part(name, '※', 1) else name end as bare_name, case when contains(name, '※') then split_part(name, '※', 2) end as notice from records""")
def url_species(spark, sf_dir):
    """X09 X24 X25 X28."""
    marked = F.col("name").contains("※")
    return records(spark, sf_dir).select(
        "id", web.url_species(F.col("source_url")).alias("url_species"), F.when(marked, F.regexp_extract("name", "^(.*?)※", 1)).otherwise(F.col("name")).alias("bare_name"),
        F.when(marked, F.regexp_extract("name", "※(.*)$", 1)).alias("notice"),
    )


@query("""with d as (select doc_id, case doc_id % 5 when 0 then concat('<b>', source, '</b> ', text) when 1 then concat('a &amp; b ', text) when 2 then concat(lang, ' < 3 &#39;', text) else text end as t, case when doc_id % 7 = 0 then concat(source, '※') else source end as s from documents)
select doc_id, field, value, reason from (
select doc_id, 'description' as field, substr(t, 1, 80) as value, 'html_tag' as reason from d where regexp_matches(t, '<[a-zA-Z/][^>]*>')
union all select doc_id, 'description', substr(t, 1, 80), 'html_entity' from d where regexp_matches(t, '&[a-z]+;|&#[0-9]+;')
union all select doc_id, 'name', s, 'notice' from d where contains(s, '※'))""")
def content_anomalies(spark, sf_dir):
    """F24 over documents, with tags, entities and notices put into some."""
    k = F.col("doc_id")
    t = F.when(k % 5 == 0, F.concat(F.lit("<b>"), "source", F.lit("</b> "), "text")).when(k % 5 == 1, F.concat(F.lit("a &amp; b "), "text")).when(k % 5 == 2, F.concat("lang", F.lit(" < 3 &#39;"), "text")).otherwise(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(k % 7 == 0, F.concat("source", F.lit("※"))).otherwise(F.col("source")).alias("name"), t.alias("description"))
    return normalize.anomalies(d, "doc_id", ("name", "description"))


@query(f"""{W}, f as (select id, breed, name, description, source_url from records)
select source_url, 'breed' as field, breed as value, 'comparison' as reason from f where regexp_matches(breed, 'より|くらい|ぐらい|程度|大きめ|小さめ|前後')
union all select source_url, 'name', name, 'notice' from f where contains(name, '※')
union all select source_url, 'description', description, 'html_tag' from f where regexp_matches(description, '<[a-zA-Z/][^>]*>')
union all select source_url, 'description', description, 'html_entity' from f where regexp_matches(description, '&[a-z]+;')""")
def record_anomalies(spark, sf_dir):
    """F24 over records."""
    return normalize.anomalies(records(spark, sf_dir), "source_url", ("breed", "name", "description"))


@query("""select page_id, concat(substr(sha256(url), 1, 2), '/', substr(sha256(url), 3, 2), '/', sha256(url), '.html') as path, concat('archive/', substr(sha256(url), 1, 2), '/', sha256(url), '.html') as archived from pages""")
def storage_paths(spark, sf_dir):
    """S16 S17 S18."""
    h = F.sha2("url", 256)
    return table(spark, sf_dir, "pages").select("page_id", web.stored_path(h, "html").alias("path"), F.concat(F.lit("archive/"), F.substring(h, 1, 2), F.lit("/"), h, F.lit(".html")).alias("archived"))


@query("select cast(coalesce(sum(length(html)), 0) as bigint) as bytes, count(*) as n, cast(coalesce(round(count(*) filter (where length(html) < 5000) / nullif(count(*), 0), 6), 0) as double) as small_rate from pages")
def storage_usage(spark, sf_dir):
    """A16 A20."""
    return table(spark, sf_dir, "pages").agg(
        F.coalesce(F.sum(F.length("html")), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("n"),
        F.coalesce(F.round(F.try_divide(F.count_if(F.length("html") < 5000), F.count("*")), 6), F.lit(0.0)).alias("small_rate"),
    )


@query("""select doc_id, cast(floor(length(text) * 1.5) as bigint) as tokens, round(floor(length(text) * 1.5) * 0.25 / 1e6 + 200 * 1.25 / 1e6, 9) as cost from documents""")
def token_cost(spark, sf_dir):
    """X14 X22."""
    n = F.floor(F.length("text") * F.lit(1.5).cast("double"))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("tokens"), F.round(n * F.lit(0.25) / F.lit(1e6) + F.lit(200 * 1.25 / 1e6), 9).alias("cost"))


@query(f"""{W} select id, concat_ws(',', case when species = '' then 'species' end, case when sex = '' then 'sex' end, case when age = '' then 'age' end, case when phone = '' then 'phone' end) as errors from records""")
def extract_validation(spark, sf_dir):
    """Names of the empty required fields."""
    empty = [F.when(F.col(c) == "", c) for c in ("species", "sex", "age", "phone")]
    return records(spark, sf_dir).select("id", F.array_join(F.array_compact(F.array(*empty)), ",").alias("errors"))


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, case when date_diff('day', cast(o_orderdate as date), date '1998-01-01') >= 60 then 'stale60' when date_diff('day', cast(o_orderdate as date), date '1998-01-01') >= 30 then 'stale30' else 'fresh' end as badge from orders""")
def date_badges(spark, sf_dir):
    """N37 N43."""
    age = F.datediff(F.lit("1998-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.day_text(F.col("o_orderdate").cast("string")).alias("day"), F.when(age >= 60, "stale60").when(age >= 30, "stale30").otherwise("fresh").alias("badge"),
    )


@query("select c_custkey, c_name as round_trip from customer")
def id_encryption_roundtrip(spark, sf_dir):
    """Encrypt, then decrypt."""
    key = F.lit("0123456789abcdef")
    return table(spark, sf_dir, "customer").select("c_custkey", F.aes_decrypt(F.aes_encrypt("c_name", key), key).cast("string").alias("round_trip"))


@query(f"""{W} select id, case when source_site like 'site1%' then '犬' when source_site like 'site2%' then '猫' else '' end as by_site,
case when regexp_matches(size, '[0-9.]+kg') then case when cast(regexp_extract(size, '([0-9.]+)kg', 1) as double) < 5 then '小型' when cast(regexp_extract(size, '([0-9.]+)kg', 1) as double) < 15 then '中型' else '大型' end else '' end as by_weight,
split_part(description, ':', 1) as label, regexp_extract(management_number, '-([0-9]+)$', 1) as number, case when regexp_matches(age, '^[0-9]+$') then concat(age, '歳') else age end as age from records""")
def site_rules_text(spark, sf_dir):
    """P01 P04 P08 P15 P18."""
    kg = F.regexp_extract("size", r"([0-9.]+)kg", 1).try_cast("double")
    return records(spark, sf_dir).select(
        "id", F.when(F.col("source_site").startswith("site1"), "犬").when(F.col("source_site").startswith("site2"), "猫").otherwise("").alias("by_site"),
        F.when(kg < 5, "小型").when(kg < 15, "中型").when(kg >= 15, "大型").otherwise("").alias("by_weight"), F.get(F.split("description", "[:：]", 2), F.lit(0)).alias("label"),
        F.regexp_extract("management_number", "-([0-9]+)$", 1).alias("number"), F.when(F.col("age").rlike("^[0-9]+$"), F.concat("age", F.lit("歳"))).otherwise(F.col("age")).alias("age"),
    )
