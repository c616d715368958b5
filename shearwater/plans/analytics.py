"""Queries over aggregates, run state, feeds and posts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, web
from ..operators import feeds, normalize, stats, tracking
from .bridge import AS_OF, EVENTS_AS_OF, RECORDS_CTE, events, records, table
from .registry import ORACLES, query
from .scalars import _PREF, _SEX, _SPECIES, W

_N = f"{W}, n as (select id, {_SPECIES} as species, {_SEX} as sex, {_PREF} as prefecture, category, coalesce(status, 'sheltered') as status, nullif(breed, '') as breed, nullif(name, '') as name, phone, imgs, color, source_url, location, source_site, price from records)"


def norm(spark, sf_dir):
    return normalize.normalized(records(spark, sf_dir), AS_OF)


@query(f"{_N} select k as status, coalesce(c, 0) as n from (select unnest(['sheltered', 'adopted', 'returned', 'deceased', 'transferred']) as k) left join (select status, count(*) as c from n group by 1) on k = status")
def status_counts(spark, sf_dir):
    """A01 A02."""
    return stats.zero_filled(norm(spark, sf_dir), "status", ("sheltered", "adopted", "returned", "deceased", "transferred"))


@query(f"""{_N} select 'prefecture' as dimension, coalesce(prefecture, '(未分類)') as value, count(*) as n from n group by 2 union all select 'species', species, count(*) from n group by 2 union all select 'category', category, count(*) from n group by 2""")
def dashboard_counts(spark, sf_dir):
    """All dimensions from one pass."""
    dims = F.array(*(F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in (("prefecture", F.coalesce("prefecture", F.lit("(未分類)"))), ("species", F.col("species")), ("category", F.col("category")))))
    return norm(spark, sf_dir).select(F.inline(dims)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


@query(f"""{_N}, t as (select round(avg(case when prefecture is null then 1.0 else 0 end), 4) as a, round(avg(case when breed is null then 1.0 else 0 end), 4) as b, round(avg(case when name is null then 1.0 else 0 end), 4) as c, round(avg(case when trim(color) = '' then 1.0 else 0 end), 4) as d from n)
select 'prefecture' as field, cast(a as double) as ratio from t union all select 'breed', cast(b as double) from t union all select 'name', cast(c as double) from t union all select 'color', cast(d as double) from t""")
def dashboard_quality(spark, sf_dir):
    """A08 A15 N22."""
    return stats.missing_ratio(norm(spark, sf_dir), {c: F.col(c).isNull() for c in ("prefecture", "breed", "name", "color")})


@query("select count(*) as total, count(distinct o_orderpriority) as kinds, count(distinct o_custkey) as sites, round(avg(date '1999-01-01' - cast(o_orderdate as date)) filter (where o_orderstatus = 'O'), 6) as waiting, max(cast(o_orderdate as date)) as newest, count(*) filter (where cast(o_orderdate as date) >= date '1998-07-25') as recent from orders")
def public_stats(spark, sf_dir):
    """A06 A09 A10 A11 A18."""
    day = F.col("o_orderdate").cast("date")
    wait = F.when(F.col("o_orderstatus") == "O", F.datediff(F.lit("1999-01-01").cast("date"), day))
    return table(spark, sf_dir, "orders").agg(
        F.count("*").alias("total"), F.countDistinct("o_orderpriority").alias("kinds"), F.countDistinct("o_custkey").alias("sites"), F.round(F.avg(wait), 6).alias("waiting"),
        F.max(day).alias("newest"), F.count_if(day >= F.lit("1998-07-25").cast("date")).alias("recent"),
    )


@query("select min(strlen(html)) as least, max(strlen(html)) as most, count(*) as n, cast(sum(strlen(html)) as bigint) as bytes, sum(strlen(html)) > 1e6 as alert from pages")
def hash_totals(spark, sf_dir):
    """A07 A16 A21."""
    n = F.octet_length("html")
    return table(spark, sf_dir, "pages").agg(F.min(n).alias("least"), F.max(n).alias("most"), F.count("*").alias("n"), F.sum(n).alias("bytes"), (F.sum(n) > 1e6).alias("alert"))


@query("select r_name, n_name, count(*) as n from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup(r_name, n_name)")
def region_totals(spark, sf_dir):
    """Region and prefecture totals in one roll-up."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")  # 25 and 5 rows
    s = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(avg(value), 6) as mean from events group by 1")
def latency_percentiles(spark, sf_dir):
    """A22 A23."""
    return stats.percentiles(events(spark, sf_dir), ["event_type"], "value")


@query("with h as (select date_trunc('hour', ts) as h, count(*) as n from events group by 1) select strftime(a.h, '%Y-%m-%d %H') as hour, a.n, a.n + coalesce(b.n, 0) as with_previous from h a left join h b on b.h = a.h - interval 1 hour")
def hourly_counts(spark, sf_dir):
    """This clock hour and the one before, by a range frame."""
    h = events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n"))
    h = h.withColumn("s", F.unix_timestamp("h")).withColumn("day", F.to_date("h"))
    shifted = h.select((F.col("s") + 3600).alias("s"), F.col("n").alias("m"))
    return h.join(shifted, "s", "left").select(F.date_format("h", "yyyy-MM-dd HH").alias("hour"), "n", (F.col("n") + F.coalesce("m", F.lit(0))).alias("with_previous"))


@query("""with d as (select cast(ts as date) as day, count(*) as n, count(*) filter (where event_type = 'error') as failed, count(*) filter (where event_type = 'click') as hits, quantile_cont(value, 0.95) as p95 from events group by 1)
select day, round(failed / n, 6) as rate, case when failed / n >= 0.2 then 'critical' when failed / n >= 0.05 or p95 > 5 then 'warning' else 'ok' end as level, case when failed = n or failed / n > 0.2 then 'CRITICAL' when hits > 0 or failed > 0 then 'WARNING' end as run_level, round(hits / n, 6) as hit_rate from d""")
def alert_ladder(spark, sf_dir):
    """A20 A21 A24 A26 A27 A28."""
    e = events(spark, sf_dir)
    d = e.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "click").alias("hits"), F.percentile("value", F.lit(0.95)).alias("p95"))
    rate = F.col("failed") / F.col("n")
    return d.select("day", F.round(rate, 6).alias("rate"), stats.error_level(rate, F.col("p95")).alias("level"), stats.run_level(F.col("n"), F.col("failed"), F.col("hits")).alias("run_level"), F.round(F.col("hits") / F.col("n"), 6).alias("hit_rate"))


_STREAK = """r as (select user_id, event_id, cast(ts as date) as day, event_type = 'error' as failed, sum(case when event_type <> 'error' then 1 else 0 end) over (partition by user_id order by event_id) as i from events),
s as (select user_id, event_id, day, failed, cast(sum(case when failed then 1 else 0 end) over (partition by user_id, i order by event_id) as bigint) as streak from r)"""


@query(f"with {_STREAK} select user_id, event_id, streak from s where failed")
def failure_streaks(spark, sf_dir):
    """W01 N40."""
    runs = events(spark, sf_dir).select("user_id", "event_id", "day", (F.col("event_type") == "error").alias("failed"))
    return tracking.failure_streaks(runs, "user_id", "event_id").where("failed").select("user_id", "event_id", "streak")


@query(f"with {_STREAK}, f as (select user_id, arg_max(streak, event_id) as streak, max(day) filter (where failed) as last from s group by 1) select user_id, streak, streak >= 2 as critical, streak >= 1 and (last is null or date '{EVENTS_AS_OF}' - last <= 7) as skip from f")
def auto_skip(spark, sf_dir):
    """F19 F20."""
    runs = events(spark, sf_dir).select("user_id", "event_id", "day", (F.col("event_type") == "error").alias("failed"))
    s = tracking.failure_streaks(runs, "user_id", "event_id")
    f = s.groupBy("user_id").agg(F.max_by("streak", "event_id").alias("streak"), F.max(F.when(F.col("failed"), F.col("day"))).alias("last"))
    return f.select("user_id", "streak", (F.col("streak") >= 2).alias("critical"), tracking.auto_skip(F.col("streak"), 1, F.col("last"), F.lit(EVENTS_AS_OF).cast("date"), 7).alias("skip"))


_RUNS = """g as (select u.user_id, d.day from (select distinct user_id from events) u cross join (select cast(range as date) as day from range(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day)) d),
r as (select g.user_id, g.day, count(e.event_id) as n from g left join events e on e.user_id = g.user_id and cast(e.ts as date) = g.day and e.event_type = 'purchase' group by 1, 2),
b as (select *, last_value(case when n > 0 then n end ignore nulls) over w as last_nonzero, max(n) over w as high_water, sum(case when n > 0 then 1 else 0 end) over w as i from r window w as (partition by user_id order by day rows between unbounded preceding and current row)),
z as (select user_id, day, n, last_nonzero, high_water, cast(sum(case when n = 0 then 1 else 0 end) over (partition by user_id, i order by day) as bigint) as zero_runs from b)"""


def _runs(spark, sf_dir):
    """A run a user and day, with the count of purchases; days without any count 0."""
    e = events(spark, sf_dir)
    days = F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date")))
    grid = e.select("user_id").distinct().select("user_id", days.alias("day"))
    n = e.where("event_type = 'purchase'").groupBy("user_id", "day").agg(F.count("*").alias("n"))
    return grid.join(n, ["user_id", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(f"with {_RUNS} select user_id, day, n, last_nonzero, high_water, zero_runs from z")
def baseline_fold(spark, sf_dir):
    """W02."""
    return tracking.baseline(_runs(spark, sf_dir), "user_id", "day")


@query(f"with {_RUNS}, f as (select user_id, arg_max(last_nonzero, day) as last_nonzero, arg_max(zero_runs, day) as zero_runs from z group by 1) select user_id, last_nonzero, zero_runs from f where coalesce(last_nonzero, 0) >= 1 and zero_runs >= 2")
def zero_regressions(spark, sf_dir):
    """W03."""
    state = tracking.final(tracking.baseline(_runs(spark, sf_dir), "user_id", "day"), "user_id", "day", "last_nonzero", "zero_runs")
    return tracking.regressions(state)


@query(f"with {_RUNS}, f as (select user_id, arg_max(n, day) as n, max(case when n > 0 then n end) as ever, count(*) as k from z group by 1), h as (select user_id, day from z where user_id % 2 = 0) select 'drop' as finding, user_id, strftime(day, '%Y-%m-%d') as day from (select user_id, day, n, lag(n) over (partition by user_id order by day) as p from z) where p >= 1 and n = 0 union all select 'persistent', user_id, '' from f where ever is null and k >= 14")
def persistent_zero(spark, sf_dir):
    """W04 W07."""
    runs = _runs(spark, sf_dir)
    before = F.lag("n").over(Window.partitionBy("user_id").orderBy("day"))
    drops = runs.withColumn("p", before).where("p >= 1 and n = 0").select(F.lit("drop").alias("finding"), "user_id", F.date_format("day", "yyyy-MM-dd").alias("day"))
    state = tracking.final(tracking.baseline(runs, "user_id", "day"), "user_id", "day", "last_nonzero", "zero_runs")
    return drops.unionByName(tracking.persistent_zeros(state).select(F.lit("persistent").alias("finding"), "user_id", F.lit("").alias("day")))


_RATES = """q as (select event_type as site, cast(ts as date) as day, round(avg(case when value < 5 then 1.0 else 0 end), 4) as rate, count(*) as sample from events group by 1, 2)"""


def _rates(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("site"), "day").agg(F.round(F.avg((F.col("value") < 5).cast("double")), 4).alias("rate"), F.count("*").alias("sample"))


@query(f"with {_RATES}, l as (select *, lag(rate) over (partition by site order by day) as previous from q) select site, day, cast(rate as double) as rate, cast(previous as double) as previous from l where rate - previous >= 0.05 - 1e-12")
def missing_rate_drift(spark, sf_dir):
    """W06 A15."""
    return tracking.drift(_rates(spark, sf_dir), ["site"], "day", "rate", 0.05).select("site", "day", "rate", "previous")


@query(f"with {_RATES} select site, day, sample from q qualify row_number() over (partition by site order by day desc) <= 10")
def history_last_n(spark, sf_dir):
    """W05."""
    return tracking.last_n(_rates(spark, sf_dir), ["site"], "day").select("site", "day", "sample")


_STATUS = "case event_type when 'signup' then 'sheltered' when 'purchase' then 'adopted' when 'click' then 'returned' when 'error' then 'deceased' else 'sheltered' end"


@query(f"""with l as (select user_id, event_id, {_STATUS} as new, lag({_STATUS}) over (partition by user_id order by event_id) as old from events)
select user_id, event_id, old, new, (old || '>' || new) in ('sheltered>adopted', 'sheltered>returned', 'sheltered>deceased', 'adopted>returned', 'adopted>deceased', 'returned>adopted', 'returned>deceased') as allowed from l where old <> new""")
def status_transitions(spark, sf_dir):
    """W08 W09 M02 M13."""
    log = events(spark, sf_dir).select("user_id", "event_id", F.expr(_STATUS).alias("status"))
    return tracking.transitions(log, "user_id", "event_id", "status")


@query("select user_id, event_id, event_type from events where ts >= timestamp '2024-02-01' - interval 20 day and event_type <> 'view' qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 3")
def history_ttl_topn(spark, sf_dir):
    """W10 W11 M11."""
    e = events(spark, sf_dir).where((F.col("ts") >= F.lit("2024-01-12").cast("timestamp")) & (F.col("event_type") != "view"))
    return tracking.last_n(e.withColumn("o", F.struct("ts", "event_id")), ["user_id"], "o", 3).select("user_id", "event_id", "event_type")


@query("with d as (select o_orderkey, cast(o_orderdate as date) as day, max(cast(o_orderdate as date)) over () as top from orders) select case when day is null then 'unknown' when day >= top - 30 then 'fresh' else 'stale' end as class, count(*) as n from d group by 1")
def freshness_classes(spark, sf_dir):
    """Against the newest date, from a one-row aggregate."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    top = o.agg(F.coalesce(F.max("day"), F.lit(AS_OF).cast("date")).alias("top"))
    c = F.when(F.col("day").isNull(), "unknown").when(F.col("day") >= F.date_sub("top", 30), "fresh").otherwise("stale")
    return o.crossJoin(F.broadcast(top)).groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query("""with c as (select n_name, count(*) filter (where s_acctbal > 2000) as n from supplier join nation on s_nationkey = n_nationkey group by 1), s as (select list_sort(list(n) filter (where n > 0)) as v, max(n) as m from c)
select n_name, n, case when n <= 0 then 0 else 1 + case when n >= v[1 + cast(floor(len(v) * 1 / 4.0) as int)] then 1 else 0 end + case when n >= v[1 + cast(floor(len(v) * 2 / 4.0) as int)] then 1 else 0 end + case when n >= v[1 + cast(floor(len(v) * 3 / 4.0) as int)] then 1 else 0 end end as bin,
case when n = 0 then 0 else cast(ceil(5.0 * n / m) as bigint) end as shade from c, s""")
def quantile_bins(spark, sf_dir):
    """Over one row a nation."""
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    c = s.groupBy("n_name").agg(F.count_if(F.col("s_acctbal") > 2000).alias("n"))
    v = c.agg(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.col("n")))).alias("v"), F.max("n").alias("m"))  # 25 numbers at most
    return c.crossJoin(F.broadcast(v)).select(
        "n_name", "n", stats.quantile_bin(F.col("n"), F.col("v"), 4).alias("bin"), F.when(F.col("n") == 0, 0).otherwise(F.ceil(F.lit(5.0) * F.col("n") / F.col("m"))).alias("shade"),
    )


@query(f"{_N} select id, concat(species, ' - ', location) as title, md5(source_url) as guid, string_split(imgs, ' ')[1] as enclosure from n where category = 'adoption' and status <> 'deceased'")
def feed_items(spark, sf_dir):
    """G01 G07."""
    r = norm(spark, sf_dir).where("category = 'adoption' and status <> 'deceased'")
    return feeds.rss_items(r).select("id", "title", "guid", "enclosure")


@query(f"{_N} select id, concat('tag:example.org,{AS_OF}:', md5(source_url)) as entry_id, '{AS_OF}T00:00:00Z' as updated, concat(species, ' - ', location) as title from n where category = 'adoption'")
def atom_entries(spark, sf_dir):
    """G02."""
    return feeds.atom_entries(norm(spark, sf_dir).where("category = 'adoption'"), "example.org", AS_OF).select("id", "entry_id", "updated", "title")


@query("""select o_orderkey, concat_ws('、', concat('種別: ', o_orderpriority), concat('年齢: ', case when o_orderkey % 50 < 12 then concat(cast(o_orderkey % 50 as varchar), 'ヶ月') else concat('約', cast(o_orderkey % 50 // 12 as varchar), '歳', case when o_orderkey % 50 % 12 > 0 then concat(cast(o_orderkey % 50 % 12 as varchar), 'ヶ月') else '' end) end)) as description from orders""")
def item_descriptions(spark, sf_dir):
    """G03 N32."""
    none = F.lit(None).cast("string")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("species"), none.alias("sex"), (F.col("o_orderkey") % 50).alias("age_months"), none.alias("color"), none.alias("size"), F.lit("").alias("location"))
    return o.select("o_orderkey", feeds.item_description().alias("description"))


_OPEN = f"{_N}, o as (select id, string_split(imgs, ' ')[1] as img, source_url from n where status = 'sheltered')"


@query(f"{_OPEN}, t as (select * from o order by id desc limit 100) select id, concat('img:', regexp_replace(lower(img), '^https?://', '')) as identity from t where id % 3 <> 0 and id % 7 <> 0")
def post_candidates(spark, sf_dir):
    """The newest hundred that haven't been posted, by URL or identity."""
    r = norm(spark, sf_dir).withColumn("shelter_date", F.lit(AS_OF).cast("date"))
    posted = r.select("source_url", F.when(F.col("id") % 7 == 0, web.identity_key(F.get("image_urls", F.lit(0)))).alias("identity"), "id").where("id % 3 = 0 or id % 7 = 0")
    return feeds.candidates(r, posted).select("id", "identity")


@query("""with o as (select o_orderkey as id, o_orderpriority as species, concat('cust ', cast(o_custkey as varchar)) as location, case when o_orderkey % 3 = 0 then repeat('長い', 90) else '短い' end as d, concat('https://example.org/a/', cast(o_orderkey as varchar), '?utm_source=social') as u from (select *, 1 as one from orders)),
t as (select id, u, concat('【', species, '】', location, chr(10), d, chr(10), '管理番号: ', id, chr(10), '#保護動物 #', species, chr(10), u) as long, concat('【', species, '】', location, chr(10), d, chr(10), '#保護動物 #', species, chr(10), u) as short, concat('【', species, '】', location, chr(10), d, chr(10), '#保護動物 #', species) as head from o)
select id, case when length(long) <= 180 then long when length(short) <= 180 then short else concat(substr(head, 1, 180 - length(u) - 1), chr(10), u) end as post from t""")
def post_text(spark, sf_dir):
    """G08 N34 N35."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("species"), F.concat(F.lit("cust "), F.col("o_custkey").cast("string")).alias("location"),
        F.when(F.col("o_orderkey") % 3 == 0, "長い" * 90).otherwise("短い").alias("description"), F.col("o_orderkey").cast("string").alias("management_number"), F.concat(F.lit("https://example.org/a/"), F.col("o_orderkey").cast("string")).alias("source_url"),
    )
    return o.select("id", feeds.post_text(o).alias("post"))


@query(f"{W} select id, concat_ws(',', case when coalesce(status, 'sheltered') <> 'sheltered' then 'status' end, case when id % 5 in (0, 3) then 'phone' end, case when id % 5 = 1 then 'email' end) as reasons, case when coalesce(status, 'sheltered') <> 'sheltered' or id % 5 in (0, 1, 3) then 'moderation_failed' else 'dry_run' end as decision from records")
def post_moderation(spark, sf_dir):
    """F22 G09."""
    r = records(spark, sf_dir)
    reasons = feeds.moderation(F.coalesce("status", F.lit("sheltered")), F.col("description"))
    r = r.select("id", reasons.alias("r"))
    return r.select("id", F.array_join("r", ",").alias("reasons"), feeds.decision(True, F.lit(True), F.col("r"), True).alias("decision"))


@query(f"""{_N} select id, concat('新しい保護動物の情報です', chr(10), '種別: ', species, chr(10), '場所: ', c.location, chr(10), source_url) as message, to_json({{'id': id, 'species': species}}) as payload from n join ({ORACLES['coarsen_location']}) c using (id)""")
def notification_text(spark, sf_dir):
    """G10."""
    r = norm(spark, sf_dir)
    body = F.regexp_replace(feeds.notification(r), "年齢: [^\n]*\n", "")
    return r.select("id", body.alias("message"), F.to_json(F.struct("id", "species")).alias("payload"))


@query(f"""{W}, a as (select source_site, id, {{'species': species, 'sex': sex, 'age_months': cast(id % 50 as int), 'color': nullif(color, ''), 'size': size, 'shelter_date': strftime(date '2025-01-01' + cast(id % 300 as int), '%Y-%m-%d'), 'location': location, 'phone': phone, 'image_urls': string_split(imgs, ' '), 'source_url': source_url, 'category': category}} as a from records where category <> 'lost')
select source_site, cast(count(*) as int) as animals, cast(to_json({{'animals': list(a order by id), 'source': 'collector', 'timestamp': '{AS_OF}T00:00:00Z'}}) as varchar) as payload from a group by 1""")
def webhook_payloads(spark, sf_dir):
    """What the notifier is sent of each site."""
    r = records(spark, sf_dir).where("category <> 'lost'").withColumn("age_months", (F.col("id") % 50).cast("int")).withColumn("color", F.nullif("color", F.lit("")))
    r = r.withColumn("shelter_date", F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") % 300).cast("int"))).withColumn("image_urls", F.split("imgs", " "))
    return feeds.payload(r, ["source_site"], "collector", f"{AS_OF}T00:00:00Z")


@query("select strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') as minute, user_id % 4 as ip, count(*) as n, count(*) > 1 as limited from events group by 1, 2")
def rate_limit_windows(spark, sf_dir):
    """Fixed one-minute windows."""
    w = events(spark, sf_dir).groupBy(F.window("ts", "1 minute").alias("w"), (F.col("user_id") % 4).alias("ip")).agg(F.count("*").alias("n"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("minute"), "ip", "n", (F.col("n") > 1).alias("limited"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as b from events), s as (select user_id, ts, sum(b) over (partition by user_id order by ts) as i from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, count(*) as n from s group by user_id, i""")
def session_activity(spark, sf_dir):
    """Gap sessions."""
    s = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query("""select r_name, count(*) as sources, count(distinct n_nationkey) as prefectures, array_to_string(list_sort(list(distinct n_name)), ',') as names from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1""")
def source_rollup(spark, sf_dir):
    """A33."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    # a region has at most as many names as there are nations
    return s.groupBy("r_name").agg(F.count("*").alias("sources"), F.countDistinct("n_nationkey").alias("prefectures"), F.array_join(F.sort_array(F.collect_set("n_name")), ",").alias("names"))


@query("select count(*) as total, count(*) filter (where s_suppkey % 3 = 0) as registered, count(*) filter (where s_suppkey % 3 <> 0) as rest from supplier")
def coverage_stats(spark, sf_dir):
    """A34."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    reg = s.where("s_suppkey % 3 = 0").withColumn("in_registry", F.lit(True))
    j = s.join(reg, "s_suppkey", "left")
    return j.agg(F.count("*").alias("total"), F.count("in_registry").alias("registered"), F.count_if(F.col("in_registry").isNull()).alias("rest"))


@query("select cast(ts as date) as day, count(*) as total, count(*) filter (where event_type = 'signup') as new, count(*) filter (where event_type = 'click') as updated, count(*) filter (where event_type = 'error') as deleted from events group by 1")
def run_summary_counts(spark, sf_dir):
    """A36 A17."""
    c = lambda k, n: F.count_if(F.col("event_type") == k).alias(n)
    return events(spark, sf_dir).groupBy("day").agg(F.count("*").alias("total"), c("signup", "new"), c("click", "updated"), c("error", "deleted"))


@query("""select case when s_suppkey % 11 = 0 then 'no_adapter' when s_suppkey % 7 = 0 then 'init_error' when s_suppkey % 5 = 0 then 'skipped_js' when s_acctbal < 0 then 'list_error' when s_acctbal < 500 then 'list_empty' when s_acctbal < 1000 then 'detail_error' else 'ok' end as status, count(*) as n from supplier group by 1""")
def check_ladder(spark, sf_dir):
    """A37."""
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    s = F.when(k % 11 == 0, "no_adapter").when(k % 7 == 0, "init_error").when(k % 5 == 0, "skipped_js").when(b < 0, "list_error").when(b < 500, "list_empty").when(b < 1000, "detail_error").otherwise("ok")
    return table(spark, sf_dir, "supplier").groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@query("""with r as (select event_type as field, event_id % 2 as half, round(avg(case when value < 8 then 1.0 else 0 end), 4) as rate from events where not (event_id % 2 = 1 and event_type = 'click') group by 1, 2)
select a.field, cast(a.rate as double) as before, cast(coalesce(b.rate, 1.0) as double) as after, coalesce(b.rate, 1.0) < a.rate - 0.05 as improved from r a left join r b on b.field = a.field and b.half = 1 where a.half = 0""")
def improvement_eval(spark, sf_dir):
    """A35 A38."""
    e = events(spark, sf_dir).where("not (event_id % 2 = 1 and event_type = 'click')")
    r = e.groupBy(F.col("event_type").alias("field")).agg(F.round(F.avg(F.when(F.col("event_id") % 2 == 0, (F.col("value") < 8).cast("double"))), 4).alias("before"), F.round(F.avg(F.when(F.col("event_id") % 2 == 1, (F.col("value") < 8).cast("double"))), 4).alias("after"))
    after = F.coalesce("after", F.lit(1.0))
    return r.select("field", "before", after.alias("after"), (after < F.col("before") - 0.05).alias("improved"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where cast(json_extract(props, '$.k') as bigint) % 2 = 0")
def favourite_ids(spark, sf_dir):
    """F25."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k % 2 = 0")


@query("select doc_id from documents order by md5(concat(doc_id, ':7')), doc_id limit 20")
def seeded_sample(spark, sf_dir):
    """A sample of fixed size that depends on seed and id only."""
    return stats.seeded_sample(table(spark, sf_dir, "documents"), "doc_id", 20, 7).select("doc_id")


@query("select event_id, 'status_change' as action, concat(cast(user_id as varchar), ':', event_type) as detail from events where event_type <> 'view'")
def audit_log(spark, sf_dir):
    """S24."""
    return table(spark, sf_dir, "events").where("event_type <> 'view'").select("event_id", F.lit("status_change").alias("action"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("detail"))


@query(f"{W} select id, concat('#', id, ' ', {_SPECIES}, ' / ', {_SEX}) as heading, len(list_filter(string_split(imgs, ' '), lambda x: starts_with(x, 'http'))) as n_urls from records where category = 'lost'")
def review_cards(spark, sf_dir):
    """G12 S20."""
    r = records(spark, sf_dir).where("category = 'lost'")
    n = F.size(F.filter(F.split("imgs", " "), lambda x: x.startswith("http")))
    return r.select("id", F.concat(F.lit("#"), F.col("id").cast("string"), F.lit(" "), text.species(F.col("species")), F.lit(" / "), text.sex(F.col("sex"))).alias("heading"), n.cast("long").alias("n_urls"))


@query(f"{_N} select source_site, category, count(*) as n from n where category in ('adoption', 'lost') and status <> 'deceased' group by 1, 2")
def feed_by_filter(spark, sf_dir):
    """G07 A17."""
    return norm(spark, sf_dir).where("category in ('adoption', 'lost') and status <> 'deceased'").groupBy("source_site", "category").agg(F.count("*").alias("n"))


assert RECORDS_CTE
