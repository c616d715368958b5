"""Queries over listing, merging, reconciliation and matching operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, web
from ..operators import listing, normalize, reconcile
from .bridge import AS_OF, RECORDS_CTE, records, table
from .registry import ORACLES, query
from .scalars import _PREF, _SEX, _SPECIES, W

_BOARD = """select o_orderkey as id, o_orderpriority as species, case when o_orderstatus = 'F' then 'adopted' when o_orderstatus = 'P' then 'deceased' else 'sheltered' end as status,
cast(o_orderdate as date) as shelter_date, concat('cust ', cast(o_custkey as varchar(12))) as location, o_totalprice as price from {orders}"""
_BOARD_CTE = f"board as ({_BOARD.replace('{orders}', 'orders')})"


def board(spark, sf_dir):
    """Orders as listing rows."""
    return spark.sql(_BOARD, orders=table(spark, sf_dir, "orders"))


_F = listing.ListFilter(location="cust 1", date_from="1995-01-01", date_to="1996-12-31", offset=20, limit=30)
_WHERE = "contains(location, 'cust 1') and shelter_date between date '1995-01-01' and date '1996-12-31' and status is distinct from 'deceased'"


@query(f"with {_BOARD_CTE} select id, status, shelter_date, location from board where {_WHERE} order by shelter_date desc, id desc limit 30 offset 20")
def list_newest_page(spark, sf_dir):
    """F01-F06 O01-O03."""
    return listing.page(board(spark, sf_dir), _F).select("id", "status", "shelter_date", "location")


@query(f"with {_BOARD_CTE} select id, status, shelter_date, location from board where {_WHERE} order by shelter_date, id limit 30 offset 20")
def list_oldest_page(spark, sf_dir):
    f = listing.ListFilter(location="cust 1", date_from="1995-01-01", date_to="1996-12-31", offset=20, limit=30, sort="oldest")
    return listing.page(board(spark, sf_dir), f).select("id", "status", "shelter_date", "location")


@query(f"with {_BOARD_CTE} select count(*) as total, cast(ceil((20 + 30) / 30.0) as bigint) as page, cast(ceil(count(*) / 30.0) as bigint) as pages, count(*) > 50 as has_next from board where {_WHERE}")
def page_meta(spark, sf_dir):
    """O04."""
    return listing.page_meta(board(spark, sf_dir), _F)


@query(f"with {_BOARD_CTE} select id, status from board where status = 'adopted' and species = '1-URGENT'")
def status_listing(spark, sf_dir):
    """F03 F09."""
    return listing.filtered(board(spark, sf_dir), listing.ListFilter(status="adopted", species="1-URGENT")).select("id", "status")


@query(f"{W}, n as (select id, {_SPECIES} as species, nullif(trim(color), '') as color, location, {_PREF} as prefecture, nullif(breed, '') as breed, coalesce(status, 'sheltered') as status from records) select id, breed from n where status <> 'deceased' and (contains(species, 'ちワワ') or contains(coalesce(color, ''), 'ちワワ') or contains(location, 'ちワワ') or contains(coalesce(prefecture, ''), 'ちワワ') or breed in ('チワワ', 'ちわわ'))")
def keyword_search_kana(spark, sf_dir):
    """F07 N23 N24."""
    r = normalize.normalized(records(spark, sf_dir), AS_OF)
    return listing.filtered(r, listing.ListFilter(q="ちワワ")).select("id", "breed")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'ed_w') or contains(lower(p_name), 'red w')")
def keyword_search_literal(spark, sf_dir):
    """Wild cards of LIKE are literal."""
    p = table(spark, sf_dir, "part").withColumn("species", F.col("p_name"))
    return p.where(listing.keyword(p, "ed_w") | listing.keyword(p, "RED w")).select("p_partkey", "p_name")


def _settled(spark, sf_dir):
    return board(spark, sf_dir).withColumn("status_changed_at", F.col("shelter_date").cast("timestamp"))


@query(f"with {_BOARD_CTE} select id, case when status = 'adopted' and shelter_date <= date '1998-01-01' - 180 then 'archive' else 'active' end as side from board")
def archive_split(spark, sf_dir):
    """the archive and what stays active, from one pass."""
    rows = _settled(spark, sf_dir)
    old = listing.archivable(rows, "1998-01-01").select("id", F.lit("archive").alias("side"))
    return rows.select("id").join(old, "id", "left").select("id", F.coalesce("side", F.lit("active")).alias("side"))


@query(f"with {_BOARD_CTE} select id, shelter_date from board where status = 'adopted' and contains(lower(location), 'cust 12') and shelter_date >= date '1995-03-01' and shelter_date < date '1995-09-01'")
def archive_range(spark, sf_dir):
    """F10 F11 F12."""
    b = board(spark, sf_dir)
    day = F.col("shelter_date")
    return b.where((F.col("status") == "adopted") & F.lower("location").contains("cust 12") & (day >= F.lit("1995-03-01").cast("date")) & (day < F.date_add(F.lit("1995-08-31").cast("date"), 1))).select("id", "shelter_date")


@query(f"with {_BOARD_CTE} select id, shelter_date from board where status in ('adopted', 'returned') and shelter_date <= date '1998-01-01' - 180 order by shelter_date, id limit 25")
def oldest_archivable(spark, sf_dir):
    """F13 O09."""
    return listing.archivable(_settled(spark, sf_dir), "1998-01-01", limit=25).select("id", "shelter_date")


@query(f"with {_BOARD_CTE} select id, species, status from board where id in (3, 7, 64, 100)")
def point_lookups(spark, sf_dir):
    """pushed to the scan as an In filter."""
    return board(spark, sf_dir).where(F.col("id").isin(3, 7, 64, 100)).select("id", "species", "status")


@query(f"{W} select id, {_SPECIES} as species, {_SEX} as sex, category, coalesce(status, 'sheltered') as status, source_url from records")
def public_projection(spark, sf_dir):
    """F16 F17."""
    return listing.public(normalize.normalized(records(spark, sf_dir), AS_OF)).select("id", "species", "sex", "category", "status", "source_url")


_OLD_NEW = f"""{_BOARD_CTE}, a as (select * from board where id % 5 <> 0), b as (select id, species, case when id % 7 = 0 then 'returned' else status end as status, shelter_date, location, price from board where id % 11 <> 0)"""


def _versions(spark, sf_dir):
    b = board(spark, sf_dir)
    return b.where("id % 5 <> 0"), b.where("id % 11 <> 0").withColumn("status", F.when(F.col("id") % 7 == 0, "returned").otherwise(F.col("status")))


@query(f"with {_OLD_NEW} select coalesce(a.id, b.id) as id, case when a.id is null then 'new' when b.id is null then 'deleted' else 'updated' end as change from a full join b on a.id = b.id where a.id is null or b.id is null or a.status is distinct from b.status or a.species is distinct from b.species")
def snapshot_diff(spark, sf_dir):
    """J04."""
    old, new = _versions(spark, sf_dir)
    return reconcile.snapshot_diff(old, new, "id", ["species", "status", "shelter_date", "location", "price"])


@query(f"""with {_OLD_NEW}, m as (select coalesce(b.id, a.id) as k, a.id as oid, case when b.id is null then a.price else b.price end as price,
case when b.id is null then a.shelter_date when b.id % 2 = 0 and a.shelter_date is not null then a.shelter_date else b.shelter_date end as shelter_date, coalesce(b.status, a.status, 'sheltered') as status, case when b.id is null then 'old' else 'now' end as stamp from a full join b on a.id = b.id)
select k, price, shelter_date, status, stamp, oid is null as is_new from m""")
def upsert_merge(spark, sf_dir):
    """Even keys count as estimated dates."""
    old, new = _versions(spark, sf_dir)
    old = old.withColumnRenamed("id", "k").withColumn("id", F.col("k")).withColumn("stamp", F.lit("old"))
    new = new.withColumnRenamed("id", "k").withColumn("id", F.lit(None).cast("long"))
    top = old.agg(F.max("id").alias("top"))
    merged = reconcile.upsert(
        old, new, "k", ["price", "shelter_date"], ["status"], {"shelter_date": F.col("n.k") % 2 == 0}, {"status": F.lit("sheltered")}, ("stamp", F.lit("now")),
    )
    return merged.crossJoin(F.broadcast(top)).select("k", "price", "shelter_date", "status", "stamp", (F.col("id") > F.col("top")).alias("is_new"))


@query("""with t as (select o_orderkey, o_custkey % 50 as site from orders), seen as (select o_orderkey, site from t where o_orderkey % 3 <> 0 and site < 30)
select o_orderkey, site from t where not (site in (select site from seen)) or o_orderkey in (select o_orderkey from seen)""")
def prune_disappeared(spark, sf_dir):
    """Only sites with seen rows lose what has gone."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("site"))
    return reconcile.prune(t, t.where("o_orderkey % 3 <> 0 and site < 30"), "site", "o_orderkey")


@query(f"""{W}, c as (select source_url, concat('site', cast(id % 3 as varchar)) as owner, id % 3 as o from records union all select source_url, 'late', 9 from records where id % 2 = 0),
f as (select source_url, owner from c qualify row_number() over (partition by source_url order by o, owner) = 1) select owner, count(*) as n from f group by 1""")
def group_by_source(spark, sf_dir):
    """The first source that claims a URL owns it."""
    r = records(spark, sf_dir)
    claims = r.select("source_url", F.concat(F.lit("site"), (F.col("id") % 3).cast("string")).alias("owner"), (F.col("id") % 3).alias("o"))
    claims = claims.unionByName(r.where("id % 2 = 0").select("source_url", F.lit("late").alias("owner"), F.lit(9).cast("long").alias("o")))
    return reconcile.first_claim(claims, "source_url", "owner", "o").groupBy("owner").agg(F.count("*").alias("n"))


@query("""with l as (select 1 as o, regexp_extract(url, '^https?://[^/]+/') as list_url from pages where page_id % 10 = 0 union all select 2, regexp_extract(url, '^https?://[^/]+/[^/]+/') from pages where page_id % 10 = 1),
d as (select min(o) as o, list_url from l where list_url <> '' group by 2) select page_id, arg_min(list_url, o * 1000000 - length(list_url)) as list_url from pages join d on starts_with(url, list_url) group by 1""")
def prefix_attribution(spark, sf_dir):
    """Prefix join by host."""
    pages = table(spark, sf_dir, "pages")
    one = pages.where("page_id % 10 = 0").select(F.lit(1).alias("o"), F.regexp_extract("url", "^https?://[^/]+/", 0).alias("list_url"))
    two = pages.where("page_id % 10 = 1").select(F.lit(2).alias("o"), F.regexp_extract("url", "^https?://[^/]+/[^/]+/", 0).alias("list_url"))
    lists = one.union(two).where("list_url <> ''").groupBy("list_url").agg(F.min("o").alias("o")).withColumn("rank", F.col("o") * 1000000 - F.length("list_url"))
    return reconcile.prefix_attribution(pages.select("page_id", "url"), lists, "url", "list_url", "rank").select("page_id", "list_url")


_SITES = "select s.s_suppkey, n.n_name, count(l.l_orderkey) as n, max(cast(l.l_shipdate as date)) as last from supplier s left join nation n on s.s_nationkey = n.n_nationkey left join lineitem l on l.l_suppkey = s.s_suppkey group by 1, 2"


@query(f"with s as ({_SITES}) select s_suppkey, n_name, n, last, case when s_suppkey % 6 = 0 then 'failing' when s_suppkey % 4 = 0 then 'warning' else 'ok' end as health from s")
def site_overview(spark, sf_dir):
    """Sites left-joined with counts of their rows."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    stats = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max(F.col("l_shipdate").cast("date")).alias("last"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")  # 25 rows
    failures = F.when(F.col("s_suppkey") % 6 == 0, 3).when(F.col("s_suppkey") % 4 == 0, 1).otherwise(0)
    health = F.when(failures >= 3, "failing").when(failures > 0, "warning").otherwise("ok")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left").join(stats, s.s_suppkey == stats.l_suppkey, "left").select("s_suppkey", "n_name", F.coalesce("n", F.lit(0)).alias("n"), "last", health.alias("health"))


@query(f"with s as ({_SITES}) select case when n > 0 then 'with' else 'without' end as side, count(*) as sites from s group by 1")
def site_coverage(spark, sf_dir):
    """J10 A12."""
    s = table(spark, sf_dir, "supplier")
    have = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("has", F.lit("with"))
    return s.join(have, "s_suppkey", "left").groupBy(F.coalesce("has", F.lit("without")).alias("side")).agg(F.count("*").alias("sites"))


@query(f"with {_OLD_NEW} select case when a.id is null then 'right_only' when b.id is null then 'left_only' else 'matched' end as status, count(*) as n from a full join b on a.id = b.id group by 1")
def audit_reconcile(spark, sf_dir):
    """J12 A30."""
    old, new = _versions(spark, sf_dir)
    return reconcile.audit(old, new, "id", ["species", "status"])[0].groupBy("status").agg(F.count("*").alias("n"))


@query(f"with {_OLD_NEW} select a.id, 'status' as field, a.status as left_value, b.status as right_value from a join b on a.id = b.id where a.status is distinct from b.status")
def audit_mismatches(spark, sf_dir):
    """J12 N28 O07."""
    old, new = _versions(spark, sf_dir)
    return reconcile.audit(old, new, "id", ["species", "status", "location"])[1]


@query(f"with {_OLD_NEW} select id, case when id in (select id from b) then 'remaining' else 'resolved' end as state from a where status = 'adopted'")
def audit_recheck(spark, sf_dir):
    """J13."""
    old, new = _versions(spark, sf_dir)
    now = new.select("id").withColumn("_in", F.lit("remaining"))
    return old.where("status = 'adopted'").join(now, "id", "left").select("id", F.coalesce("_in", F.lit("resolved")).alias("state"))


@query("""with l as (select regexp_extract(url, '^https?://([^/?#]+)', 1) as host, count(*) as listed, sum(len(regexp_extract_all(html, '<a href='))) as links from pages group by 1),
r as (select regexp_extract(url, '^https?://([^/?#]+)', 1) as host, count(*) as stored from pages where page_id % 3 <> 0 group by 1)
select l.host, listed, coalesce(stored, 0) as stored, concat_ws(',', case when coalesce(stored, 0) < listed then 'undercount' end, case when coalesce(stored, 0) = 0 then 'zero_suspect' end, case when links > 6 * listed then 'pagination' end) as flags from l left join r using (host)""")
def audit_host_flags(spark, sf_dir):
    """J14 O06 N25."""
    p = table(spark, sf_dir, "pages").withColumn("host", web.authority(F.col("url")))
    seen = p.groupBy("host").agg(F.count("*").alias("listed"), F.sum(F.regexp_count("html", F.lit("<a href="))).alias("links"))
    kept = p.where("page_id % 3 <> 0").groupBy("host").agg(F.count("*").alias("stored"))
    n = F.coalesce("stored", F.lit(0))
    flags = F.array_compact(F.array(F.when(n < F.col("listed"), "undercount"), F.when(n == 0, "zero_suspect"), F.when(F.col("links") > 6 * F.col("listed"), "pagination")))
    return seen.join(kept, "host", "left").select("host", "listed", n.alias("stored"), F.array_join(flags, ",").alias("flags"))


@query("""with u as (select user_id, 0 as part, event_id as pos from events where event_type = 'error' union all select user_id, 1, event_id from events where event_type = 'purchase')
select user_id, part, pos from u qualify row_number() over (partition by user_id order by part, pos) = 1""")
def ordered_union_dedup(spark, sf_dir):
    """Union in order, each key once at its first place."""
    e = table(spark, sf_dir, "events")
    return reconcile.ordered_distinct([e.where("event_type = 'error'"), e.where("event_type = 'purchase'")], ["user_id"], "event_id")


@query("select distinct user_id from events where event_type = 'error' and user_id not in (select user_id from events where event_type = 'purchase' and value > 50)")
def candidate_difference(spark, sf_dir):
    """J18."""
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'error'").select("user_id").distinct().join(e.where("event_type = 'purchase' and value > 50").select("user_id"), "user_id", "left_anti")


_PREFS = """select c_custkey as user_id, case c_custkey % 4 when 0 then '犬' when 1 then '猫' end as p_species, case c_custkey % 3 when 0 then '高知市|大村市' when 1 then '吾妻町' end as places,
case when c_custkey % 5 = 0 then 12 end as age_min, case when c_custkey % 7 = 0 then 100 end as age_max, case when c_custkey % 6 = 0 then '大型' end as p_size, case when c_custkey % 2 = 0 then '男の子' end as p_sex,
c_acctbal > 0 as active, c_custkey % 10 <> 3 as enabled from {customer}"""
_SIZE = "case id % 9 when 0 then '小型' when 1 then '中型' when 2 then '大型' when 4 then 'Sサイズ' when 6 then '小型' when 8 then '大型' end"
_MATCH = f"""{W}, n as (select id, {_SPECIES} as species, {_SEX} as sex, age_months, {_SIZE} as size, location, source_url from records join ({ORACLES['normalize_age']}) using (id)),
p as ({_PREFS.replace('{customer}', 'customer')}), m as (select user_id, id, source_url from n join p on active and enabled and (p_species is null or p_species = species) and (places is null or list_bool_or(list_transform(string_split(places, '|'), lambda x: contains(location, x))))
and (age_min is null or age_months >= age_min) and (age_max is null or age_months <= age_max) and (p_size is null or p_size = size) and (p_sex is null or p_sex = sex))"""


def _matches(spark, sf_dir):
    prefs = spark.sql(_PREFS, customer=table(spark, sf_dir, "customer")).where("active and enabled").withColumn("prefectures", F.split("places", "[|]"))
    raw = records(spark, sf_dir)
    r = normalize.normalized(raw, AS_OF).drop("location").join(raw.select("id", "location"), "id")
    classes, members = reconcile.criteria_classes(prefs)
    return reconcile.class_matches(r, classes).select("class_id", "id", "source_url"), members


_CLASS = f"{_MATCH}, u as (select *, min(user_id) over (partition by p_species, places, age_min, age_max, p_size, p_sex) as class_id from p where active and enabled)"


@query(f"{_CLASS} select class_id, null as user_id, id, source_url from m join (select distinct class_id from u) on user_id = class_id union all select class_id, user_id, null, null from u")
def subscriber_match(spark, sf_dir):
    """Records by class of equal criteria, and the users of each class: every pair of user and record."""
    matches, members = _matches(spark, sf_dir)
    return matches.unionByName(members, allowMissingColumns=True).select("class_id", "user_id", "id", "source_url")


@query(f"{_CLASS} select user_id, class_id from u")
def subscriber_classes(spark, sf_dir):
    """Subscribers and the class of their criteria."""
    return _matches(spark, sf_dir)[1]


@query(f"{_MATCH} select user_id, count(*) as n from m where (user_id + id) % 4 <> 0 group by 1")
def subscriber_unnotified(spark, sf_dir):
    """Any earlier notification counts, whatever its status; here of a quarter of all pairs, which users of a group share."""
    matches, members = _matches(spark, sf_dir)
    groups = members.select("user_id", (F.col("user_id") % 4).alias("group")).distinct()
    told = records(spark, sf_dir).select(((4 - F.col("id") % 4) % 4).alias("group"), "source_url")
    return reconcile.unnotified(matches, members, told, groups=groups)


@query(f"""{_MATCH}, t as (select user_id, count(*) as m, count(*) filter (where id <> user_id and id <> 2 * user_id) as n from m group by 1)
select cast(sum(m) as bigint) as matches, cast(sum(m - n) as bigint) as skipped, cast(sum(case when user_id % 5 <> 0 then n else 0 end) as bigint) as sent, cast(sum(case when user_id % 5 = 0 then n else 0 end) as bigint) as failed from t""")
def notification_totals(spark, sf_dir):
    """Totals of a run from counts by class."""
    matches, members = _matches(spark, sf_dir)
    told = members.select("user_id", F.explode(F.array(F.col("user_id"), 2 * F.col("user_id"))).alias("id")).join(records(spark, sf_dir).select("id", "source_url"), "id")
    results = members.select("user_id", (F.col("user_id") % 5 != 0).alias("ok")).distinct()
    return reconcile.notified(matches, members, told, results)


@query("""with l as (select distinct url from pages where page_id % 2 = 0), k as (select url, min(page_id) as page_id from pages where page_id % 3 = 0 group by 1)
select l.url, case when k.url is null then 'extract' else 'reuse' end as action, k.page_id from l left join k on k.url = l.url""")
def known_reuse(spark, sf_dir):
    """Listed URLs that an earlier run knows take its record, the others are to be extracted."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    known = p.where("page_id % 3 = 0").groupBy("url").agg(F.min("page_id").alias("page_id"))
    again, new = reconcile.reused(p.where("page_id % 2 = 0").select("url"), known, "url")
    return again.select("url", F.lit("reuse").alias("action"), "page_id").unionByName(new.select("url", F.lit("extract").alias("action"), F.lit(None).cast("long").alias("page_id")))


@query("""with e as (select user_id, event_type, max(event_id) as event_id from events where event_type in ('error', 'purchase') group by 1, 2) select user_id, arg_max(event_type, event_type) as origin, arg_max(event_id, event_type) as event_id from e group by 1""")
def merged_results(spark, sf_dir):
    """Of two results by user the second one wins."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase")).groupBy("user_id", F.col("event_type").alias("origin")).agg(F.max("event_id").alias("event_id"))
    return reconcile.right_wins(e.where("origin = 'error'"), e.where("origin = 'purchase'"), "user_id")


@query("""with u as (select user_id, 0 as part, min(event_id) as pos from events where event_type = 'error' group by 1 union all select user_id, 1, min(event_id) from events where event_type = 'purchase' and value > 50 group by 1),
c as (select user_id, part, pos from u qualify row_number() over (partition by user_id order by part, pos) = 1), t as (select user_id from c where user_id % 4 <> 0 order by part, pos, user_id limit 3)
select user_id, part, pos, user_id in (select user_id from t) as target from c""")
def fix_candidates(spark, sf_dir):
    """Candidates in order, each once; the first three that weren't attempted are targets."""
    e = table(spark, sf_dir, "events")
    tried = e.where("user_id % 4 = 0").select("user_id")
    return reconcile.capped([e.where("event_type = 'error'"), e.where("event_type = 'purchase' and value > 50")], "user_id", "event_id", 3, tried)


@query("""with p as (select page_id, url, regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) as folder, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, case when page_id % 4 > 0 then 'n' || (page_id % 4) end as name from pages)
select page_id, folder, name, host from p qualify row_number() over (partition by folder, name, host order by page_id) = 1""")
def distinct_sources(spark, sf_dir):
    """Sources once for each place, name and host."""
    n = F.col("page_id") % 4
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+/([^/?#]*)", 1).alias("folder"), F.when(n > 0, F.concat(F.lit("n"), n.cast("string"))).alias("name"), web.authority(F.col("url")).alias("host"))
    return reconcile.first_of(p, ["folder", "name", "host"], "page_id")


@query("""select c_custkey as user_id, case when c_custkey % 3 = 0 then 'new' when c_custkey % 2 = 0 then 'both' else 'old' end as origin, case when c_custkey % 3 = 0 or c_custkey % 2 = 0 then c_acctbal + 1 else c_acctbal end as value from customer""")
def preference_merge(spark, sf_dir):
    """Incoming preferences win by user."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    old, new = c.where("user_id % 3 <> 0"), c.where("user_id % 3 = 0 or user_id % 2 = 0").withColumn("value", F.col("value") + 1)
    both = old.alias("o").join(new.alias("n"), F.col("o.user_id") == F.col("n.user_id"), "full_outer")
    origin = F.when(F.col("o.user_id").isNull(), "new").when(F.col("n.user_id").isNull(), "old").otherwise("both")
    return both.select(F.coalesce("n.user_id", "o.user_id").alias("user_id"), origin.alias("origin"), F.coalesce("n.value", "o.value").alias("value"))


@query("""with e as (select user_id, event_type, event_id from events where event_type in ('signup', 'error', 'purchase')), l as (select user_id, arg_max(event_type, event_id) as last, count(*) filter (where event_type = 'error') as toggles from e group by 1)
select user_id, last <> 'error' as is_active, toggles % 2 = 0 as enabled, 0 as history from l""")
def account_state(spark, sf_dir):
    """The state that a log of account commands leaves."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "error", "purchase"))
    s = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"), F.count_if(F.col("event_type") == "error").alias("toggles"))
    return s.select("user_id", (F.col("last") != "error").alias("is_active"), (F.col("toggles") % 2 == 0).alias("enabled"), F.lit(0).alias("history"))


@query("""select sha256(url) as hash, min(page_id) as page_id, count(*) as n, not bool_or(page_id % 4 = 0) as is_new from pages group by 1""")
def save_with_hash(spark, sf_dir):
    """Save and register hashes in one pass."""
    p = table(spark, sf_dir, "pages")
    return p.groupBy(F.sha2("url", 256).alias("hash")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"), (~F.bool_or(F.col("page_id") % 4 == 0)).alias("is_new"))


@query("""with f as (select user_id, count(*) filter (where event_type = 'error') as failures, max(cast(ts as date)) filter (where event_type = 'error') as last from events group by 1)
select s_suppkey, coalesce(failures, 0) as failures from supplier left join f on s_suppkey = user_id where s_suppkey % 2 = 0 and s_suppkey % 3 <> 0 and not (coalesce(failures, 0) >= 15 and (last is null or date '2024-02-01' - last <= 14))""")
def eligible_sites(spark, sf_dir):
    """Mode, registry and the auto-skip of failing sites."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("failures"), F.max(F.col("ts").cast("date")).alias("last"))
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0 and s_suppkey % 3 <> 0")
    n = F.coalesce("failures", F.lit(0))
    skip = (n >= 15) & (F.col("last").isNull() | (F.datediff(F.lit("2024-02-01").cast("date"), "last") <= 14))
    return s.join(e, s.s_suppkey == e.user_id, "left").where(~skip).select("s_suppkey", n.alias("failures"))


@query(f"""with {RECORDS_CTE}, d as (select source_site, case when id % 2 = 0 then '/list1' else '/list2' end as page, source_url from records), u as (select distinct source_site, source_url from d)
select source_site, count(*) as n, count(*) filter (where contains(source_url, '/dog/')) as dogs from u group by 1""")
def union_with_side_map(spark, sf_dir):
    """The union of list pages, each detail once, with its species from a side map."""
    r = records(spark, sf_dir).select("source_site", "source_url", "id")
    both = r.where("id % 2 = 0").select("source_site", "source_url").union(r.where("id % 2 <> 0").select("source_site", "source_url")).distinct()
    side = r.select("source_url", web.url_species(F.col("source_url")).alias("kind")).distinct()
    return both.join(side, "source_url").groupBy("source_site").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "犬").alias("dogs"))


assert text.MISSING
