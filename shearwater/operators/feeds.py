"""Feed items, posts and messages as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, web


def item_description(c: dict[str, Column] | None = None) -> Column:
    """Labelled parts, the empty ones skipped."""
    part = lambda label, x: F.when(x.isNotNull() & (x != ""), F.concat(F.lit(label + ": "), x))
    return F.concat_ws("、", part("種別", F.col("species")), part("性別", F.col("sex")), part("年齢", text.human_age(F.col("age_months"))), part("毛色", F.col("color")), part("体格", F.col("size")), part("場所", F.col("location")))


def rss_items(rows: DataFrame) -> DataFrame:
    """G01."""
    return rows.select(
        "id", F.concat_ws(" - ", "species", "location").alias("title"), F.col("source_url").alias("link"), F.md5("source_url").alias("guid"),
        F.concat(F.date_format("shelter_date", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("pub_date"), item_description().alias("description"), F.get("image_urls", F.lit(0)).alias("enclosure"),
    )


def atom_entries(rows: DataFrame, domain: str, as_of: str) -> DataFrame:
    """G02."""
    return rows.select(
        "id", F.concat(F.lit(f"tag:{domain},{as_of}:"), F.md5("source_url")).alias("entry_id"), F.concat_ws(" - ", "species", "location").alias("title"),
        F.lit(f"{as_of}T00:00:00Z").alias("updated"), item_description().alias("summary"),
    )


def feed_title(filters: dict[str, str | None]) -> str:
    """G04."""
    parts = [v for v in filters.values() if v]
    return "保護動物情報" + (f" ({' / '.join(parts)})" if parts else "")


def query_string(filters: dict[str, str | None]) -> str:
    """G05."""
    from urllib.parse import urlencode

    return urlencode({k: v for k, v in filters.items() if v})


def rss_document(items: list[dict[str, str]], title: str, link: str, ttl: int = 60) -> str:
    """XML text of collected items."""
    from xml.sax.saxutils import escape

    body = "".join(f"<item><title>{escape(i['title'])}</title><link>{escape(i['link'])}</link><guid isPermaLink=\"false\">{i['guid']}</guid><pubDate>{i['pub_date']}</pubDate><description>{escape(i['description'] or '')}</description></item>" for i in items)
    return f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{escape(title)}</title><link>{escape(link)}</link><ttl>{ttl}</ttl>{body}</channel></rss>'


def post_text(rows: DataFrame, target: int = 180) -> Column:
    """Lines of a post; over the target the management line goes first, then the text is cut."""
    head = F.concat(F.lit("【"), F.col("species"), F.lit("】"), F.col("location"))
    manage = F.when(F.col("management_number").isNotNull(), F.concat(F.lit("管理番号: "), F.col("management_number")))
    url, tags = web.with_utm(F.col("source_url"), "social"), F.concat(F.lit("#保護動物 #"), F.col("species"))
    full = F.concat_ws("\n", head, F.col("description"), manage, tags, url)
    short = F.concat_ws("\n", head, F.col("description"), tags, url)
    room = F.lit(target) - F.length(url) - 1
    cut = F.concat_ws("\n", F.substring(F.concat_ws("\n", head, F.col("description"), tags), F.lit(1), F.greatest(room, F.lit(0))), url)
    return F.when(F.length(full) <= target, full).when(F.length(short) <= target, short).otherwise(cut)


def moderation(status: Column, body: Column) -> Column:
    """reasons to reject a post; empty means it may go out."""
    return F.array_compact(F.array(
        F.when(~status.isin("sheltered"), "status"), F.when(body.rlike(text.PHONES), "phone"), F.when(body.rlike(text.EMAILS), "email"),
    ))


def candidates(rows: DataFrame, posted: DataFrame, pool: int = 100) -> DataFrame:
    """open records with an image whose URL and identity haven't been posted, from the newest ``pool``."""
    newest = rows.where((F.col("status") == "sheltered") & (F.size("image_urls") > 0)).orderBy(F.desc("shelter_date"), F.desc("id")).limit(pool)
    keyed = newest.withColumn("identity", web.identity_key(F.get("image_urls", F.lit(0))))
    return keyed.join(posted.select("source_url"), "source_url", "left_anti").join(posted.where("identity is not null").select("identity"), "identity", "left_anti")


def decision(enabled: bool, has_candidate: Column, reasons: Column, dry_run: bool) -> Column:
    """G09."""
    return F.when(F.lit(not enabled), "disabled").when(~has_candidate, "no_candidate").when(F.size(reasons) > 0, "moderation_failed").when(F.lit(dry_run), "dry_run").otherwise("published")


def payload(rows: DataFrame, of: Sequence[str], source: str, timestamp: str) -> DataFrame:
    """(of..., animals, payload): the JSON text that the notifier is sent for each group of records, records in order of id.

    Group so that one request's records fit: they are one row.
    """
    fields = ("species", "sex", "age_months", "color", "size", "shelter_date", "location", "phone", "image_urls", "source_url", "category")
    day = F.date_format("shelter_date", "yyyy-MM-dd").alias("shelter_date")
    animal = F.struct(*(day if f == "shelter_date" else F.col(f) for f in fields))
    grouped = rows.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("i"), animal.alias("a")))).alias("every"))
    body = F.struct(F.transform("every", lambda x: x["a"]).alias("animals"), F.lit(source).alias("source"), F.lit(timestamp).alias("timestamp"))
    return grouped.select(*of, F.size("every").alias("animals"), F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def notification(rows: DataFrame) -> Column:
    """G10."""
    return F.concat_ws("\n", F.lit("新しい保護動物の情報です"), F.concat(F.lit("種別: "), F.col("species")), F.concat(F.lit("年齢: "), F.coalesce(text.human_age(F.col("age_months")), F.lit("不明"))), F.concat(F.lit("場所: "), F.col("location")), F.col("source_url"))
