"""From raw listing records to normalized ones, in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text, web


def normalized(raw: DataFrame, as_of: str) -> DataFrame:
    """All scalar rules at once; the order of rules follows the record: images, date, location, then the other fields."""
    today = F.to_date(F.lit(as_of))
    raw = dates.with_age(raw, "age", "_months", today)
    raw = raw.withColumn("_day", dates.folded(F.col("shelter_date"))).withColumn("_day", dates.shelter_date(F.col("_day"), today, ready=True)).withColumn("_phone", web.phone(F.col("phone")))
    day, estimated = dates.clamped(F.col("_day"), today)
    return raw.select(
        "id", "source_url", "source_site", "category", "price",
        text.species(F.col("species")).alias("species"), text.sex(F.col("sex")).alias("sex"), F.col("_months").alias("age_months"),
        text.color(F.col("color")).alias("color"), text.size(F.col("size")).alias("size"), day.alias("shelter_date"), estimated.alias("shelter_date_estimated"),
        text.coarse_location(F.col("location"), F.col("category")).alias("location"), web.prefecture(F.col("source_url")).alias("prefecture"),
        web.public_phone(F.col("_phone")).alias("phone"), web.images(F.split("imgs", " ")).alias("image_urls"),
        text.cap(F.col("breed"), 50).alias("breed"), text.cap(F.col("name"), 100).alias("name"), text.cap(F.col("management_number"), 50).alias("management_number"),
        text.description(F.col("description")).alias("description"), F.coalesce("status", F.lit("sheltered")).alias("status"),
    )


def rejects(records: DataFrame) -> DataFrame:
    """``records`` with the first reason for which a record is invalid; null where it is valid."""
    return records.withColumn(
        "reject_reason",
        F.when(~F.col("species").isin("犬", "猫", "その他"), "species").when(~F.col("sex").isin("男の子", "女の子", "不明"), "sex")
        .when(~F.col("category").isin("adoption", "lost", "sheltered"), "category").when(F.col("age_months") < 0, "age_months"),
    )


def backfilled(prefecture: Column, url: Column, needles: tuple[tuple[str, str], ...]) -> Column:
    """A null or empty prefecture from the URL; the first needle wins; idempotent."""
    out = F
    for needle, name in needles:
        out = out.when(url.contains(needle), name)
    return F.when(F.coalesce(prefecture, F.lit("")) == "", out.otherwise(prefecture)).otherwise(prefecture)


def anomalies(rows: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field, value, reason), one row a finding: comparison words in breed, notices in name, tags and entities anywhere."""
    found = []
    for f in fields:
        c = F.col(f)
        if f == "breed":
            found.append(F.when(text.has_any(c, text.COMPARISON), F.struct(F.lit(f).alias("field"), c.alias("value"), F.lit("comparison").alias("reason"))))
        if f == "name":
            found.append(F.when(c.contains("※"), F.struct(F.lit(f).alias("field"), c.alias("value"), F.lit("notice").alias("reason"))))
        for reason, p in (("html_tag", "<[a-zA-Z/][^>]*>"), ("html_entity", "&[a-z]+;|&#[0-9]+;")):
            found.append(F.when(c.rlike(p), F.struct(F.lit(f).alias("field"), F.substring(c, 1, 80).alias("value"), F.lit(reason).alias("reason"))))
    return rows.select(key, F.inline(F.array_compact(F.array(*found))))
