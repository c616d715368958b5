"""Filtered, ordered and paged reads."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

STATUSES, CATEGORIES, SORTS = ("sheltered", "adopted", "returned", "deceased"), ("adoption", "lost", "sheltered"), ("newest", "oldest")
SEARCHED = ("species", "color", "size", "location", "prefecture")


@dataclass(frozen=True)
class ListFilter:
    """Optional predicates; None and empty strings don't filter."""

    species: str | None = None
    sex: str | None = None
    location: str | None = None
    prefecture: str | None = None
    category: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    status: str | None = None
    q: str | None = None
    include_non_public: bool = False
    sort: str = "newest"
    limit: int = 50
    offset: int = 0

    def __post_init__(self) -> None:
        """F14."""
        for name, allowed in (("status", STATUSES), ("category", CATEGORIES), ("sort", SORTS)):
            value = getattr(self, name)
            if value and value not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if not 1 <= self.limit <= 1000:
            raise ValueError("limit must be between 1 and 1000")
        if self.offset < 0:
            raise ValueError("offset must not be negative")


# fixed values: parts that no value of a feed's request may hold, and how long a request may be
UNWANTED, LONGEST = ("<", ">", "script", "SELECT", "DROP", "INSERT", "DELETE", "UPDATE"), 1000
FEED_VALUES = {"species": ("犬", "猫", "その他"), "category": CATEGORIES, "status": STATUSES, "sex": ("男の子", "女の子", "不明")}


def feed_request(params: dict[str, object], limit: int = 50) -> dict[str, object]:
    """the parameters that are set, checked in order: length, unwanted parts, known values, limit."""
    given = {k: v for k, v in params.items() if v is not None}
    if len("&".join(f"{k}={v}" for k, v in given.items())) > LONGEST:
        raise ValueError("the request is too long")
    for k, v in given.items():
        if any(part in str(v) for part in UNWANTED):
            raise ValueError(f"invalid parameter: {k}")
    for k, allowed in FEED_VALUES.items():
        if given.get(k) and given[k] not in allowed:
            raise ValueError(f"invalid parameter: {k}")
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return given


def keyword(df: DataFrame, q: str):
    """case-insensitive literal search in the searched columns, and in breed under all kana spellings."""
    low = q.lower()
    tests = [F.lower(F.col(c)).contains(low) for c in SEARCHED if c in df.columns]
    if "breed" in df.columns:
        tests += [F.lower(F.col("breed")).contains(v.lower()) for v in text.kana_variants(q)]
    return reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests))


def filtered(df: DataFrame, f: ListFilter) -> DataFrame:
    """The predicates as one plan; equality, substring and range predicates reach the scan."""
    for c in ("species", "sex", "prefecture", "category", "status"):
        if getattr(f, c):
            df = df.where(F.col(c) == getattr(f, c))
    if f.location:
        df = df.where(F.col("location").contains(f.location))
    if f.date_from:
        df = df.where(F.col("shelter_date") >= F.lit(f.date_from).cast("date"))
    if f.date_to:
        df = df.where(F.col("shelter_date") <= F.lit(f.date_to).cast("date"))
    if not f.include_non_public and not f.status:
        df = df.where(~F.col("status").eqNullSafe("deceased"))  # null is kept
    return df.where(keyword(df, f.q)) if f.q else df


def page(df: DataFrame, f: ListFilter) -> DataFrame:
    """The ordered page; id breaks ties.  One TakeOrderedAndProject, no full sort."""
    up = f.sort == "oldest"
    order = [F.asc("shelter_date"), F.asc("id")] if up else [F.desc("shelter_date"), F.desc("id")]
    return filtered(df, f).orderBy(*order).offset(f.offset).limit(f.limit)


def page_meta(df: DataFrame, f: ListFilter) -> DataFrame:
    """Total, page, pages, has_next as one row."""
    total = F.count("*")
    return filtered(df, f).agg(
        total.alias("total"), F.lit(-(-(f.offset + f.limit) // f.limit)).cast("long").alias("page"),
        F.ceil(total / f.limit).cast("long").alias("pages"), (total > f.offset + f.limit).alias("has_next"),
    )


#: F16: what a public record shows.
PUBLIC = ("id", "species", "sex", "age_months", "color", "size", "shelter_date", "location", "prefecture", "phone", "image_urls", "source_url", "category", "breed", "name", "description", "status")


def public(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in PUBLIC if c in df.columns))


def archivable(df: DataFrame, as_of: str, days: int = 180, limit: int | None = None) -> DataFrame:
    """Settled long enough ago, oldest change first."""
    df = df.where(F.col("status").isin("adopted", "returned") & (F.col("status_changed_at") <= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))))
    return df.orderBy("status_changed_at", "id").limit(limit) if limit else df


assert {f.name for f in fields(ListFilter)} >= {"species", "q"}
