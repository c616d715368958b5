"""Dates and ages in free text.  ``as_of`` stands for today in every function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank_to_null, extract, fold_digits, number, strip

_S = r"[\s　]*"


def make(y: Column, m: Column, d: Column) -> Column:
    """A date, or null where there is no such day."""
    dash = F.lit("-")
    return F.concat(F.lpad(y.cast("string"), 4, "0"), dash, F.lpad(m.cast("string"), 2, "0"), dash, F.lpad(d.cast("string"), 2, "0")).try_cast("date")


def yearless(m: Column, d: Column, as_of: Column) -> Column:
    """This year; more than 30 days ahead means last year."""
    this = make(F.year(as_of), m, d)
    return F.when(F.datediff(this, as_of) > 30, make(F.year(as_of) - 1, m, d)).otherwise(this)


def _parts(c: Column, pattern: str, n: int) -> list[Column]:
    return [number(F.regexp_extract(c, pattern, i + 1)) for i in range(n)]


def folded(c: Column) -> Column:
    return fold_digits(strip(c))


def shelter_date(c: Column, as_of: Column, ready: bool = False) -> Column:
    """The first form that fits decides; null where none does.  ``ready``: the text is folded already."""
    s = c if ready else folded(c)
    iso = "^([0-9]{4})-([0-9]{2})-([0-9]{2})$"
    era = "令和([0-9]+)年([0-9]{1,2})月([0-9]{1,2})日"
    short = r"R([0-9]+)(?:\.|[\s　]+)([0-9]{1,2})/([0-9]{1,2})"
    dots = r"R([0-9]+)\.([0-9]{1,2})\.([0-9]{1,2})"
    month_day = "^([0-9]{1,2})月([0-9]{1,2})日"
    slash = "([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})"
    kanji = "([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日"
    md = "^([0-9]{1,2})/([0-9]{1,2})"

    def of_era(p: str) -> Column:
        y, m, d = _parts(s, p, 3)
        return F.when(y >= 1, make(y + 2018, m, d))

    return (
        F.when(s.rlike(iso), make(*_parts(s, iso, 3))).when(s.rlike(era), of_era(era)).when(s.rlike(short), of_era(short)).when(s.rlike(dots), of_era(dots))
        .when(s.rlike(month_day) & yearless(*_parts(s, month_day, 2), as_of).isNotNull(), yearless(*_parts(s, month_day, 2), as_of))
        .when(s.rlike(slash), make(*_parts(s, slash, 3))).when(s.rlike(kanji), make(*_parts(s, kanji, 3))).when(s.rlike(md), yearless(*_parts(s, md, 2), as_of))
    )


def clamped(date: Column, as_of: Column) -> tuple[Column, Column]:
    """(date, estimated): a missing or future date becomes today."""
    bad = date.isNull() | (date > as_of)
    return F.when(bad, as_of).otherwise(date), bad


def months_between(birth: Column, as_of: Column) -> Column:
    """Whole calendar months, null for a birth date ahead."""
    m = (F.year(as_of) - F.year(birth)) * 12 + F.month(as_of) - F.month(birth) - F.when(F.dayofmonth(as_of) < F.dayofmonth(birth), 1).otherwise(0)
    return F.when(birth <= as_of, F.greatest(m, F.lit(0)))


def birth_date(s: Column) -> Column:
    """The first matching form decides, even when there is no such day."""
    forms = (("([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", 0), ("([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})", 0), ("([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日", 0), ("令和([0-9]+)年([0-9]{1,2})月([0-9]{1,2})日", 2018), (r"R([0-9]+)\.([0-9]{1,2})\.([0-9]{1,2})", 2018))
    out = None
    for p, base in forms:
        y, m, d = _parts(s, p, 3)
        out = (F if out is None else out).when(s.rlike(p), make(y + base, m, d))
    return out


_MONTH = "(?:ヶ|か|カ|ヵ|ケ|箇)?月"
_YEAR_MONTH, _YEARS, _MONTHS, _WEEKS = f"([0-9]+)歳{_S}([0-9]+){_S}{_MONTH}", "([0-9]+)歳", f"([0-9]+){_S}(?:ヶ|か|カ|ヵ|ケ|箇)月", f"([0-9]+){_S}週齢"
_YM, _ERA_YM, _YY, _BARE = "([0-9]{4})年([0-9]{1,2})月", "令和([0-9]+)年([0-9]{1,2})月", "([0-9]{4})年", "([0-9]+)年"


def with_age(df: DataFrame, column: str, out: str, as_of: Column) -> DataFrame:
    """Age in months by the first form that fits; over 360 is implausible and null.

    In three projections, so that no expression is repeated inside another:
    the folded text, the birth date it names, and the months.
    """
    s, full, born = F.col("_age"), F.col("_full"), F.col("_born")
    one = lambda p: number(F.regexp_extract(s, p, 1))
    two = lambda p: number(F.regexp_extract(s, p, 2))
    first = lambda y, m: make(y, m, F.lit(1))
    partial = (
        F.when(full.isNotNull(), full).when(s.rlike(_ERA_YM), first(one(_ERA_YM) + 2018, two(_ERA_YM)))
        .when(s.rlike(_YM), first(one(_YM), two(_YM))).when(s.rlike(_YY), first(one(_YY), F.lit(1)))
    )
    n = (
        F.when(s.rlike(_YEAR_MONTH), one(_YEAR_MONTH) * 12 + two(_YEAR_MONTH)).when(s.rlike(_YEARS), one(_YEARS) * 12)
        .when(s.rlike(_MONTHS), one(_MONTHS)).when(s.rlike(_WEEKS), F.floor(one(_WEEKS) / 4).cast("int"))
        .when(s == "幼齢", 3).when(s == "若齢", 12).when(s == "中齢", 60).when(s == "高齢", 120)
        .when(full.isNotNull() | s.rlike(f"{_ERA_YM}|{_YM}|{_YY}"), months_between(born, as_of)).when(s.rlike(_BARE), one(_BARE) * 12)
    )
    df = df.withColumn("_age", F.regexp_replace(folded(F.col(column)), "才", "歳"))
    df = df.withColumn("_full", birth_date(s)).withColumn("_born", partial).withColumn("_n", n)
    return df.withColumn(out, F.when(F.col("_n") <= 360, F.col("_n").cast("int"))).drop("_age", "_full", "_born", "_n")


def day_text(c: Column) -> Column:
    """YYYY-MM-DD, or null where the text is no timestamp."""
    return F.date_format(F.try_to_timestamp(blank_to_null(c)), "yyyy-MM-dd")


__all__ = ["birth_date", "clamped", "day_text", "extract", "make", "months_between", "shelter_date", "with_age", "yearless"]
