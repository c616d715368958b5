"""Rules that single sources need, each once, to be chosen by configuration."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import _parts, birth_date, make, yearless
from .text import blank_to_null, fold_digits, strip

# fixed values: months of an age word, looked up in this order
AGE_WORDS = (
    ("高齢", 120), ("老齢", 120), ("老犬", 120), ("老猫", 120), ("成犬", 36), ("成猫", 36), ("成熟", 36), ("中齢", 60), ("若犬", 18), ("若猫", 18), ("若齢", 18),
    ("仔犬", 3), ("子犬", 3), ("仔猫", 3), ("子猫", 3), ("幼齢", 3),
)
UNKNOWN_AGE, DEFAULT_AGE = ("不明", "ふめい", "未確認", "わからない", "わかりません"), 36


def months_text(n: Column) -> Column:
    return F.when(n >= 12, F.concat(F.floor(n / 12).cast("string"), F.lit("歳"))).otherwise(F.concat(n.cast("string"), F.lit("ヶ月")))


def with_legacy_age(df: DataFrame, column: str, out: str, as_of: Column) -> DataFrame:
    """Age text that the general rule reads: numbers stay, birthdays, ranges (mean) and age words become numbers, none means adult.

    Staged over projections, so that no date expression is repeated.
    """
    s, born, partial = F.col("_text"), F.col("_born"), F.col("_partial")
    md = r"(?:誕生日|生年月日)[：:\s　]*([0-9]{1,2})/([0-9]{1,2})"
    m, d = _parts(s, md, 2)
    months = lambda b: F.greatest((F.year(as_of) - F.year(b)) * 12 + F.month(as_of) - F.month(b), F.lit(0))
    span = r"([0-9]+)\s*[-~〜]\s*([0-9]+)\s*歳"
    lo, hi = _parts(s, span, 2)
    df = df.withColumn("_text", strip(F.coalesce(F.col(column), F.lit("")))).withColumn("_born", birth_date(fold_digits(s)))
    df = df.withColumn("_partial", make(F.year(as_of), m, d)).withColumn("_partial", F.when(partial > as_of, make(F.year(as_of) - 1, m, d)).otherwise(partial))
    df = df.withColumn("_n", F.coalesce(born, partial)).withColumn("_n", F.when(F.col("_n").isNotNull(), months(F.col("_n"))))
    rule = (
        F.when(s == "", months_text(F.lit(DEFAULT_AGE))).when(s.rlike(r"[0-9]+\s*[歳年]|[0-9]+\s*[ヶかカケ]月") & ~s.rlike(span) & ~s.contains("年月日"), s)
        .when(F.col("_n").isNotNull(), months_text(F.col("_n"))).when(s.rlike(span), F.concat(F.floor((lo + hi) / 2).cast("string"), F.lit("歳")))
    )
    for word, n in AGE_WORDS:
        rule = rule.when(s.contains(word), months_text(F.lit(n)))
    for word in UNKNOWN_AGE:
        rule = rule.when(s.contains(word), months_text(F.lit(DEFAULT_AGE)))
    return df.withColumn(out, rule.otherwise(s)).drop("_text", "_born", "_partial", "_n")


def not_ahead(c: Column, as_of: Column) -> Column:
    """An era or yearless date that lies ahead falls back by a year, as ISO text; other text stays."""
    era, md, long = r"R([0-9]{1,2})[.\s　]+([0-9]{1,2})/([0-9]{1,2})", "^([0-9]{1,2})/([0-9]{1,2})", "令和([0-9]+)年([0-9]+)月([0-9]+)日"
    s = F.trim(c)
    y, m, d = _parts(s, era, 3)
    ym, yd = _parts(s, md, 2)
    ly, lm, ld = _parts(s, long, 3)
    iso = lambda x: F.date_format(x, "yyyy-MM-dd")
    back = lambda yy, mm, dd: F.when(make(yy, mm, dd) > as_of, make(yy - 1, mm, dd)).otherwise(make(yy, mm, dd))
    return (
        F.when(s.rlike(era) & make(y + 2018, m, d).isNotNull(), iso(back(y + 2018, m, d)))
        .when(s.rlike(md) & make(F.year(as_of), ym, yd).isNotNull(), iso(back(F.year(as_of), ym, yd)))
        .when(s.rlike(long) & (make(ly + 2018, lm, ld) > as_of), iso(make(ly + 2017, lm, ld))).otherwise(c)
    )


# fixed values: words that name a species in a breed, and in a page
DOG_WORDS, CAT_WORDS = "犬|いぬ|イヌ", "猫|ねこ|ネコ"
DOG_PHRASES, CAT_PHRASES = "保護犬|譲渡犬|迷い犬", "保護猫|譲渡猫|迷い猫|負傷猫"


def species_by_content(breed: Column, page: Column) -> Column:
    """A breed that names a species stays, else phrases of the page decide, dogs first; else the breed."""
    return F.when(breed.rlike(f"{DOG_WORDS}|{CAT_WORDS}"), breed).when(page.rlike(DOG_PHRASES), "犬").when(page.rlike(CAT_PHRASES), "猫").otherwise(breed)


def date_and_place(c: Column) -> tuple[Column, Column]:
    """A leading date and the rest; without a date all is the first part."""
    p = r"^((?:令和[0-9]+年|[0-9]{4}年)?[0-9]{1,2}月[0-9]{1,2}日|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2})[\s　]*(.*)$"
    return F.when(c.rlike(p), F.regexp_extract(c, p, 1)).otherwise(c), F.when(c.rlike(p), F.regexp_extract(c, p, 2)).otherwise("")


def kind_and_sex(c: Column) -> tuple[Column, Column]:
    """Cut at the last sex mark."""
    p = "^(.*)([♂♀雄雌])[^♂♀雄雌]*$"
    return F.when(c.rlike(p), strip(F.regexp_extract(c, p, 1))).otherwise(c), blank_to_null(F.regexp_extract(c, p, 2))


def completed_year(month: Column, day: Column, heading: Column) -> Column:
    """The heading's year; a later month and day belong to the year before."""
    late = (month * 100 + day) > (F.month(heading) * 100 + F.dayofmonth(heading))
    return make(F.year(heading) - late.cast("int"), month, day)


def birth_month(c: Column) -> Column:
    """A birth month gets day 1."""
    return F.regexp_replace(c, "([0-9]{4}年[0-9]{1,2}月)(?![0-9])", "$11日")


def token_role(t: Column) -> Column:
    """P10: what an unlabelled token says."""
    return F.when(t.rlike("オス|メス|♂|♀|雄|雌"), "sex").when(t.rlike("[0-9０-９]+(?:歳|か月|ヶ月)|齢"), "age").when(t.rlike("[茶白黒灰]|キジ|三毛色"), "color").when(t.rlike("雑種|柴|プードル"), "breed").otherwise("other")


def species_by_name(c: Column, other: str = "") -> Column:
    """A site's name as the last resort."""
    return F.when(c.contains("犬"), "犬").when(c.contains("猫"), "猫").otherwise(other)


def first_keyword(c: Column, pairs: Mapping[str, str], default: str = "") -> Column:
    """The value of the first keyword, in the order given, that a text holds; the default without any and for null."""
    return reduce(lambda rest, kv: F.when(c.contains(kv[0]), kv[1]).otherwise(rest), reversed(list(pairs.items())), F.lit(default))


def said_fields(text: Column, labels: Mapping[str, str]) -> dict[str, Column]:
    """A column a field from ``label: value`` parts of free text, null where none is said.

    Parts end at line breaks and after full stops; a label of at most eight
    characters counts if it is one of ``labels`` or holds one (equal ones
    first, then in the order given), and a field takes its first value.
    """
    part = r"^\s*([^:：]{1,8})\s*[:：]\s*(.+)$"
    label = lambda x: strip(F.regexp_extract(x, part, 1))
    said = F.filter(F.transform(F.split(text, r"[\n\r]+|(?<=。)", -1), lambda x: F.trim(x)), lambda x: x.rlike(part))
    named = F.transform(said, lambda x: F.struct(_field(label(x), labels).alias("field"), strip(F.regexp_extract(x, part, 2)).alias("value")))
    first = lambda f: F.get(F.filter(named, lambda x: (x["field"] == f) & (x["value"] != "")), F.lit(0))["value"]
    return {f: first(f) for f in dict.fromkeys(labels.values())}


def _field(label: Column, labels: Mapping[str, str]) -> Column:
    tests = [(label == k, f) for k, f in labels.items()] + [(label.contains(k), f) for k, f in labels.items()]
    return reduce(lambda rest, t: F.when(t[0], t[1]).otherwise(rest), reversed(tests), F.lit(None).cast("string"))


def source_date(c: Column, form: Column, as_of: Column) -> Column:
    """The day of arrival as single sources write it, as ISO text; '' without one.

    ``form`` says how: ``any`` (an era date, else a full one), ``era_text`` (the
    era date as it stands, without blanks), ``labelled`` (a full date behind
    【収容日】), ``past_day`` (month and day of the last twelve months), ``full``
    (a full date only).
    """
    gap = r"[\s　]*"
    era = f"令和{gap}([0-9]+){gap}年{gap}([0-9]{{1,2}}){gap}月{gap}([0-9]{{1,2}}){gap}日"
    full, label, day = "([0-9]{4})[年/-]([0-9]{1,2})[月/-]([0-9]{1,2})", "【収容日】([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日", "([0-9]{1,2})月([0-9]{1,2})日"
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")

    def iso(pattern: str, shift: int = 0) -> Column:
        y, m, d = _parts(c, pattern, 3)
        return F.when(c.rlike(pattern), F.concat_ws("-", pad(y + shift, 4), pad(m, 2), pad(d, 2)))

    m, d = _parts(c, day, 2)
    this = make(F.year(as_of), m, d)
    past = F.date_format(F.when(this > as_of, make(F.year(as_of) - 1, m, d)).otherwise(this), "yyyy-MM-dd")
    found = (
        F.when(form == "any", F.coalesce(iso(era, 2018), iso(full))).when(form == "era_text", F.regexp_replace(F.regexp_extract(c, era, 0), r"[\s　]+", ""))
        .when(form == "labelled", iso(label)).when(form == "past_day", past).when(form == "full", iso(full))
    )
    return F.coalesce(found, F.lit(""))


def complete_row(date: Column, *others: Column) -> Column:
    """A row read from a file counts if it has a date and anything else."""
    filled = lambda c: F.coalesce(strip(c), F.lit("")) != ""
    return filled(date) & reduce(lambda a, b: a | b, map(filled, others), F.lit(False))


def serial_number(c: Column) -> Column:
    """What follows the separator of a numbered heading, wide slashes first; '' without one."""
    after = lambda sep: F.trim(F.substr(c, F.instr(c, sep) + 1))
    return reduce(lambda rest, sep: F.when(c.contains(sep), after(sep)).otherwise(rest), (":", "：", "/", "／"), F.lit(""))


def decoded_again(c: Column, known: str = "札幌|犬") -> Column:
    """P20: a text whose UTF-8 bytes were read as single characters is read again; others, and those with a known word, stay."""
    raw = F.encode(F.when(c.rlike("^[\\x{00}-\\x{ff}]*$"), c), "ISO-8859-1").cast("string")
    return F.when(c.rlike(known), c).otherwise(F.coalesce(F.try_validate_utf8(raw), c))


__all__ = ["birth_month", "completed_year", "date_and_place", "decoded_again", "first_keyword", "kind_and_sex", "months_text", "not_ahead", "said_fields", "serial_number", "species_by_content", "species_by_name", "token_role", "with_legacy_age", "yearless"]
