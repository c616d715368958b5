"""Criteria in free text, commands, and the conversation state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# fixed values
STATES = ("idle", "species", "prefectures", "age", "size", "sex", "done")
CITY = {"東京": "東京都", "大阪": "大阪府", "京都": "京都府", "北海道": "北海道"}
COMMANDS = (("キャンセル", "cancel"), ("停止", "stop"), ("再開", "resume"), ("設定", "settings"), ("ヘルプ", "help"))


def command(c: Column) -> Column:
    """N31."""
    s, out = text.strip(c), F
    for word, name in COMMANDS:
        out = out.when(s.contains(word), name)
    return out.otherwise("text")


def prefecture(c: Column) -> Column:
    """東京 to 東京都, others with 県 unless they end in one of 都道府県."""
    s, out = text.strip(c), F
    for short, full in CITY.items():
        out = out.when(s == short, full)
    return out.when(s.rlike("[都道府県]$"), s).otherwise(F.concat(s, F.lit("県")))


def prefectures(c: Column) -> Column:
    """A list split at commas and white space, each once."""
    parts = F.filter(F.split(c, "[、,，\\s　]+"), lambda x: x != "")
    return F.array_distinct(F.transform(parts, prefecture))


def age_range(c: Column) -> Column:
    """(lo, hi) in months; months where the text names them, else years; null where there is no number."""
    s = text.fold_digits(c)
    unit = F.when(s.rlike("月"), 1).otherwise(12)
    a, b = (F.nullif(F.regexp_extract(s, r"(\d+)\D*?(?:[〜~\-]|から)\D*?(\d+)", i), F.lit("")).try_cast("int") for i in (1, 2))
    one = F.nullif(F.regexp_extract(s, r"(\d+)", 1), F.lit("")).try_cast("int")
    lo = F.when(a.isNotNull(), a).when(s.rlike("以上|から"), one).when(s.rlike("以下|まで"), None).otherwise(one)
    hi = F.when(b.isNotNull(), b).when(s.rlike("以下|まで"), one).when(s.rlike("以上|から"), None).otherwise(one)
    return F.when(one.isNotNull(), F.struct((lo * unit).alias("lo"), (hi * unit).alias("hi")))


def step(state: Column, word: Column, valid: Column) -> Column:
    """The next state; cancel resets, invalid input stays."""
    out = F.when(word == "cancel", "idle")
    for a, b in zip(STATES, STATES[1:]):
        out = out.when((state == a) & valid, b)
    return out.otherwise(state)


def conversations(turns: DataFrame, key: str, order: str, word: str, valid: str) -> DataFrame:
    """(key, state, turns): a fold over each conversation's turns in order.

    A conversation is bounded by its own length; the fold runs in the JVM.
    """
    log = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(word).alias("w"), F.col(valid).alias("v"))))
    per = turns.groupBy(key).agg(log.alias("log"))
    return per.select(key, F.aggregate("log", F.lit("idle"), lambda s, t: step(s, t["w"], t["v"])).alias("state"), F.size("log").cast("long").alias("turns"))
