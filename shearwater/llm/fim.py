"""Fill-in-the-middle: cut texts into prefix, middle and suffix, put them in another order behind sentinels, and restore them.

Native Spark SQL throughout: one ``regexp_extract_all`` makes the array of
units, digits of a SHA-256 of the row's id choose cuts and form, ``slice`` and
``array_join`` build the parts.  Rows don't meet, so nothing is shuffled.
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a text is cut between: code points, words with the blanks behind them, or lines with their ends.
UNITS = {"char": r"(?s).", "word": r"(?s)\s+|\S+\s*", "line": r"[^\n]*\n|[^\n]+"}


@dataclasses.dataclass(frozen=True)
class Plan:
    """How texts are arranged: sentinels, unit, seed and the shares in percent."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = "char"
    seed: int = 1
    changed: int = 90
    spm: int = 20

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if self.unit not in UNITS:
            raise ValueError(f"unit is one of {', '.join(UNITS)}")
        # a mark that another one overlaps could be found across a seam
        if not all(marks) or any((a != b and b.find(a) >= 0) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))) for a in marks for b in marks) or len(set(marks)) < 3:
            raise ValueError("sentinels must differ, hold something and not overlap themselves or each other")

    @property
    def any_mark(self) -> str:
        return "|".join(re.escape(m) for m in (self.prefix, self.suffix, self.middle))


def _digits(key: Column, group: int) -> Column:
    """The unsigned integer of the ``group``-th (from 1) eight hex digits."""
    return F.conv(F.substring(key, 8 * group - 7, 8), 16, 10).cast("long")


def arranged(docs: DataFrame, plan: Plan = Plan(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the column ``fim`` appended (replacing one of that name).

    ``fim`` is a struct of n (units), form ("plain", "psm" or "spm"), output,
    prefix and middle (null if plain).  Cuts and form follow only from the seed
    and the row's id: repeated ids cut alike, a null id counts as an empty one.
    Null texts count as empty; empty texts, and texts that hold a sentinel, stay
    plain.  Texts may have any length (memory of a row: its units).  Equal cuts
    give an empty middle.  All rows, repeated ones too, and other columns stay.
    An empty table gives no rows.
    """
    key = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(docs[doc_id].cast("string"), F.lit(""))), 256)
    # struct fields, so that no name of ours meets a column of the caller; one projection a step computes each once
    made = docs.withColumn("fim", F.struct(F.coalesce(docs[text], F.lit("")).alias("text"), key.alias("key")))
    made = made.withColumn("fim", F.struct("fim.text", "fim.key", F.regexp_extract_all("fim.text", F.lit(UNITS[plan.unit]), F.lit(0)).alias("units")))
    n = F.size("fim.units").cast("long")
    one, two = (F.pmod(_digits(F.col("fim.key"), k), n + 1).cast("int") for k in (1, 2))
    marked = F.contains("fim.text", F.lit(plan.prefix)) | F.contains("fim.text", F.lit(plan.suffix)) | F.contains("fim.text", F.lit(plan.middle))
    plain = (F.col("fim.text") == "") | marked | (_digits(F.col("fim.key"), 3) % 100 >= plan.changed)
    form = F.when(plain, "plain").when(_digits(F.col("fim.key"), 4) % 100 < plan.spm, "spm").otherwise("psm")
    made = made.withColumn("fim", F.struct("fim.text", "fim.units", n.alias("n"), form.alias("form"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b")))
    part = lambda start, size: F.array_join(F.slice("fim.units", start, size), "")
    cut = F.col("fim.form") != "plain"
    a, b = F.col("fim.a"), F.col("fim.b")
    parts = F.when(cut, F.struct(part(F.lit(1), a).alias("prefix"), part(a + 1, b - a).alias("middle"), part(b + 1, F.col("fim.n").cast("int") - b).alias("suffix")))
    made = made.withColumn("fim", F.struct("fim.text", "fim.n", "fim.form", parts.alias("parts")))
    prefix, middle, suffix = (F.concat(F.lit(m), f"fim.parts.{k}") for m, k in ((plan.prefix, "prefix"), (plan.middle, "middle"), (plan.suffix, "suffix")))
    output = F.when(F.col("fim.form") == "psm", F.concat(prefix, suffix, middle)).when(F.col("fim.form") == "spm", F.concat(suffix, prefix, middle)).otherwise(F.col("fim.text"))
    return made.withColumn("fim", F.struct("fim.n", "fim.form", output.alias("output"), "fim.parts.prefix", "fim.parts.middle"))


def restored(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text before it was arranged: parts between the sentinels in their first order, plain texts as they are.

    Null if the output or the form is; null too if the sentinels of an arranged text aren't all there in order.
    """
    order = {"psm": (plan.prefix, plan.suffix, plan.middle), "spm": (plan.suffix, plan.prefix, plan.middle)}
    pieces = F.split(output, plan.any_mark, -1)

    def built(name: str) -> Column:
        marks = order[name]
        text = F.concat(*(F.get(pieces, F.lit(marks.index(m) + 1)) for m in (plan.prefix, plan.middle, plan.suffix)))
        at = [F.locate(m, output) for m in marks]
        return F.when((F.size(pieces) == 4) & (at[0] == 1) & (at[1] > 1) & (at[2] > at[1]), text)

    return F.when(form == "plain", output).when(form == "psm", built("psm")).when(form == "spm", built("spm"))


def digest(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Counts and digests of ``arranged`` and ``restored``, a row each; odd rows as described there."""
    made = arranged(docs.select("doc_id", "text"), plan)
    made = made.select("doc_id", "fim", restored(F.col("fim.output"), F.col("fim.form"), plan).alias("back"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select(
        "doc_id", "fim.n", "fim.form", F.length("fim.prefix").cast("long").alias("prefix_chars"), F.length("fim.middle").cast("long").alias("middle_chars"),
        sha(F.col("fim.output")).alias("output_sha256"), sha(F.col("back")).alias("restored_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
