"""Personal data by candidate gradient boosting, in DataFrame expressions only.

Fixed patterns give the base spans, which always stay.  High-recall generators
propose further, overlapping candidates (national phone numbers, identity
numbers, account numbers, spelled-out addresses); boosted depth-2 trees over
format and context features score them, Platt scaling calibrates the scores,
and a threshold for each kind, set for precision, selects what is added.

The trees are fitted in the driver on labelled candidates drawn from a fixed
grammar (FIT_ROWS of them, the same on every run) and become one column
expression; no Python runs on executors.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Possessive forms match what the plain ones do, without backtracking; a start inside a run of the first class is
# never the leftmost, so only run starts (or the end of the match before) are tried.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of 16 to 19 digits with single separators.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of further candidates.
MORE = {
    "tel": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "idnum": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])",
    "spelled": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,64})++",
}
CONTEXT = 24
CUES = {
    "tel": r"(?i)(?:tel|phone|call|fax|mobile|cell|contact|tfno|téléphone|telefon)(?:\W{1,3}\w{1,6}){0,2}\W{0,6}$",
    "idnum": r"(?i)(?:ssn|social|security|identity|\bid)(?:\W{1,3}\w{1,6}){0,2}\W{0,6}$",
    "iban": r"(?i)(?:iban|account|konto|cuenta|compte|bank)(?:\W{1,3}\w{1,6}){0,2}\W{0,6}$",
    "spelled": r"(?i)(?:mail|contact|write|reach)(?:\W{1,3}\w{1,6}){0,2}\W{0,6}$",
}
AGAINST = r"(?i)(?:order|invoice|version|part|serial|model|isbn|ref|page|no\.?|#|sku|build|lot)\W{0,4}$"
FEATURES = ("cue", "against", "digits", "length", "kinds", "groups", "equal", "zero", "valid")
FIT_ROWS, TREES, RATE, PRECISION = 4000, 30, 0.3, 0.97


# ---- features, once for rows of the fixed grammar and once as columns ----

def features(kind: str, value: str, before: str) -> list[float]:
    digits = re.sub("[^0-9]", "", value)
    return [
        float(bool(re.search(CUES[kind], before))), float(bool(re.search(AGAINST, before))), float(len(digits)), float(len(value)),
        float(len(set(digits))), float(len(re.split("[^0-9A-Za-z]+", value))), float(bool(re.search("[=#/]$", before))), float(digits[:1] in ("0", "1") or digits[:3] in ("666", "900")),
        float(kind in ("tel", "spelled") or kind == "idnum" and "00" not in (digits[3:5],) and digits[5:] != "0000" or kind == "iban" and 15 <= len(value) <= 34 and len(digits) >= 10),
    ]


def feature_columns(kind: str, value: Column, before: Column) -> dict[str, Column]:
    digits = F.regexp_replace(value, "[^0-9]", "")
    number = lambda c: c.cast("double")
    if kind in ("tel", "spelled"):
        valid = F.lit(1.0)
    elif kind == "idnum":
        valid = number((F.substring(digits, 4, 2) != "00") & (F.substring(digits, 6, 9) != "0000"))
    else:
        valid = number(F.length(value).between(15, 34) & (F.length(digits) >= 10))
    return {
        "cue": number(before.rlike(CUES[kind])), "against": number(before.rlike(AGAINST)), "digits": number(F.length(digits)), "length": number(F.length(value)),
        "kinds": number(F.size(F.array_distinct(F.filter(F.split(digits, ""), lambda x: x != "")))), "groups": number(F.size(F.split(value, "[^0-9A-Za-z]+", -1))),
        "equal": number(before.rlike("[=#/]$")), "zero": number(F.substring(digits, 1, 1).isin("0", "1") | F.substring(digits, 1, 3).isin("666", "900")), "valid": valid,
    }


def grammar(n: int, seed: int) -> list[tuple[str, str, str, int]]:
    """(kind, value, text before it, label): labelled candidates of a fixed grammar."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    words = "the and of to data was for entre avec und der los para result table".split()
    out = []
    for _ in range(n):
        kind, good = rng.choice(list(MORE)), rng.random() < 0.5
        sep = rng.choice(" .-")
        cue = {"tel": ["tel: ", "phone ", "call me at ", "Mobile: "], "idnum": ["SSN ", "social security no: ", "ssn: "], "iban": ["IBAN ", "account: ", "bank acct "], "spelled": ["mail: ", "contact ", "write to "]}[kind]
        lead = " ".join(rng.choices(words, k=3)) + " "
        bad = rng.choice(["order ", "invoice #", "version ", "part no ", "ref: ", "serial=", "sku "])
        before = lead + (rng.choice(cue) if rng.random() < (0.75 if good else 0.01) else "" if good or rng.random() < 0.4 else bad)
        if kind == "tel":
            value = f"({rng.randint(200, 989)}) {d(3)}-{d(4)}" if rng.random() < 0.4 else sep.join((str(rng.randint(200, 989)) if good else d(3), d(3), d(4)))
        elif kind == "idnum":
            value = f"{rng.randint(101, 665)}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" if good else rng.choice([f"000-{d(2)}-{d(4)}", f"{d(3)}-00-{d(4)}", f"{d(3)}-{d(2)}-0000", f"{d(3)}-{d(2)}-{d(4)}"])
        elif kind == "iban":
            value = rng.choice(["DE", "FR", "ES", "GB"]) + d(2) + (d(18) if good else "".join(rng.choices("ABCDEFGHJKMNPQRSTUVWXYZ0123456789", k=rng.randint(11, 20))))
        else:
            value = f"{rng.choice(words)}{d(2)} [at] {rng.choice(words)}" + rng.choice([".com", " [dot] org"])
            if not good:
                value, before = f"meet (at) {rng.choice(words)}.{rng.choice(words)}", lead
        out.append((kind, value, before[-CONTEXT:], int(good)))
    return out


# ---- boosting ----

def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
    best = (0.0, -1, 0.0)
    total = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        for at in np.unique(x[:, f])[1:]:
            left = x[:, f] < at
            gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - total
            if gain > best[0] + 1e-9:
                best = (float(gain), f, float(at))
    return best


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    gain, f, at = _split(x, g, h) if depth else (0.0, -1, 0.0)
    if f < 0:
        return float(RATE * g.sum() / (h.sum() + 1))
    left = x[:, f] < at
    return (f, at, _tree(x[left], g[left], h[left], depth - 1), _tree(x[~left], g[~left], h[~left], depth - 1))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, at, low, high = tree
    return np.where(x[:, f] < at, _apply(low, x), _apply(high, x))


@functools.lru_cache(1)
def model() -> tuple[list, dict[str, float], tuple[float, float]]:
    """(trees, threshold on the probability of each kind, Platt's slope and offset)."""
    rows = grammar(FIT_ROWS, 5)
    x, y = np.array([features(*r[:3]) for r in rows]), np.array([r[3] for r in rows], float)
    fit = np.arange(len(rows)) % 4 != 0
    score, trees = np.zeros(len(rows)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(_tree(x[fit], (y - p)[fit], (p * (1 - p))[fit], 2))
        score += _apply(trees[-1], x)
    a, b = 1.0, 0.0
    s, t = score[~fit], y[~fit]
    for _ in range(400):  # Platt scaling on rows the trees have not seen
        p = 1 / (1 + np.exp(-(a * s + b)))
        a, b = a + 0.02 * float(np.mean((t - p) * s)), b + 0.1 * float(np.mean(t - p))
    p, thresholds = 1 / (1 + np.exp(-(a * s + b))), {}
    kinds = np.array([r[0] for r in rows])[~fit]
    for kind in MORE:
        q, z = p[kinds == kind], t[kinds == kind]
        fine = [c for c in np.unique(q) if z[q >= c].mean() >= PRECISION]
        thresholds[kind] = max(0.5, float(min(fine))) if fine else 2.0
    return trees, thresholds, (a, b)


def _expression(tree, names: dict[str, Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, at, low, high = tree
    return F.when(names[FEATURES[f]] < at, _expression(low, names)).otherwise(_expression(high, names))


def probability(names: dict[str, Column]) -> Column:
    trees, _, (a, b) = model()
    return 1 / (1 + F.exp(-(a * sum((_expression(t, names) for t in trees), F.lit(0.0)) + b)))


# ---- spans ----

def _lengths(items: Column, n: Column) -> Column:
    return F.aggregate(F.slice(items, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.regexp_replace(p, "^0+(?=.)", "").substr(1, 3).cast("int") <= 255)
        return F.forall(F.split(v, r"\."), small)
    if kind == "card":
        return luhn(_digits(v))
    if kind == "phone":
        return F.length(_digits(v)).between(8, 15)
    return F.lit(True)


BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _spans(kind: str, hit: Column, cut: Column) -> Column:
    def span(v: Column, i: Column) -> Column:
        start = _lengths(cut, i + 1) + _lengths(hit, i)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"))

    return F.coalesce(F.transform(hit, span), F.array().cast(_SPAN))


def located(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``rows`` with a column of spans for each pattern: all matches of it in ``text``, with places in code points.

    Splitting by the pattern gives what lies between the matches, so places
    are sums of lengths.
    """
    for kind, pattern in patterns.items():
        rows = rows.withColumn(f"_on_{kind}", F.col("text").rlike(pattern))
    kept = rows.columns
    cuts = [F.when(F.col(f"_on_{k}"), F.split("text", p, -1)).alias(f"_cut_{k}") for k, p in patterns.items()]
    hits = [F.when(F.col(f"_on_{k}"), F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"_hit_{k}") for k, p in patterns.items()]
    rows = rows.select(*kept, *cuts, *hits)
    for kind in patterns:
        rows = rows.withColumn(kind, _spans(kind, F.col(f"_hit_{kind}"), F.col(f"_cut_{kind}")))
    return rows.drop(*(f"_{x}_{k}" for x in ("on", "cut", "hit") for k in patterns))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base, more): base spans by kind as listed, and the spans that the trees add.

    ``more`` spans that overlap a base span are dropped.  Null texts count as
    empty; one row per input row; other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = located(located(rows, BASE), MORE)
    _, thresholds, _ = model()
    right = lambda k: lambda s: _valid(k, s["value"])
    base = F.concat(*(F.filter(F.col(k), right(k)) for k in BASE))
    rows = rows.select("doc_id", "text", base.alias("base"), *MORE)

    def chosen(kind: str) -> Column:
        def keep(s: Column) -> Column:
            before = F.substring(F.col("text"), F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
            free = ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
            return free & (probability(feature_columns(kind, s["value"], before)) >= thresholds[kind])

        return F.when(F.size(F.col(kind)) > 0, F.filter(F.col(kind), keep)).otherwise(F.array().cast(_SPAN))

    return rows.select("doc_id", "text", "base", F.concat(*(chosen(k) for k in MORE)).alias("more"))


def digest(docs: DataFrame) -> DataFrame:
    """Counts by base kind, a digest of the base spans and all spans."""
    rows = detect(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[pii]") -> DataFrame:
    """(doc_id, text) with every span masked; of spans that overlap, what a later one adds is masked too."""
    ordered = F.array_sort(F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(acc: Column, s: Column) -> Column:
        lead = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.when(fresh, F.concat(acc["out"], lead, F.lit(mark))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    return detect(docs).withColumn("d", done).select("doc_id", F.concat(F.col("d.out"), F.substring(F.col("text"), F.col("d.at") + 1, F.length("text"))).alias("text"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
