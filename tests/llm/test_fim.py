import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from shearwater.llm import fim


def brute(i, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    x, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{x}<M>{m}"
    return n, "psm", a, b - a, f"<P>{x}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_rows_match_brute_force(docs_of):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab <PSM>é🐾\n\r\t \x00", k=rng.choice([0, 1, 2, 9, 80, 700]))) for _ in range(300)]
    texts += [None, "", "x", "<P>", "a <S> b", "<M", "S>", "<", "é" * 60_000, "🐾" * 501, "same", "same"]
    ids = [rng.randrange(-(2**40), 2**40) for _ in texts[:-2]] + [7, 7]
    rows = list(zip(ids, texts)) + [(None, "no id at all"), (None, None)]
    got = fim.digest(docs_of(rows).repartition(4)).collect()
    want = sorted(str((i, *b[:4], sha(b[4]), sha(t or ""))) for i, t in rows for b in [brute(i, t)])
    assert sorted(str(tuple(r)) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_units_and_sentinels_restore(docs_of, unit):
    rng = random.Random(2)
    plan = fim.Plan("[pre'\\d]", "[suf]", "[mid.*]", unit, seed=9, changed=100, spm=50)
    rows = [(i, "".join(rng.choices(["one ", "two\n", "  ", "[", "]", "pre", "\\d", "$1", "\r\n"], k=rng.randrange(40)))) for i in range(200)]
    docs = docs_of(rows)
    made = fim.arranged(docs.withColumn("fim", F.lit(1)), plan)
    assert made.columns == [*docs.columns, "fim"] and made.count() == 200
    out = made.select("text", "fim.*", fim.restored(F.col("fim.output"), F.col("fim.form"), plan).alias("back")).collect()
    pattern = {"char": r"(?s).", "word": r"\s+|\S+\s*", "line": r"[^\n]*\n|[^\n]+"}[unit]
    for r in out:
        units = re.findall(pattern, r.text)
        assert "".join(units) == r.text and r.n == len(units) and r.back == r.text
        if r.form != "plain":
            ends = {"".join(units[:k]) for k in range(len(units) + 1)}
            assert r.prefix in ends and r.prefix + r.middle in ends
    assert sum(r.form == "spm" for r in out) > 50 and sum(r.form == "psm" for r in out) > 50


def test_broken_outputs_give_null(spark):
    rows = [("<P>a<S>b<M>c", "psm", "acb"), ("<S>a<P>b<M>c", "spm", "bca"), ("<S>a<P>b<M>c", "psm", None), ("<P>a<S>b", "psm", None), ("x<P>a<S>b<M>", "psm", None), (None, "psm", None), ("a", None, None), ("<P>", "plain", "<P>")]
    df = spark.createDataFrame(rows, "o string, f string, want string").withColumn("got", fim.restored(F.col("o"), F.col("f")))
    assert all(r.got == r.want for r in df.collect())


def test_settings_and_empty_tables(docs_of):
    assert fim.digest(docs_of([])).count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("aba", "x", "y"), ("ab", "bc", "x"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            fim.Plan(*marks)
    with pytest.raises(ValueError):
        fim.Plan(unit="token")
    plan = fim.digest(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
