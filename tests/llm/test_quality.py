import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shearwater.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY = {"n_words": 0, "word_chars": 0, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0}


def brute(text):
    words = WORD.findall(text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        again += bool(WORD.search(line)) and line in seen
        seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": again, "n_repeat_words": len(covered)}


def prose(rng, n):
    return " ".join("".join(rng.choices(["la", "ti", "mo", "né", "ru", "sk"], k=rng.randint(1, 4))) for _ in range(n))


def junk(rng, n):
    return " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in prose(rng, n).split())


def test_counts_match_brute_force():
    rng = random.Random(4)
    texts = ["".join(rng.choices(["a", "b", "é", "🐾", " ", "\n", "\n\n", "a b\n", "#", "|x ", "\t", "\xa0", "\r\n"], k=rng.choice([0, 1, 3, 10, 60, 300]))) for _ in range(400)]
    texts += [None, "", "\n", "\n\n", "a", "x y z " * 500, "w\n" * 300, "long" * 20_000]
    got = quality.counts(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert {k: int(v[i]) for k, v in got.items()} == brute(text), text
    assert all(len(v) == 0 for v in quality.counts(pa.array([], pa.string())).values())


def test_features_of_a_text_dont_depend_on_its_neighbours():
    rng = random.Random(1)
    texts = ["", prose(rng, 40), "a", "é", None, junk(rng, 9), "ab", "🐾x", prose(rng, 3), ""]
    together = quality.features(pa.array(texts))
    for i, text in enumerate(texts):
        for (at, offsets), (own, _) in zip(together, quality.features(pa.array([text], pa.string()))):
            assert at[offsets[i] : offsets[i + 1]].tolist() == own.tolist()
    assert len(quality.features(pa.array(["éab🐾"]))[2][0]) == 2


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    return [(i, junk(rng, rng.randint(60, 200)) if i % 5 == 0 else prose(rng, rng.randint(60, 200))) for i in range(400)]


def test_verdicts_on_documents_without_labels(spark, docs_of, corpus):
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i, _ in corpus if i < 250] + [(1, 1, 0), (7, 0, 0), (7, 1, 0), (None, 0, 0), (9, None, 0), (10**9, 0, 0)], "doc_id long, quality int, toxic int")
    odd = [(900, None), (901, ""), (902, "few words"), (903, "one two three " * 60), (None, corpus[1][1]), (904, "z" * 30_000), corpus[3], corpus[3]]
    docs = docs_of(corpus + odd).repartition(3)
    model = quality.fitted(docs, labels)
    assert model == quality.fitted(docs.repartition(7), labels.repartition(5))
    got = quality.assessed(docs, model).select("doc_id", "text", "rules.*").collect()
    assert len(got) == len(corpus) + len(odd)
    for r in got:
        want = brute(r.text)
        assert {k: r[k] for k in EMPTY} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r.base_failed == failed and r.kept == (not failed and r.probability >= 0.5)
    late = [r for r in got if r.doc_id is not None and 250 <= r.doc_id < 400]
    assert np.mean([r.kept == (r.doc_id % 5 > 0) for r in late]) == 1
    assert np.mean([(r.probability - (r.doc_id % 5 > 0)) ** 2 for r in late]) < 0.05
    kept = quality.filtered(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_sample_is_bounded_and_loses_no_class(spark, docs_of, corpus):
    """One id a third of all rows, both classes over the bound: each keeps about the bound."""
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i, _ in corpus] + [(0, 0)] * 300, "doc_id long, quality int")
    docs = docs_of(corpus + [(0, f"{t} more") for _, t in corpus[:200]])
    rows = quality.sample(docs, labels, 40).collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(15 <= sum(r.good == k for r in rows) <= 75 for k in (True, False))
    assert len(quality.sample(docs, labels).collect()) == 400


def test_without_both_classes(spark, docs_of, corpus):
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert quality.fitted(docs_of(corpus), labels) == b"" and quality.fitted(docs_of(corpus), labels.where("false")) == b""
    out = quality.assessed(docs_of(corpus[:10]), b"").select("rules.*").collect()
    assert all(r.kept and r.probability is None for r in out)
    assert quality.assessed(docs_of([]), b"").count() == 0 and quality.fitted(docs_of([]), labels) == b""
