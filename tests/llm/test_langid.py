import random
import zlib

import numpy as np

from shearwater.llm import langid

SYLLABLES = {"aa": "ka lo mi tu se".split(), "bb": "sch ung pf tz ei".split(), "cc": "ção nh lh ão é".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_odd_texts(docs_of, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 80)
    rng = random.Random(0)
    rows = [(i, text(rng, lang, rng.randint(3, 80)), lang, "s", 0, "k", 1) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=400))]
    odd = [(1000, None), (1001, ""), (1002, "123 !!"), (1003, "¡¿…"), (None, text(rng, "bb", 30)), (1004, "z" * 5000)]
    docs = docs_of(rows + [(i, t, "aa", "s", 0, "k", 1) for i, t in odd] + [rows[0], (1005, "no label ka lo", None, "s", 0, "k", 1)]).repartition(3)
    got = langid.predict(docs, langid.trained(docs)).select("doc_id", "lang", "lang_pred", "score", "key", langid.held_out().alias("h")).collect()
    assert len(got) == 400 + len(odd) + 2
    by = {r.doc_id: r for r in got}
    for i, _ in odd[:4]:
        assert by[i].lang_pred == "und" and by[i].score == 0
    assert by[None].lang_pred == "bb" and by[None].h is False
    tested = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.h]
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert len(tested) > 60 and np.mean([r.lang == r.lang_pred for r in tested]) >= 0.97
    empty = docs_of([])
    assert langid.identify(empty).count() == 0
    unlabelled = docs_of([(1, "ka lo", None, "s", 0, "k", 1)])
    assert [r.lang_pred for r in langid.identify(unlabelled).collect()] == ["und"]


def test_backpropagation_agrees_with_differences():
    net = langid.Network(["x", "y"], hidden=3, seed=1)
    for part in (*(s.w for s in net.sides), net.out):
        for k in part:
            part[k] = part[k].astype(np.float64)
    seq, lens = langid.padded([b"abc", b"zebra", b"q"])
    label = np.array([0, 1, 1])
    grads, _ = net.step(seq, lens, label)
    for part, grad in zip((*(s.w for s in net.sides), net.out), grads):
        for k in part:
            at = np.unravel_index(np.argmax(np.abs(grad[k])), grad[k].shape)
            old = part[k][at]
            part[k][at] = old + 1e-3
            up = net.step(seq, lens, label)[1]
            part[k][at] = old - 1e-3
            down = net.step(seq, lens, label)[1]
            part[k][at] = old
            assert abs((up - down) / 2e-3 - grad[k][at]) < 2e-3 * max(1, abs(grad[k][at])) + 1e-4


def test_sample_loses_no_language_to_repeated_rows(spark, docs_of):
    """One row 10^5 times beside five others: a third of all rows and more share one document."""
    often = docs_of([(1, "ka lo mi", "es", "s", 0, "k", 1)]).crossJoin(spark.range(100_000)).drop("id")
    docs = often.unionByName(docs_of([(10 + i, f"sch ung {i}", "fr", "s", 0, "k", 1) for i in range(8)])).repartition(6)
    held = {i for i in (1, *range(10, 18)) if zlib.crc32(str(i).encode()) % 4 == 2}
    rows = langid.sample(docs).collect()
    assert 1 not in held and sorted(r.lang for r in rows) == ["es"] + ["fr"] * (8 - len(held & set(range(10, 18))))
    assert [r.runs for r in rows if r.lang == "es"] == [[bytearray(b"ka"), bytearray(b"lo"), bytearray(b"mi")]]


def test_sample_of_many_languages_repeated_unevenly(docs_of):
    rows = [(1000 * k + i, f"word {'x' * i}", f"l{k:03d}", "s", 0, "k", 1) for k in range(300) for i in range(1 + k % 4) for _ in range(1 + (k * i) % 5)]
    docs = docs_of(rows).repartition(5)
    got = langid.sample(docs, per_language=2).collect()
    want = {}
    for i, t, lang, *_ in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            want.setdefault(lang, set()).add(i)
    most = sorted(want, key=lambda k: (-len(want[k]), k))[: langid.LANGUAGES]
    assert {r.lang for r in got} == set(most)
    for lang in most:
        mine = [r.h for r in got if r.lang == lang]
        assert len(mine) == len(set(mine)) == min(2, len(want[lang]))


def test_script_without_spaces(docs_of, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 80)
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("漢字語文中国学校" if i % 2 else "あいうえおかきく", k=rng.randint(20, 90))), "zh" if i % 2 else "ja", "s", 0, "k", 1) for i in range(200)]
    docs = docs_of(rows)
    got = langid.predict(docs, langid.trained(docs)).collect()
    tested = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(tested) > 20 and np.mean([r.lang == r.lang_pred for r in tested]) >= 0.95
