import random

import numpy as np
import pytest

from tests.llm.conftest import WORDS

from shearwater.llm import common
from shearwater.llm import substring_dedup as sd


def prose(rng, n):
    return [rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n)]


def brute(rows):
    """{row: (word places inside an exact passage of 50 words that another text holds, rows of those texts)}."""
    at, out = {}, {}
    low = [(t or "").lower().split() for _, t in rows]
    for k, w in enumerate(low):
        for i in range(len(w) - 49):
            at.setdefault(tuple(w[i : i + 50]), []).append((k, i))
    for places in at.values():
        if len({tuple(low[k]) for k, _ in places}) > 1:
            for k, i in places:
                spots, others = out.setdefault(k, (set(), set()))
                spots.update(range(i, i + 50))
                others.update(j for j, _ in places if low[j] != low[k])
    return out


def check_exact(got, rows):
    """Every exactly repeated word lies in a passage, and texts that share one share its class."""
    want = brute(rows)
    ids = [d for d, _ in rows]
    classes = {}
    for k, (spots, _) in want.items():
        r = got[ids[k]]
        spans = [tuple(map(int, s.split(":"))) for s in r.passages.split(",")]
        assert spots <= {p for s, e in spans for p in range(s, e)}
        assert len(spans) == r.n_passages == len(r.passage_ids) == len(r.n_texts) and all(e - s >= 50 for s, e in spans)
        classes[k] = set(r.passage_ids)
    for k, (_, others) in want.items():
        assert all(classes[k] & classes[j] for j in others)
    return want


def test_exact_repeats_match_brute_force(docs_of):
    rng = random.Random(0)
    shared = [prose(rng, n) for n in (50, 51, 60, 120)] + [prose(rng, 49)]
    texts = []
    for k in range(70):
        w = prose(rng, rng.randint(0, 300))
        for p in rng.sample(shared, rng.choice([0, 0, 1, 2])):
            i = rng.randint(0, len(w))
            w = w[:i] + p + w[i:]
        texts.append(rng.choice([" ", "\n"]).join(w))
    texts += [texts[3], texts[5].upper(), None, "", "short one", "z " * 3000]
    rows = list(zip(rng.sample(range(5000), len(texts)), texts))
    got = {r.doc_id: r for r in sd.repeats(docs_of(rows).repartition(3)).collect()}
    want = check_exact(got, rows)
    copies = {rows[k][0] for k in (3, 5, 70, 71)}
    assert copies <= set(got) <= copies | {rows[k][0] for k in want}
    assert all(got[d].n_copies == 2 for d in copies)


@pytest.mark.parametrize("size", [2, 12, 13, 40, 400])
def test_groups_of_any_size(docs_of, size):
    """Exact and near repeats (70 words, three changed): every member is found, all in one class."""
    rng = random.Random(size)
    rows, kinds = [], {}
    for kind, changes in (("exact", 0), ("near", 3)):
        for g in range(max(2, 60 // size)):
            hot = prose(rng, 70)
            for k in range(size):
                h = list(hot)
                for p in rng.sample(range(70), changes if k else 0):
                    h[p] = "changed%d" % rng.randint(0, 9**9)
                kinds[len(rows)] = (kind, g)
                rows.append((len(rows), " ".join(prose(rng, 30) + h + prose(rng, 30))))
    rows += [(len(rows) + k, " ".join(prose(rng, 150))) for k in range(20)]
    got = {r.doc_id: r for r in sd.repeats(docs_of(rows).repartition(3)).collect()}
    assert not [d for d in got if d not in kinds]  # clean texts
    check_exact(got, [r for r in rows if kinds.get(r[0], ("",))[0] == "exact"])
    for r in got.values():
        (s, e), = (tuple(map(int, x.split(":"))) for x in r.passages.split(","))
        assert s >= 25 and e <= 105
    near = [d for d, (kind, _) in kinds.items() if kind == "near"]
    assert sum(d in got for d in near) >= 0.95 * len(near)
    for g in {g for _, g in kinds.values()}:
        exact = [got[d] for d, k in kinds.items() if k == ("exact", g)]
        assert len({r.passage_ids[0] for r in exact}) == 1 and {r.n_texts[0] for r in exact} == {size}


def test_common_short_phrases_do_not_hide_exact_repeats(docs_of):
    """A line of 40 words in all texts, and pairs that share 52 words around it."""
    rng = random.Random(5)
    line, rows = prose(rng, 40), []
    for k in range(60):
        a, b = prose(rng, 6), prose(rng, 6)
        rows += [(2 * k + j, " ".join(prose(rng, 50) + a + line + b + prose(rng, 50))) for j in range(2)]
    got = {r.doc_id: r for r in sd.repeats(docs_of(rows).repartition(3)).collect()}
    assert len(check_exact(got, rows)) == 120
    assert all(r.n_texts == [2] for r in got.values())


def test_hot_keys_are_spread_with_the_same_result(docs_of, monkeypatch):
    rng = random.Random(2)
    hot = prose(rng, 80)
    rows = [(k, " ".join(prose(rng, 60) + hot + prose(rng, 60))) for k in range(120)]
    rows += [(200 + k, " ".join(prose(rng, 150))) for k in range(10)] + [(None, rows[0][1]), (7, rows[7][1])]
    plain = {(r.doc_id, r.passages, tuple(r.n_texts)) for r in sd.repeats(docs_of(rows)).collect()}
    monkeypatch.setattr(sd, "HOT", 8)
    spread = {(r.doc_id, r.passages, tuple(r.n_texts)) for r in sd.repeats(docs_of(rows).repartition(4)).collect()}
    assert spread == plain and {d for d, _, _ in spread} == {*range(120), None} and all(n == (120,) for _, _, n in spread)
    assert sd.repeats(docs_of([])).count() == 0


def test_roots_match_brute_force(monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    v[500:600] = v[500]
    offs = np.array([0, 30, 75, 75, 400, 446, 700])
    want = {}
    for a, b in zip(offs, offs[1:]):
        for i in range(a, b - sd.WINDOW + 1):
            k = i + int(np.argmin(v[i : i + sd.WINDOW]))
            lo, _ = want.get(k, (i, i))
            want[k] = (lo, i + sd.WINDOW - 1)
    for bits in (22, 8):  # in one piece, and in many
        monkeypatch.setattr(sd, "_BITS", bits)
        monkeypatch.setattr(sd, "_POS", (1 << bits) - 1)
        c, l, r = sd.roots(v & ~np.uint64((1 << 22) - 1), offs)
        assert {int(x): (int(y), int(z)) for x, y, z in zip(c, l, r)} == want


def test_hot_keys_joined_apart(spark, monkeypatch):
    """A third of the left rows share one key; the wide side goes through one exchange for both joins."""
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = common.table(spark.range(900).selectExpr("if(id % 3 = 0, 1L, id) as a", "id as b", "concat('s', id) as x").union(spark.createDataFrame([(10**6, 1, "none")], "a long, b long, x string")), "left")
        right = common.table(spark.range(900).selectExpr("id as cls", "array(id, id + 1) as words"), "right")
        one, two = (right.selectExpr(f"cls as {k}", f"words as w{k}") for k in ("a", "b"))
        both = common.apart_join(left, one, "a", "b").join(two, "b")
        want = left.join(one, "a").join(two, "b").select(both.columns)
        assert sorted(map(str, both.collect())) == sorted(map(str, want.collect())) and both.count() == 900
        plan = both._jdf.queryExecution()
        both.collect()
        assert "ReusedExchange" in plan.executedPlan().toString()
        calm = common.apart_join(left.where("a <> 1"), one, "a", "b")
        assert calm.count() == left.where("a <> 1").join(one, "a").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
