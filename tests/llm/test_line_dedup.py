import random
import re

from tests.llm.conftest import WORDS

from shearwater.llm import line_dedup


def tokens(line):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", low))


def brute(rows):
    seen, out = [], {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        kept = []
        for line in (t.split("\n") if t is not None else []):
            s = tokens(line)
            if s and any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                pass
            else:
                kept.append(line)
            if s:
                seen.append(s)
        out[d] = None if t is None else "\n".join(kept)
    return out


def corpus(seed):
    rng = random.Random(seed)
    bases = [[rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(rng.choice([1, 2, 4, 5, 9, 30, 70]))] for _ in range(30)]
    hot = [f"h{i}" for i in range(20)]

    def line():
        w = list(rng.choice(bases)) if rng.random() < 0.6 else list(hot)
        for _ in range(rng.randint(0, 1 + len(w) // 12)):
            w[rng.randrange(len(w))] = rng.choice(["zz", "Yy", "x" + str(rng.randint(0, 99))])
        if rng.random() < 0.2:
            rng.shuffle(w)
        return rng.choice([" ", "  "]).join(w) + rng.choice(["", " "])

    rows = ["\n".join(line() for _ in range(rng.randint(1, 6))) for _ in range(60)]
    rows += [None, "", "\n\n", " \n\t", "the\nthe\nTHE", "a b c d\na b c d e", "end newline\n", "very " * 5000]
    return list(zip(rng.sample(range(500), len(rows)), rows))


def test_matches_brute_force(docs_of):
    for seed in range(2):
        rows = corpus(seed)
        got = {r.doc_id: r for r in line_dedup.dedup(docs_of(rows).repartition(3)).collect()}
        want = brute(rows)
        assert {d: r.text for d, r in got.items()} == want
        for d, t in rows:
            assert got[d].n_lines == (0 if t is None else t.count("\n") + 1) and got[d].key == "y" and got[d].cls == 2


def test_repeats_nulls_and_empty(docs_of):
    rows = [(1, "one two three"), (1, "one two three"), (1, "four five six"), (None, "one two three"), (2, "four five six\n\nseven")]
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.dedup(docs_of(rows)).collect())
    assert got == [("1", ""), ("1", ""), ("1", "four five six"), ("2", "\nseven"), ("None", "one two three")]
    assert line_dedup.dedup(docs_of([])).count() == 0


def test_second_round_finds_what_the_first_try_missed(docs_of, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW", 1)
    monkeypatch.setattr(line_dedup, "SMALL", 1)
    rows = corpus(7)
    assert {r.doc_id: r.text for r in line_dedup.dedup(docs_of(rows)).collect()} == brute(rows)


def test_wide_signatures(docs_of, monkeypatch):
    monkeypatch.setattr(line_dedup, "WIDE", 3)
    rows = corpus(4)
    assert {r.doc_id: r.text for r in line_dedup.dedup(docs_of(rows)).collect()} == brute(rows)


def test_many_buckets_wide_signatures_and_ids_of_any_size(docs_of, monkeypatch):
    monkeypatch.setattr(line_dedup, "WORDS", 40)
    monkeypatch.setattr(line_dedup, "WIDE", 3)
    rows = [({0: -(1 << 62), 1: 1 << 62}.get(k, d), t) for k, (d, t) in enumerate(corpus(5))]
    assert {r.doc_id: r.text for r in line_dedup.dedup(docs_of(rows).repartition(3)).collect()} == brute(rows)


def test_documents_are_read_four_times_even_with_a_second_round(docs_of, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW", 1)
    rng = random.Random(3)
    base, often = [f"b{i}" for i in range(40)], [f"often{i}" for i in range(20)]
    lines = [" ".join(base[:-k]) for k in (1, 2, 3)]  # nothing else is similar to them, but 35 of 45 words look so by chance
    lines += [" ".join([*rng.sample(base, 35), *rng.sample(often, 5)]) for _ in range(400)]
    rows = [*enumerate(lines), *((k, " ".join(often)) for k in range(1000, 1600))]
    docs = docs_of(rows).coalesce(2)
    seen = docs.sparkSession.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    got = line_dedup.dedup(docs.mapInArrow(read, docs.schema)).collect()
    assert {r.doc_id: r.text for r in got} == brute(rows)
    assert 0 < seen.value <= 4 * len(rows)


def test_postings_travel_as_one_row_a_bucket(docs_of):
    rows = corpus(3)
    docs = line_dedup._prepared(docs_of(rows).coalesce(1))
    _, rarity, words = line_dedup.listed(docs)
    posts = line_dedup.postings(docs, docs.sparkSession.sparkContext.broadcast(rarity), 7).collect()
    assert words == sum(len(t.split()) for _, t in rows if t) and len(posts) == len({r.bucket for r in posts}) == 7
    assert all(len(r.cls) == len(r.key) == 2 * len(r.n) for r in posts) and sum(len(r.key) for r in posts) > 8 * 500
