import random
import re
import zlib
from collections import Counter

import pytest

from shearwater.llm import variants


def words_of(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 97 == 0:
                k = h % len(low)
                low = low[:k] + low[k + 1 :]
            total[low] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:k] + long_[k + 1 :] == short for k in range(len(long_)))


def brute(rows):
    count = words_of(rows)
    form, out = {}, {}
    close = {w: [v for v in count if one_edit(w, v)] for w in count}
    for w, n in count.items():
        best = min(((-count[v], v) for v in close[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n else None
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(close[w]), count[form[w]] if form[w] else None)
    return out


def text(rng, words):
    return "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "1", "'", "漢"]) for _ in range(rng.randrange(40)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = []
    for _ in range(60):
        base = "".join(rng.choices("abéÿ×", k=rng.randint(4, 9)))
        words += [base, base.upper(), base[:-1], base + rng.choice("ab"), rng.choice("ab") + base[1:], base[:3] + base[4:], base[:2] + base[2:] * 2]
    out = [(rng.randrange(10**6), text(rng, words)) for _ in range(250)]
    out += [(11, "ladder " * 3 + "laddew " * 6 + "laddxw " * 13 + "ladtxw " * 27), (12, "zzzzzz " * 4 + "zzzzz " * 8 + "zzzzzzz " * 8)]  # forms of forms, ties
    return out + [(1, None), (2, ""), (3, "a" * 3000 + " " + "a" * 2999), (4, "a" * 3000), (5, "a" * 3000), (6, "a" * 2999 + " " + "a" * 2999), (None, "aaaaa aaaaa aaaaa"), (7, "same words"), (7, "same words"), (7, "same words")]


@pytest.mark.parametrize("hot, shard, piece", [(20_000, 60_000, 1 << 20), (12, 40, 7), (1, 10**6, 50)])
def test_variants_match_brute_force(docs_of, monkeypatch, rows, hot, shard, piece):
    """Also where keys are hot at once, so that regions are halved down to single characters."""
    monkeypatch.setattr(variants, "HOT", hot)
    monkeypatch.setattr(variants, "SHARD", shard)
    monkeypatch.setattr(variants, "PIECE", piece)
    monkeypatch.setattr(variants, "HELD", 30)
    use = [r for r in rows if hot > 1 or len(r[1] or "") < 2000]  # regions of very long words take a round for each halving
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.grouped(docs_of(use).repartition(3)).collect()}
    want = brute(use)
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 30 and any(v[1] != v[0] for w, v in want.items() if v[0])


def test_automaton_is_minimal_and_numbers_its_words():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(0, 6))) for _ in range(300)})
    made = variants.Automaton(words)
    # minimal: as many states as there are different sets of endings
    endings = Counter()
    for k in {w[:i] for w in words for i in range(len(w) + 1)}:
        endings[frozenset(w[len(k) :] for w in words if w.startswith(k))] += 1
    assert len(made.edges) == len(endings)
    for word in ["", "abca", "bbbb", "cab", "zz"]:
        for low in range(len(word) + 1):
            for high in range(low, len(word) + 1):
                found = sorted(words[k] for k in made.near(word, low, high))
                assert len(found) == len(set(found))
                want = [v for v in words if one_edit(word, v) and v[:low] == word[:low] and (high == len(word) or v.endswith(word[high:])) and len(v) >= low + len(word) - high]
                assert found == want
    assert variants.Automaton([]).near("abc", 0, 3) == []


def test_long_runs_take_linear_work():
    made = variants.Automaton(sorted(["a" * 4000, "a" * 4001, "a" * 3999, "b" + "a" * 3999]))
    assert len(made.near("a" * 4000, 0, 4000)) == 3


def test_empty_tables(docs_of):
    assert variants.grouped(docs_of([])).count() == 0
    assert variants.grouped(docs_of([(1, None), (2, "none of these")])).count() == 0
