import math
import random

import numpy as np
import pytest

from shearwater.llm import pieces

TEXTS = [
    "", None, " ", "a", "Hello world", "  two  spaces ", "line\n\nbreak \n x", "déjà vu 日本語 🐾🐾", "own ▁ marker▁x ▁", "x" * 700, "tab\there", "word " * 400,
    "mixed ▁▁  ▁\n▁", "\u0000nul", "Un ciónue jaaras con cióncióndomente adoll.",
]


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(pieces.model_path())


def brute_score(v, text):
    """Viterbi over characters of the marked text with a plain dictionary."""
    score = {v.bytes[v.begin[i] : v.begin[i] + v.width[i]].tobytes(): s for i, s in zip(v.ids.tolist(), v.score.tolist())}
    chars = [c.encode() if c != pieces.MARKER else None for c in " " + text]
    best = [0.0] + [-math.inf] * len(chars)
    for i in range(len(chars)):
        raw = b""
        for j in range(i, min(len(chars), i + v.longest)):
            if chars[j] is None:
                if j == i:
                    best[i + 1] = max(best[i + 1], best[i] + 3 * v.byte_score)
                break
            raw += chars[j]
            if j == i:
                best[i + 1] = max(best[i + 1], best[i] + len(raw) * v.byte_score)
            if raw in score:
                best[j + 1] = max(best[j + 1], best[i] + score[raw])
    return best[-1]


def test_scores_match_brute_force_and_texts_come_back(docs_of, vocab):
    rows = list(enumerate(TEXTS)) + [(3, "a"), (None, "no id")]
    got = pieces.encoded(docs_of(rows), pieces.model_path()).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    value = np.full(len(vocab.width), vocab.byte_score)
    value[vocab.ids] = vocab.score
    for r in got:
        if r.doc_id is not None:
            text = TEXTS[r.doc_id]
            assert r.n_ids == len(r.ids) and (text or r.n_ids == 0)
            if text:
                assert abs(value[r.ids].sum() - brute_score(vocab, text)) < 1e-6
    back = {r.doc_id: r.text for r in pieces.decoded(docs_of(rows).selectExpr("doc_id").limit(0).selectExpr("doc_id", "array(1) as ids"), pieces.model_path()).collect()}
    assert back == {}
    assert pieces.encoded(docs_of([]), pieces.model_path()).count() == 0


def test_decoding(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS) if t is not None]
    ids = pieces.encoded(docs_of(rows), pieces.model_path())
    assert {r.doc_id: r.text for r in pieces.decoded(ids, pieces.model_path()).collect()} == dict(rows)


def test_trie_holds_its_keys():
    rng = random.Random(1)
    keys = list({bytes(rng.choices(range(256), k=rng.randint(1, 6))) for _ in range(3000)})
    t = pieces.Trie(keys)

    def find(k):
        node = 0
        for c in k:
            nxt = t.base[node] + c
            if t.check[nxt] != node:
                return -1
            node = nxt
        return t.value[node]

    assert all(find(k) == i for i, k in enumerate(keys))
    assert all(find(k) == -1 for k in (bytes(rng.choices(range(256), k=7)) for _ in range(500)))
