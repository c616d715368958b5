import hashlib
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from shearwater.llm import merkle

MASK = (1 << 64) - 1


def fold(children):
    s = 42
    for c in children:
        s = xxhash.xxh64_intdigest(struct.pack("<Q", c), s)
    return s


def cut(text, ends):
    """Pieces of text that end where ``ends(text, start of piece, place)``."""
    out, at = [], 0
    for p in range(1, len(text)):
        if ends(text, at, p):
            out.append(text[at:p])
            at = p
    return out + [text[at:]] if text else []


def brute(text):
    """(fingerprint, set of leaf hashes) of a text, with sections, paragraphs and leaves cut by hand."""
    sections, every = [], set()
    for s in cut(text, lambda t, a, p: t[:p].endswith(("\n\n", "\n \n", "\n\t\n"))):
        paragraphs = []
        for line in cut(s, lambda t, a, p: t[p - 1] == "\n"):
            leaves = [xxhash.xxh64_intdigest(x.encode(), 42) for x in cut(line, lambda t, a, p: t[p - 1] in ".!?" and t[p] in " \t\n\x0b\f\r" or p - a == merkle.LONGEST)]
            every.update(leaves)
            paragraphs.append((fold(leaves), leaves))
        sections.append((fold(h for h, _ in paragraphs), paragraphs))
    root = hashlib.sha256(",".join(f"{h:016x}" for h, _ in sections).encode()).hexdigest()
    body = "/".join(f"{h:016x}=" + ",".join(f"{p:016x}+" + ".".join(f"{x:016x}" for x in ls) for p, ls in ps) for h, ps in sections)
    return f"{root}:{body}", every


def like(a, b):
    (ra, x), (rb, y) = brute(a), brute(b)
    return 1.0 if ra == rb else len(x & y) / len(x | y)


@pytest.mark.parametrize("side, rows", [(64, 256), (3, 4)])
def test_fingerprints_match_brute_force(docs_of, monkeypatch, side, rows):
    monkeypatch.setattr(merkle, "SIDE", side)
    monkeypatch.setattr(merkle, "ROWS", rows)
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab. é🐾\n!", k=rng.choice([0, 1, 2, 7, 60, 500]))) for _ in range(120)] + [None, "same text.\nHere", "same text.\nHere", "word " * 400]
    ids = rng.sample(range(-2000, 100000, 37), 60) + [rng.getrandbits(63) for _ in range(len(texts) - 60)]  # dense and sparse
    table = list(zip(ids, texts))
    got = {r.doc_id: r for r in merkle.fingerprints(docs_of(table).repartition(5)).collect()}
    assert len(got) == len(table)
    order = sorted((i, t or "") for i, t in table)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == brute(t)[0] and r.edited_fingerprint == brute(edited)[0]
        assert r.near_edited == pytest.approx(like(t, edited)) and r.near_next == pytest.approx(like(t, nxt))


def test_an_id_of_very_many_rows(docs_of, monkeypatch):
    """Rows of one doc_id are dealt over ranges by their hash; the chain still goes through all rows once."""
    monkeypatch.setattr(merkle, "ROWS", 8)
    table = [(7, f"text {k}. more") for k in range(200)] + [(k, f"other {k}") for k in range(20)] + [(None, "x")] * 3
    out = merkle.chained(docs_of(table).repartition(4)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in out) == sorted((-1 if i is None else i, t) for i, t in table)
    assert sorted(r.next_text for r in out) == sorted(t for _, t in table)


def test_edges(docs_of):
    assert merkle.fingerprints(docs_of([])).count() == 0
    (one,) = merkle.fingerprints(docs_of([(None, "alone here. yes")])).collect()
    assert one.near_next == 1 and one.doc_id is None and one.n_chars == 15
    rows = merkle.fingerprints(docs_of([(1, "x"), (1, "x"), (1, "y"), (2, None)])).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 1, 2]


def test_edits_are_located_behind_an_insertion(spark):
    old = "a one. a two.\nb one.\n\nc one.\nd one.\n\ne one.\n"
    new = "fresh start.\n\na one. a two.\nb one.\n\nc one.\nd 1!\n\ne one.\n"
    pairs = spark.createDataFrame([(1, old, new), (2, old, old), (3, None, "x"), (4, None, None)], "id long, old string, new string")
    got = {(r.id, r.side, r.section, r.paragraph) for r in merkle.edits(pairs).collect()}
    assert got == {(1, "new", 0, 0), (1, "new", 2, 1), (1, "old", 1, 1), (3, "new", 0, 0)}


def test_leaves_of_text_without_sentences(spark):
    a, b = "word " * 200, "word " * 100 + "other " * 60
    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(merkle.likeness(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("l")).first()
    assert 0 < got.l < 1
