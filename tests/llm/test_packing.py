import random
import zlib

import numpy as np
import pytest

from shearwater.llm import packing


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


NASTY = [
    "", None, " ", "  two  spaces ", "a\nb\n\nc \n d", "tab\tx y z 　w", "déjà vu à la carte", "x" * 5000, "don't we'll 123 !!",
    "café wide line \u0085 next", "<|endoftext|> text", "a<|endoftext|>b c", "x\n<|endoftext|>\ny <|endoftext|> z <|endoftext|", "two <|endoftext|><|endoftext|>q", "emoji 🐾 🐾🐾 z", "word " * 3000, "\x1c\x1d a \x1f b", "日本語 の テキスト\n\n行",
]


def test_units_encode_like_the_whole_text(docs_of, tok):
    rows = {r.doc_id: [] for r in []}
    for r in packing.pieces(docs_of(list(enumerate(NASTY))), packing.tokenizer_path(), 64, ids=True).collect():
        rows.setdefault(r.doc_id, []).append(r)
    for k, text in enumerate(NASTY):
        want = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        got = sorted(rows[k], key=lambda r: r.piece)
        assert [x for r in got for x in r.ids] == want
        assert [r.start for r in got] == list(np.cumsum([0, *(r.length for r in got)])[:-1])
        assert all(r.length == 64 for r in got[1:]) and got[0].length <= 64
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)


@pytest.mark.parametrize("seed", range(30))
def test_plan_fills_without_overlap(seed):
    rng = random.Random(seed)
    top = rng.choice([7, 50, 300])
    hist = {n: rng.randint(1, 400) for n in rng.sample(range(1, top + 1), rng.randint(1, min(top, 25)))}
    seqs: dict[int, list] = {}
    ranks = {n: [] for n in hist}
    for n, rank, count, seq, off in packing.plan(hist, top):
        ranks[n] += range(rank, rank + count)
        for j in range(count):
            seqs.setdefault(seq + j, []).append((off, n))
    assert all(sorted(r) == list(range(hist[n])) for n, r in ranks.items())
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= top
    # the same count of bins as best fit over single pieces
    rooms: list[int] = []
    for n in sorted((n for n, c in hist.items() for _ in range(c)), reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(top - n)
    assert len(seqs) == len(rooms)


def test_pack_places_every_piece(docs_of):
    rows = list(enumerate(NASTY)) + [(3, "repeat me")] * 3 + [(None, "no id")]
    got = packing.pack(docs_of(rows), packing.tokenizer_path(), 128).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 128
    assert packing.pack(docs_of([]), packing.tokenizer_path()).count() == 0
