"""Unigram encoding and decoding over pieces with log scores.

Text is written with the white-space marker for every space, one marker put in
front.  Encoding is the Viterbi path of the highest total score over a
double-array trie of the pieces' UTF-8 bytes; a character that no piece covers
falls back to its bytes.  A marker that stands in the text itself is written
as bytes, so decoding gives back every text exactly.

No piece runs across the start of a word (checked when a vocabulary is
loaded), so the best path of a text is the best paths of its words; words are
encoded many at a time and remembered.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, kernels

MARKER = "▁"
#: A marker in the text itself while it is encoded; these bytes are in no UTF-8 text.
OWN_MARKER = b"\xff\xfe\xfd"
CACHE_WORDS = 1_000_000
#: A byte costs this much more than the rarest piece.
BYTE_PENALTY = 10.0


class Trie:
    """A double-array trie: child of ``s`` by byte ``c`` is ``base[s] + c`` if ``check`` there is ``s``."""

    def __init__(self, keys: list[bytes]):
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.check[0] = 0
        order = sorted(range(len(keys)), key=keys.__getitem__)
        free, todo = 257, [(0, 0, len(keys), 0)]
        hint = [0] * 257  # where the search for so many children last ended; earlier places are too full
        taken = bytearray(size)
        taken[0] = 1
        while todo:
            node, lo, hi, depth = todo.pop()
            if len(keys[order[lo]]) == depth:
                self.value[node] = order[lo]
                lo += 1
            kids, at = [], lo
            while at < hi:
                c, b = keys[order[at]][depth], at
                while at < hi and keys[order[at]][depth] == c:
                    at += 1
                kids.append((c, b, at))
            if not kids:
                continue
            while taken[free]:
                free += 1
            base = max(free - kids[0][0], hint[len(kids)], 1)
            codes = [c for c, _, _ in kids]
            while True:
                if base + 512 > len(taken):
                    grow = len(taken)
                    taken += bytearray(grow)
                    self.base, self.check, self.value = (np.concatenate([x, np.full(grow, f, np.int32)]) for x, f in ((self.base, 0), (self.check, -1), (self.value, -1)))
                if not any([taken[base + c] for c in codes]):
                    break
                base += 1
            if len(kids) > 1:
                hint[len(kids)] = base
            self.base[node] = base
            for c, b, e in kids:
                taken[base + c] = 1
                self.check[base + c] = node
                todo.append((base + c, b, e, depth + 1))


class Vocabulary:
    """Pieces, their log scores and the ids of the 256 bytes."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], skip: set[int]):
        self.byte_ids = np.array(byte_ids, np.int32)
        self.written = self.byte_ids.copy()  # ids of bytes of marked text, where three bytes stand for a text's own marker
        self.written[list(OWN_MARKER)] = self.byte_ids[list(MARKER.encode())]
        plain = [i for i in range(len(pieces)) if i not in skip]
        self.ids = np.array(plain, np.int32)
        keys = [pieces[i].encode() for i in plain]
        self.score = np.array([scores[i] for i in plain])
        self.byte_score = float(self.score.min()) - BYTE_PENALTY
        self.trie = Trie(keys)
        self.longest = max(map(len, keys))
        if any(MARKER in p.lstrip(MARKER) or "\n" in p for p in map(pieces.__getitem__, plain)):
            raise ValueError("a piece runs across a word start")
        # what each id decodes to
        raw = [b""] * len(pieces)
        for i in plain:
            raw[i] = pieces[i].replace(MARKER, " ").encode()
        for b, i in enumerate(byte_ids):
            raw[i] = bytes([b])
        self.width = np.array([len(r) for r in raw], np.int64)
        self.begin = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.clear()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a model file.  Scores that are merge ranks, not logarithms, become Zipf's: -log(rank + 2)."""
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        names = [p.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if p.is_control(i) or p.is_unknown(i) or p.is_unused(i)}
        byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        skip = special | set(byte_ids)
        score = np.array([p.get_score(i) for i in range(n)])
        if (score == np.round(score)).all():
            order = np.argsort(-score, kind="stable")
            order = order[~np.isin(order, list(skip))]
            score = np.zeros(n)
            score[order] = -np.log(np.arange(len(order)) + 2.0)
        return cls(names, score.tolist(), byte_ids, skip)

    def clear(self) -> None:
        self.known, self.slot = self.known[:0], self.slot[:0]
        self.pool, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def best_paths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, their count for each word, total score): the Viterbi paths of words of marked text."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lens, kind="stable")
        out, count, total = [None] * len(words), np.zeros(len(words), np.int64), np.zeros(len(words))
        at = 0
        while at < len(order):
            stop = min(at + 4096, len(order))
            if lens[order[stop - 1]] > 64:  # long words few at a time: the table is words x longest
                stop = min(stop, at + max(1, (1 << 18) // int(lens[order[min(stop, at + 64) - 1]])), at + 64)
            part = order[at:stop].tolist()
            ids, n, score = self._paths([words[i] for i in part], lens[part])
            cut = np.cumsum(n) - n
            for i, a, m in zip(part, cut.tolist(), n.tolist()):
                out[i] = ids[a : a + m]
            count[part], total[part] = n, score
            at = stop
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), count, total

    def _paths(self, words: list[bytes], lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, width = len(words), int(lens.max())
        pad = self.longest + 4
        text = np.frombuffer(b"".join(x + bytes(width + pad - len(x)) for x in words), np.uint8).reshape(w, width + pad)
        best = np.full((w, width + pad + 1), -np.inf)
        best[:, 0] = 0
        piece, step = np.full((w, width + pad + 1), -1, np.int32), np.zeros((w, width + pad + 1), np.int16)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(width):
            rows = np.flatnonzero((best[:, i] > -np.inf) & (i < lens))
            if not len(rows):
                continue
            lead = text[rows, i]
            size = np.where(lead < 0xF8, 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0), 1)
            to, cand = i + size, best[rows, i] + size * self.byte_score
            better = cand > best[rows, to]
            r, to, size, cand = rows[better], to[better], size[better], cand[better]
            best[r, to], piece[r, to], step[r, to] = cand, -1, size
            node, at = np.zeros(len(rows), np.int32), i
            while len(rows) and at < width:
                nxt = base[node] + text[rows, at]
                ok = (check[nxt] == node) & (at < lens[rows])
                rows, node = rows[ok], nxt[ok]
                at += 1
                v = value[node]
                hit = v >= 0
                r, v = rows[hit], v[hit]
                cand = best[r, i] + self.score[v]
                better = cand > best[r, at]
                r, v = r[better], v[better]
                best[r, at], piece[r, at], step[r, at] = cand[better], v, at - i
        out = np.full((w, width), -1, np.int32)
        pos, left, k, rows = lens.copy(), np.zeros(w, np.int64), 0, np.flatnonzero(lens > 0)
        while len(rows):
            p = pos[rows]
            inside = left[rows] > 0
            fall = ~inside & (piece[rows, p] < 0)
            left[rows[fall]] = step[rows[fall], p[fall]]
            byte = inside | fall
            ids = np.empty(len(rows), np.int32)
            ids[byte] = self.written[text[rows[byte], p[byte] - 1]]
            ids[~byte] = self.ids[piece[rows[~byte], p[~byte]]]
            out[rows, k] = ids
            pos[rows] -= np.where(byte, 1, step[rows, p])
            left[rows[byte]] -= 1
            k += 1
            rows = rows[pos[rows] > 0]
        n = (out >= 0).sum(1)
        turned = out[:, :k][:, ::-1]
        return turned[turned >= 0], n, best[np.arange(w), lens]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets of the texts)."""
        n = int(offsets[-1])
        starts = word_starts(buf, offsets)
        ends = np.append(starts[1:], n) if len(starts) else starts
        first = np.searchsorted(starts, offsets)
        lead = np.zeros(len(starts), bool)  # the first word of a text also has the marker put in front
        lead[first[:-1][first[:-1] < first[1:]]] = True
        h = kernels.hash_spans(buf, starts, ends)
        h = np.where(lead, kernels.mix(h ^ np.uint64(0x5851F42D4C957F2D)), h)
        hashes, back = np.unique(h, return_inverse=True)
        if len(self.known) + len(hashes) > CACHE_WORDS:
            self.clear()
        at = np.searchsorted(self.known, hashes)
        new = np.flatnonzero(np.append(self.known, 0)[at] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(new):
            where = np.empty(len(hashes), np.int64)
            where[back] = np.arange(len(back))
            place, raw = where[new], buf.tobytes()
            words = [marked(raw[a:b], l) for a, b, l in zip(starts[place].tolist(), ends[place].tolist(), lead[place].tolist())]
            ids, size, _ = self.best_paths(words)
            self.slot = np.insert(self.slot, at[new], len(self.size) + np.arange(len(new)))
            self.known = np.insert(self.known, at[new], hashes[new])
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
            self.size, self.pool = np.concatenate([self.size, size]), np.concatenate([self.pool, ids])
            at = np.searchsorted(self.known, hashes)
        slot = self.slot[at][back]
        size = self.size[slot]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.pool[np.repeat(self.start[slot] - total[:-1], size) + np.arange(total[-1])], total[first]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of ids laid end to end, each without the marker put in front."""
        size = self.width[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        raw = self.bytes[np.repeat(self.begin[ids] - total[:-1], size) + np.arange(total[-1])]
        offs = total[offsets]
        filled = offs[:-1] < offs[1:]
        keep = np.ones(len(raw), bool)
        keep[offs[:-1][filled]] = False
        return raw[keep], offs - np.concatenate([[0], np.cumsum(filled)])


def marked(word: bytes, lead: bool) -> bytes:
    """Spaces as markers, the text's own markers as bytes no piece starts with, one marker in front of a text."""
    mark = MARKER.encode()
    own = word.replace(mark, OWN_MARKER) if mark in word else word
    return mark * lead + own.replace(b" ", mark)


def word_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Text starts, spaces after something else, and newlines and what follows them."""
    n = int(offsets[-1])
    b = buf[:n]
    cut = np.zeros(n + 1, bool)
    cut[1:n] = ((b[1:] == 32) & (b[:-1] != 32)) | (b[1:] == 10) | (b[:-1] == 10)
    cut[offsets[:-1]] = True
    return np.flatnonzero(cut[:n])


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.load(path)


def encoded(docs: DataFrame, model: str, ids: bool = True) -> DataFrame:
    """doc_id, n_ids, n_bytes (ids that are bytes), ids_crc32, round_trip, and the ids if asked for.

    ``round_trip`` says that decoding the ids gives back the text.  Null and
    empty texts have no ids.  One row per input row, repeated rows too; other
    columns are ignored; an empty table gives no rows.
    """
    common.ready(docs.sparkSession)
    shape = "doc_id long, n_ids long, n_bytes long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        is_byte = np.zeros(len(v.width), bool)
        is_byte[v.byte_ids] = True
        for batch in kernels.chunks(batches):
            buf, offsets = kernels.text_buffer(batch.column("text"))
            flat, offs = v.encode(buf, offsets)
            raw, at = v.decode(flat, offs)
            same = np.diff(at) == np.diff(offsets)
            if same.all() and np.array_equal(raw, buf[: offsets[-1]]):
                pass
            else:
                same &= np.array([np.array_equal(raw[a:b], buf[c:d]) for a, b, c, d in zip(at[:-1], at[1:], offsets[:-1], offsets[1:])], bool)
            upto = np.concatenate([[0], np.cumsum(is_byte[flat])])
            data = flat.astype("<u4").tobytes()
            cols = [
                batch.column("doc_id"), pa.array(np.diff(offs)), pa.array(upto[offs[1:]] - upto[offs[:-1]]),
                pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], pa.int64()), pa.array(same),
            ]
            if ids:
                cols.append(pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in shape.split(", ")])

    return common.texts(docs, "doc_id", "text").mapInArrow(run, shape)


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids count as none.  Ids must be of the vocabulary."""
    common.ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            raw, at = v.decode(np.array([i for x in lists for i in x], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64))
            whole = raw.tobytes()
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path(), ids=False)
