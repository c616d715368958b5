"""Vectorised byte kernels shared by the text operators.

Every function works on one *buffer*: the UTF-8 bytes of many texts laid end
to end (exactly how Arrow stores a string column) plus the offsets of the
texts.  Words are maximal runs of bytes outside ``[\\x09-\\x0D\\x20]``; those
bytes never occur inside a multi-byte UTF-8 sequence, so byte-level splitting
and code-point-level splitting agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text handled at once inside a task; bounds the working set.
CHUNK_BYTES = 3 << 20
#: Words longer than this are hashed one by one, the others in bulk.
LONG_WORD = 128

_U = np.uint64
_C1, _C2, _C3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the splitmix64 constants)."""
    x = x ^ (x >> _U(30))
    x *= _C2
    x ^= x >> _U(27)
    x *= _C3
    x ^= x >> _U(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes padded by eight zeros, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(8, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    out = np.zeros(len(raw) + 8, np.uint8)
    out[: len(raw)] = raw
    return out, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice record batches so that each holds about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and for each text the index of its first word."""
    n = int(offsets[-1])
    sep = SEPARATOR[buf[:n]]
    inside = ~sep
    head = np.zeros(n + 1, bool)
    head[offsets[:-1]] = True
    start = inside.copy()
    start[1:] &= sep[:-1] | head[1:n]
    end = inside.copy()
    end[:-1] &= sep[1:] | head[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span; ``buf`` has eight bytes of padding."""
    wide = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    size = ends - starts
    out = mix((size.astype(np.uint64) + _U(seed + 1)) * _C1)
    todo = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at = 0
    while len(todo):
        word = wide[starts[todo] + at]
        left = np.minimum(size[todo] - at, 8).astype(np.uint64)
        word = word & (~_U(0) >> ((_U(8) - left) * _U(8)))
        out[todo] = mix((out[todo] ^ word) * _C1 + _C3)
        at += 8
        todo = todo[size[todo] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed)
    return out


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and the offsets of each text's shingles.

    A text of one to k-1 words gives one shingle: its whole word sequence.
    """
    n = len(words)
    count = np.diff(first)
    want = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    offs = np.concatenate([[0], np.cumsum(want)])
    if n == 0:
        return np.zeros(0, np.uint64), offs
    left = np.repeat(first[1:], count) - np.arange(n)
    m = max(n - k + 1, 0)
    acc = np.full(m, k, np.uint64) * _C1
    for j in range(k):
        acc = mix((acc ^ words[j : j + m]) * _C1 + _C2)
    full = np.flatnonzero(left[:m] >= k)
    out = np.empty(int(offs[-1]), np.uint64)
    long_text = np.repeat(count >= k, want)
    out[long_text] = acc[full]
    for d in np.flatnonzero((count > 0) & (count < k)):
        h = np.full(1, int(count[d]), np.uint64) * _C1
        for w in words[first[d] : first[d + 1]]:
            h = mix((h ^ w) * _C1 + _C2)
        out[offs[d]] = h[0]
    return out, offs


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def order_keys(hashes: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Token identities whose numeric order is rarity order: a rarity class in the top byte, hash bits below."""
    cls = rarity[(hashes & _U(len(rarity) - 1)).astype(np.int64)].astype(np.uint64)
    return ((cls >> _U(1)) << _U(56)) | (hashes >> _U(8))
