"""Best-fit packing planned over the length histogram.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the
driver.  Best-fit decreasing runs over counts: bins that hold the same lengths
are one range of sequence ids, and a step puts as many equal pieces into as
many equal bins as it can.  Pieces then take their slots by a join on (length,
rank within length); the rank is computed in blocks, so one very common length
is never sorted by one task.
"""

from __future__ import annotations

import bisect
import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, kernels

CAPACITY = 2048
#: Distinct units whose ids a worker keeps; beyond it the cache starts anew.
CACHE_UNITS = 1_000_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def unit_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a byte-level pre-tokenizer is sure to start a new word.

    These are text starts, and single spaces or newlines between two
    characters that are not white space in any sense; a word never reaches
    across such a place, so units between them can be encoded apart.  Names of
    added tokens hold no white space and lie inside one unit.
    """
    n = int(offsets[-1])
    b = np.concatenate([np.zeros(3, np.uint8), buf[:n], np.zeros(3, np.uint8)])
    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0]] = True
    at = np.flatnonzero((b[3 : n + 3] == 32) | (b[3 : n + 3] == 10)) + 3
    p1, p2, p3, n1, n2 = b[at - 1], b[at - 2], b[at - 3], b[at + 1], b[at + 2]
    wide = lambda x, y: (x >= 0xE1) & (x <= 0xE3) & ((y == 0x9A) | (y == 0x80) | (y == 0x81))
    two = lambda x, y: (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
    bad = white[p1] | white[n1] | two(p2, p1) | two(n1, n2) | wide(p3, p2) | wide(n1, n2)
    cut = np.zeros(n + 1, bool)
    cut[at[~bad] - 3] = True
    cut[offsets[:-1]] = True
    return np.flatnonzero(cut[:n])


class UnitEncoder:
    """Token ids of whole texts from cached ids of their units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        # a byte-level vocabulary writes each byte as one character
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for piece, i in vocab.items():
            self.width[i] = len(piece)
        self.clear()

    def clear(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes of units, and their slots
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 1
        self.begin, self.size, self.slots = np.zeros(1 << 12, np.int64), np.ones(1 << 12, np.int64), 1  # slot 0: the id 0

    def add(self, hashes: np.ndarray, spans: list[tuple[int, int]], inner: np.ndarray, raw: bytes) -> None:
        """Encode new units.  Inner units (neither first nor last of a text) begin where a word must begin and end
        where one must end, so many of them are encoded as one text and its ids are dealt out by their byte lengths."""
        done = []
        for lone in (False, True):
            mine = np.flatnonzero(inner != lone).tolist()
            for g in range(0, len(mine), 4096):
                part = mine[g : g + 4096]
                units = [raw[spans[i][0] : spans[i][1]] for i in part]
                if lone:
                    each = [e.ids for e in self.batch([u.decode("utf-8", "replace") for u in units], add_special_tokens=False)]
                    lens = np.fromiter(map(len, each), np.int64, len(each))
                    flat = np.array([x for i in each for x in i], np.uint32)
                else:
                    flat = np.array(self.batch([b"".join(units).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.int64)
                    ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
                    upto = np.searchsorted(np.cumsum(self.width[flat]), ends) + 1
                    lens = np.diff(np.concatenate([[0], upto]))
                done.append((hashes[part], flat, lens))
        if done:
            self.keep(*map(np.concatenate, zip(*done)))

    def keep(self, hashes: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> None:
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.slots + len(lens) > len(self.size):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.pool[self.used : self.used + len(flat)] = flat
        self.begin[self.slots : self.slots + len(lens)] = self.used + np.cumsum(lens) - lens
        self.size[self.slots : self.slots + len(lens)] = lens
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.known = np.insert(self.known, at, hashes[order])
        self.slot = np.insert(self.slot, at, self.slots + order)
        self.used += len(flat)
        self.slots += len(lens)

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end_id: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets of the texts); each text is followed by id 0 if asked for."""
        starts = unit_starts(buf, offsets)
        ends = np.append(starts[1:], offsets[-1]) if len(starts) else starts
        hashes, back = np.unique(kernels.hash_spans(buf, starts, ends), return_inverse=True)
        if len(self.known) + len(hashes) > CACHE_UNITS:
            self.clear()
        first = np.searchsorted(starts, offsets)
        at = np.searchsorted(self.known, hashes)
        missing = np.flatnonzero(np.append(self.known, 0)[at] != hashes if len(self.known) else np.ones(len(hashes), bool))
        if len(missing):
            where = np.empty(len(hashes), np.int64)
            where[back] = np.arange(len(back))
            new = where[missing]
            inner = np.ones(len(starts), bool)
            filled = first[:-1] < first[1:]
            inner[first[:-1][filled]] = inner[first[1:][filled] - 1] = False
            self.add(hashes[missing], list(zip(starts[new].tolist(), ends[new].tolist())), inner[new], buf.tobytes())
            at = np.searchsorted(self.known, hashes)
        slots = self.slot[at][back]
        if end_id:
            slots = np.insert(slots, first[1:], 0)
            first = first + np.arange(len(first))
        size = self.size[slots]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.begin[slots] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[first]


@functools.lru_cache(2)
def encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of ``capacity`` tokens but the first, which may be shorter."""
    head = (n - 1) % capacity + 1
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 (and the token ids themselves if asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in kernels.chunks(batches):
            flat, offs = enc.encode(*kernels.text_buffer(batch.column("text")))
            names, rows, raw = batch.column("doc_id").to_pylist(), [], flat.astype("<u4").tobytes()
            for d, (a, b) in zip(names, zip(offs[:-1].tolist(), offs[1:].tolist())):
                for k, (s, m) in enumerate(cut(b - a, capacity)):
                    rows.append((d, k, s, m, zlib.crc32(raw[4 * (a + s) : 4 * (a + s + m)]), a + s))
            cols = list(zip(*rows))
            out = [pa.array(cols[i], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if ids:
                out.append(pa.array([flat[a : a + m].tolist() for a, m in zip(cols[5], cols[3])], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    return common.texts(docs, "doc_id", "text").mapInArrow(run, PIECE_SCHEMA + ", ids array<int>" * ids)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns slots (length, rank, count, sequence, offset): the pieces of that
    length with ranks rank .. rank + count - 1 go to as many sequences in
    turn, at that offset.
    """
    out: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of sequences
    rooms: list[int] = []
    opened = 0

    def put_back(room: int, start: int, count: int) -> None:
        if room and count:
            if room not in free:
                free[room] = []
                bisect.insort(rooms, room)
            free[room].append((start, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                start, count = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
            else:
                room = capacity
                start, count = opened, -(-left // (capacity // length))
                opened += count
            each = room // length
            full = min(count, left // each)
            for j in range(each if full else 0):
                out.append((length, rank, full, start, capacity - room + j * length))
                rank += full
            left -= full * each
            put_back(room - each * length, start, full)
            some = min(left, each) if full < count else 0
            for j in range(some):
                out.append((length, rank, 1, start + full, capacity - room + j * length))
                rank += 1
            left -= some
            put_back(room - some * length, start + full, 1 if some else 0)
            rest = full + (1 if some else 0)
            put_back(room, start + rest, count - rest)
    return out


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece its sequence_id and offset.  ``parts`` should be a written table."""
    spark = parts.sparkSession
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = plan(counts, capacity)
    shape = "length long, rank_lo long, rank_hi long, seq long, offset long"
    planned = spark.createDataFrame([(a, b, b + c, s, o) for a, b, c, s, o in slots], shape)
    n_blocks = max(16, sum(counts.values()) // 20_000)
    keyed = parts.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_blocks)))
    sizes = keyed.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = sizes.select(
        "length", "block",
        (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("ahead"),
    )
    order = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        keyed.withColumn("at", F.row_number().over(order)).join(before, ["length", "block"])
        .withColumn("rank", F.col("ahead") + F.col("at") - 1)
    )
    # the plan has at most a few ranges for each of `capacity` lengths, whatever the corpus
    fit = (ranked.length == planned.length) & (ranked.rank >= planned.rank_lo) & (ranked.rank < planned.rank_hi)
    return ranked.join(F.broadcast(planned), fit).select(
        *(ranked[c] for c in parts.columns),
        (F.col("seq") + F.col("rank") - F.col("rank_lo")).alias("sequence_id"), F.col("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    Null texts count as empty (their one piece is the end id).  Repeated rows
    and repeated or null doc_ids are packed each for itself.  An empty table
    gives no rows.  A text may have any length: it becomes pieces of
    ``capacity`` tokens.  Names of added tokens in a text become their ids, as
    the tokenizer does it.  Pieces equal in all take any of their slots.  Other
    columns are ignored.
    """
    common.ready(docs.sparkSession)
    return place(common.table(pieces(docs, tokenizer, capacity, ids), "pieces"), capacity)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
