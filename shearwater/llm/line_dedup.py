"""Line dedup by an exact set-similarity join.

Lines are token sets (distinct words, A-Z lower-cased).  Tokens are ordered by
rarity over all documents; only a line's prefix is indexed; length, positional
and bitmap bounds prune pairs inside a token's group; what is left is verified
on the whole token sets.  A line goes when an earlier line of the corpus is
similar (Jaccard >= 0.8), so it is enough to find *one* earlier match of each
line, which keeps large groups of near copies from becoming all pairs.
Postings are many and small, so tasks hand them on as blocks of columns, one
for each of as many buckets of tokens as the corpus needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels, setjoin

WIDTH = 1 << 20
#: Groups up to this size are compared pair by pair in bulk, larger ones row by row.
SMALL = 400
#: In a group a line with a very likely match and many candidates first tries its likeliest ones only; a second round
#: takes all the others of lines for which these fail.
FEW = 8
#: Lines of more tokens than this also have a signature of 256 bits.
WIDE = 80
#: Postings that a task holds at most before it hands them on, and the words of the corpus to a bucket of tokens.
HELD, WORDS = 1 << 18, 600_000
#: Columns of postings; each row with more than WIDE tokens also has four words of the wide signature in ``wide``.
FIELDS = {"key": np.int64, "cls": np.int64, "sig": np.uint64, "doc": np.int64, "line": np.int32, "n": np.int32, "pos": np.int32, "wide": np.uint64}
_LOWEST = -(1 << 63)


def _place(doc, line):
    """One long for a place: arrays or columns."""
    if isinstance(doc, Column):
        return doc.bitwiseXOR(F.shiftleft(line.cast("long"), 40))
    return doc ^ (line.astype(np.int64) << 40)


class Lines:
    """Lines and words of one buffer of texts; with ``places``, a Bloom filter, only of lines at these."""

    def __init__(self, batch: pa.RecordBatch, places: np.ndarray | None = None):
        buf, self.offsets = kernels.text_buffer(batch.column("text"))
        n = int(self.offsets[-1])
        newline = np.flatnonzero(buf[:n] == 10)
        filled = self.offsets[:-1][np.diff(self.offsets) > 0]
        begin = np.union1d(newline + 1, filled)
        # a newline that ends a text opens one more, empty line; those hold no words and are left out
        self.begin = begin[begin < n]
        self.doc = np.searchsorted(self.offsets, self.begin, "right") - 1
        self.number = np.cumsum(np.ones(len(self.begin), np.int64)) - 1
        head = np.searchsorted(self.begin, self.offsets[:-1])
        self.number -= head[self.doc] if len(self.begin) else 0
        if places is not None:
            have = np.flatnonzero(common.in_bloom(places, _place(batch.column("doc").to_numpy()[self.doc], self.number)))
            size = np.diff(np.append(self.begin, n))[have]
            cuts = np.concatenate([[0], np.cumsum(size)])
            n, some = int(cuts[-1]), np.zeros(int(cuts[-1]) + 8, np.uint8)
            some[:n] = buf[np.repeat(self.begin[have] - cuts[:-1], size) + np.arange(n)]
            buf, self.offsets, self.begin, self.doc, self.number = some, cuts, cuts[:-1], self.doc[have], self.number[have]
        low = kernels.LOWER[buf]
        starts, ends, _ = kernels.word_spans(low, self.offsets)
        self.words = kernels.hash_spans(low, starts, ends)
        self.first = np.searchsorted(starts, np.append(self.begin, n))
        self.count = np.diff(self.first)

    def classes(self) -> np.ndarray:
        """A hash of each line's word sequence; 0 for lines without words."""
        out = np.zeros(len(self.count), np.uint64)
        if len(self.words):
            at = (np.arange(len(self.words)) - np.repeat(self.first[:-1], self.count)).astype(np.uint64)
            term = kernels.mix(self.words ^ kernels.mix((at + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
            full = self.count > 0
            out[full] = kernels.mix(np.add.reduceat(term, self.first[:-1][full]) + self.count[full].astype(np.uint64)) | np.uint64(1)
        return kernels.signed(out)

    def sets(self, keys: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, sizes): distinct tokens of the given lines in key order, end to end."""
        count = self.count[lines]
        at = np.repeat(self.first[:-1][lines] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        line, keys = np.repeat(np.arange(len(lines), dtype=np.uint64), count), keys[at]
        bits = np.uint64(max(1, int(len(lines) - 1).bit_length()))
        short = line << (np.uint64(64) - bits) | keys >> bits
        order = np.argsort(short, kind="stable")
        short, sorted_ = short[order], keys[order]
        if ((short[1:] == short[:-1]) & (sorted_[1:] != sorted_[:-1])).any():  # the bits left out of ``short`` matter
            order = np.lexsort((keys, line))
            sorted_ = keys[order]
        line = line[order].astype(np.int64)
        new = np.concatenate([[True], (sorted_[1:] != sorted_[:-1]) | (line[1:] != line[:-1])]) if len(line) else np.zeros(0, bool)
        return sorted_[new], np.bincount(line[new], minlength=len(lines))


class Met:
    """Classes met lately with the first place of each, in a fixed number of slots."""

    def __init__(self, slots: int = 1 << 16):
        self.mask = np.int64(slots - 1)
        self.cls, self.doc, self.line = (np.zeros(slots, np.int64) for _ in range(3))

    def news(self, cls: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Rows with a class that isn't in a slot, or with an earlier place than that; one row a class."""
        rows = np.flatnonzero(cls)
        rows = rows[np.lexsort((line[rows], doc[rows], cls[rows]))]
        rows = rows[np.concatenate([[True], cls[rows][1:] != cls[rows][:-1]])] if len(rows) else rows
        at = cls[rows] & self.mask
        later = (doc[rows] > self.doc[at]) | (doc[rows] == self.doc[at]) & (line[rows] >= self.line[at])
        rows = rows[(self.cls[at] != cls[rows]) | ~later]
        at = cls[rows] & self.mask
        self.cls[at], self.doc[at], self.line[at] = cls[rows], doc[rows], line[rows]
        return np.sort(rows)


def _prepared(docs: DataFrame) -> DataFrame:
    """Rows as the operator reads them: doc_id (null: lowest), a hash of the text, the text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc"), F.xxhash64("text").alias("th"), "text")


def listed(docs: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """(cls, doc, th, line) of every line that holds words, rarity classes of tokens, and the number of words."""

    def rows(batch: pa.RecordBatch, counts: np.ndarray) -> pa.RecordBatch:
        x = Lines(batch)
        counts += np.bincount((x.words & np.uint64(WIDTH - 1)).astype(np.int64), minlength=WIDTH)
        full = np.flatnonzero(x.count > 0)
        doc, th = (batch.column(c).to_numpy()[x.doc[full]] for c in ("doc", "th"))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (x.classes()[full], doc, th, x.number[full].astype(np.int32))], ["cls", "doc", "th", "line"])

    lines, counts = setjoin.counted(docs, rows, "cls long, doc long, th long, line int", WIDTH, "lines")
    return lines, common.rarity_classes(counts), int(counts.sum())


def _wide_signatures(keys: np.ndarray, n: np.ndarray, wide: int) -> np.ndarray:
    """256 bits, as four words, for each set of more than ``wide`` tokens; each token flips one."""
    start, long_ = np.cumsum(n) - n, np.flatnonzero(n > wide)
    out = [np.zeros((0, 4), np.uint64)]
    for k in range(0, len(long_), 2048):
        part = long_[k : k + 2048]
        size = n[part]
        at = np.repeat(start[part] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        bit = np.repeat(np.arange(len(part)) * 256, size) + ((keys[at] >> np.uint64(6)).astype(np.int64) & 255)
        out.append(np.packbits(np.bincount(bit, minlength=256 * len(part)).astype(np.uint8).reshape(-1, 256) & 1, axis=1).view(np.uint64))
    return np.concatenate(out)


def _posted(keys: np.ndarray, n: np.ndarray, cls: np.ndarray, doc: np.ndarray, line: np.ndarray, wide: int, only: np.ndarray | None) -> dict[str, np.ndarray]:
    """Columns of postings for lines with these token sets, end to end in ``keys``.

    Tokens in a bucket counted once can't match and aren't indexed.  ``sig``
    has a bit flipped by each token: two sets differ in at least as many
    tokens as their signatures differ in bits; long lines also have a wide
    one.  ``doc`` and ``line`` are the place, ``n`` is the number of tokens and
    ``pos`` the token's position.  ``only`` is a Bloom filter of keys.
    """
    start = np.cumsum(n) - n
    sig = np.bitwise_xor.reduceat(np.uint64(1) << (keys & np.uint64(63)), start)
    pos = np.arange(len(keys)) - np.repeat(start, n)
    take = (pos < np.repeat(setjoin.prefix(n), n)) & (keys >> np.uint64(56) > 0)
    if only is not None:
        take[take] = common.in_bloom(only, kernels.signed(keys[take]))
    of = np.repeat(np.arange(len(n)), n)[take]
    big = n > wide
    long_ = (np.cumsum(big) - 1)[of[big[of]]]
    return {"key": kernels.signed(keys[take]), "cls": cls[of], "sig": sig[of], "doc": doc[of], "line": line[of], "n": n[of], "pos": pos[take], "wide": _wide_signatures(keys, n, wide)[long_]}


def _blocks(parts: Iterator[dict[str, np.ndarray]], buckets: int, wide: int) -> Iterator[pa.RecordBatch]:
    """Postings as rows (bucket, a binary for each column): a token's bucket depends on its hash alone."""

    def block(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        g = {c: np.concatenate([h[c] for h in held]).astype(kind, copy=False) for c, kind in FIELDS.items()}
        bucket = (kernels.mix(g["key"].view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
        bucket, big = bucket[order], g["n"] > wide
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        cuts = np.append(start, len(bucket))
        wides = np.concatenate([[0], np.cumsum(big[order])])[cuts]
        cols = []
        for c, v in g.items():
            v, at = (v[(np.cumsum(big) - 1)[order[big[order]]]], wides) if c == "wide" else (v[order], cuts)
            ends = (at * v.itemsize * (4 if c == "wide" else 1)).astype(np.int32)
            cols.append(pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(v).reshape(-1))]))
        return pa.RecordBatch.from_arrays([pa.array(bucket[start].astype(np.int32)), *cols], ["bucket", *g])

    held, rows = [], 0
    for part in parts:
        if len(part["key"]):
            held.append(part)
            rows += len(part["key"])
        if rows >= HELD:
            yield block(held)
            held, rows = [], 0
    if held:
        yield block(held)


BLOCKS = "bucket int, " + ", ".join(f"{c} binary" for c in FIELDS)


def postings(docs: DataFrame, rarity: object, buckets: int) -> DataFrame:
    """Blocks of postings: prefix tokens of every line that its task meets for the first time."""
    wide = WIDE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[dict[str, np.ndarray]]:
            met = Met()
            for batch in kernels.chunks(batches):
                x = Lines(batch)
                cls = x.classes()
                doc = batch.column("doc").to_numpy()[x.doc]
                lines = met.news(cls, doc, x.number)
                if len(lines):
                    keys, n = x.sets(kernels.order_keys(x.words, rarity.value), lines)
                    yield _posted(keys, n, cls[lines], doc[lines], x.number[lines], wide, None)

        return _blocks(parts(), buckets, wide)

    return docs.mapInArrow(run, BLOCKS)


def postings_of(sets: DataFrame, only: object, buckets: int) -> DataFrame:
    """The same blocks from (cls, keys, doc, line), for keys in a Bloom filter."""
    wide = WIDE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[dict[str, np.ndarray]]:
            for batch in batches:
                if batch.num_rows:
                    cls, doc, line = (batch.column(c).to_numpy() for c in ("cls", "doc", "line"))
                    n = batch.column("keys").value_lengths().to_numpy().astype(np.int64)
                    yield _posted(batch.column("keys").flatten().to_numpy().view(np.uint64), n, cls, doc, line, wide, only.value)

        return _blocks(parts(), buckets, wide)

    return sets.select("cls", "keys", "doc", "line").mapInArrow(run, BLOCKS)


def _bound(g: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmap, length and positional filters: (numbers of the pairs that can still be similar, bits that differ over bits that may)."""
    a, b = g["n"][i], g["n"][j]
    both = a + b
    at = np.flatnonzero(np.bitwise_count(g["sig"][i] ^ g["sig"][j]) <= both // 9)  # both - 2 * overlap is at most both / 9
    if not len(at):
        return at, np.zeros(0)
    a, b, i, j = a[at], b[at], i[at], j[at]
    need = setjoin.overlap(a, b)
    ok = (np.minimum(a, b) * setjoin.DEN >= np.maximum(a, b) * setjoin.NUM) & (np.minimum(a - g["pos"][i], b - g["pos"][j]) >= need)
    at, a, b, i, j, need = (x[ok] for x in (at, a, b, i, j, need))
    flips = np.bitwise_count(g["sig"][i] ^ g["sig"][j]).astype(np.int64)
    wi, wj = g["at"][i], g["at"][j]
    two = np.flatnonzero((wi >= 0) & (wj >= 0))
    flips[two] = np.bitwise_count(g["wide"][wi[two]] ^ g["wide"][wj[two]]).astype(np.int64).sum(1)
    most = a + b - 2 * need
    ok = flips <= most
    return at[ok], flips[ok] / np.maximum(most[ok], 1)


def _by_place(g: dict[str, np.ndarray]) -> np.ndarray:
    """Order of rows by doc, line and, where these repeat, cls."""
    bits = int(g["line"].max()).bit_length()
    if (int(g["doc"].max()) - int(g["doc"].min())).bit_length() + bits < 63:
        at = (g["doc"] - g["doc"].min()) << bits | g["line"]
        order = np.argsort(at)
        same = at[order[1:]] == at[order[:-1]]
        if not (same & (g["cls"][order[1:]] != g["cls"][order[:-1]])).any():
            return order
    return np.lexsort((g["cls"], g["line"], g["doc"]))


def candidates(posts: DataFrame, every: object | None = None) -> DataFrame:
    """(a, b, more, ad, al, bd, bl): line class a and an earlier class b it may be similar to, with the places of both.

    In a group a line with many candidates gets its earliest and ``more``; it
    and the others are only named, in rows where a is b.  With ``every``, a
    Bloom filter over classes: all candidates of those classes and nothing else.
    """
    least_wide = WIDE

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: dict[str, list[bytes]] = {c: [] for c in FIELDS}
        for batch in batches:
            for c, v in raw.items():
                v.extend(batch.column(c).to_pylist())
        g = {c: np.frombuffer(b"".join(raw.pop(c)), kind) for c, kind in FIELDS.items()}
        wide = g.pop("wide").reshape(-1, 4)
        g["n"], g["pos"] = g["n"].astype(np.int64), g["pos"].astype(np.int64)
        big = g["n"] > least_wide
        g["at"] = np.where(big, np.cumsum(big) - 1, -1)
        order = np.argsort(g["key"])
        start, size = setjoin.group_bounds(g["key"][order])
        able = np.add.reduceat(g["n"][order] >= 9 * g["pos"][order], start) > 0 if len(start) else size > 1
        group = np.repeat(np.arange(len(size)), size)
        kept = np.repeat((size > 1) & able, size)  # without a row that has a longest partner no pair is close
        order, group = order[kept], group[kept]
        if len(order):
            g = {c: v[order] for c, v in g.items()}
            g["group"] = group << 32 | g["n"]
            order = _by_place(g)
            g["place"] = np.empty(len(order), np.int64)
            g["place"][order] = np.arange(len(order))
            # the same class from several tasks: its first place counts
            order = order[np.lexsort((g["cls"][order], g["group"][order]))]
            again = np.concatenate([[False], (g["group"][order[1:]] == g["group"][order[:-1]]) & (g["cls"][order[1:]] == g["cls"][order[:-1]])])
            g = {c: v[order[~again]] for c, v in g.items()}
            g["wide"], place = wide, g["place"]
            wanted = None if every is None else common.in_bloom(every.value, g["cls"])
            start, size = setjoin.group_bounds(g["group"] >> 32)
            # rows of a group by size: the partners of each as the shorter one, up to the longest possible, come next
            longest = np.maximum((5 * g["n"] - 9 * g["pos"]) // 4, 0)
            left = np.searchsorted(g["group"], (g["group"] >> 32 << 32) + longest, "right") - np.arange(len(place))
            small = np.repeat(size <= SMALL, size)
            later, earlier, odds = [], [], []

            def put(i, j):
                late = place[i] > place[j]
                a, b = np.where(late, i, j), np.where(late, j, i)
                if wanted is not None:
                    a, b = a[wanted[a]], b[wanted[a]]
                ok, part = _bound(g, a, b)
                if len(ok):
                    later.append(a[ok])
                    earlier.append(b[ok])
                    odds.append(part)

            for i, j in setjoin.pairs_within(np.where(small, left, 0)):
                put(i, j)
            for k in np.flatnonzero(~small & (left > 1)).tolist():
                put(np.full(left[k] - 1, k), np.arange(k + 1, k + left[k]))
            a, b, part = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (later, earlier, odds))
            more, named = np.zeros(len(a), bool), np.zeros(0, np.int64)
            if every is None and len(a):
                order = np.lexsort((place[b], part, a))
                a, b, part = a[order], b[order], part[order]
                start, size = setjoin.group_bounds(a)
                many = np.repeat((size > FEW) & (part[start] <= 0.5), size)
                named = np.union1d(a[many], b[many])
                named = named[np.unique(g["cls"][named], return_index=True)[1]]
                keep = ~many | (np.arange(len(a)) - np.repeat(start, size) < FEW)
                a, b, more = a[keep], b[keep], many[keep]
            if len(a):
                a, b, more = np.concatenate([a, named]), np.concatenate([b, named]), np.concatenate([more, np.zeros(len(named), bool)])
                cols = [g["cls"][a], g["cls"][b], more, g["doc"][a], g["line"][a], g["doc"][b], g["line"][b]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "more", "ad", "al", "bd", "bl"])

    return posts.groupBy("bucket").applyInArrow(run, "a long, b long, more boolean, ad long, al int, bd long, bl int")


def sets_of(docs: DataFrame, wanted: object, places: object, rarity: object) -> DataFrame:
    """(cls, keys): token sets of the line classes in a Bloom filter, read where another one has their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = common.Recent()
        for batch in kernels.chunks(batches):
            x = Lines(batch, places.value)
            cls = x.classes()
            lines = np.flatnonzero(recent.fresh(np.where(common.in_bloom(wanted.value, cls), cls, 0)))
            if len(lines):
                keys, n = x.sets(kernels.order_keys(x.words, rarity.value), lines)
                cuts = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cls[lines]), pa.ListArray.from_arrays(pa.array(cuts), pa.array(kernels.signed(keys)))], ["cls", "keys"])

    return docs.mapInArrow(run, "cls long, keys array<long>").groupBy("cls").agg(F.first("keys").alias("keys"))


def similar(docs: DataFrame, rarity: np.ndarray, words: int) -> DataFrame:
    """(cls) of the line classes that have an earlier similar class, in a corpus of so many words."""
    sc = docs.sparkSession.sparkContext
    rare = sc.broadcast(rarity)
    buckets = 1 + words // WORDS

    def check(pairs: DataFrame) -> DataFrame:
        return setjoin.verified(pairs, known).where(setjoin.enough()).select(F.col("a").alias("cls")).distinct()

    place = ("ad", "al", "bd", "bl")
    tried = candidates(postings(docs, rare, buckets)).groupBy("a", "b").agg(F.max("more").alias("more"), *(F.first(c).alias(c) for c in place))
    tried = common.table(tried, "candidates")
    wanted = sc.broadcast(common.bloom(tried.select(F.explode(F.array("a", "b")).alias("cls")), "cls"))
    at = F.array(*(_place(F.col(f"{x}d"), F.col(f"{x}l")) for x in "ab"))
    places = sc.broadcast(common.bloom(tried.select(F.explode(at).alias("place")), "place"))
    known = common.table(sets_of(docs, wanted, places, rare), "sets")
    pairs = tried.where("a <> b").select("a", "b", "more")
    found = common.table(check(pairs.select("a", "b")), "similar")
    # lines whose few tried candidates failed try all the others, which are among those named
    left = common.table(pairs.where("more").select(F.col("a").alias("cls")).distinct().join(found, "cls", "left_anti"), "unsettled")
    if left.isEmpty():
        return found
    every = sc.broadcast(common.bloom(left, "cls"))
    asked = known.join(left, "cls", "left_semi")
    keys = sc.broadcast(common.bloom(asked.select(F.explode(F.slice("keys", F.lit(1), setjoin.prefix(F.size("keys")))).alias("key")), "key"))
    named = tried.where("a = b").select(F.col("a").alias("cls"), F.col("ad").alias("doc"), F.col("al").alias("line"))
    rest = candidates(postings_of(known.join(named, "cls"), keys, buckets), every).select("a", "b").distinct().join(left.withColumnRenamed("cls", "a"), "a", "left_semi")
    rest = common.table(rest.join(pairs, ["a", "b"], "left_anti"), "rest")
    return found.union(check(rest)).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc, th, gone array<int>): numbers (from 0) of the lines to remove in each text that loses any."""
    lines, rarity, words = listed(docs)
    late = similar(docs, rarity, words)
    place = F.struct("doc", "line", "th")
    # only classes that lose a line: late ones, and those that are there more than once
    first = lines.groupBy("cls").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(late.withColumn("late", F.lit(True)), "cls", "left")
    first = common.table(first.where("n > 1 or late").select("cls", "first", F.coalesce("late", F.lit(False)).alias("late")), "first")
    gone = common.spread_join(lines, first, "cls", "doc").where(F.col("late") | (place != F.col("first")))
    return gone.groupBy("doc", "th").agg(F.collect_set("line").alias("gone"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with later similar lines taken out of ``text``, and n_lines, n_removed.

    Lines are ordered by doc_id (nulls first), then by line number, then, where
    doc_ids repeat, by a hash of the line's words or, for equal lines, of the
    text; rows equal in doc_id and text count as one document and are treated
    alike.  Lines without words always stay.  Null
    texts stay null with 0 lines; a text that loses every line becomes empty.
    All rows and all other columns stay; n_lines and n_removed replace columns
    of those names.  Texts and lines may have any length.  An empty table
    gives no rows.
    """
    common.ready(docs.sparkSession)
    gone = removed_lines(_prepared(docs))
    own = {c: f"_{c}_{uuid.uuid4().hex[:8]}" for c in ("doc", "th", "gone", "lines", "none", "d", "h")}  # names no column of the caller has
    gone = gone.select(*(F.col(c).alias(own[c]) for c in ("doc", "th", "gone")))
    out = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(
        *(c for c in out if c != "text"), F.col("text").isNull().alias(own["none"]), F.split("text", "\n", -1).alias(own["lines"]),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias(own["d"]), F.xxhash64("text").alias(own["h"]),
    )
    joined = keyed.join(gone, (F.col(own["d"]) == F.col(own["doc"])) & (F.col(own["h"]) == F.col(own["th"])), "left")
    lines, left = F.col(own["lines"]), F.coalesce(own["gone"], F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), left)  # both hold a number once at most
    text = F.when(F.size(left) == 0, F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    null = F.col(own["none"])
    return joined.select(
        *(F.when(~null, text).alias("text") if c == "text" else F.col(c) for c in out),
        F.when(null, 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.size(left).cast("long").alias("n_removed"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
