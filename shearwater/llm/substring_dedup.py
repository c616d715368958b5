"""Repeated passages across documents by compact windows.

Tokens are 5-word shingles.  Under each of HASHES functions a text has a
Cartesian tree over its token hashes; a node (l, c, r) of it is a compact
window: all subsequences of [l, r] that hold the root c have c's hash as their
min-hash.  Only nodes that can hold a passage of WORDS words are kept, with l
and r at most a passage away from c, so a text of n words has about 2n / WORDS
of them a function, and they cover every subsequence of that width.

1. Windows meet by (function, min-hash); those of a single text are dropped.
2. The windows of a text are joined with each other as intervals: wherever
   windows of ENOUGH functions have a subsequence in common, their min-hashes
   are a signature of it.
3. Texts with equal signatures form a group.  Each member is verified against
   the group's leader by extending from their roots, word by word (32-bit
   hashes of words).  A group of any size costs one comparison a member.
4. Members of larger groups meet once more by the exact runs of GRAM words
   around their roots that don't lie in what they share with the leader; each
   group of these again has one leader, and members that fail there meet by
   their exact passages of WORDS words.  So texts that repeat a passage exactly
   find each other, whatever the sizes of groups.
5. Matched passages are linked to passage classes: connected components of
   (text, passage) nodes.  Nothing is ever expanded to all pairs of a group.

Keys of very many rows are known from counts in a fixed number of buckets over
all documents; they are spread over tasks by text and get a leader a share,
and the leaders meet a second time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels, setjoin

WORDS, SHINGLE, HASHES, ENOUGH = 50, 5, 5, 2
WINDOW = WORDS - SHINGLE + 1
MATCH, MISMATCH, DROP, LIKE = 1, -4, 16, 0.8
#: Buckets of the shingle counts; keys of buckets beyond HOT rows (and beyond 8 times the mean) are spread.
WIDTH, HOT = 1 << 20, 20_000
#: Any WORDS words around a root hold one of the runs of GRAM words that start STEP words apart from the root.
STEP = 8
GRAM = WORDS - STEP + 1
_BITS = 22
_POS = (1 << _BITS) - 1
_SEEDS = [np.uint64(0x9E3779B97F4A7C15 * (2 * f + 1) & (1 << 64) - 1) for f in range(HASHES)]


def hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each text, class of each text's word sequence; 0 without words)."""
    buf, offsets = kernels.text_buffer(batch.column("text"))
    low = kernels.LOWER[buf]
    starts, ends, first = kernels.word_spans(low, offsets)
    words = kernels.hash_spans(low, starts, ends)
    cls = np.zeros(len(first) - 1, np.uint64)
    count = np.diff(first)
    if len(words):
        at = (np.arange(len(words)) - np.repeat(first[:-1], count)).astype(np.uint64)
        term = kernels.mix(words ^ kernels.mix((at + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
        cls[count > 0] = kernels.mix(np.add.reduceat(term, first[:-1][count > 0]) + count[count > 0].astype(np.uint64)) | np.uint64(1)
    return words, first, kernels.signed(cls)


def _lowest(values: np.ndarray) -> np.ndarray:
    """Place of the smallest of each WINDOW values in a row (the first of equal ones), by minima of blocks.

    Places take the low _BITS bits beside the value, so longer inputs are done in pieces.
    """
    n, w = len(values), WINDOW
    step = _POS - 2 * w
    if n - w + 1 > step:
        return np.concatenate([_lowest(values[s : s + step + w - 1]) + s for s in range(0, n - w + 1, step)])
    packed = (values & ~np.uint64(_POS)) | np.arange(n, dtype=np.uint64)
    full = np.full(-(-n // w) * w + w, ~np.uint64(0))
    full[:n] = packed
    grid = full.reshape(-1, w)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.arange(n - w + 1)
    return (np.minimum(tail[at], head[at + w - 1]) & np.uint64(_POS)).astype(np.int64)


def roots(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of the compact windows of texts laid end to end: root, first and last shingle, at most WINDOW - 1 from c."""
    n, w = len(values), WINDOW
    if n < w:
        return (np.zeros(0, np.int64),) * 3
    low, at = _lowest(values), np.arange(n - w + 1)
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(n)
    valid = left[: n - w + 1] >= w
    at, low = at[valid], low[valid]
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    last = np.append(new[1:], len(at)) - 1
    return low[new], at[new], at[last] + w - 1


def _packed(l: np.ndarray, c: np.ndarray, r: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """One long of a window: l, the power of two of its key's shares, c - l and r - l - WINDOW + 1 (both below WINDOW)."""
    return l << 22 | shares.astype(np.int64) << 16 | (c - l) << 8 | (r - l - WINDOW + 1)


def rows_of(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, cls, n_words) of every text of at least WORDS words, and shingle counts by bucket over all documents."""

    def rows(batch: pa.RecordBatch, counts: np.ndarray) -> pa.RecordBatch:
        words, first, cls = hashed(batch)
        h, offs = kernels.shingles(words, first, SHINGLE)
        counts += np.bincount((h & np.uint64(WIDTH - 1)).astype(np.int64), minlength=WIDTH)
        ok = np.flatnonzero(np.diff(first) >= WORDS)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ok)), pa.array(cls[ok]), pa.array(np.diff(first)[ok])], ["doc_id", "cls", "n_words"])

    return setjoin.counted(docs, rows, "doc_id long, cls long, n_words long", WIDTH, "texts")


def heat(counts: np.ndarray) -> np.ndarray:
    """For each bucket how many shares its keys are spread over, as a power of two (0: not hot)."""
    bound = max(HOT, 8 * float(counts.mean()))
    return np.ceil(np.log2(np.maximum(counts / bound, 1))).astype(np.uint8)


def windows(docs: DataFrame, warm: object) -> DataFrame:
    """(key, cls, at): a row for each compact window; key holds the root's hash and the function in its lowest bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = common.Recent()
        for batch in kernels.chunks(batches):
            words, first, cls = hashed(batch)
            h, offs = kernels.shingles(words, first, SHINGLE)
            fresh = recent.fresh(cls)
            text = np.repeat(np.arange(len(cls)), np.diff(offs))
            for f, seed in enumerate(_SEEDS):
                v = kernels.mix(h ^ seed)
                c, l, r = roots(v, offs)
                ok = fresh[text[c]]
                c, l, r = c[ok], l[ok], r[ok]
                if len(c):
                    d = text[c]
                    key = kernels.signed((kernels.mix(v[c]) & ~np.uint64(7)) | np.uint64(f))
                    lo = offs[d]
                    shares = warm.value[(h[c] & np.uint64(WIDTH - 1)).astype(np.int64)]
                    cols = [key, cls[d], _packed(l - lo, c - lo, r - lo, shares)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "cls", "at"])

    return docs.mapInArrow(run, "key long, cls long, at long")


def shared_windows(found: DataFrame) -> DataFrame:
    """(cls, key, at): windows whose min-hash occurs in several texts, or is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in common.sorted_groups(batches, "key"):
            start, size = setjoin.group_bounds(g["key"])
            two = (np.minimum.reduceat(g["cls"], start) != np.maximum.reduceat(g["cls"], start)) | np.logical_or.reduceat((g["at"] >> 16 & 63) > 0, start)
            keep = np.flatnonzero(np.repeat(two, size))
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(g[c][keep]) for c in ("cls", "key", "at")], ["cls", "key", "at"])

    where = F.when(F.col("at").bitwiseAND(63 << 16) > 0, F.xxhash64("key", "cls")).otherwise(F.col("key"))
    return found.repartition(where).sortWithinPartitions("key").mapInArrow(run, "cls long, key long, at long")


def signatures(shared: DataFrame) -> DataFrame:
    """(sig, cls, c, share): where windows of two functions intersect in a passage; c is the first function's root.

    The interval join runs inside a text, over both functions' windows by their
    first and last passage; a text's windows never leave its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in common.sorted_groups(batches, "cls"):
            order = np.lexsort((g["at"], g["key"] & 7, g["cls"]))
            cls, key, at = (g[c][order] for c in ("cls", "key", "at"))
            again = np.concatenate([[False], (cls[1:] == cls[:-1]) & (at[1:] == at[:-1]) & (key[1:] == key[:-1])])
            cls, key, at = cls[~again], key[~again], at[~again]
            text = np.cumsum(np.concatenate([[0], cls[1:] != cls[:-1]])).astype(np.int64)
            first = (text << 40) + (at >> 22)
            last, c = first + (at & 255), (at >> 22) + (at >> 8 & 255)
            warm = at >> 16 & 63
            mine = [np.flatnonzero((key & 7) == f) for f in range(HASHES)]
            for f in range(HASHES):
                for e in range(f + 1, HASHES):
                    x, y = mine[f], mine[e]
                    if not len(x) or not len(y):
                        continue
                    lo, hi = np.searchsorted(last[y], first[x], "left"), np.searchsorted(first[y], last[x], "right")
                    n = np.maximum(hi - lo, 0)
                    i = np.repeat(x, n)
                    j = y[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                    if not len(i):
                        continue
                    one = kernels.mix(key[i].view(np.uint64))  # in the high half, so that groups of one root lie together
                    sig = (one & ~np.uint64(0xFFFFFFFF)) | (kernels.mix(one ^ key[j].view(np.uint64)) >> np.uint64(32))
                    shares = np.minimum(warm[i], warm[j])
                    share = (cls[i] >> 8) & ((1 << shares) - 1)
                    cols = [kernels.signed(sig), cls[i], c[i].astype(np.int32), np.where(shares > 0, share + 1, 0).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], ["sig", "cls", "c", "share"])

    return shared.repartition("cls").sortWithinPartitions("cls").mapInArrow(run, "sig long, cls long, c int, share int")


def stars(members: DataFrame, by: list[str]) -> DataFrame:
    """(a, b, ca, cb, sig): every member b of a group with the group's first text a; b null names leaders of shares.

    ``members`` has (sig, cls, c, share), dealt by the root of sig and ``by``; a text that is
    there several times comes with each of its places, the leader with its
    first.  ``sig`` is null where the group has only two texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = (None, None, 0, 0)  # the group the last batch ended in and its leader: a group may be of any size
        for batch in common.gathered(batches, 100_000):
            if not batch.num_rows:
                continue
            sig, share, cls, c = (batch.column(k).to_numpy() for k in ("sig", "share", "cls", "c"))
            inner = (sig[1:] != sig[:-1]) | (share[1:] != share[:-1])
            new = np.concatenate([[(sig[0], share[0]) != head[:2]], inner])
            at = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
            lead, leadc = (np.where(at >= 0, v[np.maximum(at, 0)], h) for v, h in ((cls, head[2]), (c, head[3])))
            group = np.cumsum(np.concatenate([[False], inner]))
            texts = np.bincount(group, np.concatenate([[False], inner | (cls[1:] != cls[:-1])])) + (np.bincount(group) > 0)
            texts[0] += at[0] < 0
            large = (texts > 2)[group] | (group == group[-1]) | (share > 0)  # the last group may go on
            head = (sig[-1], share[-1], lead[-1], leadc[-1])
            ok = np.flatnonzero(cls != lead)
            if len(ok):  # signatures of one root give the same places
                order = ok[np.lexsort((~large[ok], c[ok], leadc[ok], cls[ok], lead[ok]))]
                same = np.logical_and.reduce([v[order][1:] == v[order][:-1] for v in (c, leadc, cls, lead)])
                ok = order[np.concatenate([[True], ~same])]
            own = np.flatnonzero(new & (share > 0))
            if len(ok) + len(own):
                none = lambda k: pa.nulls(k, pa.int64())
                kept = pa.array(sig[ok], mask=~large[ok])
                cols = [np.concatenate([lead[ok], cls[own]]), pa.concat_arrays([pa.array(cls[ok]), none(len(own))]), *(np.concatenate([v[ok], c[own]]).astype(np.int32) for v in (leadc, c)), pa.concat_arrays([kept, pa.array(sig[own])])]
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in cols], ["a", "b", "ca", "cb", "sig"])

    where = [F.shiftright("sig", 32).alias("root"), *by]
    return members.repartition(*where).sortWithinPartitions("share", "sig", "cls", "c").mapInArrow(run, "a long, b long, ca int, cb int, sig long")


def meetings(members: DataFrame, spread: bool) -> DataFrame:
    """(a, b, seeds): pairs of a leader and a member with the places (ca, cb, large: of a group of more texts) where they meet."""
    pairs = stars(members, ["share"])
    if spread:
        once = common.table(pairs, "meetings")
        leaders = once.where("b is null").select("sig", F.col("a").alias("cls"), F.col("ca").alias("c"), F.lit(0).alias("share"))
        pairs = once.where("b is not null").union(stars(leaders, []))
    return pairs.groupBy("a", "b").agg(F.collect_set(F.struct("ca", "cb", F.col("sig").isNotNull().alias("large"))).alias("seeds"))


def extend(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """(words, matches) of the best common run from the start of x and y; few differing words are bridged."""
    n, size = min(len(x), len(y)), 256
    while True:
        m = min(n, size)
        gain = np.where(x[:m] == y[:m], MATCH, MISMATCH)
        score = np.cumsum(gain)
        top = np.maximum.accumulate(np.maximum(score, 0))
        over = np.flatnonzero(top - score > DROP)
        if len(over) or m == n:
            stop = int(over[0]) if len(over) else m
            if stop == 0 or score[:stop].max(initial=0) <= 0:
                return 0, 0
            k = int(np.argmax(score[:stop])) + 1
            return k, int((gain[:k] == MATCH).sum())
        size *= 4


def passages(x: np.ndarray, y: np.ndarray, seeds: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(start and end in x, start and end in y) of verified common passages of at least WORDS words.

    A seed inside what was found before, on both sides, is not extended again:
    texts that repeat themselves would else match at every pair of places.
    """
    out: list[tuple[int, int, int, int]] = []
    for a, b in sorted(set(seeds)):
        if any(s <= a < e for s, e, _, _ in out) and any(t <= b < u for _, _, t, u in out):
            continue
        right, r = extend(x[a:], y[b:])
        left, l = extend(x[:a][::-1], y[:b][::-1])
        if left + right >= WORDS and l + r >= LIKE * (left + right):
            out.append((a - left, a + right, b - left, b + right))
    return out


class Grams:
    """Hashes of runs of words anywhere in many texts laid end to end, from sums of weighted words."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, flat: np.ndarray):
        n = len(flat)
        power = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b & (1 << 64) - 1, np.uint64)]))
        self.back = power(pow(self.BASE, -1, 1 << 64))
        self.upto = np.concatenate([[np.uint64(0)], np.cumsum(kernels.mix(flat.view(np.uint32).astype(np.uint64)) * power(self.BASE)[:n])])

    def at(self, start: np.ndarray, size: int) -> np.ndarray:
        return kernels.signed(kernels.mix((self.upto[start + size] - self.upto[start]) * self.back[start]))


def _asked(n: int, seeds: list[tuple[int, bool]], good: list[tuple[int, int]], size: int) -> list[int]:
    """Starts of the runs of ``size`` words of a text of n words that may repeat beyond its spans ``good``."""
    step = STEP if size == GRAM else 1
    starts = {c - k for c, large in seeds if large for k in range(0, WINDOW, step)}
    for s, e in good:
        starts = {p for p in starts if p < s or p + size > e}
    starts |= {p for s, e in good for p in (s - 1, e + 1 - size)}
    return [p for p in starts if 0 <= p <= n - size]


def verified(pairs: DataFrame, words: DataFrame, name: str, ask: int) -> DataFrame:
    """(a, sa, ea, b, sb, eb): passages of a and b that match.

    With ``ask``, a number of words, also (b, sb, gram) of runs of so many
    words of members around places in larger groups and at edges of passages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, own, place = [], [], []
            flat = lambda c: (batch.column(c).flatten(), np.concatenate([[0], np.cumsum(batch.column(c).value_lengths().to_numpy())]).tolist())
            (wa, ia), (wb, ib), (seeds, at) = flat("wa"), flat("wb"), flat("seeds")
            wa, wb = wa.to_numpy(), wb.to_numpy()
            ca, cb, large = (seeds.field(c).to_pylist() for c in ("ca", "cb", "large"))
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                x, y, k = wa[ia[i] : ia[i + 1]], wb[ib[i] : ib[i + 1]], slice(at[i], at[i + 1])
                good = passages(x, y, list(zip(ca[k], cb[k])))
                rows += [(a, s, e, b, t, u) for s, e, t, u in good]
                more = [(c, l) for c, l in zip(cb[k], large[k]) if l]
                if ask and more:
                    starts = _asked(len(y), more, [g[2:] for g in good], ask)
                    own += [(b, p) for p in starts]
                    place += [ib[i] + p for p in starts]
            m, o = len(rows), len(own)
            if m + o:
                cols = [[*r, *n] for r, n in zip(zip(*rows) if m else [()] * 6, ([None] * o, [None] * o, [None] * o, [b for b, _ in own], [p for _, p in own], [None] * o))]
                gram = Grams(wb).at(np.array(place, np.int64), ask) if o else []
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
                out = [pa.array(c, t) for c, t in zip(cols, kinds)]
                yield pa.RecordBatch.from_arrays([*out, pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(gram, pa.int64())])], ["a", "sa", "ea", "b", "sb", "eb", "gram"])

    one, two = (words.select(F.col("cls").alias(k), F.col("words").alias(f"w{k}")) for k in ("a", "b"))
    # both sides read one exchange of the words, hot leaders' apart
    both = common.apart_join(pairs, one, "a", "b").join(two, "b").select("a", "b", "seeds", "wa", "wb")
    return common.table(both.mapInArrow(run, "a long, sa int, ea int, b long, sb int, eb int, gram long"), name)


def words_of(docs: DataFrame, wanted: object) -> DataFrame:
    """(cls, words): the word hashes (32 bits) of the classes in a Bloom filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = common.Recent()
        for batch in kernels.chunks(batches):
            words, first, cls = hashed(batch)
            ok = np.flatnonzero(recent.fresh(np.where(common.in_bloom(wanted.value, cls), cls, 0)))
            if len(ok):
                parts = [(words[first[i] : first[i + 1]] >> np.uint64(32)).astype(np.uint32).view(np.int32) for i in ok]
                cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cls[ok]), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(parts)))], ["cls", "words"])

    return docs.mapInArrow(run, "cls long, words array<int>").groupBy("cls").agg(F.first("words").alias("words"))


def only(words: DataFrame, wanted: object) -> DataFrame:
    """The rows of ``words`` whose class is in a Bloom filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(common.in_bloom(wanted.value, batch.column("cls").to_numpy())))

    return words.mapInArrow(run, words.schema)


def matches(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(a, sa, ea, b, sb, eb): enough verified passages of pairs of texts to connect all that match."""
    sc = docs.sparkSession.sparkContext
    warm = heat(counts)
    members = signatures(shared_windows(windows(docs, sc.broadcast(warm))))
    pairs = common.table(meetings(members, bool(warm.any())), "pairs")
    wanted = sc.broadcast(common.bloom(pairs.select(F.explode(F.array("a", "b")).alias("cls")), "cls"))
    words = common.table(words_of(docs, wanted), "words")
    found = None
    for name, ask in (("roots", GRAM), ("runs", WORDS), ("exact", 0)):
        some = verified(pairs, words, name, ask)
        good = some.where("gram is null").drop("gram")
        found = good if found is None else found.union(good)
        if ask:
            again = some.where("gram is not null").select(F.col("gram").alias("sig"), F.col("b").alias("cls"), F.col("sb").alias("c")).distinct()
            share = F.pmod(F.shiftright("cls", 8), F.lit(16)).cast("int") + 1 if warm.any() else F.lit(0)
            pairs = common.table(meetings(again.withColumn("share", share), bool(warm.any())), "pairs")
            words = only(words, sc.broadcast(common.bloom(pairs.select(F.explode(F.array("a", "b")).alias("cls")), "cls")))
    return found.distinct()


def merged(spans: str):
    """Sorted spans with those that overlap or touch united."""
    shape = "array<struct<start:int,end:int>>"
    return F.aggregate(
        spans, F.array().cast(shape),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def repeats(docs: DataFrame) -> DataFrame:
    """Documents that share a passage of at least 50 words with another one.

    Returns doc_id, n_words, n_copies (rows with the very same words, itself
    included), first_copy_id, n_passages, passages (``start:end`` in words,
    comma-joined, in order), passage_ids (the class of each passage: equal ids
    are one passage), n_texts (different texts that hold the passage, itself
    included) and first_ids (smallest doc_id that holds it).  Passages of a
    text that overlap are one.  Rows without any repeat aren't returned; null,
    empty and short texts have none.  Repeated rows and repeated doc_ids count
    as copies of each other, and copies without other partners have no
    passages beside that; ties go to the smallest class.  A null doc_id comes
    back as null.  Texts may have any length.  An empty table gives no rows.
    Other columns are ignored.
    """
    common.ready(docs.sparkSession)
    docs = common.texts(docs, "doc_id", "text")
    rows, counts = rows_of(docs)
    classes = rows.groupBy("cls").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_copies"))
    found = common.table(matches(docs, counts), "matches")
    both = found.select(F.col("a").alias("cls"), F.col("sa").alias("start"), F.col("ea").alias("end")).union(found.select("b", "sb", "eb"))
    spans = both.groupBy("cls").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")).select("cls", merged("spans").alias("spans"))
    spans = common.table(spans, "spans")

    def node(end: str, place: str) -> F.Column:
        return F.xxhash64(end, F.filter("spans", lambda s: (s["start"] <= F.col(place)) & (F.col(place) < s["end"]))[0]["start"])

    links = common.table(found.select("a", "sa", "b", "sb").distinct(), "links")
    left = common.table(common.spread_join(links, spans.withColumnRenamed("cls", "a"), "a", "b").select(node("a", "sa").alias("na"), "b", "sb"), "links")
    ends = common.spread_join(left, spans.withColumnRenamed("cls", "b"), "b", "na").select(F.col("na").alias("a"), node("b", "sb").alias("b"))
    comp = common.components(ends).withColumnRenamed("comp", "id")
    nodes = spans.select("cls", F.explode("spans").alias("s")).select("cls", "s", F.xxhash64("cls", F.col("s.start")).alias("node")).join(comp, "node").join(classes, "cls")
    nodes = common.table(nodes.select("cls", "s", "id", "low"), "nodes")
    sizes = nodes.groupBy("id").agg(F.countDistinct("cls").alias("n"), F.min("low").alias("first"))
    per = common.spread_join(nodes, sizes, "id", "cls").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("s", "id", "n", "first"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["s"]["start"].cast("string"), x["s"]["end"].cast("string"))), ",")
    final = classes.join(per, "cls", "left").where((F.col("n_copies") > 1) | F.col("p").isNotNull()).select(
        "cls", "low", "n_copies", F.coalesce(F.size("p"), F.lit(0)).alias("size"), F.coalesce(text, F.lit("")).alias("passages"),
        *(F.coalesce(F.col(f"p.{k}"), F.array().cast("array<long>")).alias(v) for k, v in (("id", "passage_ids"), ("n", "n_texts"), ("first", "first_ids"))),
    )
    return common.spread_join(rows, final, "cls", "doc_id").select(
        "doc_id", "n_words", "n_copies", F.col("low").alias("first_copy_id"), F.greatest("size", F.lit(0)).cast("long").alias("n_passages"), "passages", "passage_ids", "n_texts", "first_ids",
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
