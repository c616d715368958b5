"""Language identification by a bidirectional gated recurrent network.

The network reads the bytes of a word (a run of letters, after one space),
forwards and backwards, and gives every position a distribution over the
learned languages; a document's probabilities are the mean over all its
positions.  It is trained here, in numpy, by backpropagation through time.
Sequences end at word boundaries, so equal words get equal labels and each
task runs the network once for each word it hasn't seen.
"""

from __future__ import annotations

import functools
import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

#: Training sample: at most so many documents of each language (those with the smallest hash), so many letter runs of
#: each of them, and so many languages (the most frequent).  With many languages fewer runs of a document are taken,
#: so that it never holds more than some RUNS runs of 32 bytes.
DOCS_PER_LANGUAGE, RUNS_PER_DOCUMENT, LANGUAGES = 200, 1000, 256
RUNS = 1_000_000
#: Training runs over this many word occurrences drawn from the sample.
TRAINING_WORDS = 60_000
HIDDEN, STEPS, BATCH, SEED = 16, 320, 512, 7
#: Longer letter runs are cut into sequences of this many bytes; every byte is still labelled.
SEQUENCE = 32
CACHE_WORDS = 1_500_000
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Direction:
    """One gated recurrent layer over byte sequences."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.h = hidden
        self.w = {
            "x": rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32),
            "u": rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32),
            "b": np.zeros(3 * hidden, np.float32),
        }

    def states(self, seq: np.ndarray, lens: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(time, sequence, hidden); a sequence's state stays where it has ended."""
        h, k = np.zeros((len(seq), self.h), np.float32), self.h
        out = np.empty((seq.shape[1], len(seq), k), np.float32)
        for t in range(seq.shape[1]):
            x, g = self.w["x"][seq[:, t]] + self.w["b"], h @ self.w["u"]
            zr = _sigmoid(x[:, : 2 * k] + g[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(x[:, 2 * k :] + r * g[:, 2 * k :])
            on = (t < lens)[:, None]
            if keep is not None:
                keep.append((h, z, r, n, g[:, 2 * k :], on))
            h = np.where(on, n + z * (h - n), h)
            out[t] = h
        return out

    def gradients(self, seq: np.ndarray, keep: list, given: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of ``given``, the gradient at every state."""
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        carry = np.zeros_like(given[0])
        for t in range(len(keep) - 1, -1, -1):
            before, z, r, n, gn, on = keep[t]
            d = given[t] + carry
            dn, dz = d * (1 - z) * (1 - n * n), d * (before - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dx = np.where(on, np.concatenate([dz, dr, dn], 1), 0)
            dg = np.where(on, np.concatenate([dz, dr, dn * r], 1), 0)
            carry = np.where(on, d * z, d) + dg @ self.w["u"].T
            grad["u"] += before.T @ dg
            grad["b"] += dx.sum(0)
            hot = np.zeros((len(seq), 256), np.float32)
            hot[np.arange(len(seq)), seq[:, t]] = 1
            grad["x"] += hot.T @ dx
        return grad


class Network:
    """Both directions and a softmax over languages at each position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.sides = (Direction(rng, hidden), Direction(rng, hidden))
        self.out = {"v": rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32), "c": np.zeros(len(languages), np.float32)}
        self.rng = rng

    @staticmethod
    def turned(lens: np.ndarray, width: int) -> np.ndarray:
        """For each sequence the places of its positions read backwards; padding stays in place."""
        at = np.arange(width)[None, :]
        return np.where(at < lens[:, None], lens[:, None] - 1 - at, at)

    def run(self, seq: np.ndarray, lens: np.ndarray, keeps: tuple = (None, None)) -> tuple[np.ndarray, np.ndarray]:
        """(states of both sides, probabilities), time first."""
        turn = self.turned(lens, seq.shape[1])
        one = self.sides[0].states(seq, lens, keeps[0])
        two = self.sides[1].states(np.take_along_axis(seq, turn, 1), lens, keeps[1])
        two = np.take_along_axis(two, turn.T[:, :, None], 0)
        both = np.concatenate([one, two], 2)
        e = both @ self.out["v"] + self.out["c"]
        e = np.exp(e - e.max(2, keepdims=True))
        return both, e / e.sum(2, keepdims=True)

    def step(self, seq: np.ndarray, lens: np.ndarray, label: np.ndarray) -> tuple[list[dict], float]:
        keeps: tuple[list, list] = ([], [])
        both, p = self.run(seq, lens, keeps)
        on = (np.arange(seq.shape[1])[:, None] < lens[None, :])[:, :, None]
        d = p.copy()
        rows = np.arange(len(seq))
        loss = float(-(np.log(p[:, rows, label] + 1e-9) * on[:, :, 0]).sum() / on.sum())
        d[:, rows, label] -= 1
        d = np.where(on, d, 0) / np.float32(on.sum())
        out = {"v": np.einsum("tbh,tbl->hl", both, d), "c": d.sum((0, 1))}
        back = d @ self.out["v"].T
        h, turn = self.sides[0].h, self.turned(lens, seq.shape[1])
        one = self.sides[0].gradients(seq, keeps[0], np.ascontiguousarray(back[:, :, :h]))
        two = self.sides[1].gradients(np.take_along_axis(seq, turn, 1), keeps[1], np.take_along_axis(back[:, :, h:], turn.T[:, :, None], 0))
        return [one, two, out], loss

    def train(self, words: list[bytes], label: np.ndarray, steps: int = STEPS, rate: float = 0.01) -> list[float]:
        """Adam on batches of word occurrences; deterministic."""
        parts = [*(s.w for s in self.sides), self.out]
        first = [{k: np.zeros_like(v) for k, v in p.items()} for p in parts]
        second = [{k: np.zeros_like(v) for k, v in p.items()} for p in parts]
        losses = []
        for n in range(1, steps + 1):
            pick = self.rng.integers(0, len(words), BATCH)
            seq, lens = padded([words[i] for i in pick])
            grads, loss = self.step(seq, lens, label[pick])
            losses.append(loss)
            now = rate * (1 - n / (steps + 1))
            for p, g, a, b in zip(parts, grads, first, second):
                for k in p:
                    a[k] = 0.9 * a[k] + 0.1 * g[k]
                    b[k] = 0.99 * b[k] + 0.01 * g[k] ** 2
                    p[k] -= (now * (a[k] / (1 - 0.9**n)) / (np.sqrt(b[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
        return losses

    def totals(self, words: list[bytes]) -> np.ndarray:
        """Summed probabilities over all positions of each word: (word, language)."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        for k in range(0, len(order), 2048):
            part = order[k : k + 2048]
            seq, lens = padded([words[i] for i in part.tolist()])
            p = self.run(seq, lens)[1]
            out[part] = np.where((np.arange(seq.shape[1])[:, None] < lens[None, :])[:, :, None], p, 0).sum(0)
        return out


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of a space and the word's bytes, padded with zeros."""
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    width = int(lens.max())
    raw = b"".join(b" " + w + bytes(width - 1 - len(w)) for w in words)
    return np.frombuffer(raw, np.uint8).reshape(len(words), width), lens


def letter_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of runs of letter bytes, cut every SEQUENCE bytes."""
    n = int(offsets[-1])
    on = _LETTER[buf[:n]]
    head = np.zeros(n + 1, bool)
    head[offsets[:-1]] = True
    start, end = on.copy(), on.copy()
    start[1:] &= ~on[:-1] | head[1:n]
    end[:-1] &= ~on[1:] | head[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    pieces = -(-(ends - starts) // SEQUENCE)
    if len(pieces) and pieces.max() > 1:
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        last = np.repeat(ends, pieces)
        starts = np.repeat(starts, pieces) + nth * SEQUENCE
        ends = np.minimum(starts + SEQUENCE, last)
    return starts, ends, np.searchsorted(starts, offsets)


class Labeller:
    """The network with a cache of words."""

    def __init__(self, network: Network):
        self.network = network
        self.known, self.total = np.zeros(0, np.uint64), np.zeros((0, len(network.languages)), np.float32)

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """(text, language): mean over the text's positions; zeros where a text has no letter bytes."""
        buf, offsets = kernels.text_buffer(column)
        low = kernels.LOWER[buf]
        starts, ends, first = letter_runs(low, offsets)
        out = np.zeros((len(offsets) - 1, len(self.network.languages)))
        if not len(starts):
            return out
        hashes, back = np.unique(kernels.hash_spans(low, starts, ends), return_inverse=True)
        if len(self.known) + len(hashes) > CACHE_WORDS:
            self.known, self.total = self.known[:0], self.total[:0]
        at = np.searchsorted(self.known, hashes)
        new = np.flatnonzero(np.append(self.known, 0)[at] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(new):
            where = np.empty(len(hashes), np.int64)
            where[back] = np.arange(len(back))
            raw, place = low.tobytes(), where[new]
            totals = self.network.totals([raw[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist())])
            self.known, self.total = np.insert(self.known, at[new], hashes[new]), np.insert(self.total, at[new], totals, axis=0)
            at = np.searchsorted(self.known, hashes)
        each = self.total[at][back]
        upto = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, axis=0, dtype=np.float64)])
        out = upto[first[1:]] - upto[first[:-1]]
        return np.maximum(out, 0) / np.maximum(out.sum(1, keepdims=True), 1e-9)


@functools.lru_cache(2)
def labeller(model: bytes) -> Labeller:
    return Labeller(pickle.loads(model))


def runs_of(text: str, most: int = RUNS_PER_DOCUMENT) -> list[bytes]:
    """At most ``most`` letter runs of a text, spread evenly over it."""
    buf, offsets = kernels.text_buffer(pa.array([text]))
    low = kernels.LOWER[buf]
    starts, ends, _ = letter_runs(low, offsets)
    pick = np.unique(np.linspace(0, len(starts) - 1, most).astype(np.int64)) if len(starts) else []
    raw = low.tobytes()
    return [raw[starts[i] : ends[i]] for i in pick]


def sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """(lang, h, runs): letter runs of at most ``per_language`` labelled documents of each learned language.

    Documents, told apart by a hash of doc_id and text, are chosen by the
    smallest hash: neither a frequent doc_id, nor a text that is repeated, nor a
    long one brings more than its share, a language with fewer documents brings
    all it has, and each task keeps no more than the sample.
    """
    learn = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    learn = learn.select("lang", F.shiftright(F.xxhash64("doc_id", "text"), 1).alias("h"), "text")
    # the share of different documents that surely holds the smallest hashes: few rows leave each task, at any size
    counts = learn.select("lang", "h").distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    most = max(8, min(RUNS_PER_DOCUMENT, RUNS // max(1, len(counts) * per_language)))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list] = {}
        there: dict[str, set] = {}
        for batch in batches:
            last = batch.column(2).to_pylist()
            for k, (lang, h) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist())):
                q, known = best.setdefault(lang, []), there.setdefault(lang, set())
                if h not in known and (len(q) < per_language or -h > q[0][0]):
                    runs = last[k] if isinstance(last[k], list) else runs_of(last[k], most)
                    known.add(h)
                    if len(q) < per_language:
                        heapq.heappush(q, (-h, runs))
                    else:
                        known.discard(-heapq.heappushpop(q, (-h, runs))[0])
        rows = [(lang, -h, runs) for lang, q in best.items() for h, runs in q]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.list_(pa.binary())))], ["lang", "h", "runs"])

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return least(batches)

    shape = "lang string, h long, runs array<binary>"
    share = [(r["lang"], int(min(1.0, 8.0 * per_language / r["count"]) * 2.0**63 - 2.0**62)) for r in counts]
    bound = F.broadcast(docs.sparkSession.createDataFrame(share, "lang string, upto long"))  # at most LANGUAGES rows
    some = learn.join(bound, "lang").where(F.col("h") <= F.col("upto")).select("lang", "h", "text")
    return some.mapInArrow(least, shape).groupBy("lang").applyInArrow(merged, shape)


def held_out() -> F.Column:
    """The rows that are never learned from: remainder 2 of the checksum of doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(rows: list[tuple[str, list[bytes]]]) -> Network | None:
    """Train on (language, letter runs) rows."""
    languages = sorted({lang for lang, runs in rows if runs})
    rng = np.random.default_rng(SEED)
    words, label = [], []
    for k, lang in enumerate(languages):
        mine = [w for x, runs in rows if x == lang for w in runs]
        pick = np.sort(rng.choice(len(mine), TRAINING_WORDS // len(languages)))
        words += [mine[i] for i in pick]
        label += [k] * len(pick)
    if not words:
        return None
    network = Network(languages)
    network.train(words, np.array(label))
    return network


def trained(docs: DataFrame) -> bytes:
    """The fitted network, pickled; empty bytes if nothing is labelled.

    The bounded sample goes to one task, whose linear algebra runs on one thread.
    """
    common.ready(docs.sparkSession)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["lang"], r["h"], r["runs"]) for b in batches for r in b.to_pylist())
        network = fit([(lang, runs) for lang, _, runs in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network) if network else b""], pa.binary())], ["model"])

    made = sample(docs.select("doc_id", "text", "lang")).withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "model binary").collect()
    return bytes(made[0].model) if made else b""


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` with lang_pred and score appended (replacing columns of those names).

    Null texts and texts without a letter, and all texts if nothing could be
    learned, get ``und`` with score 0.  All rows, repeated ones too, and other
    columns stay; texts may have any length; of equal probabilities the first
    language by name counts.  An empty table gives no rows.
    """
    spark = common.ready(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = labeller(shared.value) if shared.value else None
        for batch in kernels.chunks(batches):
            column = batch.column("text")
            p = own.probabilities(column) if own else np.zeros((len(column), 1))
            best, top = p.argmax(1), np.minimum(p.max(1), 1.0)
            names, scores = [], []
            for text, b, s in zip(column.to_pylist(), best.tolist(), top.tolist()):
                ok = s > 0 and has_letter(text)
                names.append(own.network.languages[b] if ok else UNKNOWN)
                scores.append(s if ok else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identify(docs: DataFrame) -> DataFrame:
    """Train on the labelled rows that aren't held out and label all rows.  An empty table gives no rows.

    The LANGUAGES most frequent languages (by different documents) are learned;
    a text of any other is given the likest of those.  Repeated rows, and long
    texts, count once in training and are labelled each.
    """
    return predict(docs, trained(docs))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = trained(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
