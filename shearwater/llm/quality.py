"""Quality rules: counted base rules and a calibrated logistic regression on hashed word and character n-grams.

The model is fitted on a bounded sample of labelled documents (LABELLED ids of
each class) in one task; its weights have a fixed size.  All documents are
scored in Arrow batches against fixed thresholds, whole texts always.
"""

from __future__ import annotations

import dataclasses
import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernels

#: Bound of the sample: labelled ids of each class, chosen by a hash of the id.
LABELLED = 4000
#: Every FOLDS-th id of a class, in the order of a hash, is kept from fitting and calibrates instead.
FOLDS = 5
#: Places of the hashed features, and passes over the sample.
WIDTH, STEPS = 1 << 18, 120
#: Characters of a character n-gram.
GRAM = 3

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclasses.dataclass(frozen=True)
class Thresholds:
    """Least words, most repeated words in percent, and the least probability of good quality (both classes equally likely before)."""

    words: int = 50
    repeated: int = 50
    probability: float = 0.5


# ---- counts --------------------------------------------------------------------------------


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between neighbouring offsets."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def repeated_before(keys: np.ndarray) -> np.ndarray:
    """Mask of the entries that equal an earlier one."""
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counted base measures of each text of a string column."""
    buf, offsets = kernels.text_buffer(column)
    raw, n = buf[: offsets[-1]], len(offsets) - 1
    word = ~kernels.SEPARATOR[raw]
    starts, ends, first = kernels.word_spans(buf, offsets)
    text_key = kernels.mix(np.arange(1, n + 1, dtype=np.uint64))
    # a text's lines: one begins where it does and one behind each line feed, one stops before each line feed and one at its end
    feeds = np.flatnonzero(raw == 10)
    edge = np.concatenate([[0], np.cumsum(np.diff(np.searchsorted(feeds, offsets)) + 1)])
    begins, stops = np.full(edge[-1], -1), np.full(edge[-1], -1)
    begins[edge[:-1]], stops[edge[1:] - 1] = offsets[:-1], offsets[1:]
    begins[begins < 0], stops[stops < 0] = feeds + 1, feeds
    of = np.repeat(np.arange(n), np.diff(edge))
    size = np.concatenate([[0], np.cumsum(word)])
    line = np.flatnonzero(size[stops] > size[begins])
    again = repeated_before(kernels.mix(kernels.hash_spans(buf, begins[line], stops[line], 3) ^ text_key[of[line]]))
    hashes = kernels.hash_spans(buf, starts, ends, 5)
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(hashes) >= 3:
        of_word = np.repeat(np.arange(n), np.diff(first))
        at = np.flatnonzero(of_word[2:] == of_word[:-2])
        key = kernels.mix(kernels.mix(kernels.mix(hashes[at] ^ text_key[of_word[at]]) + hashes[at + 1]) + hashes[at + 2])
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        at = at[times[which] > 1]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + 3, -1)
    return {
        "n_words": np.diff(first),
        "word_chars": per_text(word & (raw & 0xC0 != 0x80), offsets),
        "n_symbols": per_text(SYMBOLS[raw], offsets),
        "n_dup_lines": np.bincount(of[line[again]], minlength=n),
        "n_repeat_words": per_text(np.cumsum(covered)[:-1] > 0, first),
    }


# ---- model ---------------------------------------------------------------------------------


def features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, offsets of each text) of the hashed words, pairs of words and character n-grams."""
    buf, offsets = kernels.text_buffer(column)
    starts, ends, first = kernels.word_spans(buf, offsets)
    hashes = kernels.hash_spans(buf, starts, ends, 11)
    fold = lambda h: (h >> np.uint64(64 - WIDTH.bit_length() + 1)).astype(np.int32)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pair = np.flatnonzero(of[1:] == of[:-1])
    raw = buf[: offsets[-1]]
    lead = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])[offsets]
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    m = max(len(points) - GRAM + 1, 0)
    gram = np.full(m, 7, np.uint64)
    for k in range(GRAM):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + points[k : k + m]
    inside = np.ones(m, bool)  # not across the end of a text
    cross = (lead[1:-1, None] - np.arange(1, GRAM)).ravel()
    inside[cross[(cross >= 0) & (cross < m)]] = False
    at = np.flatnonzero(inside)
    return [
        (fold(kernels.mix(hashes)), first),
        (fold(kernels.mix(hashes[pair] * np.uint64(3) + hashes[pair + 1])), np.searchsorted(pair, first)),
        (fold(kernels.mix(gram[at])), np.searchsorted(at, lead)),
    ]


class Model:
    """Logistic regression over mean feature weights, with Platt's scaling of its margin."""

    def __init__(self) -> None:
        self.weights, self.bias, self.slope, self.shift = np.zeros(WIDTH, np.float32), 0.0, 1.0, 0.0

    def margins(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for places, offsets in features(column):
            total = np.concatenate([[0.0], np.cumsum(self.weights[places], dtype=np.float64)])
            out += np.diff(total[offsets]) / np.maximum(np.diff(offsets), 1)
        return out

    def probabilities(self, column: pa.Array) -> np.ndarray:
        return logistic(self.slope * self.margins(column) + self.shift)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, held: np.ndarray) -> None:
        """rows: (places, values) of each text; both classes weigh the same, in fitting and in calibration."""
        rows_in = [rows[i] for i in np.flatnonzero(~held)]
        at, values, y = np.concatenate([r[0] for r in rows_in]), np.concatenate([r[1] for r in rows_in]), good[~held]
        of = np.repeat(np.arange(len(rows_in)), [len(r[0]) for r in rows_in])
        share = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
        state = [np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)]
        w = np.zeros(WIDTH + 1)  # the bias is last
        for step in range(1, STEPS + 1):
            gap = share * (logistic(np.bincount(of, w[at] * values, len(y)) + w[-1]) - y)
            slope = np.bincount(at, gap[of] * values, WIDTH + 1) + 1e-6 * w
            slope[-1] = gap.sum()
            state[0] += 0.1 * (slope - state[0])
            state[1] += 0.001 * (slope**2 - state[1])
            w -= 0.5 * state[0] / (1 - 0.9**step) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        self.weights, self.bias = w[:-1].astype(np.float32), float(w[-1])
        use = held if good[held].any() and not good[held].all() else ~held
        margin, y = np.array([float(self.weights[r[0]] @ r[1]) + self.bias for r, u in zip(rows, use) if u]), good[use]
        self.slope, self.shift = platt(margin, y)


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def platt(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins, by Newton steps; targets are drawn in as Platt does."""
    up, down = good.sum(), (~good).sum()
    target = np.where(good, (up + 1) / (up + 2), 1 / (down + 2))
    share = np.where(good, 0.5 / up, 0.5 / down)
    x = np.stack([margin, np.ones(len(margin))], 1)
    loss = lambda v: float((share * (np.logaddexp(0, x @ v) - target * (x @ v))).sum())
    v = np.array([0.0, 0.0])
    for _ in range(60):
        p = logistic(x @ v)
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (share * (p - target)))
        size = 1.0
        while loss(v - size * step) > loss(v) and size > 1e-6:
            size /= 2
        v = v - size * step
    return float(max(v[0], 0.0)), float(v[1])


@functools.lru_cache(2)
def loaded(model: bytes) -> Model:
    return pickle.loads(model)


# ---- jobs ----------------------------------------------------------------------------------


def sample(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(doc_id, good, text): about ``bound`` labelled documents of each class, one text an id.

    Ids count once however often they are repeated; of several texts the
    smallest is taken.  Null ids and qualities, and ids with both qualities, are
    left out, as are ids without a text.  The chosen ids are at most some 2 *
    ``bound``, so they are broadcast to the documents, which aren't shuffled.
    """
    there = docs.where("text is not null and doc_id is not null").select("doc_id").distinct()
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("most"))
    known = common.table(known.where("q = most").join(there, "doc_id", "left_semi").select("doc_id", (F.col("q") == 1).alias("good"), F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h")), "labelled")
    total = {r.good: r["count"] for r in known.groupBy("good").count().collect()}
    upto = {k: int(min(1.0, bound / n) * 2.0**63) for k, n in total.items()}
    keep = functools.reduce(lambda a, b: a | b, ((F.col("good") == k) & (F.col("h") < min(u, 2**63 - 1)) for k, u in upto.items()), F.lit(False))
    chosen = F.broadcast(known.where(keep).select(F.col("doc_id").alias("id"), "good"))
    return docs.select("doc_id", "text").where("text is not null").join(chosen, F.col("doc_id") == F.col("id")).groupBy("doc_id", "good").agg(F.min("text").alias("text"))


def fitted(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> bytes:
    """The model of the labelled rows, pickled; empty bytes unless both classes are there.  Needs doc_id, text and doc_id, quality."""
    common.ready(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.chunks(batches):
            found, places, values = features(batch.column("text")), [], []
            for i in range(batch.num_rows):
                own = [(at[o[i] : o[i + 1]], max(o[i + 1] - o[i], 1)) for at, o in found]
                at, which = np.unique(np.concatenate([a for a, _ in own]), return_inverse=True)
                places.append(at.astype("<i4").tobytes())
                values.append(np.bincount(which, np.concatenate([np.full(len(a), 1 / n) for a, n in own]), len(at)).astype("<f4").tobytes())
            columns = [batch.column("doc_id"), batch.column("good"), pa.array(places, pa.binary()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "good", "places", "vals"])

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((r["doc_id"], r["good"], r["places"], r["vals"]) for b in batches for r in b.to_pylist()), key=lambda r: r[0])
        good = np.array([r[1] for r in rows], bool)
        held = np.zeros(len(rows), bool)
        turn = np.argsort(kernels.mix(np.array([r[0] for r in rows], np.int64).view(np.uint64)), kind="stable")
        for kind in (True, False):  # by hash within each class, so that no pattern of the ids empties one
            held[turn[good[turn] == kind][FOLDS - 1 :: FOLDS]] = True
        made = b""
        if good.any() and not good.all():
            model = Model()
            model.fit([(np.frombuffer(r[2], "<i4"), np.frombuffer(r[3], "<f4").astype(np.float64)) for r in rows], good, held)
            made = pickle.dumps(model)
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["model"])

    rows = sample(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), bound).mapInArrow(counted, "doc_id long, good boolean, places binary, vals binary")
    made = rows.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "model binary").collect()
    return bytes(made[0].model) if made else b""


#: Fields of the column ``rules``.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def assessed(docs: DataFrame, model: bytes, limits: Thresholds = Thresholds()) -> DataFrame:
    """``docs`` with the struct ``rules`` appended (replacing a column of that name).

    Its fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, probability of good quality and kept.  Null and empty texts
    hold no words, so they fail the base.  Without a model (``b""``) the
    probability is null and the base alone decides.  Texts may have any length;
    a probability equal to the threshold is kept.  All rows, repeated ones too,
    and other columns stay.  An empty table gives no rows.
    """
    spark = common.ready(docs.sparkSession)
    docs = docs.drop("rules")
    shared = spark.sparkContext.broadcast(model)
    kinds = [*((m, pa.int64()) for m in MEASURES), ("base_failed", pa.bool_()), ("probability", pa.float64()), ("kept", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(shared.value) if shared.value else None
        for batch in kernels.chunks(batches):
            column = batch.column("text")
            made = counts(column)
            failed = (made["n_words"] < limits.words) | (100 * made["n_repeat_words"] > limits.repeated * made["n_words"])
            p = own.probabilities(column) if own else None
            kept = ~failed & (p >= limits.probability) if own else ~failed
            values = [*(made[m] for m in MEASURES), failed, p if own else [None] * len(column), kept]
            rules = pa.StructArray.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, kinds)], [k for k, _ in kinds])
            yield pa.RecordBatch.from_arrays([*batch.columns, rules], [*batch.schema.names, "rules"])

    to = {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.float64(): T.DoubleType()}
    rules = T.StructType([T.StructField(k, to[t]) for k, t in kinds])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("rules", rules)]))


def filtered(docs: DataFrame, labels: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns; odd rows as described at ``assessed``."""
    out = assessed(docs.drop("rules"), fitted(docs, labels), limits).where("rules.kept")
    return out.select(*(c for c in out.columns if c != "rules"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return assessed(docs, model).select("doc_id", *(f"rules.{m}" for m in MEASURES), "rules.base_failed", "rules.kept", "rules.probability")
