"""Plumbing shared by the corpus operators: shared folders, fixed-size corpus
statistics, Bloom filters, sorted group streams and connected components."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
_OWN: dict[str, str] = {}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep Arrow batches small.

    Batches are bounded in rows and bytes because one batch of very long texts
    must fit beside its working arrays in a worker.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    env.setdefault("OMP_NUM_THREADS", "1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session, whose executors are this very machine, gets a
    temporary folder of its own where that is unset; a cluster has to name one.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or _OWN.get(sc.applicationId)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="shearwater-")
        atexit.register(shutil.rmtree, where, True)
    return where.rstrip("/")


#: Paths of tables written since the scopes now open began, one list a scope.
_SCOPES: list[list[str]] = []


def table(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors.

    With ``keep`` the table outlives the scopes it was written in.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shearwater/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for made in [] if keep else _SCOPES:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete tables that ``table`` wrote (all of them, if none are named), by the file system that holds them."""
    for where in [f"{shared_dir(spark)}/shearwater"] if paths is None else paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written inside it when it ends well: what is read from them must be stored by then."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
    cleanup(spark, made)


class Recent:
    """Classes met lately, in a fixed number of slots: a class met again is usually known, never wrongly."""

    def __init__(self, slots: int = 1 << 16):
        self.slot, self.mask = np.zeros(slots, np.int64), np.int64(slots - 1)

    def fresh(self, cls: np.ndarray) -> np.ndarray:
        """Mask of the rows whose class (not 0) isn't in a slot and not in an earlier row; they enter the slots."""
        out = np.zeros(len(cls), bool)
        names, first = np.unique(cls, return_index=True)
        first = first[(names != 0) & (self.slot[names & self.mask] != names)]
        out[first] = True
        self.slot[cls[first] & self.mask] = cls[first]
        return out


#: Least rows of a key that are spread, and the most keys that can be: a broadcast of so many rows.
HOT_ROWS, HOT_KEYS = 2000, 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join of ``left`` (a written table) with ``right`` (unique by ``key``) where hot keys are spread over tasks.

    A key is hot beyond HOT_ROWS rows and beyond 1 / HOT_KEYS of all rows, so
    there are at most HOT_KEYS of them whatever the size.  Its left rows are
    dealt by a hash of ``by``, and its right row is repeated for each share.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    per = max(HOT_ROWS, -(-left.count() // HOT_KEYS))
    hot = {r[key]: -(-r["_n"] // per) for r in counts.where(F.col("_n") > per).collect()}
    if not hot:
        return left.join(right, key)
    spark = left.sparkSession
    parts = F.broadcast(spark.createDataFrame(list(hot.items()), f"{key} {dict(left.dtypes)[key]}, _parts int"))
    one = left.join(parts, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    two = right.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return one.join(two, [key, "_part"]).drop("_part")


def apart_join(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """The rows of ``spread_join``, hot keys joined apart from the others.

    For a wide ``right``: only its rows of hot keys are repeated and shuffled
    by share; all of it is shuffled by ``key`` alone, as another join by its
    key does, so both use one exchange.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    per = max(HOT_ROWS, -(-left.count() // HOT_KEYS))
    hot = {r[key]: -(-r["_n"] // per) for r in counts.where(F.col("_n") > per).collect()}
    if not hot:
        return left.join(right, key)
    parts = F.broadcast(left.sparkSession.createDataFrame(list(hot.items()), f"{key} {dict(left.dtypes)[key]}, _parts int"))  # HOT_KEYS rows at most
    one = left.join(parts, key).withColumn("_part", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).drop("_parts")
    two = right.join(parts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return left.join(parts, key, "left_anti").join(right, key).unionByName(one.join(two, [key, "_part"]).drop("_part"))


def texts(df: DataFrame, *keep: str) -> DataFrame:
    """Only the columns an operator reads, by plain names; extra columns never get into its plan."""
    return df.select(*(df[c] for c in keep))


def blocks(df: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], np.ndarray], width: int, kind: str) -> np.ndarray:
    """Combine one fixed-size array a task over all tasks and fetch it.

    ``of`` gives the array of a task's rows; arrays are cut into blocks of
    4096 entries, which meet by block number: sums of counts, or of bits.
    The result has ``width`` entries whatever the size of the corpus.
    """
    step = 4096
    bits = kind == "bits"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = of(batches)
        for b in range(0, len(out), step):
            part = out[b : b + step]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([b // step], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "data"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("data"):
                part = np.frombuffer(raw.as_py(), np.uint8 if bits else np.int64)
                total = part.copy() if total is None else (total | part if bits else total + part)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "data"])

    shape = "block int, data binary"
    out = np.zeros(width, np.uint8 if bits else np.int64)
    for row in df.mapInArrow(run, shape).groupBy("block").applyInArrow(merge, shape).toLocalIterator():
        part = np.frombuffer(bytes(row.data), out.dtype)
        out[row.block * step : row.block * step + len(part)] = part
    return out


def rarity_classes(counts: np.ndarray) -> np.ndarray:
    """Counts to classes 0..255, eight to a doubling; class 0 means "not seen twice"."""
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


BLOOM_BITS = 1 << 24


def _bloom_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = keys.view(np.uint64)
    k = (k ^ (k >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (k >> np.uint64(40)).astype(np.int64), ((k >> np.uint64(8)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64)


def bloom(df: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter (fixed 2 MB) over a long column; it only ever lets too much through."""

    def of(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        seen = np.zeros(BLOOM_BITS, bool)
        for batch in batches:
            for at in _bloom_places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)):
                seen[at] = True
        return np.packbits(seen)

    return blocks(df.select(column), of, BLOOM_BITS // 8, "bits")


def in_bloom(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    ok = np.ones(len(keys), bool)
    for at in _bloom_places(np.ascontiguousarray(keys)):
        ok &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return ok


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 100_000) -> Iterator[dict[str, np.ndarray]]:
    """Whole groups from rows sorted by ``key``: each yield is a run of complete groups, singletons included."""
    held: list[dict[str, np.ndarray]] = []
    for batch in gathered(batches, rows):
        if batch.num_rows == 0:
            continue
        cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        k = cols[key]
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if held and held[0][key][0] != k[0]:
            yield {n: np.concatenate([h[n] for h in held]) for n in cols}
            held = []
        if cut:
            done = [*held, {n: c[:cut] for n, c in cols.items()}]
            yield {n: np.concatenate([h[n] for h in done]) for n in cols}
            held = []
        held.append({n: c[cut:] for n, c in cols.items()})
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, over links (a, b) of longs; nodes without links are absent.

    Each round hooks every node below its smallest neighbour where that is
    smaller, lets pointers jump to the roots, and goes on with the links
    between roots until there are none.  A root that nothing hooks below has a
    smaller neighbour in the next round, so two rounds at least halve the
    roots: rounds grow with the logarithm of the nodes, whatever the shape.
    All joins are by key, and each table is written to the shared folder.
    """
    links = table(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    label = None
    while True:
        both = links.union(links.select("b", "a"))
        root = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
        root = table(root, "roots")
        while True:
            jump = root.select(F.col("node").alias("up"), F.col("comp").alias("new"))
            step = table(root.join(jump, F.col("comp") == F.col("up")).select("node", "new", F.col("comp").alias("old")), "roots")
            root = step.select("node", F.col("new").alias("comp"))
            if step.where("new <> old").isEmpty():
                break
        if label is None:
            label = root
        else:
            moved = root.select(F.col("node").alias("up"), F.col("comp").alias("new"))
            label = table(label.join(moved, F.col("comp") == F.col("up"), "left").select("node", F.coalesce("new", "comp").alias("comp")), "labels")
        one, two = (root.select(F.col("node").alias(k), F.col("comp").alias(f"c{k}")) for k in ("a", "b"))
        between = links.join(one, "a").join(two, "b").where("ca <> cb")
        links = table(between.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "links")
        if links.isEmpty():
            return label
