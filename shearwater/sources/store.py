"""Keyed tables that change by row: copy-on-write over hash buckets, versions committed for all tables at once.

Rows lie in buckets by a hash of their key.  A change reads and rewrites only
the buckets it touches, into files of its own; what is current is said by a
small manifest, which is put in place last, by a rename that never replaces.
Readers keep the version they opened; a run that dies leaves files that no
manifest names.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer committed first; open the store again and repeat the change."""


class Missing(RuntimeError):
    """A version that should be there isn't."""


@dataclasses.dataclass(frozen=True)
class Change:
    """A table's next entry in the manifest, its files written but not yet current."""

    table: str
    entry: dict
    rewritten: int


class Store:
    """One version of the tables under ``root``; changes are staged by its methods and become current by ``commit``."""

    def __init__(self, spark: SparkSession, root: str, manifest: dict):
        self.spark, self.root, self.manifest = spark, root.rstrip("/"), manifest

    # ---- versions --------------------------------------------------------------------------

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    @staticmethod
    def _listed(spark: SparkSession, path: str) -> list[str]:
        fs, p = Store._fs(spark, path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    @classmethod
    def versions(cls, spark: SparkSession, root: str) -> list[int]:
        return sorted(int(n[:-5]) for n in cls._listed(spark, f"{root.rstrip('/')}/versions") if n.endswith(".json") and n[:-5].isdigit())

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> Store:
        """An empty store; ``Conflict`` if there is one."""
        return cls(spark, root, {"version": -1, "tables": {}, "streams": {}}).commit([])

    @classmethod
    def open(cls, spark: SparkSession, root: str, version: int | None = None) -> Store:
        """The last version or the one named; ``Missing`` if there is none, or a gap in what is kept."""
        known = cls.versions(spark, root)
        if not known:
            raise Missing(f"no version of a store under {root}")
        if known != list(range(known[0], known[-1] + 1)):
            raise Missing(f"versions {sorted(set(range(known[0], known[-1])) - set(known))} under {root} are gone")
        if version is not None and version not in known:
            raise Missing(f"version {version} under {root} isn't kept: {known[0]} to {known[-1]} are")
        path = f"{root.rstrip('/')}/versions/{known[-1] if version is None else version:09d}.json"
        return cls(spark, root, json.loads(spark.read.text(path, wholetext=True).first().value))

    @property
    def version(self) -> int:
        return self.manifest["version"]

    def commit(self, changes: Sequence[Change], note: dict | None = None, stream: tuple[str, int] | None = None) -> Store:
        """All changes become current together, or none: the next version, opened.

        ``note`` is kept with the version; ``stream`` is the id and number of the batch that it holds.
        """
        if len({c.table for c in changes}) < len(changes):
            raise ValueError("a commit changes each table once")
        streams = {**self.manifest["streams"], **(dict([stream]) if stream else {})}
        made = {"version": self.version + 1, "note": note or {}, "streams": streams, "tables": {**self.manifest["tables"], **{c.table: c.entry for c in changes}}}
        held = f"{self.root}/versions/.{uuid.uuid4().hex}"
        to = f"{self.root}/versions/{made['version']:09d}.json"
        fs, p = self._fs(self.spark, held)
        out = fs.create(p, False)
        try:
            out.write(bytearray(json.dumps(made, sort_keys=True).encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        target = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(to))
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(p), target, never)
        except Py4JJavaError as e:
            fs.delete(p, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {made['version']} under {self.root} is there already") from e
            raise
        return Store(self.spark, self.root, made)

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` versions and the files none of them names; how many folders went.

        For times without writers: files of a change that isn't committed yet go too.
        """
        known = self.versions(self.spark, self.root)
        kept, named = known[-keep:], set()
        for v in kept:
            for entry in Store.open(self.spark, self.root, v).manifest["tables"].values():
                named.update(f.split("/")[1] for files in entry["files"].values() for f in files)
        fs, _ = self._fs(self.spark, self.root)
        gone = [n for n in self._listed(self.spark, f"{self.root}/data") if n not in named]
        for path in [f"{self.root}/versions/{v:09d}.json" for v in known[:-keep]] + [f"{self.root}/data/{n}" for n in gone]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        return len(gone)

    # ---- reading ---------------------------------------------------------------------------

    def _entry(self, table: str) -> dict:
        if table not in self.manifest["tables"]:
            raise KeyError(f"the store has no table {table}")
        return self.manifest["tables"][table]

    def schema(self, table: str) -> T.StructType:
        return T.StructType.fromJson(self._entry(table)["schema"])

    def read(self, table: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets only."""
        entry, schema = self._entry(table), self.schema(table)
        files = [f"{self.root}/{f}" for b, own in entry["files"].items() if buckets is None or int(b) in buckets for f in own]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def absent(self, table: str, keys: DataFrame) -> DataFrame:
        """The keys (one column) that the table doesn't hold: what an update or delete wouldn't find."""
        key = self._entry(table)["key"]
        return keys.select(key).distinct().join(self.read(table, self._touched(table, keys)).select(key), key, "left_anti")

    # ---- changes ---------------------------------------------------------------------------

    def _bucket(self, key: str, kind: T.DataType, buckets: int) -> Column:
        k = F.col(key).cast(kind)
        checked = F.when(k.isNull(), F.raise_error(F.lit(f"{key} is null"))).otherwise(k).cast(kind)
        return F.pmod(F.xxhash64(checked), F.lit(buckets)).cast("int")

    def _touched(self, table: str, keys: DataFrame) -> list[int]:
        """Buckets of the keys: at most as many numbers as there are buckets."""
        entry = self._entry(table)
        kind = self.schema(table)[entry["key"]].dataType
        return sorted(r[0] for r in keys.select(self._bucket(entry["key"], kind, entry["buckets"])).distinct().collect())

    def _written(self, rows: DataFrame, key: str, schema: T.StructType, buckets: int) -> dict[str, list[str]]:
        if BUCKET in rows.columns:
            raise ValueError(f"{BUCKET} names the store's own column")
        name = f"data/{uuid.uuid4().hex}"
        typed = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
        typed = typed.withColumn(BUCKET, self._bucket(key, schema[key].dataType, buckets))
        # small buckets share a task, one that is large (a key with very many rows) is split over several
        typed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{name}")
        made = [n for n in self._listed(self.spark, f"{self.root}/{name}") if n.startswith(BUCKET)]
        return {n.split("=")[1]: [f"{name}/{n}"] for n in made}

    def put(self, table: str, rows: DataFrame, key: str, buckets: int = 64) -> Change:
        """A whole table, new or instead of the one there.  Choose so many buckets that one is a task's work."""
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
        files = self._written(rows, key, schema, buckets)
        return Change(table, {"key": key, "buckets": buckets, "schema": json.loads(schema.json()), "files": files}, len(files))

    def _rewritten(self, table: str, touched: Sequence[int], rows: DataFrame) -> Change:
        entry = self._entry(table)
        made = self._written(rows, entry["key"], self.schema(table), entry["buckets"])
        files = {b: f for b, f in entry["files"].items() if int(b) not in touched}
        return Change(table, {**entry, "files": {**files, **made}}, len(touched))

    def upsert(self, table: str, rows: DataFrame) -> Change:
        """Rows replace those of their key or are added (M01).  Each key comes once; columns that are missing are null."""
        key, touched = self._entry(table)["key"], self._touched(table, rows)
        old = self.read(table, touched).join(rows.select(key), key, "left_anti")
        return self._rewritten(table, touched, old.unionByName(rows, allowMissingColumns=True).select(self.schema(table).names))

    def update(self, table: str, rows: DataFrame) -> Change:
        """Columns of ``rows`` beside the key are set where the key is found, to null too (M03); other keys change nothing."""
        key, touched = self._entry(table)["key"], self._touched(table, rows)
        mine = rows.select(F.col(key).alias("__key"), F.struct(*(c for c in rows.columns if c != key)).alias("__new"))
        both = self.read(table, touched).join(mine, F.col(key) == F.col("__key"), "left")
        new = lambda c: F.when(F.col("__key").isNull(), F.col(c)).otherwise(F.col(f"__new.{c}")).alias(c)
        return self._rewritten(table, touched, both.select(*(new(c) if c in rows.columns and c != key else F.col(c) for c in self.schema(table).names)))

    def delete(self, table: str, keys: DataFrame) -> Change:
        """Rows of the keys go (M03); keys that aren't there change nothing."""
        key, touched = self._entry(table)["key"], self._touched(table, keys)
        return self._rewritten(table, touched, self.read(table, touched).join(keys.select(key), key, "left_anti"))

    def append(self, table: str, rows: DataFrame) -> Change:
        """Rows are added beside others of their key (M11, M13: histories); no file is rewritten."""
        entry = self._entry(table)
        made = self._written(rows, entry["key"], self.schema(table), entry["buckets"])
        files = {b: [*entry["files"].get(b, []), *made.get(b, [])] for b in {**entry["files"], **made}}
        return Change(table, {**entry, "files": files}, 0)
