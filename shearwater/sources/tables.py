"""Tables, snapshots and state files: reads that tolerate what is missing or broken, writes that merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One row a configured source.
SITE_SCHEMA = T.StructType([T.StructField(n, k, n not in ("name", "list_url")) for n, k in (
    ("name", T.StringType()), ("prefecture", T.StringType()), ("prefecture_code", T.StringType()), ("list_url", T.StringType()), ("list_link_pattern", T.StringType()),
    ("category", T.StringType()), ("extraction", T.StringType()), ("requires_js", T.BooleanType()), ("request_interval", T.DoubleType()), ("timeout_sec", T.IntegerType()), ("license", T.StringType()),
)])


def exists(spark: SparkSession, path: str) -> bool:
    """By the file system of the path, whichever it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def sites(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Validated configuration entries as a table; an unknown license comes from the host."""
    from ..functions import web

    for e in entries:
        if not e.get("name") or not str(e.get("list_url", "")).startswith(("http://", "https://")):
            raise ValueError(f"a source needs a name and a list_url: {e}")
    rows = [tuple(e.get(f.name, {"requires_js": False, "request_interval": 1.0}.get(f.name)) for f in SITE_SCHEMA) for e in entries]
    df = spark.createDataFrame(rows, SITE_SCHEMA)
    return df.withColumn("license", F.coalesce("license", web.license_of(web.host(F.col("list_url")))))


def state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The state at ``path``; empty where there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def snapshot(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Records of a JSON snapshot; broken lines and records without a key are skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    wide = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    df = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return df.where(F.col("_broken").isNull() & F.col(key).isNotNull()).drop("_broken")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old records without the new keys, then the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_version(df: DataFrame, root: str, version: str) -> str:
    """A table version; readers of the version before aren't disturbed."""
    path = f"{root}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def output(new: DataFrame, changes: DataFrame, collected_at: str) -> DataFrame:
    """One row of collected_at, total_count and counts of changes."""
    counts = changes.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("new", "updated", "deleted")))
    return new.agg(F.count("*").alias("total_count")).crossJoin(counts).withColumn("collected_at", F.lit(collected_at))


def blobs(spark: SparkSession, path: str, limit: int = 20 << 20, pattern: str = "*") -> DataFrame:
    """Files as binary rows up to a size, which prunes before any content is read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return df.where(F.col("length") <= limit)
