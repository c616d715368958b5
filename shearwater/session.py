"""What operators with Python functions ask of a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
_OWN: dict[str, str] = {}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and bound the bytes of a batch, so that long texts fit beside their work."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def shared(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; only a local session that names none gets a temporary one."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or _OWN.get(sc.applicationId)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="shearwater-")
        atexit.register(shutil.rmtree, where, True)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and stored in the session's checkpoint folder: loops don't grow the plan and survive lost executors."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()
