"""Lineage cuts and level tables for iterative operators.

Iterative operators write each round to the shared folder named by
``spark.checkpoint.dir`` and read it back. A lost executor then costs a re-read
of files, never a replay of earlier rounds, and the optimizer sees real file
sizes when it decides whether a frontier is small enough to broadcast.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


#: Folders of rounds written so far, by application; ``release`` removes them.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Only a session in one process (local mode) that lacks the setting gets a
    temporary folder; executors elsewhere could not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trailgraph-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def release(spark: SparkSession) -> int:
    """Remove all rounds this application has written; DataFrames that read them end. Returns their number."""
    folders = _written.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)


def tasks_for(df: DataFrame, rows: int = 250_000) -> int:
    """Tasks of about ``rows`` rows of a table each, for steps that hold what
    they read; 1 if one would do, else no fewer than there are cores."""
    tasks = -(-df.count() // rows)
    return max(tasks, df.sparkSession.sparkContext.defaultParallelism) if tasks > 1 else 1


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Dealt by ``keys`` to ``tasks`` tasks, which stay as many; one task leaves that to the session."""
    return df.repartition(tasks, *keys) if tasks > 1 else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    return RoundStore(df.sparkSession, df.schema).append(df)


class RoundStore:
    """Append-only table with one folder per round of an iteration."""

    def __init__(self, spark: SparkSession, schema: T.StructType):
        self.spark = spark
        self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
        self.base = f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"
        _written.setdefault(spark.sparkContext.applicationId, []).append(self.base)
        self.paths: list[str] = []

    def append(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths):05d}"
        df.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)
