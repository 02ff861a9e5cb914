"""Structured Streaming forms of the incremental operators.

Session state, telemetry and weekly buckets keep keyed state in the state
store; every stream writes an append-only table in the shared folder, from
which the batch operators read. The windowed streams extend the batch operators
and have no counterpart of their own in them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgraph.functions import scalar as S
from trailgraph.runtime import shared_dir

# Tools that edit files and commands that validate a change.
EDIT_TOOLS = r"^(Edit|Write|NotebookEdit|MultiEdit)$"
VALIDATION = (r"(?i)\b(jest|vitest|mocha|pytest|tox|nox|unittest|eslint|ruff|flake8|pylint|tsc|typecheck|type-check|mypy|pyright|cargo\s+(test|check|clippy)"
              r"|go\s+(test|vet)|gradle|mvn|rspec|phpunit|dotnet\s+test|npm\s+(test|run\s+\S+)|pnpm\s+\S+|yarn\s+\S+)\b")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream, with the schema of its batch form."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drain(stream: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Process what is available, exactly once, and return the written table."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    run = writer.start(f"{base}/rows")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def session_changes(hooks: DataFrame, ttl: str = "30 days") -> DataFrame:
    """First sight of every edited source file and validation command of a session.

    hooks: session_id, ts, tool_name, file_path, command. State holds one entry
    per (session, kind, value) and expires with the watermark, so a session with
    very many events is spread over the state store, not held in one value.
    """
    edit = F.col("tool_name").rlike(EDIT_TOOLS) & F.col("file_path").rlike(S.SOURCE_SUFFIX)
    check = (F.col("tool_name") == "Bash") & F.col("command").rlike(VALIDATION)
    kind = F.when(edit, "changed").when(check, "validated")
    value = F.when(edit, S.slashes("file_path")).when(check, F.col("command"))
    seen = hooks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", ttl).select("session_id", "ts", kind.alias("kind"), value.alias("value")).filter(F.col("kind").isNotNull())
    return seen.dropDuplicatesWithinWatermark(["session_id", "kind", "value"])


def session_totals(log: DataFrame, by: str, gap: str, delay: str, sums: list[str]) -> DataFrame:
    """Telemetry of sessions separated by idle gaps; a session is appended once
    the watermark has passed its end."""
    w = F.session_window("ts", gap)
    agg = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(by, w).agg(F.count("*").alias("turns"), *[F.sum(c).alias(c) for c in sums])
    return agg.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "turns", *sums)


def weekly_touches(touches: DataFrame, by: str, delay: str = "1 day", width: str = "7 days") -> DataFrame:
    """Touches per module and tumbling week, appended when the week closes."""
    agg = touches.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(by, F.window("ts", width)).agg(F.count("*").alias("touches"))
    return agg.select(by, F.col("window.start").alias("start"), "touches")


def latest_rows(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Current rows of an appended change log: the newest per key, deletions
    dropped. The batch half of an incremental merge."""
    cols = [c for c in log.columns if c not in key]
    newest = log.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in cols if c not in order])).alias("m"))
    out = newest.select(*key, "m.*")
    return out.filter(~F.col("deleted")).drop("deleted") if "deleted" in cols else out
