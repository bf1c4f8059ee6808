"""Tables between the rounds of an iterative plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of our own only where that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hyperloom-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def cut(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back, which ends its lineage."""
    path = f"{shared_dir(frame.sparkSession)}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def until_stable(frame: DataFrame, step, label: str, rounds: int = 200) -> DataFrame:
    """Apply ``step`` until the number of rows stays the same; for steps that only remove rows."""
    frame = cut(frame, label)
    before = frame.count()
    for k in range(rounds):
        frame = cut(step(frame), f"{label}-{k}")
        after = frame.count()
        if after == before:
            return frame
        before = after
    raise RuntimeError(f"{label} did not settle in {rounds} rounds")
