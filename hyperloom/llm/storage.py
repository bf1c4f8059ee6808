"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of our own only where that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="hyperloom-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(frame: DataFrame, label: str, level: int = 3, page_bytes: int = 1 << 20) -> DataFrame:
    """Write ``frame`` once to the shared folder (zstd of ``level``, in pages of ``page_bytes``) and read it back: lineage ends here, and a lost
    executor costs only a reread."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).option("parquet.page.size", str(page_bytes)).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until no column of ``frame`` has them (in any case)."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions_for(frame: DataFrame, bytes_each: int) -> int:
    """Partitions for an exchange of ``frame``: grows with the input, so that a task's share stays the same; at least the session's number."""
    spark = frame.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # An unknown size counts as enormous there; such frames are not estimated.
    return max(least, min(-(-size // bytes_each), 50_000)) if size < 1 << 60 else least
