"""The folder that all executors share, and durable cuts of the lineage in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of rows that a Python worker gets at once, where rows are long.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES, unless it asks for fewer bytes already."""
    now = spark.conf.get(_BATCH_KEY, "64m").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    if not 0 < int(now.rstrip("kmg")) * unit <= BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is named and Spark is local, as in tests, one of our own."""
    sc = spark.sparkContext
    said = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not said:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        said = tempfile.mkdtemp(prefix="spark-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(said)
    return said


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, which outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
