"""Durable cuts of the lineage, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import bound_batches


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset and Spark is local, as in tests, one of our own."""
    bound_batches(spark)
    said = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not said:
        now = sc._jsc.sc().getCheckpointDir()
        if now.isDefined():
            return now.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        said = tempfile.mkdtemp(prefix="spark-shared-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(said)
    return said


def durable(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, which outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table in the shared folder, used by no other run."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def as_table(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a written table in the shared folder: compressed, and read by column."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    # finished steps leave shuffle files until the driver's JVM collects what points to them
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where a column of the data has them already."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n.lower() not in taken) for name in names]


def content_key(*columns: Column) -> Column:
    """128 bits of what the columns hold, as text: rows with equal keys are equal there, whatever their ids, and reruns agree."""
    told = [x for c in columns for x in (c.isNull(), c)]
    return F.concat_ws("/", F.xxhash64(F.lit(1), *told).cast("string"), F.xxhash64(F.lit(2), *told).cast("string"))


def with_rows(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows with a key of their own in a written table, and the key's column: ids may be null or repeated."""
    (row,) = unused(df, "row_key")
    return as_table(df.withColumn(row, F.monotonically_increasing_id()), name), row
