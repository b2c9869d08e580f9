"""Readers and writers.  Text formats are parsed from lines (file, n, line), so that any source of lines will do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import over
from ..operators.intervals import runs
from .arrays import read_arrays, write_files  # noqa: F401


def read_sessions(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """The catalog of recordings, one row a session."""
    reader = spark.read.schema(schemas.SESSIONS)
    d = reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)
    return d.dropDuplicates(["session_id"])


def session_of_path(path: Column | str = "path") -> tuple[Column, Column, Column]:
    """(age, subject, session) of p<age>_<session> in a path; the subject is the letters at the session's start."""
    p = F.col(path) if isinstance(path, str) else path
    name = F.regexp_extract(p, r"[pP](\d+)_([A-Za-z0-9_]+)", 0)
    age = F.regexp_extract(name, r"^[pP](\d+)_", 1).try_cast("int")
    session = F.nullif(F.regexp_extract(name, r"^[pP]\d+_(.*)$", 1), F.lit(""))
    return age, F.nullif(F.regexp_extract(session, r"^([A-Za-z]+)", 1), F.lit("")), session


def parse_session_path(df: DataFrame, path: str = "path") -> DataFrame:
    age, subject, session = session_of_path(path)
    return df.select("*", age.alias("age"), subject.alias("subject"), session.alias("session_id")).filter(F.col("age").isNotNull())


def read_period_labels(arrays: DataFrame, label: str) -> DataFrame:
    """Runs of a boolean mask read with read_arrays."""
    return runs(arrays.filter("value <> 0"), ("path",)).withColumn("label", F.lit(label))


def read_interval_arrays(arrays: DataFrame, label: str) -> DataFrame:
    """Intervals of a 2 x n array of seconds: row 0 holds the starts, row 1 the ends (read with zeros: 0 is a time too)."""
    side = lambda c: F.max(F.when(F.col("cell") == c, F.col("value")))
    return arrays.groupBy("path", "frame").agg(F.coalesce(side(0), F.lit(0.0)).alias("t0"), side(1).alias("t1")).select("path", F.lit(label).alias("label"), "t0", "t1")


def read_lines(spark: SparkSession, path: str, kind: str = "text") -> DataFrame:
    """(file, n, line) of texts.  n orders a file's lines; it is read whole, as such files are small.

    kind: text for a file each, or a format of rows (file, value), where many texts share a file.
    """
    if kind == "text":
        texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    else:
        texts = spark.read.format(kind).load(path).select("file", "value")
    return texts.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))


def parse_invalid_frames(lines: DataFrame, minus_one: bool = False) -> DataFrame:
    """A line that starts with p names a session, the a-b lines after it are its bad frames."""
    head = F.when(F.lower("line").startswith("p"), F.trim("line"))
    d = lines.withColumn("session_id", F.last(head, ignorenulls=True).over(over("file", "n")))
    pair = F.regexp_extract("line", r"^\s*(\d+)\s*-\s*(\d+)\s*$", 0)
    off = 1 if minus_one else 0
    return d.filter((pair != "") & F.col("session_id").isNotNull()).select("session_id", (F.regexp_extract("line", r"(\d+)\s*-", 1).cast("int") - off).alias("first"), (F.regexp_extract("line", r"-\s*(\d+)", 1).cast("int") - off).alias("last"))


def parse_assemblies(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (file, assembly, cell) and event times (file, assembly, single, frame) of a sectioned text.

    #CELL_ASSEMBLIES# holds SCA_cluster lines of members, then single_sce_in_ca and
    multiple_sce_in_ca lines of "cluster:frame frame ..."; other sections are passed over.
    """
    section = F.last(F.when(F.col("line").rlike(r"^#\w+#"), F.regexp_extract("line", r"^#(\w+)#", 1)), ignorenulls=True)
    d = lines.withColumn("section", section.over(over("file", "n"))).filter("section = 'CELL_ASSEMBLIES'")
    numbers = lambda x: F.explode(F.filter(F.split(x, r"[\s,]+"), lambda y: y.rlike(r"^\d+$")).cast("array<int>"))
    cluster = d.filter(F.col("line").startswith("SCA_cluster")).withColumn("assembly", (F.row_number().over(over("file", "n")) - 1).cast("int"))
    members = cluster.select("file", "assembly", numbers(F.regexp_extract("line", r":(.*)$", 1)).alias("cell"))
    times = d.filter(F.col("line").rlike(r"^(single|multiple)_sce_in_ca")).select("file", F.regexp_extract("line", r":\s*(\d+)\s*:", 1).cast("int").alias("assembly"), F.col("line").startswith("single").alias("single"), numbers(F.regexp_extract("line", r":\s*\d+\s*:(.*)$", 1)).alias("frame"))
    return members, times


def parse_sequence_results(lines: DataFrame) -> DataFrame:
    """(file, n_cells, repetitions) of lines "n:[r,r,...]" or "n:count"; the slope is the last number of the file's name."""
    d = lines.filter(F.col("line").rlike(r"^\s*\d+\s*:"))
    n = F.regexp_extract("line", r"^\s*(\d+)\s*:", 1).cast("int")
    body = F.trim(F.regexp_extract("line", r":(.*)$", 1))
    listed = F.from_json(body, "array<int>")
    total = F.when(body.startswith("["), F.aggregate(listed, F.lit(0), lambda s, x: s + x)).otherwise(body.try_cast("int"))
    slope = F.regexp_extract("file", r"(\d+)(?:\.\w+)?$", 1).try_cast("int")
    return d.select("file", slope.alias("slope"), n.alias("n_cells"), F.when(body.startswith("["), F.size(listed)).otherwise(1).alias("n_sequences"), total.alias("repetitions"))


def parse_best_order(lines: DataFrame) -> DataFrame:
    d = lines.filter(F.col("line").startswith("best_order:"))
    return d.select("file", F.posexplode(F.filter(F.split(F.regexp_extract("line", r":(.*)$", 1), r"[\s,]+"), lambda x: x != "")).alias("rank", "cell")).withColumn("cell", F.col("cell").cast("int"))


def read_wide_events(df: DataFrame, cell: str, conditions: Sequence[str] | None = None) -> DataFrame:
    """(cell, condition, t): one column for each condition, one event a row, padding dropped."""
    columns = list(conditions or [c for c in df.columns if c != cell])
    d = df.select(F.col(cell).alias("cell"), *[F.col(c).try_cast("double").alias(c) for c in columns])
    return d.unpivot(["cell"], columns, "condition", "t").filter(F.col("t").isNotNull() & ~F.isnan("t"))


def write_dataset(df: DataFrame, path: str, by: Sequence[str] = (), kind: str = "parquet", mode: str = "errorifexists", within: Sequence[str] = ()) -> None:
    """Parquet split by columns, or csv for summaries; rows of a split are gathered first, so that it is few files.

    by: columns of folders, of few values.  within: columns of many values, as sessions: they share files, dealt by ranges
    and in order, so that readers find one by the files' statistics and files grow in number with bytes only.
    """
    out = df.repartitionByRange(*by, *within).sortWithinPartitions(*by, *within) if within else df.repartition(*by) if by else df
    writer = out.write.mode(mode)
    writer = writer.partitionBy(*by) if by else writer
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def frame_means(pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """Mean pixel value of each cell's mask by frame; cell -1 is the whole frame."""
    own = pixels.join(masks, ["session_id", "x", "y"]).groupBy("session_id", "frame", "cell").agg(F.avg("v").alias("value"))
    return own.unionByName(pixels.groupBy("session_id", "frame").agg(F.avg("v").alias("value")).withColumn("cell", F.lit(-1)))

