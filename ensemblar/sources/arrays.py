"""Arrays in .npy and .npz files as a data source that splits files.

The header says where the numbers begin and how they are laid out.  So a file, however large, is cut into ranges of
numbers; a task reads its range only, in pieces, and knows the cell and frame of each number from its place.  Small files
are read many to a task.
Members of an .npz archive that are stored as they are split in the same way; a compressed one is read in order by
one task, a piece at a time.  Files are opened through Arrow's file systems (local and shared folders, s3, gs, hdfs).
"""

from __future__ import annotations

import fnmatch
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, cell int, frame int, value double"
_ARROW = pa.schema([("path", pa.string()), ("cell", pa.int32()), ("frame", pa.int32()), ("value", pa.float64())])

#: Bytes of numbers in a partition, and of a piece that a task holds.
PARTITION_BYTES, PIECE_BYTES = 32 << 20, 4 << 20
#: Bytes of small files that share a task, what opening one counts for, and rows that they hand on together.
SHARED_BYTES, OPEN_BYTES, ROWS = 4 << 20, 64 << 10, 1 << 16


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("/") else fs.FileSystem.from_uri(uri.replace("file:", "file://", 1))


def matching(glob: str) -> list[str]:
    """Files below the part of the glob that has no pattern, in order."""
    system, path = opened(glob.replace("*", "%2A").replace("?", "%3F").replace("[", "%5B") if "://" in glob else glob)
    parts = path.split("/")
    fixed = next((k for k, x in enumerate(parts) if any(c in x for c in "*?[")), None)
    if fixed is None:
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [path]
        return sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith((".npy", ".npz")))
    below = system.get_file_info(fs.FileSelector("/".join(parts[:fixed]) or "/", recursive=fixed < len(parts) - 1))
    return sorted(f.path for f in below if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.path, path) and f.path.count("/") == path.count("/"))


@dataclass
class Numbers(InputPartition):
    """A range of the numbers of one array, in the order of the file."""

    path: str
    member: str | None
    offset: int
    dtype: str
    n_cells: int
    n_frames: int
    by_frame: bool
    first: int
    end: int


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    parts: list[Numbers]


def _dealt(parts: list[Numbers], size: int) -> list[Ranges]:
    """Ranges one after another, as many to a task as have about some bytes; a larger one is alone."""
    out, held = [], size
    for p in parts:
        cost = (p.end - p.first) * np.dtype(p.dtype).itemsize + OPEN_BYTES
        if held + cost > size:
            out.append(Ranges([]))
            held = 0
        out[-1].parts.append(p)
        held += cost
    return out


def _header(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, dtype = read(f)
    if dtype.hasobject or len(shape) > 2:
        raise ValueError(f"an array of numbers with one or two dimensions is asked for, not {shape} of {dtype}")
    return shape, by_column, dtype


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        # names of options come in small letters
        self.glob, self.variable = options["path"], options.get("variable")
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", 1 << 31))
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))
        self.zeros = str(options.get("zeros", "false")).lower() == "true"

    def partitions(self) -> list[Ranges]:
        out = []
        system, _ = opened(self.glob.split("*")[0].split("?")[0])
        for path in matching(self.glob):
            with system.open_input_file(path) as f:
                member, start, whole = None, 0, False
                if path.endswith(".npz"):
                    z = zipfile.ZipFile(f)
                    names = z.namelist()
                    name = f"{self.variable}.npy" if self.variable else names[0]
                    if name not in names:
                        raise ValueError(f"{path} has no array {self.variable}; it has {[n[:-4] for n in names]}")
                    info = z.getinfo(name)
                    if info.compress_type == zipfile.ZIP_STORED:
                        f.seek(info.header_offset + 26)
                        lengths = np.frombuffer(f.read(4), "<u2")
                        start = info.header_offset + 30 + int(lengths.sum())
                    else:
                        member, whole = name, True
                if whole:
                    with z.open(member) as m:
                        shape, by_column, dtype = _header(m)
                        offset = 0
                else:
                    f.seek(start)
                    shape, by_column, dtype = _header(f)
                    offset = f.tell()
            cells, frames = shape if len(shape) == 2 else (1, shape[0] if shape else 1)
            n, step = cells * frames, max(1, self.size // dtype.itemsize)
            for a in range(0, n, n if whole else step):
                out.append(Numbers(path, member, offset, dtype.str, cells, frames, by_column and len(shape) == 2, a, min(n, n if whole else a + step)))
        return _dealt(out, min(self.size, SHARED_BYTES))

    def read(self, ranges: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.glob.split("*")[0].split("?")[0])
        held, rows = [], 0
        for p in ranges.parts:
            for batch in self._numbers(system, p):
                held.append(batch)
                rows += len(batch)
                if rows >= ROWS:
                    yield _joined(held)
                    held, rows = [], 0
        if held:
            yield _joined(held)

    def _numbers(self, system: fs.FileSystem, p: Numbers) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype(p.dtype)
        step = max(1, PIECE_BYTES // dtype.itemsize)
        with system.open_input_file(p.path) as f:
            if p.member:
                source = zipfile.ZipFile(f).open(p.member)
                _header(source)
            else:
                f.seek(p.offset + p.first * dtype.itemsize)
                source = f
            for a in range(p.first, p.end, step):
                x = np.frombuffer(source.read((min(p.end, a + step) - a) * dtype.itemsize), dtype)
                at = np.arange(len(x)) if self.zeros else np.flatnonzero(x)
                if p.by_frame:
                    frame, cell = np.divmod(at + a, p.n_cells)
                else:
                    cell, frame = np.divmod(at + a, p.n_frames)
                kept = (frame >= self.first) & (frame <= self.last)
                at, cell, frame = at[kept], cell[kept], frame[kept]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([p.path], pa.string()).take(pa.array(np.zeros(len(at), np.int32))), pa.array(cell.astype(np.int32)), pa.array(frame.astype(np.int32)), pa.array(x[at].astype(np.float64))], schema=_ARROW)


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "number_arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(dict(self.options))


def read_arrays(spark: SparkSession, glob: str, variable: str | None = None, first: int | None = None, last: int | None = None, zeros: bool = False, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Rows (path, cell, frame, value) of cells x frames arrays in .npy or .npz files, in partitions of ranges of numbers.

    Zeros are left out, as activity is sparse, unless they are asked for.  A one-dimensional array is one cell.
    first, last: frames to keep.
    """
    spark.dataSource.register(ArraySource)
    r = spark.read.format("number_arrays").option("partitionBytes", partition_bytes).option("zeros", zeros)
    for name, x in (("variable", variable), ("first", first), ("last", last)):
        r = r if x is None else r.option(name, x)
    return r.load(glob)


def write_files(files: DataFrame, folder: str) -> None:
    """Writes rows (name, content) as files; a file has its name only once it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = posixpath.join(path, f".{name}.{np.random.default_rng().integers(1 << 60)}")
                with system.open_output_stream(part) as f:
                    f.write(content)
                system.move(part, posixpath.join(path, name))
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    files.select("name", "content").mapInArrow(run, "name string").count()
