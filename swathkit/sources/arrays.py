"""Archives of arrays (zipped NPY files) as a Spark data source: read in parallel, never unpickled.

The driver reads only directories and headers. A stored (not deflated) array is cut into stretches of its first axis, a
task each, which seek to their bytes; a deflated one is a task of its own. Arrays that were not asked for are not read.
Arrays of Python objects are refused by their header, before a byte of them is read. Complex and structured arrays are
refused too; an array of any shape gives its values in C order, with the place of each.

Rows: file, array, position, value (double; whole numbers beyond 2^53 are refused rather than rounded).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from swathkit.operators.contracts import ContractError

STRETCH = 1_000_000  #: values of a task
BATCH = 65_536
SCHEMA = "file string, array string, position bigint, value double"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def archives(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The archive at path, or all below it."""
    system, root = opened(path)
    found = system.get_file_info(root)
    if found.type == fs.FileType.File:
        return system, [root]
    if found.type == fs.FileType.NotFound:
        raise ContractError(f"no archive at {path}")
    return system, sorted(f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".npz"))


@dataclass
class Header:
    file: str
    array: str
    kind: str
    size: int
    start: int  #: byte of the first value, in the file if the member is stored, else in the member
    stored: bool


def _header(file: str, source, member: zipfile.ZipInfo, archive: zipfile.ZipFile) -> Header:
    with archive.open(member) as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(f)
        start = f.tell()
    name = member.filename.removesuffix(".npy")
    if dtype.hasobject:
        raise ContractError(f"{file}: {name} holds Python objects, which are never unpickled")
    if dtype.kind not in "biuf" or (fortran and len(shape) > 1):
        raise ContractError(f"{file}: {name} is of a kind that is not read ({dtype})")
    stored = member.compress_type == zipfile.ZIP_STORED
    if stored:  # local header: 30 bytes, then name and extra field
        source.seek(member.header_offset + 26)
        lengths = np.frombuffer(source.read(4), "<u2").astype(int)
        start += member.header_offset + 30 + int(lengths.sum())
    return Header(file, name, dtype.str, int(np.prod(shape, dtype=np.int64)), start, stored)


def headers(path: str) -> list[Header]:
    """Headers of all arrays of the archives at path; object arrays are an error."""
    system, files = archives(path)
    out = []
    for file in files:
        with system.open_input_file(file) as source, zipfile.ZipFile(source) as archive:
            out += [_header(file, source, m, archive) for m in archive.infolist() if m.filename.endswith(".npy")]
    return out


def require_arrays(path: str, required: set[str]) -> None:
    """Every archive at path holds the arrays; their headers are read, not they."""
    held: dict[str, set[str]] = {f: set() for f in archives(path)[1]}
    for h in headers(path):
        held[h.file].add(h.array)
    if missing := {f: sorted(required - names) for f, names in held.items() if required - names}:
        raise ContractError(f"missing arrays: {missing}")
    if not held:
        raise ContractError(f"no archive at {path}")


class Stretch(InputPartition):
    def __init__(self, header: Header, first: int, n: int):
        self.header, self.first, self.n = header, first, n


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.stretch = options["path"], int(options.get("stretch", STRETCH))
        self.wanted = {a for a in options.get("arrays", "").split(",") if a}

    def partitions(self) -> list[Stretch]:
        out = []
        for h in headers(self.path):
            if not self.wanted or h.array in self.wanted:
                step = self.stretch if h.stored else max(h.size, 1)
                out += [Stretch(h, a, min(step, h.size - a)) for a in range(0, h.size, step)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no array was asked for
            return
        h, kind = partition.header, np.dtype(partition.header.kind)
        system, _ = opened(self.path)
        with system.open_input_file(h.file) as source:
            if h.stored:
                source.seek(h.start + partition.first * kind.itemsize)
                yield from self._batches(source, partition, kind)
            else:
                with zipfile.ZipFile(source) as archive, archive.open(f"{h.array}.npy") as member:
                    member.read(h.start)
                    yield from self._batches(member, partition, kind)

    def _batches(self, source, partition: Stretch, kind: np.dtype) -> Iterator[pa.RecordBatch]:
        h, at, end = partition.header, partition.first, partition.first + partition.n
        while at < end:
            n = min(BATCH, end - at)
            values = np.frombuffer(source.read(n * kind.itemsize), kind)
            if len(values) != n:
                raise ContractError(f"{h.file}: {h.array} ends early")
            if kind.kind in "iu" and kind.itemsize == 8 and n and (values.max() > 2**53 or (kind.kind == "i" and values.min() < -(2**53))):
                raise ContractError(f"{h.file}: {h.array} has numbers that a double cannot hold")
            columns = [pa.array([h.file] * n), pa.array([h.array] * n), pa.array(np.arange(at, at + n)), pa.array(values.astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, ["file", "array", "position", "value"])
            at += n


class Archive(DataSource):
    """spark.read.format("npz"): options path, arrays (names joined by commas; all if empty) and stretch."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:  # noqa: ANN001
        return ArchiveReader(self.options)


def read_arrays(spark: SparkSession, path: str, arrays: list[str] | None = None, stretch: int = STRETCH) -> DataFrame:
    spark.dataSource.register(Archive)
    return spark.read.format("npz").option("arrays", ",".join(arrays or [])).option("stretch", str(stretch)).load(path)


def write_arrays(df: DataFrame, path: str, columns: list[str], deflated: bool = False) -> DataFrame:
    """One archive for each partition, an array for each column (numbers without nulls); file, n of what was written.

    An archive has the name of its partition and appears whole, by a move, so a task that runs again leaves one file.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if not held:
            return
        whole = pd.concat(held)
        if whole.isna().to_numpy().any() or any(whole[c].dtype.kind not in "biuf" for c in columns):
            raise ContractError("arrays hold numbers without nulls")
        system, root = opened(path)
        task = TaskContext.get()
        buffer = io.BytesIO()
        (np.savez_compressed if deflated else np.savez)(buffer, **{c: whole[c].to_numpy() for c in columns})
        name = f"{root.rstrip('/')}/part-{task.partitionId():05d}"
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as out:
            out.write(buffer.getbuffer())
        system.move(f"{name}.{task.taskAttemptId()}.tmp", f"{name}.npz")
        yield pd.DataFrame({"file": [f"{name}.npz"], "n": [len(whole)]})

    from swathkit.sources.files import written

    return written(df.select(*columns).mapInPandas(write, "file string, n bigint"), "archives")
