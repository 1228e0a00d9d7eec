"""Binary files in parts: a source of byte ranges and a sink of pieces.

The source's partitions are ranges of whole records, so a file of any size is read
by many tasks, each of which opens the file and reads its own bytes.  The sink
takes rows (name, raw) and appends each row's bytes to the piece of that name;
tasks write below a staging folder, and a piece takes its place only when all
tasks are done, so a lost or repeated task leaves nothing.  Bytes go between
executors and the file system alone.  Both open files through Arrow's file
systems; `reachable` tells whether there is one for a path.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from orbitalis.sources.tables import STATE

HEAD = "<iid"  # count, dimensions, time
_BATCH = 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path, and the path in it."""
    scheme, found, rest = path.partition(":")
    if not found or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if found else path).lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def reachable(path: str) -> bool:
    try:
        opened(path)
    except (OSError, ValueError, NotImplementedError):  # no such file system in this build of Arrow
        return False
    return True


@dataclass
class _Range(InputPartition):
    path: str
    size: int
    first: int  # record in the file
    count: int
    id: int  # of the first record


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.fields, self.head, self.rows = int(options["fields"]), options["head"] == "true", int(options["rows"])
        self.skip, self.start, self.stop = struct.calcsize(HEAD) if self.head else 0, int(options["start"]), int(options["stop"])

    def partitions(self) -> list[InputPartition]:
        """The ranges; a file without records has an empty one, for its preamble is
        checked too."""
        out, total = [], 0
        for path, size in self.files:
            n = (size - self.skip) // (8 * self.fields)
            low, high = max(0, self.start - total), max(0, min(n, self.stop - total))
            if low < high or n == 0:
                out += [_Range(path, size, at, max(0, min(self.rows, high - at)), total + at) for at in range(low if n else 0, max(high, 1), self.rows)]
            total += n
        return out

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there are no partitions
            return
        system, path = opened(partition.path)
        with system.open_input_file(path) as f:
            if self.head:
                n, dims, _ = struct.unpack(HEAD, f.read_at(self.skip, 0))
                if dims != 3 or partition.size != self.skip + 8 * self.fields * n:
                    raise ValueError(f"{partition.size} bytes don't fit {n} bodies of {dims} dimensions: {partition.path}")
            for at in range(0, partition.count, _BATCH):
                n = min(_BATCH, partition.count - at)
                raw = f.read_at(8 * self.fields * n, self.skip + 8 * self.fields * (partition.first + at))
                yield bodies_of(np.frombuffer(raw, "<f8").reshape(n, self.fields), partition.id + at)


class BodyRanges(DataSource):
    """Packed bodies by ranges.  Options: files (JSON of path and size), fields, head,
    rows (of a range), start and stop (ids)."""

    @classmethod
    def name(cls) -> str:
        return "orbitalis_body_ranges"

    def schema(self) -> str:
        return STATE

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(dict(self.options))


def bodies_of(a: np.ndarray, first: int) -> pa.RecordBatch:
    """Rows of x y z vx vy vz mass (and more) as bodies with ids from `first` on."""
    cols = {"id": np.arange(first, first + len(a)), "mass": a[:, 6].astype("f8")}
    return pa.RecordBatch.from_pydict(cols | {c: a[:, i].astype("f8") for i, c in enumerate(("x", "y", "z", "vx", "vy", "vz"))})


def read_ranges(spark: SparkSession, files: list[tuple[str, int]], fields: int, head: bool, start: int, stop: int, rows: int) -> DataFrame:
    spark.dataSource.register(BodyRanges)
    source = spark.read.format(BodyRanges.name()).option("files", json.dumps(files)).option("fields", fields).option("head", str(head).lower())
    return source.option("start", start).option("stop", stop).option("rows", rows).load()


@dataclass
class _Written(WriterCommitMessage):
    pieces: list[tuple[str, str]]  # staged path, name


class _PieceWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, folder = opened(f"{self.staging}/{uuid.uuid4().hex}")
        system.create_dir(folder, recursive=True)
        pieces, stream, last = [], None, None
        try:
            for batch in iterator:
                for name, raw in zip(batch.column("name").to_pylist(), batch.column("raw"), strict=True):
                    if name != last:
                        if stream is not None:
                            stream.close()
                        stream, last = system.open_output_stream(f"{folder}/{len(pieces)}"), name
                        pieces.append((f"{folder}/{len(pieces)}", name))
                    stream.write(raw.as_buffer())
        finally:
            if stream is not None:
                stream.close()
        return _Written(pieces)

    def commit(self, messages: list[_Written | None]) -> None:
        """Moves the pieces to their places; overwriting then deletes the folder's other files."""
        system, folder = opened(self.path)
        made = {name: staged for m in messages if m is not None for staged, name in m.pieces}
        for name, staged in made.items():
            system.move(staged, f"{folder}/{name}")
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(folder)):
                if info.type == fs.FileType.File and info.base_name not in made:
                    system.delete_file(info.path)
        system.delete_dir(opened(self.staging)[1])

    def abort(self, messages: list[_Written | None]) -> None:
        system, staging = opened(self.staging)
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class PieceFiles(DataSource):
    """A folder of pieces, written from rows (name, raw)."""

    @classmethod
    def name(cls) -> str:
        return "orbitalis_pieces"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _PieceWriter(dict(self.options), overwrite)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def write_pieces(rows: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Rows (name, raw) of a partition as pieces below the folder, those of one name one
    after another.  Where Arrow doesn't know the file system, the driver writes them."""
    spark = rows.sparkSession
    where = qualified(spark, folder)
    if reachable(where):
        spark.dataSource.register(PieceFiles)
        rows.select("name", "raw").write.format(PieceFiles.name()).mode("overwrite" if overwrite else "append").save(where)
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(where)
    system, stream, last = target.getFileSystem(spark._jsc.hadoopConfiguration()), None, None
    if overwrite:
        system.delete(target, True)
    try:
        for name, raw in rows.select("name", "raw").toLocalIterator():
            if name != last:
                if stream is not None:
                    stream.close()
                stream, last = system.create(spark._jvm.org.apache.hadoop.fs.Path(f"{where}/{name}"), True), name
            stream.write(bytearray(raw))
    finally:
        if stream is not None:
            stream.close()


def chunked(name: str, parts: Iterator[bytes], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows (name, raw) of at most `size` bytes."""
    for part in parts:
        for at in range(0, len(part), size):
            yield pa.RecordBatch.from_pydict({"name": [name], "raw": pa.array([part[at : at + size]], pa.binary())})
