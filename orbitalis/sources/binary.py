"""Packed binary body files.

preamble: int32 count, int32 dimensions, float64 time, then for each body
x y z vx vy vz mass softening as float64.  plain: x y z vx vy vz mass, no
preamble.  Ids are the order in the file.  Ranges of bodies are read by many tasks;
write_folder's files are written by the tasks that hold the bodies.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from orbitalis.sources import pieces
from orbitalis.sources.pieces import HEAD
from orbitalis.sources.tables import STATE

_ORDER = ("x", "y", "z", "vx", "vy", "vz", "mass")


def _decoded(spark: SparkSession, path: str, fields: int, head: bool, limit: int | None, start: int, rows: int) -> DataFrame:
    """The bodies with ids from start on (limit of them) of a file or of a folder's files
    in the order of their names, ids from 0 over all of them.  A task reads a range of
    `rows` bodies; where Arrow doesn't know the file system, a task reads a whole file
    through Spark, which may have 2 GB then."""
    skip = struct.calcsize(HEAD) if head else 0
    listed = spark.read.format("binaryFile").load(path).select("path", "length").collect()  # a row for each file
    first, total = {}, 0
    for name, size in sorted(listed):
        if (size - skip) % (8 * fields) or size < skip:
            raise ValueError(f"{size} bytes don't fit whole bodies: {name}")
        first[name], total = total, total + (size - skip) // (8 * fields)
    stop = total if limit is None else min(start + limit, total)
    if all(map(pieces.reachable, sorted(first)[:1])):
        return pieces.read_ranges(spark, sorted((r[0], r[1]) for r in listed), fields, head, start, stop, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if head:
                    n, dims, _ = struct.unpack_from(HEAD, raw)
                    if dims != 3 or len(raw) != skip + 8 * fields * n:
                        raise ValueError(f"{len(raw)} bytes don't fit {n} bodies of {dims} dimensions: {name}")
                a, low = np.frombuffer(raw, "<f8", offset=skip).reshape(-1, fields), max(0, start - first[name])
                a = a[low : max(low, stop - first[name])]
                for at in range(0, len(a), 1 << 16):
                    yield pieces.bodies_of(a[at : at + (1 << 16)], first[name] + low + at)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, STATE)


def read_preamble(spark: SparkSession, path: str, limit: int | None = None, start: int = 0, rows: int = 1 << 20) -> DataFrame:
    return _decoded(spark, path, 8, True, limit, start, rows)


def read_plain(spark: SparkSession, path: str, limit: int | None = None, start: int = 0, rows: int = 1 << 20) -> DataFrame:
    return _decoded(spark, path, 7, False, limit, start, rows)


def _encoded(bodies: DataFrame, preamble: bool, softening: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            p = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in _ORDER] + [np.full(b.num_rows, softening)] * preamble, 1)
            yield p.astype("<f8").tobytes()

    return run


def write_folder(bodies: DataFrame, path: str, preamble: bool, softening: float = 0.0, time: float = 0.0, rows: int = 1 << 20) -> None:
    """A folder of whole files of about `rows` bodies each, in id order over the names;
    each task writes its own, and holds it until its preamble is known."""
    ends, encoded = "tab" if preamble else "bin", _encoded(bodies, preamble, softening)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(encoded(b for b in batches if b.num_rows))
        if held:
            head = [struct.pack(HEAD, sum(map(len, held)) // 64, 3, time)] if preamble else []
            yield from pieces.chunked(f"part-{TaskContext.get().partitionId():08d}.{ends}", iter(head + held))

    parts = max(1, -(-bodies.count() // rows))
    ordered = bodies.repartitionByRange(parts, "id").sortWithinPartitions("id").select(*_ORDER)
    pieces.write_pieces(ordered.mapInArrow(run, "name string, raw binary"), path, overwrite=True)


def _chunks(bodies: DataFrame, preamble: bool, softening: float, time: float) -> Iterator[bytes]:
    """The file's bytes in pieces of some thousand bodies, in id order."""
    encoded = _encoded(bodies, preamble, softening)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in encoded(batches):
            yield pa.RecordBatch.from_pydict({"raw": pa.array([raw], pa.binary())})

    if preamble:
        yield struct.pack(HEAD, bodies.count(), 3, time)
    ordered = bodies.repartitionByRange("id").sortWithinPartitions("id").select(*_ORDER)
    for (raw,) in ordered.mapInArrow(run, "raw binary").toLocalIterator():
        yield bytes(raw)


def packed(bodies: DataFrame, preamble: bool, softening: float = 0.0, time: float = 0.0) -> bytes:
    """The whole file's bytes, for tables that fit the driver."""
    return b"".join(_chunks(bodies, preamble, softening, time))


def write_packed(bodies: DataFrame, path: str, preamble: bool, softening: float = 0.0, time: float = 0.0) -> None:
    """One file, which the driver writes through Spark's file systems, a piece at a time,
    for programs that want one; write_folder writes large sets."""
    spark = bodies.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        for raw in _chunks(bodies, preamble, softening, time):
            stream.write(bytearray(raw))
    finally:
        stream.close()


#: numpy kinds of VTK's types (fixed values).
_KINDS = {"Float64": "f8", "Float32": "f4", "Int64": "i8", "Int32": "i4", "UInt64": "u8", "UInt32": "u4", "UInt8": "u1"}


def read_vtu_points(text: str | bytes) -> dict[str, np.ndarray]:
    """The arrays of an XML VTK file: ASCII, base64 (each behind its length), or raw
    appended ones."""
    import base64
    import re
    import xml.etree.ElementTree as ET

    raw = text.encode() if isinstance(text, str) else text
    blob, mark = b"", re.search(rb'<AppendedData encoding="raw">\s*_', raw)
    if mark:
        blob, raw = raw[mark.end() :], raw[: mark.start()] + b"</VTKFile>"
    root = ET.fromstring(raw)
    order = ">" if root.get("byte_order") == "BigEndian" else "<"
    size = np.dtype(order + _KINDS[root.get("header_type", "UInt32")])
    out = {}
    for i, node in enumerate(root.iter("DataArray")):
        kind, n = np.dtype(order + _KINDS[node.get("type", "Float64")]), int(node.get("NumberOfComponents") or 1)
        if node.get("format") == "appended":
            at = int(node.get("offset"))
            length = int(np.frombuffer(blob, size, 1, at)[0])
            data = np.frombuffer(blob, kind, length // kind.itemsize, at + size.itemsize)
        elif node.get("format") == "ascii":
            data = np.array((node.text or "").split(), kind)
        else:
            data = np.frombuffer(base64.b64decode((node.text or "").strip()), kind, offset=size.itemsize)
        out[node.get("Name") or f"array{i}"] = data.reshape(-1, n) if n > 1 else data
    return out


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The points of a folder of XML VTK pieces as rows: id (if they have one), mass,
    x, y, z; one task reads a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                a = read_vtu_points(raw)
                p = a["position"] if "position" in a else a["Points"]
                n = len(p)
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(a["id"].astype(np.int64) if "id" in a else [None] * n, pa.int64()), "mass": pa.array(a["mass"] if "mass" in a else [None] * n, pa.float64()),
                    **{c: p[:, k].copy() for k, c in enumerate("xyz")},
                })

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id long, mass double, x double, y double, z double")
