"""Series of snapshots: a collection by time names parallel indexes, these name pieces.

write_frame writes pieces and their index, extend_collection adds a frame to a
collection; read_series follows both back to rows.  Indexes are small (a line for
each frame or piece); pieces are written and read by tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitalis.sources import binary, pieces, writers

#: Columns of arrays that files name otherwise (fixed values).
COLUMNS = {"velocity": "v", "acceleration": "a", "potential": "phi"}


def _file(spark: SparkSession, folder: str, name: str, text: str) -> None:
    pieces.write_pieces(spark.createDataFrame([(name, text.encode())], "name string, raw binary").coalesce(1), folder)


def write_frame(bodies: DataFrame, folder: str, step: int, appended: bool = False) -> str:
    """A snapshot's pieces below the folder and their index, frame_<step>.pvtp; its name."""
    spark, name, have = bodies.sparkSession, f"frame_{step:05d}", bodies.columns
    if appended:
        found = writers.write_appended(bodies, f"{folder}/{name}/run", step)
        vectors = tuple(n for n in ("velocity", "acceleration") if COLUMNS[n] + "x" in have)
        scalars = tuple(n for n in ("id", "mass", "potential", "key") if COLUMNS.get(n, n) in have) + ("pe",)
    else:
        found = writers.write_snapshot(bodies, f"{folder}/{name}")
        vectors, scalars = writers.snapshot_arrays(have)
    _file(spark, folder, f"{name}.pvtp", writers.piece_index([f"{name}/{p}" for p in found], vectors, scalars))
    return f"{name}.pvtp"


def frames(spark: SparkSession, path: str) -> list[tuple[float, str]]:
    """Time and index of each frame of a collection, by time."""
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.explode(F.arrays_zip(F.expr("xpath(value, '//DataSet/@timestep')").alias("t"), F.expr("xpath(value, '//DataSet/@file')").alias("f"))).alias("d"))
    return sorted((r[0], r[1]) for r in each.select(F.col("d.t").cast("double"), "d.f").collect())  # a row for each frame


def extend_collection(spark: SparkSession, folder: str, time: float, index: str, name: str = "series.pvd") -> None:
    """Adds a frame to the folder's collection; one of the same time and index stands once."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    old = frames(spark, f"{folder}/{name}") if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there) else []
    _file(spark, folder, name, writers.timeline(sorted({*old, (float(time), index)})))


def _listed(spark: SparkSession, indexes: list[str]) -> DataFrame:
    """path, source, names of vectors, of integers and of all arrays of each index."""
    arrays = "//PPointData/PDataArray"
    names = {"source": "//Piece/@Source", "vectors": f'{arrays}[@NumberOfComponents="3"]/@Name', "whole": f'{arrays}[contains(@type,"Int")]/@Name', "names": f"{arrays}/@Name"}
    return spark.read.text(indexes, wholetext=True).select(F.col("_metadata.file_name").alias("index"), *(F.expr(f"xpath(value, '{x}')").alias(n) for n, x in names.items()))


def read_series(spark: SparkSession, path: str, first: float = float("-inf"), last: float = float("inf")) -> DataFrame:
    """timestep, x, y, z and the arrays that the first index declares (a vector as three
    columns; null where a piece lacks one) of the frames with times in [first, last].
    Only those frames' pieces are read, a piece by one task."""
    folder = pieces.qualified(spark, path).rsplit("/", 1)[0]
    wanted = [(t, f) for t, f in frames(spark, path) if first <= t <= last]
    if not wanted:
        return spark.createDataFrame([], "timestep double, x double, y double, z double")
    base = {f.rsplit("/", 1)[-1]: f"{folder}/{f}".rsplit("/", 1)[0] for _, f in wanted}
    found = {r["index"]: r for r in _listed(spark, sorted({f"{folder}/{f}" for _, f in wanted})).collect()}  # a row for each frame
    places = [(t, f"{base[n]}/{s}") for t, f in wanted for n in (f.rsplit("/", 1)[-1],) for s in found[n]["source"]]
    declared = found[wanted[0][1].rsplit("/", 1)[-1]]
    vectors, whole = set(declared["vectors"]), set(declared["whole"])
    return _decoded(spark, places, [n for n in declared["names"] if n not in vectors], sorted(vectors), whole)


def read_legacy(spark: SparkSession, path: str, scalars: tuple[str, ...], vectors: tuple[str, ...] = ("v",), whole: tuple[str, ...] = ("id",)) -> DataFrame:
    """x, y, z and the named arrays of a folder of legacy ASCII files; whole: those of integers."""
    listed = spark.read.format("binaryFile").load(path).select("path").collect()  # a row for each piece
    return _decoded(spark, [(0.0, r[0]) for r in listed], list(scalars), list(vectors), set(whole)).drop("timestep")


def _decoded(spark: SparkSession, places: list[tuple[float, str]], scalars: list[str], vectors: list[str], whole: set[str]) -> DataFrame:
    column = lambda n: COLUMNS.get(n, n)
    fields = [("timestep", pa.float64()), *((c, pa.float64()) for c in "xyz"), *((column(n), pa.int64() if n in whole else pa.float64()) for n in scalars), *((column(v) + c, pa.float64()) for v in vectors for c in "xyz")]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for time, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = legacy_arrays(raw.decode()) if raw.startswith(b"# vtk") else binary.read_vtu_points(raw)
                points = a["position"] if "position" in a else a["Points"]
                cols = {"timestep": np.full(len(points), time), **{c: points[:, k] for k, c in enumerate("xyz")}}
                cols |= {column(n): a[n] for n in scalars if n in a} | {column(v) + c: a[v][:, k] for v in vectors if v in a for k, c in enumerate("xyz")}
                for at in range(0, len(points), 1 << 16):
                    part = {n: np.ascontiguousarray(v[at : at + (1 << 16)]) for n, v in cols.items()}
                    n = len(part["x"])
                    yield pa.RecordBatch.from_arrays([pa.array(part[f.name].astype(f.type.to_pandas_dtype())) if f.name in part else pa.nulls(n, f.type) for f in schema], schema=schema)

    times = spark.createDataFrame(places, "timestep double, path string")
    files = spark.read.format("binaryFile").load(sorted({p for _, p in places})).select("path", "content") if places else spark.createDataFrame([], "path string, content binary")
    ddl = ", ".join(f"`{f.name}` {'long' if f.type == pa.int64() else 'double'}" for f in schema)
    return files.join(times, "path").select("timestep", "content").mapInArrow(run, ddl)


def legacy_arrays(text: str) -> dict[str, np.ndarray]:
    """The points (as position), scalars and vectors of a legacy ASCII file."""
    out, lines, n, at = {}, text.split("\n"), 0, 0
    while at < len(lines):
        word = lines[at].split()
        at += 1
        if not word:
            continue
        if word[0] == "POINTS":
            n = int(word[1])
            out["position"] = _numbers(lines[at : at + n], "double").reshape(n, 3)
            at += n
        elif word[0] == "VERTICES":
            at += int(word[1])
        elif word[0] == "SCALARS":
            at += lines[at].startswith("LOOKUP_TABLE")
            out[word[1]] = _numbers(lines[at : at + n], word[2])
            at += n
        elif word[0] == "VECTORS":
            out[word[1]] = _numbers(lines[at : at + n], word[2]).reshape(n, 3)
            at += n
    return out


def _numbers(lines: list[str], kind: str) -> np.ndarray:
    return np.array(" ".join(lines).split(), np.int64 if kind in ("long", "int") else np.float64)
