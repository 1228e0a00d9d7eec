"""Writers: state tables, energy logs, VTK snapshots and their indexes, reports.

Distributed outputs are one piece for each partition, with an index written by
the driver; pieces go through Spark's text writer, so any file system works.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE_COLUMNS = ("id", "mass", "x", "y", "z", "vx", "vy", "vz")
#: Headers of state files (fixed values).
STATE_HEADERS = ("id", "mass", "pos_x", "pos_y", "pos_z", "vel_x", "vel_y", "vel_z")


def write_state(bodies: DataFrame, path: str, merged: bool = False) -> None:
    """CSV with full precision; merged: in one file, in id order."""
    out = bodies.select(*(F.col(c).alias(h) for c, h in zip(STATE_COLUMNS, STATE_HEADERS, strict=True)))
    out = out.orderBy("id").coalesce(1) if merged else out
    out.write.mode("overwrite").csv(path, header=True)


def write_positions(bodies: DataFrame, path: str) -> None:
    bodies.select("id", "x", "y", "z").write.mode("overwrite").csv(path, header=True)


def append_energy(log: DataFrame, path: str) -> None:
    """step, time, kinetic, potential, total, rel_drift."""
    log.coalesce(1).write.mode("append").csv(path, header=True)


def _number(x: float) -> str:
    return repr(float(x))


def _texts(column: np.ndarray) -> str:
    return " ".join(map(repr, column.ravel().tolist()))


class _Piece:
    """The rows of one partition by column, for text and binary writers."""

    def __init__(self, batches: list[pa.RecordBatch], names: list[str]):
        self.n = sum(b.num_rows for b in batches)
        self._cols = {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]) if batches else np.zeros(0) for c in names}

    def __getitem__(self, name: str) -> np.ndarray:
        return self._cols[name]

    def vector(self, name: str) -> np.ndarray:
        return np.stack([self._cols[name + c].astype(np.float64) for c in "xyz"], 1)


def vtk_points(p: _Piece, vectors: tuple[str, ...] = ("v",), scalars: tuple[str, ...] = ("mass",)) -> Iterator[str]:
    """The lines of a legacy ASCII VTK file of points with vector and scalar data."""
    rows = lambda v: (" ".join(map(repr, r)) for r in v.tolist())
    yield from ("# vtk DataFile Version 3.0", "bodies", "ASCII", "DATASET POLYDATA", f"POINTS {p.n} double")
    yield from rows(p.vector(""))
    yield f"VERTICES {p.n} {2 * p.n}"
    yield from (f"1 {i}" for i in range(p.n))
    yield f"POINT_DATA {p.n}"
    for s in scalars:
        whole = p[s].dtype.kind in "iu"
        yield from (f"SCALARS {s} {'long' if whole else 'double'} 1", "LOOKUP_TABLE default")
        yield from map(repr, (p[s] if whole else p[s].astype(np.float64)).tolist())
    for v in vectors:
        yield f"VECTORS {v} double"
        yield from rows(p.vector(v))


def _array(name: str, values: str, parts: int = 1, kind: str = "Float64") -> str:
    return f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{parts}" format="ascii">{values}</DataArray>'


def _kind(x: np.ndarray) -> str:
    return "Int64" if x.dtype.kind in "iu" else "Float64"


def vtp_piece(p: _Piece, vectors: tuple[str, ...], scalars: tuple[str, ...]) -> Iterator[str]:
    """The lines of an XML PolyData piece in ASCII, an array in each."""
    yield '<?xml version="1.0"?>'
    yield f'<VTKFile type="PolyData" version="1.0" byte_order="LittleEndian"><PolyData><Piece NumberOfPoints="{p.n}" NumberOfVerts="{p.n}"><PointData>'
    yield from (_array(s, _texts(p[s]), 1, _kind(p[s])) for s in scalars)
    yield from (_array(v, _texts(p.vector(v)), 3) for v in vectors)
    yield "</PointData><Points>"
    yield _array("position", _texts(p.vector("")), 3)
    yield "</Points><Verts>"
    yield _array("connectivity", " ".join(map(str, range(p.n))), 1, "Int64")
    yield _array("offsets", " ".join(map(str, range(1, p.n + 1))), 1, "Int64")
    yield "</Verts></Piece></PolyData></VTKFile>"


#: The arrays of an appended piece: type, components (fixed values).
_APPENDED = {
    "Points": ("Float64", 3), "connectivity": ("Int32", 1), "offsets": ("Int32", 1), "mass": ("Float64", 1), "velocity": ("Float64", 3),
    "acceleration": ("Float64", 3), "potential": ("Float64", 1), "pe": ("Int32", 1), "key": ("UInt64", 1), "id": ("Int64", 1),
}


def vtp_appended(p: _Piece, part: int, have: list[str]) -> bytes:
    """An XML PolyData piece whose arrays are appended raw, each behind its length;
    the arrays that have columns, and the part that wrote it."""
    from orbitalis.sources.binary import _KINDS

    data = {"Points": p.vector(""), "connectivity": np.arange(p.n), "offsets": np.arange(1, p.n + 1), "pe": np.full(p.n, part)}
    data |= {name: p.vector(v) for name, v in (("velocity", "v"), ("acceleration", "a")) if v + "x" in have}
    data |= {name: p[c] for name, c in (("mass", "mass"), ("potential", "phi"), ("key", "key"), ("id", "id")) if c in have}
    tags, blob, at = {}, [], 0
    for name, (kind, n) in _APPENDED.items():
        if name in data:
            raw = data[name].astype("<" + _KINDS[kind]).tobytes()
            tags[name] = f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{n}" format="appended" offset="{at}"/>'
            blob += [len(raw).to_bytes(8, "little"), raw]
            at += 8 + len(raw)
    points = "".join(t for n, t in tags.items() if n not in ("Points", "connectivity", "offsets"))
    head = (
        '<?xml version="1.0"?>\n<VTKFile type="PolyData" version="1.0" byte_order="LittleEndian" header_type="UInt64"><PolyData>'
        f'<Piece NumberOfPoints="{p.n}" NumberOfVerts="{p.n}" NumberOfLines="0" NumberOfStrips="0" NumberOfPolys="0"><Points>{tags["Points"]}</Points>'
        f'<Verts>{tags["connectivity"]}{tags["offsets"]}</Verts><PointData>{points}</PointData></Piece></PolyData><AppendedData encoding="raw">_'
    )
    return head.encode() + b"".join(blob) + b"</AppendedData></VTKFile>\n"


def box_piece(p: _Piece, span: float, low: tuple[float, float, float], scalars: tuple[str, ...]) -> Iterator[str]:
    """The lines of an XML unstructured grid: cells (ix, iy, iz, depth) as hexahedra."""
    corners = np.array([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)])
    side = span / 2.0 ** p["depth"].astype(np.float64)
    at = np.stack([p["i" + c] for c in "xyz"], 1)
    points = np.array(low) + (at[:, None, :] + corners[None]) * side[:, None, None]
    ints = lambda name, v, kind="Int64": _array(name, " ".join(map(str, v)), 1, kind)
    yield '<?xml version="1.0"?>'
    yield f'<VTKFile type="UnstructuredGrid" version="1.0" byte_order="LittleEndian"><UnstructuredGrid><Piece NumberOfPoints="{8 * p.n}" NumberOfCells="{p.n}"><CellData>'
    yield from (_array(s, _texts(p[s]), 1, _kind(p[s])) for s in scalars)
    yield "</CellData><Points>"
    yield _array("position", _texts(points), 3)
    yield "</Points><Cells>"
    yield from (ints("connectivity", range(8 * p.n)), ints("offsets", range(8, 8 * p.n + 1, 8)), ints("types", [12] * p.n, "UInt8"))
    yield "</Cells></Piece></UnstructuredGrid></VTKFile>"


def _written(df: DataFrame, path: str, names: list[str], lines) -> None:
    """Text pieces below path, one for each partition: a partition's columns are held,
    its text is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        size = 0
        for line in lines(_Piece([b for b in batches if b.num_rows], names)):
            held.append(line)
            size += len(line)
            if size > 1 << 20:
                yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.string())})
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.string())})

    df.select(*names).mapInArrow(run, "value string").write.mode("overwrite").text(path)


#: Scalars that a snapshot has if the bodies do, and their whole-numbered ones (fixed values).
_SCALARS = ("id", "mass", "phi", "key", "speed", "a_size", "rank")
_WHOLE = ("id", "key", "rank", "pe")


def snapshot_arrays(columns: list[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Names of the vectors and scalars in a snapshot of bodies with these columns."""
    vectors = tuple(v for v in ("v", "a") if v + "x" in columns)
    sizes = {name for v, name in (("v", "speed"), ("a", "a_size")) if v in vectors}
    return vectors, tuple(s for s in _SCALARS if s in sizes or s == "rank" or s in columns)


def write_snapshot(bodies: DataFrame, path: str, kind: str = "vtp") -> list[str]:
    """One piece for each partition below path; the pieces' names.  kind: vtp (XML) or
    vtk (legacy).  Velocities come with their size (speed), accelerations likewise."""
    sizes = {name: F.sqrt(sum((F.pow(F.col(v + c), 2) for c in "yz"), F.pow(F.col(v + "x"), 2))) for v, name in (("v", "speed"), ("a", "a_size")) if v + "x" in bodies.columns}
    bodies = bodies.withColumns({**sizes, "rank": F.spark_partition_id()})
    vectors, scalars = snapshot_arrays(bodies.columns)
    cols = ["x", "y", "z", *(v + c for v in vectors for c in "xyz"), *scalars]
    make = vtp_piece if kind == "vtp" else vtk_points
    _written(bodies, path, cols, lambda p: make(p, vectors, scalars))
    return _names(bodies.sparkSession, path)


def _names(spark, path: str) -> list[str]:
    found = spark.read.format("binaryFile").load(path).select("path").collect()  # a row for each piece
    return sorted(r["path"].rsplit("/", 1)[-1] for r in found)


def write_appended(bodies: DataFrame, path: str, step: int = 0) -> list[str]:
    """Pieces with raw appended arrays, <path>_<step>_pe<part>.vtp; their names.  Each
    task writes its own."""
    from orbitalis.sources import pieces

    spark, names = bodies.sparkSession, [c for c in ("id", "mass", "x", "y", "z", "vx", "vy", "vz", "ax", "ay", "az", "phi", "key") if c in bodies.columns]
    folder, _, stem = path.rpartition("/")
    start = f"{stem}_{step:05d}_pe"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if held:
            yield from pieces.chunked(f"{start}{part}.vtp", iter([vtp_appended(_Piece(held, names), part, names)]))

    pieces.write_pieces(bodies.select(*names).mapInArrow(run, "name string, raw binary"), folder)
    return [n for n in _names(spark, folder) if n.startswith(start)]


def write_boxes(cells: DataFrame, path: str, domain, scalars: tuple[str, ...] = ("n",)) -> None:
    """Cells (depth, prefix), essential records or histogram buckets as boxes, one
    piece for each partition."""
    from orbitalis.functions import keys

    low, span = domain.low, domain.span
    corners = [c.alias("i" + n) for n, c in zip("xyz", keys.decode(F.col("prefix")), strict=True)]
    _written(cells.select("depth", *corners, *scalars), path, ["depth", "ix", "iy", "iz", *scalars], lambda p: box_piece(p, span, low, scalars))


def histogram_cells(histogram: DataFrame, bits: int) -> DataFrame:
    """Buckets of a key histogram (bits divisible by 3) as cells with n and part."""
    return histogram.select(F.lit(bits // 3).alias("depth"), F.col("bucket").alias("prefix"), F.col("cnt").alias("n"), *[c for c in histogram.columns if c == "part"])


def piece_index(pieces: list[str], vectors: tuple[str, ...] = ("v",), scalars: tuple[str, ...] = ("mass",)) -> str:
    """A parallel index over PolyData pieces."""
    data = "".join(f'<PDataArray type="{"Int64" if s in _WHOLE else "Float64"}" Name="{s}"/>' for s in scalars) + "".join(f'<PDataArray type="Float64" Name="{v}" NumberOfComponents="3"/>' for v in vectors)
    parts = "".join(f'<Piece Source="{p}"/>' for p in pieces)
    return (
        '<?xml version="1.0"?>\n<VTKFile type="PPolyData" version="1.0" byte_order="LittleEndian"><PPolyData GhostLevel="0">'
        f'<PPointData>{data}</PPointData><PPoints><PDataArray type="Float64" Name="position" NumberOfComponents="3"/></PPoints>{parts}</PPolyData></VTKFile>\n'
    )


def timeline(frames: list[tuple[float, str]]) -> str:
    """A collection of snapshots by time."""
    sets = "".join(f'<DataSet timestep="{_number(t)}" part="0" file="{f}"/>' for t, f in frames)
    return f'<?xml version="1.0"?>\n<VTKFile type="Collection" version="0.1" byte_order="LittleEndian"><Collection>{sets}</Collection></VTKFile>\n'


def graphviz(cells: DataFrame, digit: int = 3) -> DataFrame:
    """Lines of a dot graph of the tree, to be written as text."""
    node = F.concat(F.lit('  "'), "depth", F.lit(":"), "prefix", F.lit('" [label="n='), "n", F.lit('"];'))
    edge = F.concat(F.lit('  "'), F.col("depth") - 1, F.lit(":"), F.shiftright("prefix", digit), F.lit('" -> "'), "depth", F.lit(":"), "prefix", F.lit('";'))
    return cells.select(node.alias("value")).union(cells.where("depth > 0").select(edge.alias("value")))


def metrics_toml(metrics: dict) -> str:
    """Flat metrics and one level of tables as TOML."""
    one = lambda v: json.dumps(v) if isinstance(v, (str, bool)) else repr(v)
    flat = [f"{k} = {one(v)}" for k, v in metrics.items() if not isinstance(v, dict)]
    for name, table in metrics.items():
        if isinstance(table, dict):
            flat += ["", f"[{name}]", *(f"{k} = {one(v)}" for k, v in table.items())]
    return "\n".join(flat) + "\n"


def read_metrics(text: str) -> dict:
    """The metrics of a TOML report."""
    import tomllib

    return tomllib.loads(text)


def due(step: int, every: int, last: int, final: bool = True) -> bool:
    """Whether a snapshot is due: each `every` steps, and at the end."""
    return bool(every and step % every == 0) or (final and step == last)


def due_at(time: float, next_time: float, interval: float) -> tuple[bool, float]:
    """Whether one is due by simulated time, and when the next is."""
    return (True, next_time + interval) if interval > 0 and time >= next_time else (False, next_time)
