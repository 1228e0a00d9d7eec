"""The hierarchy of cells as one grouped sum over nested key prefixes.

Bodies are first summed by key, so that coincident bodies cost one row.  Each
key is then counted into its prefix at every depth; map-side aggregation leaves
few rows for the upper levels.  A cell stays if it is the root or its parent
holds more than `capacity` bodies; it is a leaf if it doesn't, or lies at the
greatest depth.  Levels are counted some at a time, and only for the bodies of
cells that are still crowded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitalis.functions import keys
from orbitalis.operators.scratch import cut

SECOND = ("xx", "yy", "zz", "xy", "xz", "yz")


def all_cells(bodies: DataFrame, depth: int = keys.BITS, digit: int = 3, second: bool = False, boxes: bool = False, origin=(0.0, 0.0, 0.0), first: int = 0, domain=None, by: tuple[str, ...] = ()) -> DataFrame:
    """Every non-empty cell from depth `first` down to a depth: depth, prefix, n, mass and centre of
    mass; with second, central second moments; with boxes, those of the bodies.

    First moments are summed about the domain's middle, or else about `origin`.  Cells
    without mass have no centre (null).  by: columns whose values have cells of their own.
    """
    if domain is not None:
        origin = tuple(lo + domain.span / 2 for lo in domain.low)
    m = F.col("mass")
    x, y, z = (F.col(c) - o for c, o in zip("xyz", origin, strict=True))
    sums = {"n": F.count("*"), "mass": F.sum(m), "mx": F.sum(m * x), "my": F.sum(m * y), "mz": F.sum(m * z)}
    if boxes:
        sums |= {p + c: f(c) for p, f in (("l", F.min), ("h", F.max)) for c in "xyz"}
    by_key = bodies.groupBy(*by, "key").agg(*(v.alias(k) for k, v in sums.items()))
    level = F.explode(F.sequence(F.lit(first), F.lit(depth))).alias("depth")
    nested = by_key.select("*", level).withColumn("prefix", keys.prefix_at(F.col("key"), F.col("depth"), digit))
    again = {k: (F.min if k[0] == "l" else F.max if k[0] == "h" else F.sum)(k).alias(k) for k in sums}
    cells = nested.groupBy(*by, "depth", "prefix").agg(*again.values())
    out = cells.withColumns({"c" + c: F.try_divide("m" + c, "mass") + o for c, o in zip("xyz", origin, strict=True)}).drop("mx", "my", "mz")
    if not second:
        return out
    if by:
        raise ValueError("second moments are those of one tree")
    low = bodies.select("mass", "x", "y", "z", F.lit(depth).alias("leaf_depth"), keys.prefix_at(F.col("key"), depth, digit).alias("leaf_prefix"))
    return second_moments(out.withColumn("is_leaf", F.col("depth") == depth), low, digit, first).drop("is_leaf")


#: Cells up to which second moments go from the leaves to all levels above at once.
AT_ONCE = 200_000


def second_moments(cells: DataFrame, placed: DataFrame, digit: int = 3, first: int = 0, step: int | None = None) -> DataFrame:
    """cells with their central second moments: those of leaves about the leaf's own
    centre of mass, summed over its bodies (placed: mass, x, y, z, leaf_depth,
    leaf_prefix), then rolled up towards depth `first`.

    What a cell adds to one above it is its own moment and its mass times the
    product of the distances between the centres (the parallel-axis rule), so
    nothing is subtracted and small cells far from everything keep their digits.
    `step` levels are made at a time, from the last that were made and the leaves
    in between; by default all of a small tree, else as many as 64 children have.
    """
    cells = cut(cells)
    step = step or (keys.KEY_BITS if cells.count() <= AT_ONCE else 6 // digit)
    centres = cells.select("depth", "prefix", *("c" + c for c in "xyz"))

    def about(sources: DataFrame, at: DataFrame, names: str) -> DataFrame:
        """Moments about the centres in `at` of sources (depth, prefix, mass, names)."""
        d = {c: F.col(names + c) - F.col("c" + c) for c in "xyz"}
        met = sources.join(at, ["depth", "prefix"])
        own = {k: (F.col("o" + k) if "o" + k in sources.columns else F.lit(0.0)) for k in SECOND}
        return met.groupBy("depth", "prefix").agg(*(F.sum(own[k] + F.col("mass") * d[k[0]] * d[k[1]]).alias(k) for k in SECOND))

    bodies = placed.select(F.col("leaf_depth").alias("depth"), F.col("leaf_prefix").alias("prefix"), "mass", *(F.col(c).alias("b" + c) for c in "xyz"))
    leaves = cut(about(bodies, cells.where("is_leaf").select(*centres.columns), "b"))
    known = cells.select("depth", "prefix", "mass", *(F.col("c" + c).alias("b" + c) for c in "xyz"))

    def sources(moments: DataFrame) -> DataFrame:
        return moments.select("depth", "prefix", *(F.col(k).alias("o" + k) for k in SECOND)).join(known, ["depth", "prefix"])

    done, last = leaves, leaves.agg(F.max("depth")).first()[0]
    made = None  # the inner cells at depth `last`
    while last is not None and last > first:
        low = max(first, last - step)
        below = sources(leaves.where(F.col("depth") > low) if made is None else leaves.where((F.col("depth") > low) & (F.col("depth") <= last)).unionByName(made))
        above = below.withColumn("_d", F.explode(F.sequence(F.lit(low), F.least(F.col("depth"), F.lit(last)) - 1)))
        above = above.withColumn("prefix", F.call_function("shiftright", "prefix", ((F.col("depth") - F.col("_d")) * digit).cast("int"))).withColumn("depth", F.col("_d")).drop("_d")
        fresh = cut(about(above, centres.where((F.col("depth") >= low) & (F.col("depth") < last)), "b"))
        done = done.unionByName(fresh)
        made, last = fresh.where(F.col("depth") == low), low
    return cells.join(done, ["depth", "prefix"])


def tree(bodies: DataFrame, capacity: int, depth: int = keys.BITS, digit: int = 3, **more) -> DataFrame:
    """The cells that a tree with leaves of at most `capacity` bodies has."""
    return tree_by_levels(bodies, capacity, depth, digit, 8 * 3 // digit, **more)


def tree_at_once(bodies: DataFrame, capacity: int, depth: int = keys.BITS, digit: int = 3, second: bool = False, **more) -> DataFrame:
    """The same in one query, which counts each key into all depths."""
    cells = _kept(all_cells(bodies, depth, digit, **more), capacity, depth, digit)
    return second_moments(cells := cut(cells), with_leaf(bodies, cells, depth, digit), digit) if second else cells


def _kept(cells: DataFrame, capacity: int, depth: int, digit: int, by: tuple[str, ...] = ()) -> DataFrame:
    crowded = cells.where(F.col("n") > capacity).select(*by, (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_up"))
    kept = cells.withColumn("_up", keys.parent(F.col("prefix"), digit)).join(crowded, [*by, "depth", "_up"], "left_semi").select(*cells.columns, "_up")
    kept = kept.unionByName(cells.where("depth = 0").withColumn("_up", F.lit(0).cast("long")))
    return kept.drop("_up").withColumn("is_leaf", (F.col("n") <= capacity) | (F.col("depth") == depth))


def tree_by_levels(bodies: DataFrame, capacity: int, depth: int = keys.BITS, digit: int = 3, step: int = 7, second: bool = False, by: tuple[str, ...] = (), **more) -> DataFrame:
    """The tree's cells, `step` levels at a time.

    Only bodies of cells that are still crowded go on to the next levels, so a
    huge table isn't counted into levels far below its leaves, where nearly each
    body is a row of its own.  Costs a semi-join of the bodies for each step.
    """
    active, parts, first = bodies, [], 0
    while True:
        last = min(first + step, depth)
        parts.append(cut(all_cells(active, last, digit, first=first + 1 if parts else 0, by=by, **more)))
        crowded = parts[-1].where((F.col("depth") == last) & (F.col("n") > capacity)).select(*by, F.col("prefix").alias("_up"))
        if last == depth or crowded.isEmpty():
            break
        active = active.withColumn("_up", keys.prefix_at(F.col("key"), last, digit)).join(crowded, [*by, "_up"], "left_semi").drop("_up")
        first = last
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    cells = _kept(every, capacity, depth, digit, by)
    return second_moments(cells := cut(cells), with_leaf(bodies, cells, depth, digit), digit) if second else cells


_PLACE = ("_part", "_own", "_kind", "_at")
_LEAF = ("_high", "_depth", "_prefix", "_tree")


def _last_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in key order, the bodies with the last leaf before each (-1: none),
    and at the end one row with the last leaf of all."""
    part, last, empty = None, dict.fromkeys(_LEAF, -1), None
    for b in batches:
        if not b.num_rows:
            continue
        part, leaf = b.column("_part")[0].as_py(), b.column("_kind").to_numpy() == 0
        at = np.maximum.accumulate(np.where(leaf, np.arange(len(leaf)), -1))
        cols = {}
        for c in _LEAF:
            own = b.column(c).fill_null(-1).to_numpy()
            cols[c] = np.where(at >= 0, own[at], last[c])
            last[c] = int(cols[c][-1])
        keep = pa.array(~leaf)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _PLACE), *(pa.array(cols[c]) for c in _LEAF), b.column("_body")], names=[*_PLACE, *_LEAF, "_body"]).filter(keep)
        empty = pa.nulls(1, b.column("_body").type)
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int64()), pa.array([0], pa.int32()), pa.array([0], pa.int64()), *(pa.array([last[c]]) for c in _LEAF), empty], names=[*_PLACE, *_LEAF, "_body"])


def with_leaf(bodies: DataFrame, cells: DataFrame, depth: int = keys.BITS, digit: int = 3, by: str | None = None) -> DataFrame:
    """Bodies with the depth and prefix of their leaf; bodies outside all leaves are left out.

    Leaves are ranges of keys that don't overlap, so a body's leaf is the last one
    that begins at its key or before.  Bodies and leaves are sorted by key into
    common ranges, each of which is read once in order and written; what a range
    needs from those before it is one leaf, which goes out in a broadcast table
    with a row for each range.  by: a column of whole numbers in bodies and cells,
    each of whose values has a tree of its own.
    """
    low, high = keys.key_range(F.col("depth"), F.col("prefix"), digit)
    names = [c for c in bodies.columns if c not in ("leaf_depth", "leaf_prefix")]
    body = F.struct(*names)
    tree_of = F.col(by).cast("long") if by else F.lit(0).cast("long")
    own = zip((high, F.col("depth"), F.col("prefix"), tree_of), _LEAF, strict=True)
    leaves = cells.where("is_leaf").select(tree_of.alias("_own"), low.alias("_at"), F.lit(0).alias("_kind"), *(c.cast("long").alias(n) for c, n in own))
    placed = bodies.select(tree_of.alias("_own"), F.col("key").alias("_at"), F.lit(1).alias("_kind"), body.alias("_body"))
    both = leaves.unionByName(placed, allowMissingColumns=True).repartitionByRange("_own", "_at").sortWithinPartitions("_own", "_at", "_kind")
    kind = "_part int, _own long, _kind int, _at long, " + ", ".join(f"{c} long" for c in _LEAF) + ", _body " + placed.schema["_body"].dataType.simpleString()
    fixed = cut(both.withColumn("_part", F.spark_partition_id()).mapInArrow(_last_leaf, kind))
    before, found = [], (-1,) * len(_LEAF)
    for part, *last in sorted(fixed.where("_kind = 0").select("_part", *_LEAF).collect()):  # a row for each range
        before.append((part, *found))
        found = tuple(last) if last[0] >= 0 else found
    known = fixed.where("_kind = 1").join(F.broadcast(bodies.sparkSession.createDataFrame(before, "_part int, h long, d long, p long, t long")), "_part")
    first = F.col("_high") < 0
    met = known.select("_own", "_at", "_body", *(F.when(first, F.col(b)).otherwise(F.col(n)).alias(b) for b, n in zip("hdpt", _LEAF, strict=True))).where("_at <= h and _own = t")
    return met.select("_body.*", F.col("d").cast("int").alias("leaf_depth"), F.col("p").alias("leaf_prefix"))


def radius2(bodies: DataFrame, cells: DataFrame, depth: int, digit: int) -> DataFrame:
    """Cells with rsq: for leaves the largest squared distance of a body from the
    centre of mass, for others that of a corner of the bodies' box."""
    placed = with_leaf(bodies, cells, depth, digit).select(F.col("leaf_depth").alias("depth"), F.col("leaf_prefix").alias("prefix"), "x", "y", "z")
    centre = cells.where("is_leaf").select("depth", "prefix", "cx", "cy", "cz")
    far = sum((F.pow(F.col(c) - F.col("c" + c), 2) for c in "yz"), F.pow(F.col("x") - F.col("cx"), 2))
    leaf = placed.join(centre, ["depth", "prefix"]).groupBy("depth", "prefix").agg(F.max(far).alias("_far"))
    corner = sum((F.pow(F.greatest(F.col("h" + c) - F.col("c" + c), F.col("c" + c) - F.col("l" + c)), 2) for c in "yz"), F.pow(F.greatest(F.col("hx") - F.col("cx"), F.col("cx") - F.col("lx")), 2))
    return cells.join(leaf, ["depth", "prefix"], "left").withColumn("rsq", F.coalesce("_far", corner)).drop("_far")


def merge_records(*records: DataFrame, sticky: bool = False) -> DataFrame:
    """Cell records of several trees added up: masses sum, centres weigh in.  A cell
    is a leaf only if no tree has split it; sticky: if it is one in any tree."""
    every = records[0]
    for r in records[1:]:
        every = every.unionByName(r)
    m = F.col("mass")
    return every.groupBy("depth", "prefix").agg(
        F.sum("n").alias("n"), F.sum(m).alias("mass"), *((F.sum(m * F.col("c" + c)) / F.sum(m)).alias("c" + c) for c in "xyz"), (F.bool_or if sticky else F.bool_and)("is_leaf").alias("is_leaf")
    )


def from_leaves(leaves: DataFrame, digit: int = 3) -> DataFrame:
    """A whole tree from its leaves' records: every ancestor is the sum of what is
    below it.  Massless and non-finite records are left out."""
    m = F.col("mass")
    good = leaves.where((m > 0) & ~F.isnan("cx") & ~F.isnan("cy") & ~F.isnan("cz"))
    up = good.withColumn("_d", F.explode(F.sequence(F.lit(0), F.col("depth"))))
    up = up.withColumn("_p", F.call_function("shiftright", F.col("prefix"), ((F.col("depth") - F.col("_d")) * digit).cast("int")))
    return up.groupBy(F.col("_d").alias("depth"), F.col("_p").alias("prefix")).agg(
        F.sum("n").alias("n"), F.sum(m).alias("mass"), *((F.sum(m * F.col("c" + c)) / F.sum(m)).alias("c" + c) for c in "xyz"), F.bool_or(F.col("_d") == F.col("depth")).alias("is_leaf")
    )


def find(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """The cells at the (depth, prefix) rows of wanted; rows without a cell keep null columns."""
    return wanted.select("depth", "prefix").join(cells, ["depth", "prefix"], "left")
