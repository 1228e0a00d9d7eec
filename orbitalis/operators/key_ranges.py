"""Bodies in key order with their leaf, by one exchange of the bodies.

A body's leaf follows from the keys next to its own: a cell has more than
`capacity` bodies just if the first and the last of so many and one in a row lie in
it.  So bodies are dealt to ranges of keys, each of which is read once in order;
what a range needs of the others are the `capacity` keys before and after it, which
are found without moving bodies.  No tree is made, and nothing is broadcast but
these keys and the ranges' bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitalis.functions import keys
from orbitalis.operators.domain import Domain, keyed

PER_RANGE = 1_000_000  # bodies of a range, at most about: they are sorted in a task's memory
_LEAST = 10_000  # or fewer only if there aren't as many for each core
_STEPS = 8 ** np.arange(keys.BITS, dtype=np.int64)


def common_depth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The depth of the smallest cell that holds both keys."""
    return keys.BITS - np.searchsorted(_STEPS, a ^ b, "right")


def leaf_depths(key: np.ndarray, capacity: int, before: int, after: int) -> np.ndarray:
    """Depths of the leaves of sorted keys but those so many at the ends, which are
    there for their neighbours' sake only."""
    if len(key) <= capacity:
        return np.zeros(len(key) - before - after, np.int64)
    ends = np.full(capacity, -1)
    split = np.concatenate((ends, common_depth(key[:-capacity], key[capacity:]), ends))  # of the runs that hold key i: i to i + capacity
    width, done = capacity + 1, 1
    while 2 * done <= width:
        split, done = np.maximum(split[:-done], split[done:]), 2 * done
    most = np.maximum(split[: len(key)], split[width - done : width - done + len(key)])
    return np.minimum(most + 1, keys.BITS)[before : len(key) - after]


def _bounds(placed: DataFrame, n: int) -> np.ndarray:
    """The last keys of all ranges but the last."""
    cores = placed.sparkSession.sparkContext.defaultParallelism
    ranges = max(min(cores, -(-n // _LEAST)), -(-n // PER_RANGE))
    if ranges < 2:
        return np.zeros(0, np.int64)
    shares = [i / ranges for i in range(1, ranges)]
    return np.array(sorted(placed.agg(F.percentile_approx("key", shares, 10_000)).first()[0]), np.int64)


def _range_of(bounds: np.ndarray, key: np.ndarray, id: np.ndarray) -> np.ndarray:
    """Bodies at one key that is the bound of several ranges are dealt to all of these."""
    first, last = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
    return (first + id % (np.maximum(last - first, 1))).astype(np.int32)


def _edges(placed: DataFrame, bounds: np.ndarray, capacity: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The least and the largest `capacity` keys of each range."""

    def ends(r: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((key, r))
        r, key = r[order], key[order]
        start = np.searchsorted(r, r, "left")
        stop, at = np.searchsorted(r, r, "right"), np.arange(len(r))
        low, high = at - start < capacity, stop - at <= capacity
        return r[low | high], key[low | high]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, key = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for b in batches:
            k = b.column("key").to_numpy()
            more = b.column("_r").to_numpy() if "_r" in b.schema.names else _range_of(bounds, k, b.column("id").to_numpy())
            r, key = ends(np.concatenate((r, more)), np.concatenate((key, k)))
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(key)], names=["_r", "key"])

    kind, ranges = "_r int, key long", len(bounds) + 1
    some = placed.select("key", "id").mapInArrow(run, kind)  # of each task
    found = some.repartitionById(ranges, "_r").mapInArrow(run, kind).collect()  # some keys for each range
    r, key = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)
    each = [np.sort(key[r == i]) for i in range(ranges)]
    return [(k[:capacity], k[-capacity:]) for k in each]


def with_leaf_depth(bodies: DataFrame, domain: Domain, n: int, capacity: int) -> DataFrame:
    """n bodies with their key: in key order (ranges of keys in partitions, each in
    order of key and id), with the depth of their leaf.  It is that of cells.tree."""
    if capacity < 1:
        raise ValueError("a leaf has room for a body at least")
    placed = keyed(bodies, domain)
    bounds = _bounds(placed, n)
    edges, ranges, none = _edges(placed, bounds, capacity), len(bounds) + 1, np.zeros(0, np.int64)
    before, after = [none], [none]
    for low, high in edges[:-1]:
        before.append(np.concatenate((before[-1], high))[-capacity:])
    for low, _ in edges[:0:-1]:
        after.append(np.concatenate((low, after[-1]))[:capacity])
    around = placed.sparkSession.sparkContext.broadcast((before, after[::-1]))

    @F.pandas_udf("int")
    def range_of(key, id):
        import pandas as pd

        return pd.Series(_range_of(bounds, key.to_numpy(), id.to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting, last = None, [], none

        def done(rows: pa.Table, past: np.ndarray, next_: np.ndarray) -> Iterator[pa.RecordBatch]:
            key = np.concatenate((past, rows.column("key").to_numpy(), next_))
            depth = leaf_depths(key, capacity, len(past), len(next_))
            yield from rows.append_column("leaf_depth", pa.array(depth.astype(np.int32))).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            if known is None:
                known = b.column("_r")[0].as_py()
                last = around.value[0][known]
            waiting.append(b)
            rows = pa.Table.from_batches(waiting)
            if (full := rows.num_rows - capacity) > 0:  # those whose neighbours are all here
                key = rows.column("key").to_numpy()
                yield from done(rows.slice(0, full), last, key[full:])
                last, waiting = np.concatenate((last, key[:full]))[-capacity:], rows.slice(full).to_batches()
        if waiting:
            yield from done(pa.Table.from_batches(waiting), last, around.value[1][known])

    dealt = placed.withColumn("_r", range_of("key", "id")).drop("key").repartitionById(ranges, "_r")
    ordered = keyed(dealt, domain).sortWithinPartitions("key", "id")  # the key is made again rather than moved
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema) + ", leaf_depth int"
    return ordered.mapInArrow(run, schema).drop("_r")
