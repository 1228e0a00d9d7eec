"""The bounding box and the cubic domain of a body table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitalis.functions import keys
from orbitalis.functions.geometry import cols


@dataclass(frozen=True)
class Domain:
    low: tuple[float, float, float]
    span: float


def bounding_box(bodies: DataFrame) -> DataFrame:
    """One row: lx, ly, lz, hx, hy, hz."""
    return bodies.agg(*(f(c).alias(n + c) for f, n in ((F.min, "l"), (F.max, "h")) for c in "xyz"))


def cubic_domain(bodies: DataFrame, pad: float = 0.0) -> Domain:
    """The cube from the box's low corner with its longest extent; 1 where that is
    0 or there are no bodies.  Six numbers come to the driver."""
    r = bounding_box(bodies).first()
    if r is None or r["lx"] is None:
        return Domain((0.0, 0.0, 0.0), 1.0)
    span = max(r["h" + c] - r["l" + c] for c in "xyz")
    if not span > 0:
        return Domain((r["lx"], r["ly"], r["lz"]), 1.0)
    grow = span * pad
    return Domain(tuple(r["l" + c] - grow / 2 for c in "xyz"), span + grow)


def keyed(bodies: DataFrame, domain: Domain) -> DataFrame:
    return bodies.withColumn("key", keys.key_of(*cols(), domain))


def sort_by_key(bodies: DataFrame, partitions: int | None = None) -> DataFrame:
    """Bodies in (key, id) order: ranges of keys in partitions, each sorted."""
    ranged = bodies.repartitionByRange(partitions, "key", "id") if partitions else bodies.repartitionByRange("key", "id")
    return ranged.sortWithinPartitions("key", "id")
