"""Boxes, distances and interaction kernels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orbitalis.functions import keys

AXES = ("x", "y", "z")


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def difference(a, b) -> tuple[Column, ...]:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def norm2(a) -> Column:
    return dot(a, a)


def cols(prefix: str = "", names=AXES) -> tuple[Column, ...]:
    return tuple(F.col(prefix + n) for n in names)


def cell_side(depth: Column, span: float) -> Column:
    """The edge of a cell at a depth."""
    return F.lit(span) / F.call_function("shiftleft", F.lit(1).cast("long"), depth.cast("int"))


def cell_centre(depth: Column, prefix: Column, domain) -> tuple[Column, ...]:
    side = cell_side(depth, domain.span)
    return tuple(F.lit(lo) + (i + 0.5) * side for lo, i in zip(domain.low, keys.decode(prefix), strict=True))


def box_gap2(low_a, high_a, low_b, high_b) -> Column:
    """The squared distance of two boxes, 0 where they touch."""
    gaps = [F.greatest(F.lit(0.0), lb - ha, la - hb) for la, ha, lb, hb in zip(low_a, high_a, low_b, high_b, strict=True)]
    return norm2(gaps)


def point_gap2(p, low, high) -> Column:
    """The squared distance of a point from a box."""
    return box_gap2(p, p, low, high)


def box_volume(low, high) -> Column:
    x, y, z = difference(high, low)
    return x * y * z


def box_contains(p, low, high) -> Column:
    inside = F.lit(True)
    for c, lo, hi in zip(p, low, high, strict=True):
        inside = inside & (c >= lo) & (c <= hi)
    return inside


def box_union(low_a, high_a, low_b, high_b) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    """The smallest box around both."""
    return tuple(F.least(a, b) for a, b in zip(low_a, low_b, strict=True)), tuple(F.greatest(a, b) for a, b in zip(high_a, high_b, strict=True))


def box_grown(p, low, high) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    """The smallest box around a box and a point."""
    return box_union(p, p, low, high)


def box_shifted(low, high, by) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    return tuple(c + d for c, d in zip(low, by, strict=True)), tuple(c + d for c, d in zip(high, by, strict=True))


def box_centre(low, high) -> tuple[Column, ...]:
    return tuple((a + b) / 2 for a, b in zip(low, high, strict=True))


def box_empty(low, high) -> Column:
    """Whether a box holds no point: null or turned around on some axis."""
    empty = F.lit(False)
    for a, b in zip(low, high, strict=True):
        empty = empty | a.isNull() | b.isNull() | (a > b)
    return empty


def monopole(mass: Column, d, r2: Column) -> tuple[Column, ...]:
    """Acceleration by a mass at difference d; r2 is the softened squared distance."""
    f = mass * F.pow(r2, -1.5)
    return tuple(c * f for c in d)


def quadrupole(d, r2: Column, q) -> tuple[Column, ...]:
    """Correction by second moments q (xx, yy, zz, xy, xz, yz) about the centre of mass."""
    xx, yy, zz, xy, xz, yz = q
    trace = xx + yy + zz
    qx = (3 * xx - trace) * d[0] + 3 * xy * d[1] + 3 * xz * d[2]
    qy = 3 * xy * d[0] + (3 * yy - trace) * d[1] + 3 * yz * d[2]
    qz = 3 * xz * d[0] + 3 * yz * d[1] + (3 * zz - trace) * d[2]
    dqd = qx * d[0] + qy * d[1] + qz * d[2]
    r5, r7 = F.pow(r2, -2.5), F.pow(r2, -3.5)
    return tuple(2.5 * dqd * r7 * c - r5 * k for c, k in zip(d, (qx, qy, qz), strict=True))


def potential(mass: Column, r2: Column) -> Column:
    """The potential of a mass; none at distance 0."""
    return F.when(r2 > 0, -mass / F.sqrt(r2)).otherwise(0.0)
