"""Space-filling keys as column expressions.

A key has 63 bits, 21 for each axis, x lowest.  A cell is (depth, prefix) where
prefix is the key's top `digit` * depth bits, right-aligned: the parent's prefix
is a shift away and prefixes are never negative.  With digit 3 cells are
octants; with digit 1 they halve space along z, y and x in turn.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 21
KEY_BITS = 3 * BITS
#: Masks that leave two zero bits between the bits of a 21-bit number (fixed values).
_MASKS = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def quantise(x: Column, low: Column, span: Column) -> Column:
    """The coordinate as a number of 21 bits; what lies outside is clamped."""
    return F.least(F.greatest(F.floor((x - low) / span * float(1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")


def spread(v: Column) -> Column:
    """Bit i of v at place 3 i."""
    for shift, mask in _MASKS:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def compact(v: Column) -> Column:
    """Bit 3 i of v at place i; the inverse of spread."""
    v = v.bitwiseAND(F.lit(_MASKS[-1][1]))
    for (shift, _), mask in zip(reversed(_MASKS), (*[m for _, m in reversed(_MASKS[:-1])], (1 << BITS) - 1), strict=True):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask))
    return v


def interleave(ix: Column, iy: Column, iz: Column) -> Column:
    return spread(ix).bitwiseOR(F.shiftleft(spread(iy), 1)).bitwiseOR(F.shiftleft(spread(iz), 2))


def key_of(x: Column, y: Column, z: Column, domain) -> Column:
    """The key of a position in the domain (one span for all axes)."""
    return interleave(*(quantise(c, F.lit(lo), F.lit(domain.span)) for c, lo in zip((x, y, z), domain.low, strict=True)))


def anisotropic_key(x: Column, y: Column, z: Column, low, spans) -> Column:
    """The key with each axis scaled by its own extent."""
    return interleave(*(quantise(c, F.lit(lo), F.lit(s)) for c, lo, s in zip((x, y, z), low, spans, strict=True)))


def decode(key: Column) -> tuple[Column, Column, Column]:
    return compact(key), compact(F.shiftright(key, 1)), compact(F.shiftright(key, 2))


def prefix_at(key: Column, depth: Column | int, digit: int = 3) -> Column:
    """The key's prefix at a depth."""
    d = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", key, (F.lit(KEY_BITS) - d * digit).cast("int"))


def parent(prefix: Column, digit: int = 3) -> Column:
    return F.shiftright(prefix, digit)


def octant(prefix: Column, digit: int = 3) -> Column:
    """Which child of its parent a cell is."""
    return prefix.bitwiseAND(F.lit((1 << digit) - 1))


def key_range(depth: Column, prefix: Column, digit: int = 3) -> tuple[Column, Column]:
    """The first and last key of a cell."""
    shift = (F.lit(KEY_BITS) - depth * digit).cast("int")
    low = F.call_function("shiftleft", prefix, shift)
    return low, low.bitwiseOR(F.call_function("shiftright", F.lit((1 << KEY_BITS) - 1), (depth * digit).cast("int")))


def is_ancestor(depth_a: Column, prefix_a: Column, depth_b: Column, prefix_b: Column, digit: int = 3) -> Column:
    """Whether cell a holds cell b (or is it)."""
    up = ((depth_b - depth_a) * digit).cast("int")
    return (depth_a <= depth_b) & (F.call_function("shiftright", prefix_b, F.greatest(up, F.lit(0))) == prefix_a)


def neighbour(prefix: Column, depth: Column, dx: int, dy: int, dz: int) -> Column:
    """The prefix of the cell that many steps away, null beyond the domain."""
    size = F.call_function("shiftleft", F.lit(1).cast("long"), depth.cast("int"))
    moved = [c + d for c, d in zip(decode(prefix), (dx, dy, dz), strict=True)]
    inside = None
    for m in moved:
        ok = (m >= 0) & (m < size)
        inside = ok if inside is None else inside & ok
    return F.when(inside, interleave(*moved))


def at_boundary(prefix: Column, depth: Column) -> Column:
    """Whether a cell touches the domain's surface."""
    top = F.call_function("shiftleft", F.lit(1).cast("long"), depth.cast("int")) - 1
    out = None
    for c in decode(prefix):
        edge = (c == 0) | (c == top)
        out = edge if out is None else out | edge
    return out


def steps_apart2(prefix_a: Column, prefix_b: Column) -> Column:
    """The squared distance of two cells of one depth, in cells."""
    return sum(((a - b) * (a - b) for a, b in zip(decode(prefix_a), decode(prefix_b), strict=True)), F.lit(0).cast("long"))


def top_bit(x: Column) -> Column:
    """The place of the highest bit that is set, of 64; -1 for 0."""
    return F.when(x == 0, -1).otherwise(F.length(F.bin(x)) - 1)


def top_bit_value(x: Column) -> Column:
    """The number of which only that bit is set; 0 for 0."""
    return F.when(x == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), top_bit(x)))


def log2_ceiling(n: Column) -> Column:
    """The least k with 2 ** k >= n; 0 up to 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def first_at_or_after(keys_: Column, key: Column) -> Column:
    """The place (from 0) in a sorted array of keys of the first that is not below
    a key; the array's size if there is none."""
    return F.size(F.filter(keys_, lambda k: k < key))
