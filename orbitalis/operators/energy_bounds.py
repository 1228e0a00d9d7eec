"""Between what limits the energy of all pairs lies, without meeting all pairs.

Bodies are dealt to ranges of keys, and each range halves its bodies to a tree of boxes.
Of two boxes far apart the pairs' energy is that of their masses at their centres,
give or take what their second moments allow (below); boxes that are too close are
halved, and bodies of leaves that are too close are summed pair by pair.  So every
pair is in the sum, and the sum of all errors is a strict limit, not an estimate.
A question about the energy that these limits decide has the answer that the sum
over all pairs would give; for one that they don't there is that sum (`virial_between`).

Of two ranges one sends the other its boxes, down to those that are small from
anywhere in the other, and the bodies of leaves that aren't.  Where a range lies is known to
all by some boxes around its bodies, as a run of keys may lie in several places; these
few rows for each range are all that is broadcast or collected.

The limit: let x be the difference of two bodies' places less that of the centres,
R.  1 / |R + x| is a sum over l of |x|^l / R^(l+1) times Legendre polynomials, which are
at most 1.  The term of l = 1 has no mean, as centres are those of mass, so the mean
is 1 / R but for at most mean(x^2) / (R^2 (R - max|x|)).  Masses must not be negative.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitalis.operators import direct, motion
from orbitalis.operators.domain import cubic_domain, keyed
from orbitalis.operators.local_tree import gaps2, norm2
from orbitalis.operators.partitioned_walk import _gathered
from orbitalis.operators.scratch import cut

PER_PART = 100_000  # bodies of a range, about
_LEAST = 4_000  # or fewer only if there aren't as many for each core
_LEAF = 16  # bodies of a leaf, at most
_PLACES = 5  # how often a range is halved for the boxes that tell where it lies
_FRONT = 100_000  # pairs of boxes that are held at a time
_TILE = 32_768  # pairs of bodies that are made at a time: arrays that stay in a core's cache
_SLACK = 1e-9  # what rounding may change of a sum, and more
_ROW = "part int, kind int, mass double, x double, y double, z double, reach double, spread double"
_OWN, _BODY, _BOX, _LOW, _HIGH = range(5)  # kinds of rows: a range's own bodies, others' bodies and boxes; corners of where a range lies


def _rows(part, kind, mass, pos, reach=None, spread=None) -> pa.RecordBatch:
    none = np.zeros(len(mass))
    part, kind = (np.broadcast_to(np.asarray(v, np.int32), (len(mass),)).copy() for v in (part, kind))
    cols = (part, kind, mass, *(np.ascontiguousarray(pos[:, k]) for k in range(3)), none if reach is None else reach, none if spread is None else spread)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[c.split()[0] for c in _ROW.split(", ")])


def halved(pos: np.ndarray, depth: int) -> np.ndarray:
    """An order of bodies in which runs of equal length are halves of halves and so on, each cut
    across its longest side; their number must be divisible by 2 ** depth."""
    order = np.arange(len(pos))
    for d in range(depth):
        rows = order.reshape(1 << d, -1)
        at = pos[rows]
        side = (at.max(1) - at.min(1)).argmax(1)
        x = np.take_along_axis(at, side[:, None, None], 2)[:, :, 0]
        order = np.take_along_axis(rows, np.argpartition(x, rows.shape[1] // 2, axis=1), 1).ravel()
    return order


class Boxes:
    """Bodies (or boxes) halved along their longest side to leaves of one size.

    Node i has the halves 2 i + 1 and 2 i + 2; leaves come last, from `leaves` on.  m: mass, c: its centre,
    reach: how far from there anything may be, spread: the mean square of that."""

    def __init__(self, mass: np.ndarray, pos: np.ndarray, reach: np.ndarray | None = None, spread: np.ndarray | None = None):
        n, depth = len(mass), 0
        while n > _LEAF << depth:
            depth += 1
        self.size = -(-n >> depth) if n else 1
        more = (self.size << depth) - n
        self.leaves = (1 << depth) - 1
        filled = lambda v: np.zeros(n + more) if v is None else np.concatenate((v, np.zeros(more)))
        pos = np.concatenate((pos, pos[:more])) if n else np.zeros((more, 3))  # copies without mass fill the leaves
        order = halved(pos, depth)
        self.mass, self.pos, self.own_reach, self.own_spread = filled(mass)[order], pos[order], filled(reach)[order], filled(spread)[order]
        levels = [self._level(1 << d) for d in range(depth + 1)]
        self.m, self.c, self.reach, self.spread = (np.concatenate(x) for x in zip(*levels, strict=True))

    def _level(self, nodes: int) -> tuple[np.ndarray, ...]:
        m, p = self.mass.reshape(nodes, -1), self.pos.reshape(nodes, -1, 3)
        low, high, total = p.min(1), p.max(1), m.sum(1)
        middle, some = (low + high) / 2, np.where(total > 0, total, 1.0)
        c = middle + np.einsum("ij,ijk->ik", m, p - middle[:, None]) / some[:, None]
        c[same] = low[same := (low == high).all(1)]
        r2 = norm2(p - c[:, None])
        reach = np.where(m > 0, np.sqrt(r2) + self.own_reach.reshape(nodes, -1), 0.0).max(1)
        return total, c, reach, (m * (r2 + self.own_spread.reshape(nodes, -1))).sum(1) / some


def wanted(t: Boxes, low: np.ndarray, high: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that hold all bodies, and whether they are small from anywhere in some boxes."""
    node, found = np.zeros(1, np.int64), []
    while len(node):
        near, _ = gaps2(t.c[node, None], low, high)
        small = t.reach[node] <= theta * (1 - _SLACK) * np.sqrt(near.min(1))
        done = small | (node >= t.leaves)
        found.append((node[done], small[done]))
        node = node[~done]
        node = np.concatenate((2 * node + 1, 2 * node + 2))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Energy:
    """The sum of mass times mass by distance, and by how much it may be off."""

    def __init__(self, theta: float, tiny: float):
        self.theta, self.tiny = theta, tiny  # tiny: how far rounding may move a centre
        self.sum = self.off = 0.0

    def add(self, a: Boxes, b: Boxes) -> None:
        """All pairs of a body of a and one of b; all pairs in a, if they are the same."""
        waiting = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while waiting:
            i, j = waiting.pop()
            if len(i) > _FRONT:
                waiting += [(i[k : k + _FRONT], j[k : k + _FRONT]) for k in range(0, len(i), _FRONT)]
                continue
            r, reach = np.sqrt(norm2(a.c[i] - b.c[j])), a.reach[i] + b.reach[j]
            far = (r > 0) & (reach <= self.theta * r)
            self._far(a, b, i[far], j[far], r[far], reach[far])
            left = ~far & ~((r == 0) & (reach == 0))  # else all are at one place
            i, j = i[left], j[left]
            ends = (i >= a.leaves) & (j >= b.leaves)
            self._near(a, b, i[ends] - a.leaves, j[ends] - b.leaves)
            i, j = i[~ends], j[~ends]
            if not len(i):
                continue
            twin = (i == j) if a is b else np.zeros(len(i), bool)
            first = ~twin & (i < a.leaves) & ((j >= b.leaves) | (a.reach[i] >= b.reach[j]))
            second = ~twin & ~first
            (p, q), (u, v), t = (i[first], j[first]), (i[second], j[second]), i[twin]
            halves = ((2 * p + 1, q), (2 * p + 2, q), (u, 2 * v + 1), (u, 2 * v + 2), (2 * t + 1, 2 * t + 1), (2 * t + 2, 2 * t + 2), (2 * t + 1, 2 * t + 2))
            waiting.append(tuple(np.concatenate(x) for x in zip(*halves, strict=True)))

    def _far(self, a: Boxes, b: Boxes, i, j, r, reach) -> None:
        e = a.m[i] * b.m[j] / r
        self.sum += float(e.sum())
        self.off += float((e * ((a.spread[i] + b.spread[j]) / (r - reach) + self.tiny) / r).sum())

    def _near(self, a: Boxes, b: Boxes, i, j) -> None:
        """Pairs of leaves, body by body."""
        step = max(1, _TILE // (a.size * b.size))
        at, to = (np.ascontiguousarray(np.moveaxis(t.pos.reshape(-1, t.size, 3), 2, 0)) for t in (a, b))
        m, n, reach, spread = (v.reshape(-1, s) for v, s in ((a.mass, a.size), (b.mass, b.size), (b.own_reach, b.size), (b.own_spread, b.size)))
        boxes = b.own_reach.any()
        d, r = (np.empty((step, a.size, b.size)) for _ in range(2))
        for k in range(0, len(i), step):
            p, q = i[k : k + step], j[k : k + step]
            d, r = d[: len(p)], r[: len(p)]
            r[...] = 0.0
            for x, y in zip(at, to, strict=True):
                np.subtract(x[p][:, :, None], y[q][:, None], out=d)
                d *= d
                r += d
            r[r == 0] = np.inf  # pairs at distance 0 don't act
            np.sqrt(r, out=r)
            np.divide(m[p][:, :, None], r, out=d)
            d *= n[q][:, None]
            if a is b:
                d[p == q] *= 0.5  # within a leaf each pair is met twice
            self.sum += float(d.sum())
            if boxes:
                self.off += float((d * (spread[q][:, None] / (r - reach[q][:, None]) + self.tiny) / r).sum())


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _ROW: a range's bodies, and the corners of the boxes in which they lie."""
    from pyspark import TaskContext

    if (a := _gathered(batches)) is None:
        return
    part, pos = TaskContext.get().partitionId(), a["pos"]
    yield _rows(part, _OWN, a["mass"], pos)
    depth = min(_PLACES, len(pos).bit_length() - 1)
    more = -len(pos) % (1 << depth)
    pos = np.concatenate((pos, pos[:more]))
    each = pos[halved(pos, depth)].reshape(1 << depth, -1, 3)
    number = np.arange(len(each), dtype=float)
    yield _rows(part, _LOW, number, each.min(1))
    yield _rows(part, _HIGH, number, each.max(1))


def _close(low: np.ndarray, high: np.ndarray, to_low: np.ndarray, to_high: np.ndarray) -> float:
    """About which share of the bodies in some boxes is close to others, as if bodies lay evenly."""
    side, margin = (high - low)[:, None], _margin(low, high)[:, None, None]
    both = np.minimum(high[:, None], to_high + margin) - np.maximum(low[:, None], to_low - margin)
    share = np.where(side > 0, np.clip(both, 0.0, side) / np.where(side > 0, side, 1.0), both >= 0)
    return float(np.minimum(share.prod(2).sum(1), 1.0).mean())


def _margin(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.sqrt(norm2(high - low)) / 6


def first_sends(places: list[tuple]) -> dict[tuple[int, int], bool]:
    """Of pairs of ranges that come close, whether the first is to send: that one of which less is close
    to the other, else scattered ranges would get most bodies.  It is settled once, for both."""
    low, high = np.array([p[1].min(0) for p in places]), np.array([p[2].max(0) for p in places])
    margin = np.array([_margin(p[1], p[2]).max() for p in places])[:, None]
    out = {}
    for a in range(len(places)):
        more = np.maximum(margin[a], margin)
        for b in np.flatnonzero((np.minimum(high[a], high) + more >= np.maximum(low[a], low)).all(1)).tolist():
            if a < b and (one := _close(*places[a][1:], *places[b][1:])) != (other := _close(*places[b][1:], *places[a][1:])):
                out[a, b] = one < other
    return out


def receivers(n: int, at: int, first: dict[tuple[int, int], bool]) -> list[int]:
    """To which of n ranges one sends what it has; others take turns."""
    pair = lambda to: (min(at, to), max(at, to))
    return [to for to in range(n) if to != at and first.get(pair(to), (at + to) % 2 == 0) == (at < to)]


def _sent(a: dict[str, np.ndarray], places: list[tuple], first: dict[tuple[int, int], bool], theta: float) -> Iterator[pa.RecordBatch]:
    """Rows of _ROW, with the range that gets them: a range's own bodies, and what it sends to others."""
    at = next(i for i, p in enumerate(places) if p[0] == a["part"][0])
    yield _rows(places[at][0], _OWN, a["mass"], a["pos"])
    t = Boxes(a["mass"], a["pos"])
    for k in receivers(len(places), at, first):
        to, low, high = places[k]
        node, small = wanted(t, low, high, theta)
        i = node[small]
        yield _rows(to, _BOX, t.m[i], t.c[i], t.reach[i], t.spread[i])
        s = ((node[~small] - t.leaves)[:, None] * t.size + np.arange(t.size)).ravel()
        s = s[t.mass[s] > 0]
        yield _rows(to, _BODY, t.mass[s], t.pos[s])


def _summed(a: dict[str, np.ndarray], theta: float, tiny: float) -> Iterator[pa.RecordBatch]:
    """The energy of a range's bodies with each other and with all that it was sent."""
    each = [Boxes(*(a[c][a["kind"] == k] for c in ("mass", "pos", "reach", "spread"))) for k in (_OWN, _BODY, _BOX)]
    e = Energy(theta, tiny)
    for other in each:
        e.add(each[0], other)
    yield pa.RecordBatch.from_pydict({"e": [e.sum], "off": [e.off]})


def _each_part(rows: DataFrame, parts: int, f, schema: str) -> DataFrame:
    """f of each range's rows, as arrays; a range is a task, if there are as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a := _gathered(batches)) is not None:
            for part in np.unique(a["part"]):
                yield from f({c: v[a["part"] == part] for c, v in a.items()})

    return rows.repartitionById(parts, "part").mapInArrow(run, schema)


def potential_bounds(bodies: DataFrame, gravity: float = 1.0, theta: float = 0.5, per_part: int = PER_PART) -> DataFrame:
    """One row: least and most, between which the energy of all pairs lies (that of
    direct.potential_energy without softening, if ids don't repeat).  Boxes are halved until
    their reach is theta of their distance; a smaller theta gives closer limits."""
    if not 0 < theta < 1:
        raise ValueError("theta lies between 0 and 1")
    spark, axes = bodies.sparkSession, ("x", "y", "z")
    known = bodies.dropna(subset=["id", "mass", *axes]).select(F.col("mass").cast("double").alias("mass"), *(F.col(c).cast("double").alias(c) for c in axes)).where("mass <> 0")
    known = cut(known.groupBy(*axes).agg(F.sum("mass").alias("mass"), F.min("mass").alias("least")))  # what lies at one place is one body
    n, least, size = known.agg(F.count("*"), F.min("least"), F.greatest(*(F.max(F.abs(c)) for c in axes))).first()
    if n == 0:
        return spark.range(1).select(F.lit(0.0).alias("least"), F.lit(0.0).alias("most"))
    if least < 0:
        raise ValueError("there are no limits for negative masses")
    parts = max(min(4 * spark.sparkContext.defaultParallelism - 1, -(-n // _LEAST)), -(-n // per_part)) | 1
    ranged = keyed(known, cubic_domain(known)).repartitionByRange(parts, "key", *axes).select("mass", *axes)
    dealt = cut(ranged.mapInArrow(_dealt, _ROW))
    corners = {k: sorted((r["part"], r["mass"], r["x"], r["y"], r["z"]) for r in dealt.where(F.col("kind") == k).collect()) for k in (_LOW, _HIGH)}
    of, low, high = np.array([r[0] for r in corners[_LOW]]), *(np.array([r[2:] for r in corners[k]]) for k in (_LOW, _HIGH))
    places = [(int(p), low[of == p], high[of == p]) for p in np.unique(of)]
    parts = places[-1][0] + 1  # those that there are, whatever was asked for
    shared, tiny = spark.sparkContext.broadcast((places, first_sends(places))), 1e-14 * size
    sent = _each_part(dealt.where(F.col("kind") == _OWN), parts, lambda a: _sent(a, *shared.value, theta), _ROW)
    each = _each_part(sent, parts, lambda a: _summed(a, theta, tiny), "e double, off double")
    total = each.agg(F.sum("e").alias("e"), F.sum("off").alias("off"))
    e, off = F.col("e"), F.col("off") + F.col("e") * _SLACK
    return total.select((-gravity * (e + off)).alias("least"), (-gravity * F.greatest(e - off, F.lit(0.0))).alias("most"))


def virial_between(bodies: DataFrame, low: float, high: float, gravity: float = 1.0, thetas: tuple[float, ...] = (0.5, 0.25), per_part: int = PER_PART) -> bool:
    """Whether twice the kinetic energy is between low and high times the size of the
    potential one: by limits of the latter, closer ones if need be, and if these
    don't decide it, by the sum over all pairs.  The driver sees a few numbers."""
    twice = 2 * motion.kinetic(bodies).first()[0]
    for theta in thetas:
        least, most = potential_bounds(bodies, gravity, theta, per_part).first()
        if low * -least <= twice <= high * -most:
            return True
        if twice < low * -most or twice > high * -least:
            return False
    size = -direct.potential_energy(bodies, gravity=gravity).first()[0]
    return low * size <= twice <= high * size
