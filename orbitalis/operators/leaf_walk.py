"""The partitioned walk with leaves as targets and second moments (mac "leaf_box").

As in `partitioned_walk`, ranges of keys sum their own cells and send each other what
may be needed.  All bodies of a leaf have one list of interactions, which is
judged by the leaf's middle and size alone.  So what a range asks for depends on
its leaves: for each depth the box of their middles.  These boxes, and the
ranges' shares of the second moments of cells that they share, are all that is
collected and known everywhere, some sixty small rows a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbitalis.operators import partitioned_walk as pw
from orbitalis.operators.domain import Domain, cubic_domain
from orbitalis.operators.local_tree import _FRONT, _TILE, GROUP, Forces, Nodes, Rules, build, gaps2, linked, norm2, spans, sums

_PAIRS = ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))  # of cells.SECOND
_SECOND = ["xx", "yy", "zz", "xy", "xz", "yz"]
_ROW = pw._ROW + "".join(f", {c} double" for c in _SECOND)
_LEAVES = 512  # targets that are walked at a time, at most
_ROOT3 = 3**0.5
_SLACK = 1e-12


def _rows(part, depth, n, key, mass, pos, flag, second=None) -> pa.RecordBatch:
    b = pw._rows(part, depth, n, key, mass, pos, flag)
    second = np.zeros((b.num_rows, 6)) if second is None else second
    return pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(second[:, k], float)) for k in range(6))], names=[*pw._NAMES, *_SECOND])


def _middles(rules: Rules, depth: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The middles of cells and half their sides."""
    side = rules.span / 2.0**depth
    at = np.zeros((len(depth), 3))
    for i in range(rules.depth):
        for k in range(3):
            at[:, k] += ((prefix >> (3 * i + k)) & 1) * float(1 << i)
    return np.array(rules.low) + (at + 0.5) * side[:, None], side / 2


def _second(mass: np.ndarray, pos: np.ndarray, centre: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Second moments of runs of bodies that don't overlap, about some centres."""
    s, each = spans(lo, hi - lo), np.repeat(np.arange(len(lo)), hi - lo)
    d, m = pos[s] - centre[each], mass[s]
    ends = np.cumsum(hi - lo)
    return np.stack([sums(m * d[:, a] * d[:, b], ends - (hi - lo), ends) for a, b in _PAIRS], 1)


def _moments(mass: np.ndarray, pos: np.ndarray, nodes: Nodes) -> np.ndarray:
    out = np.zeros((len(nodes.depth), 6))
    for d in np.unique(nodes.depth):  # cells of one depth don't overlap
        i = np.flatnonzero(nodes.depth == d)
        out[i] = _second(mass, pos, nodes.centre[i], nodes.lo[i], nodes.hi[i])
    return out


def _built(known: pw.Known, a: dict[str, np.ndarray]) -> tuple[Nodes, np.ndarray]:
    with np.errstate(invalid="ignore", divide="ignore"):  # cells without mass have no centre and don't act
        return build(known.rules, a["key"], a["mass"], a["pos"], known.shared)


def _leaf_depth(nodes: Nodes) -> np.ndarray:
    """The depth of each body's leaf."""
    leaf = np.flatnonzero(nodes.leaf)
    leaf = leaf[np.argsort(nodes.lo[leaf], kind="stable")]
    return np.repeat(nodes.depth[leaf], (nodes.hi - nodes.lo)[leaf])


def _asked(known: pw.Known, a: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A range's boxes of leaves' middles by depth (two rows; n is -1) and its shares of shared second moments."""
    rules, part = known.rules, a["part"][0]
    nodes, shared = _built(known, a)
    leaf = np.flatnonzero(nodes.leaf)
    middle, _ = _middles(rules, nodes.depth[leaf], nodes.prefix[leaf])
    for d in np.unique(nodes.depth[leaf]):
        m = middle[nodes.depth[leaf] == d]
        yield _rows(part, [d, d], -1, [0, 0], 0.0, np.stack((m.min(0), m.max(0))), 0)
    i = np.flatnonzero(shared)
    if len(i):
        yield _rows(part, nodes.depth[i], 0, nodes.prefix[i], 0.0, nodes.centre[i], 0, _moments(a["mass"], a["pos"], nodes)[i])


class Asked:
    """What all ranges know besides pw.Known: part, depth, low and high of boxes, and
    second moments in the order of the shared cells."""

    def __init__(self, known: pw.Known, rows: list):
        box = sorted((r["part"], r["depth"], r["x"], r["y"], r["z"]) for r in rows if r["id"] == -1)
        at = np.array([b[2:] for b in box]).reshape(-1, 2, 3)
        self.part, self.depth = np.array([b[0] for b in box[::2]]), np.array([b[1] for b in box[::2]])
        self.low, self.high = at.min(1), at.max(1)
        of = {(int(d), int(p)): i for i, (d, p) in enumerate(zip(known.shared["depth"], known.shared["prefix"], strict=True))}
        self.second = np.zeros((len(of), 6))
        for r in rows:
            if r["id"] != -1:
                self.second[of[r["depth"], r["key"]]] += [r[c] for c in _SECOND]


def _wanted(rules: Rules, nodes: Nodes, low: np.ndarray, high: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(box, node, accepted by all leaves of that size in the box)."""
    box = np.arange(len(low) if len(nodes.depth) else 0)
    node, found = np.zeros(len(box), np.int64), []
    while len(box):
        acts = nodes.mass[node] > 0
        box, node = box[acts], node[acts]
        near, _ = gaps2(nodes.centre[node], low[box], high[box])
        every = np.sqrt(nodes.side2[node]) < rules.theta * (np.sqrt(near) * (1 - _SLACK) - _ROOT3 * half[box]) * (1 - _SLACK)
        every &= ~(nodes.leaf[node] & rules.exact_leaves)
        found.append((box, node, every))
        opened = ~every & ~nodes.leaf[node]
        box, node = box[opened], node[opened]
        count = nodes.upto[node] - nodes.below[node]
        box, node = np.repeat(box, count), spans(nodes.below[node], count)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _sent(known: pw.Known, asked: Asked, a: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What a range sends to all: rows of _ROW; its own bodies come with the depth of their leaf."""
    rules, part = known.rules, a["part"][0]
    nodes, shared = _built(known, a)
    second = _moments(a["mass"], a["pos"], nodes)
    yield _rows(part, -1, a["id"], a["key"], a["mass"], a["pos"], pw._OWN + 8 * _leaf_depth(nodes))
    for to in np.unique(asked.part):
        b = np.flatnonzero(asked.part == to)
        _, node, far = _wanted(rules, nodes, asked.low[b], asked.high[b], rules.span / 2.0 ** asked.depth[b] / 2)
        order = np.lexsort((far, node))  # a cell that one box opens isn't far for the range
        node, far = node[order], far[order]
        first = np.concatenate(([True], node[1:] != node[:-1])) if len(node) else np.zeros(0, bool)
        node, far = node[first], far[first]
        i, f = node[~shared[node]], far[~shared[node]]  # all know the shared ones
        yield _rows(to, nodes.depth[i], nodes.n[i], nodes.prefix[i], nodes.mass[i], nodes.centre[i], nodes.leaf[i] * pw._LEAF + f * pw._FAR, second[i])
        if to != part:
            near = node[~far & nodes.leaf[node]]
            s = spans(nodes.lo[near], (nodes.hi - nodes.lo)[near])
            yield _rows(to, -1, a["id"][s], a["key"][s], a["mass"][s], a["pos"][s], 0)


class LeafForces(Forces):
    """Forces on whole leaves' bodies; depth: of the leaf of each target."""

    def __init__(self, rules: Rules, nodes: Nodes, second: np.ndarray, key, mass, pos, own: np.ndarray, depth: np.ndarray):
        super().__init__(rules, nodes, key, mass, pos, own)
        self.second, self.depth = second, depth

    def walk(self, groups: int = _LEAVES) -> LeafForces:
        prefix = self.key >> self.rules.shift(self.depth)
        fresh = np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (self.depth[1:] != self.depth[:-1]))) if len(prefix) else np.zeros(0, bool)
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(prefix))[: len(begin)]
        middle, half = _middles(self.rules, self.depth[begin], prefix[begin])
        groups = max(1, min(groups, _FRONT // max(1, len(self.nodes.depth))))
        for a in range(0, len(begin) if len(self.nodes.depth) else 0, groups):
            b = slice(a, a + groups)
            self._targets(begin[b], end[b], middle[b], half[b])
        return self

    def _targets(self, begin, end, middle, half) -> None:
        nodes, rules = self.nodes, self.rules
        group, node = np.arange(len(begin)), np.zeros(len(begin), np.int64)
        far, near = [], []
        while len(group):
            acts = nodes.mass[node] > 0
            group, node = group[acts], node[acts]
            r2 = norm2(nodes.centre[node] - middle[group])
            ok = np.sqrt(nodes.side2[node]) < rules.theta * (np.sqrt(r2) - _ROOT3 * half[group])
            ok &= ~(nodes.leaf[node] & rules.exact_leaves)
            ok |= nodes.far[node]
            leaf = nodes.leaf[node]
            far.append((group[ok], node[ok]))
            near.append((group[~ok & leaf], node[~ok & leaf]))
            opened = ~ok & ~leaf
            group, node = group[opened], node[opened]
            count = nodes.upto[node] - nodes.below[node]
            group, node = np.repeat(group, count), spans(nodes.below[node], count)
        for pairs, act in ((far, self._cells), (near, self._leaves)):
            g, i = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.argsort(g, kind="stable")
            i, cuts = i[order], np.searchsorted(g[order], np.arange(len(begin) + 1))
            for j in range(len(begin)):
                if cuts[j] < cuts[j + 1]:
                    for t in range(begin[j], end[j], GROUP):
                        act(slice(t, min(t + GROUP, end[j])), i[cuts[j] : cuts[j + 1]])

    def _cells(self, t: slice, i: np.ndarray) -> None:
        super()._cells(t, i)
        for a in range(0, len(i), _TILE):
            part = i[a : a + _TILE]
            xx, yy, zz, xy, xz, yz = self.second[part].T
            dx, dy, dz = d = [c[part] - at[t, None] for c, at in zip(self.centre, self.at, strict=True)]
            r2 = dx * dx + dy * dy + dz * dz + self.eps2
            if self.eps2 == 0:
                r2[r2 == 0] = np.inf
            q = (2 * xx - yy - zz) * dx + 3 * (xy * dy + xz * dz), 3 * (xy * dx + yz * dz) + (2 * yy - xx - zz) * dy, 3 * (xz * dx + yz * dy) + (2 * zz - xx - yy) * dz
            r5 = r2**-2.5
            along = 2.5 * (q[0] * dx + q[1] * dy + q[2] * dz) * r5 / r2
            for k in range(3):
                self.acc[k, t] += (along * d[k] - r5 * q[k]).sum(1)


def accelerations(bodies: DataFrame, config, domain: Domain | None = None, per_part: int = pw.PER_PART) -> DataFrame:
    """id, ax, ay, az, phi and interaction counts of each body (mac "leaf_box" with second moments)."""
    if config.mac != "leaf_box" or not config.quadrupole or config.digit != 3:
        raise ValueError("this walk has leaves of eightfold cells as targets and second moments")
    spark = bodies.sparkSession
    rules = Rules.of(config, domain or (domain := cubic_domain(bodies, config.pad)))
    parts = max(spark.sparkContext.defaultParallelism, -(-bodies.count() // per_part))
    fixed = pw.dealt(bodies, domain, rules, parts)
    rows = fixed.where("depth <> -1").collect()  # some for each range
    if not rows:
        return spark.createDataFrame([], pw.SCHEMA)
    with np.errstate(invalid="ignore", divide="ignore"):
        known = spark.sparkContext.broadcast(pw.Known(rules, rows))
    mine = fixed.where("depth = -1")
    asked = pw._each_part(mine, parts, lambda a: _asked(known.value, a), _ROW).collect()  # some for each range
    asked = spark.sparkContext.broadcast(Asked(known.value, asked))

    def walk(a: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        nodes, b = pw.whole_tree(known.value, a)
        cell, shared = a["depth"] >= 0, known.value.shared
        second = np.concatenate((np.stack([a[c][cell] for c in _SECOND], 1), asked.value.second))
        order = np.lexsort((np.concatenate((a["key"][cell], shared["prefix"])), np.concatenate((a["depth"][cell], shared["depth"]))))  # that of the nodes
        own = np.flatnonzero(b["flag"] & pw._OWN)
        yield pw._result(b["id"][own], LeafForces(rules, nodes, second[order], b["key"], b["mass"], b["pos"], own, b["flag"][own].astype(np.int64) >> 3).walk())

    return pw._each_part(pw._each_part(mine, parts, lambda a: _sent(known.value, asked.value, a), _ROW), parts, walk, pw.SCHEMA)
