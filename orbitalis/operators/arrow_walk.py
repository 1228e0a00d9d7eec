"""The walk as one pass over key-sorted bodies with the tree broadcast.

The tree's cells and the leaf-sorted bodies come to the driver as flat arrays
and are broadcast, behind a check of their number; larger ones take the
relational walk.  Within a batch the walk is vectorised over targets: each cell
is visited once with all targets that have opened its parent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitalis.functions import keys
from orbitalis.operators import cells as tree
from orbitalis.operators.domain import Domain, cubic_domain, keyed

MOST_CELLS = 2_000_000
_PAIRS = 500_000
SCHEMA = "id long, ax double, ay double, az double, phi double, n_approx long, n_direct long"


class FlatTree:
    """Cells by (depth, prefix) and bodies by key, as arrays."""

    def __init__(self, cells, bodies, domain: Domain, config):
        self.config, self.domain = config, domain
        self.depth, self.prefix = cells["depth"].to_numpy(np.int64), cells["prefix"].to_numpy(np.int64)
        self.mass, self.leaf = cells["mass"].to_numpy(), cells["is_leaf"].to_numpy(bool)
        self.centre = cells[["cx", "cy", "cz"]].to_numpy()
        self.side2 = (domain.span / 2.0**self.depth) ** 2
        order = np.lexsort((bodies["id"], bodies["key"]))
        self.id, self.key = bodies["id"].to_numpy()[order], bodies["key"].to_numpy()[order]
        self.m, self.pos = bodies["mass"].to_numpy()[order], bodies[["x", "y", "z"]].to_numpy()[order]
        shift = keys.KEY_BITS - config.digit * self.depth
        self.lo = np.searchsorted(self.key, self.prefix << shift)
        self.hi = np.searchsorted(self.key, ((self.prefix + 1) << shift) - 1, "right") if len(self.key) else self.lo
        place = {(d, p): i for i, (d, p) in enumerate(zip(self.depth.tolist(), self.prefix.tolist(), strict=True))}
        self.children: list[list[int]] = [[] for _ in self.depth]
        for (d, p), i in place.items():
            if d:
                self.children[place[d - 1, p >> config.digit]].append(i)
        self.root = place.get((0, 0))

    def walk(self, ids: np.ndarray, pos: np.ndarray, key: np.ndarray):
        c, eps2, n = self.config, self.config.softening**2, len(ids)
        acc, phi = np.zeros((n, 3)), np.zeros(n)
        approx, direct = np.zeros(n, np.int64), np.zeros(n, np.int64)
        theta2, guard = c.theta**2, c.guard and 3 * c.theta**2 > 1
        stack = [] if self.root is None else [(self.root, np.arange(n))]
        while stack:
            cell, t = stack.pop()
            d = self.centre[cell] - pos[t]
            r2 = (d * d).sum(1)
            ok = self.side2[cell] < theta2 * (r2 + (eps2 if c.soft_mac else 0.0))
            if guard:
                ok &= (key[t] >> (keys.KEY_BITS - c.digit * self.depth[cell])) != self.prefix[cell]
            if c.exact_leaves and self.leaf[cell]:
                ok[:] = False
            if ok.any():
                u, q = t[ok], r2[ok] + eps2
                acc[u] += d[ok] * (self.mass[cell] * q**-1.5)[:, None]
                phi[u] -= self.mass[cell] / np.sqrt(q)
                approx[u] += 1
            u = t[~ok]
            if not len(u):
                continue
            if not self.leaf[cell]:
                stack += [(k, u) for k in self.children[cell]]
                continue
            s = slice(self.lo[cell], self.hi[cell])
            rows = max(1, _PAIRS // max(1, s.stop - s.start))
            for at in range(0, len(u), rows):  # all pairs of some targets with the leaf's bodies
                v = u[at : at + rows]
                d = self.pos[s][None] - pos[v][:, None]
                q = (d * d).sum(2) + eps2
                other = ids[v][:, None] != self.id[s][None]
                with np.errstate(divide="ignore"):
                    f = np.where(other & (q > 0), q**-0.5, 0.0)
                direct[v] += other.sum(1)
                acc[v] += np.einsum("ijk,ij->ik", d, self.m[s] * f**3)
                phi[v] -= f @ self.m[s]
        return acc * c.gravity, phi * c.gravity, approx, direct


def fits(bodies: DataFrame) -> bool:
    """Whether the bodies, and so their cells, may be broadcast."""
    return bodies.count() <= MOST_CELLS


def accelerations(bodies: DataFrame, config, domain: Domain | None = None) -> DataFrame:
    """id, ax, ay, az, phi and interaction counts of each body (mac "body" only)."""
    if config.mac != "body":
        raise ValueError("this walk has bodies as targets")
    if not fits(bodies):
        raise ValueError("too many bodies to broadcast their tree; use the relational walk")
    domain = domain or cubic_domain(bodies, config.pad)
    placed = keyed(bodies, domain)
    cells = tree.tree(placed, config.leaf_size, config.depth, config.digit, origin=tuple(lo + domain.span / 2 for lo in domain.low)).toPandas()
    flat = FlatTree(cells, placed.select("id", "mass", "x", "y", "z", "key").toPandas(), domain, config)
    shared = bodies.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            pos = np.stack([b.column(c).to_numpy() for c in "xyz"], 1)
            acc, phi, approx, direct = shared.value.walk(ids, pos, b.column("key").to_numpy())
            yield pa.RecordBatch.from_pydict({"id": ids, **{"a" + n: acc[:, i].copy() for i, n in enumerate("xyz")}, "phi": phi, "n_approx": approx, "n_direct": direct})

    ordered = placed.select("id", "x", "y", "z", "key").repartitionByRange("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, SCHEMA)
