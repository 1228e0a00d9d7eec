"""Exact sums over all pairs.

Bodies are dealt by a hash of their id to a fixed number of blocks and packed to
arrays.  A task holds the targets of one block and reads the sources of all
blocks, some thousand at a time, so no table is broadcast, no row is made for a
pair, and what is shuffled is each source once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitalis.functions import geometry as g
from orbitalis.operators.scratch import cut

_BROADCAST_ROWS = 200_000
_BLOCK = 100_000  # targets of a block, at most about
_CHUNK = 4_096  # bodies of a packed row
_TILE = 16, 4_096  # targets and sources whose pairs are made at a time: arrays that stay in a core's cache
_PACKED = "_a int, part long, role int, of int, data binary"
_FORCES = ("ax", "ay", "az", "phi")


def pairs(targets: DataFrame, sources: DataFrame, condition: Column, block_rows: int = 20_000, part: bool = False) -> DataFrame:
    """Targets (columns t_*) with all sources (s_*) for which the condition holds, as
    rows; part: only those whose t_part is s_dest.  The small side is broadcast behind a
    check of its size; beyond it, both are dealt into blocks and joined block by block."""
    n = sources.count()
    if part:
        condition = condition & (F.col("t_part") == F.col("s_dest"))
    if n <= _BROADCAST_ROWS:
        return targets.join(F.broadcast(sources), condition)
    if part:  # each part in tiles of its own number
        tiles = sources.groupBy(F.col("s_dest").alias("t_part")).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_n"))
        t = targets.join(tiles, "t_part").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
        s = sources.join(tiles.withColumnRenamed("t_part", "s_dest"), "s_dest").withColumn("_b", F.pmod(F.xxhash64("s_id"), F.col("_n")).cast("int")).drop("_n")
        return t.join(s, (t["_b"] == s["_b"]) & condition).drop("_b")
    blocks, rows = -(-n // block_rows), -(-targets.count() // block_rows)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    s = sources.withColumn("_b", F.pmod(F.xxhash64("s_id"), F.lit(blocks)).cast("int")).withColumn("_a", every(rows))
    t = targets.withColumn("_a", F.pmod(F.xxhash64("t_id"), F.lit(rows)).cast("int")).withColumn("_b", every(blocks))
    return t.join(s, (t["_a"] == s["_a"]) & (t["_b"] == s["_b"]) & condition).drop("_a", "_b")


def _blocks(bodies: DataFrame) -> int:
    """Enough blocks to keep all cores busy to the end (a round of tasks isn't opened for one more); an odd number."""
    return max(4 * bodies.sparkSession.sparkContext.defaultParallelism - 1, -(-bodies.count() // _BLOCK) | 1)


def _packed(bodies: DataFrame, blocks: int, role: int, part: Column | None = None, origin: str = "id") -> DataFrame:
    """Rows of _PACKED (of: the block) with up to _CHUNK bodies' id, mass, x, y, z as arrays.
    Bodies without a place (or sources without a mass) don't take part."""
    cols = ("mass", "x", "y", "z")
    known = bodies.select(F.col(origin).cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in cols), (F.lit(0) if part is None else part).cast("long").alias("part"))
    known = known.dropna(subset=["id", "part"]).where(F.expr(" and ".join(f"{c} is not null" for c in cols[1:]))).withColumn("mass", F.coalesce("mass", F.lit(0.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, block = b.column("part").to_numpy(), b.column("_a").to_numpy()
            data = np.stack([b.column("id").to_numpy().view(np.float64), *(b.column(c).to_numpy() for c in cols)])
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            rows = [(lo, min(lo + _CHUNK, e)) for s, e in zip(cuts[:-1], cuts[1:], strict=True) for lo in range(s, e, _CHUNK)]
            of = pa.array([int(block[lo]) for lo, _ in rows], pa.int32())
            parts, chunks = pa.array([int(part[lo]) for lo, _ in rows], pa.int64()), pa.array([data[:, lo:hi].tobytes() for lo, hi in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([of, parts, pa.array([role] * len(rows), pa.int32()), of, chunks], names=["_a", "part", "role", "of", "data"])

    dealt = known.withColumn("_a", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartitionById(blocks, "_a").sortWithinPartitions("part")
    return dealt.mapInArrow(run, _PACKED)


class _Sums:
    """Accelerations (acc) and potentials (phi) of a block's targets, of which `wanted`
    are summed, for each of some squared softenings."""

    def __init__(self, data: list[np.ndarray], block: int, eps2: tuple[float, ...], least_r2: float, known: bool, wanted: str):
        all_ = np.concatenate(data, 1)
        self.id, self.mass, self.at = all_[0].view(np.int64), all_[1], np.ascontiguousarray(all_[2:])
        self.block, self.eps2, self.least, self.known, self.wanted = block, eps2, least_r2, known, wanted.split()
        self.acc, self.phi = np.zeros((len(eps2), 3, len(self.id))), np.zeros((len(eps2), len(self.id)))

    def add(self, data: np.ndarray, block: int) -> None:
        """The pull of a chunk of sources; bodies of one id, which lie in one block, don't act on each other."""
        own = data[0].view(np.int64) if self.known and block == self.block else None
        rows, cols = _TILE
        d, *more = (np.empty(shape) for shape in ((3, rows, cols), *[(rows, cols)] * 4))
        for a in range(0, len(self.id), rows):
            t = slice(a, min(a + rows, len(self.id)))
            for b in range(0, data.shape[1], cols):
                s = slice(b, min(b + cols, data.shape[1]))
                self._tile(t, data[2:, s], data[1, s], None if own is None else own[s], *(x[..., : t.stop - a, : s.stop - b] for x in (d, *more)))

    def _tile(self, t: slice, source: np.ndarray, mass: np.ndarray, own: np.ndarray | None, d, r2, q, f, w) -> None:
        for k in range(3):
            np.subtract(source[k], self.at[k, t, None], out=d[k])
        np.multiply(d[0], d[0], out=r2)
        for k in (1, 2):
            np.multiply(d[k], d[k], out=w)
            r2 += w
        if own is not None:
            r2[self.id[t, None] == own] = np.inf
        for i, eps2 in enumerate(self.eps2):  # distances are those of all softenings
            np.add(r2, eps2, out=q)
            if eps2 <= self.least:  # else no pair is as close
                q[q <= self.least] = np.inf
            np.sqrt(q, out=f)
            np.divide(1.0, f, out=f)
            if "phi" in self.wanted:
                self.phi[i, t] -= f @ mass
            if "acc" in self.wanted:
                np.divide(f, q, out=w)
                for k in range(3):
                    np.multiply(d[k], w, out=q)
                    self.acc[i, k, t] += q @ mass


def _acted(targets: DataFrame, sources: DataFrame, blocks: int, eps2: tuple[float, ...], least_r2: float, known: bool, finish, schema: str, wanted: str = "acc phi") -> DataFrame:
    """finish(sums) gives the record batch of each block of targets (rows of _PACKED)
    upon which all sources of its part with its _a have acted; known: ids of both
    are those of bodies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, sums = None, [], None
        for b in batches:
            for block, p, role, of, data in zip(*(b.column(c).to_pylist() for c in ("_a", "part", "role", "of")), b.column("data"), strict=True):
                if p != part:
                    if part is not None and (sums or waiting):
                        yield finish(sums or _Sums(waiting, at, eps2, least_r2, known, wanted))
                    part, waiting, sums = p, [], None
                array, at = np.frombuffer(data.as_buffer()).reshape(5, -1).copy(), block
                if role == 0:
                    waiting.append(array)
                elif waiting or sums:  # all targets come first
                    if sums is None:
                        sums, waiting = _Sums(waiting, block, eps2, least_r2, known, wanted), []
                    sums.add(array, of)
        if part is not None and (sums or waiting):
            yield finish(sums or _Sums(waiting, at, eps2, least_r2, known, wanted))

    met = targets.unionByName(sources).repartitionById(blocks, "_a").sortWithinPartitions("part", "role")
    return met.mapInArrow(run, schema)


def _forces(targets: DataFrame, sources: DataFrame, blocks: int, eps2: tuple[float, ...], gravity: float, least_r2: float, known: bool, wanted: str = "acc phi") -> DataFrame:
    """id and _FORCES of the targets upon which anything may act; with several
    softenings each name ends in the number of its own."""
    names = list(_FORCES) if len(eps2) == 1 else [f"{c}{i}" for i in range(len(eps2)) for c in _FORCES]
    names = [c for c in names if ("phi" if c.startswith("phi") else "acc") in wanted.split()]

    def finish(s: _Sums) -> pa.RecordBatch:
        each = {f"{c}{i if len(eps2) > 1 else ''}": x for i in range(len(eps2)) for c, x in zip(_FORCES, (*s.acc[i], s.phi[i]), strict=True)}
        return pa.RecordBatch.from_arrays([pa.array(s.id), *(pa.array(gravity * each[c]) for c in names)], names=["id", *names])

    every = sources.withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    acted = _acted(targets, every.withColumn("role", F.lit(1)), blocks, eps2, least_r2, known, finish, "id long, " + ", ".join(f"{c} double" for c in names), wanted)
    return acted.groupBy("id").agg(*(F.sum(c).alias(c) for c in names))


def accelerations(bodies: DataFrame, softening: float = 0.0, gravity: float = 1.0, sources: DataFrame | None = None) -> DataFrame:
    """id, ax, ay, az, phi of each body by all others (pairs at distance 0 don't act)."""
    blocks = _blocks(bodies)
    targets = cut(_packed(bodies, blocks, 0))
    acting = targets if sources is None else cut(_packed(sources, blocks, 1))
    acted = _forces(targets, acting, blocks, (softening**2,), gravity, 0.0, True)
    return bodies.select("id").join(acted, "id", "left").fillna(dict.fromkeys(_FORCES, 0.0))


def by_softenings(bodies: DataFrame, softenings: tuple[float, ...], gravity: float = 1.0) -> DataFrame:
    """id and, for each of several softenings (numbered from 0), ax0, ay0, az0, ax1 and
    so on of each body by all others.  Pairs are met once, whatever the number of softenings."""
    blocks, eps2 = _blocks(bodies), tuple(s**2 for s in softenings)
    targets = cut(_packed(bodies, blocks, 0))
    acted = _forces(targets, targets, blocks, eps2, gravity, 0.0, True, "acc")
    if len(eps2) == 1:
        acted = acted.withColumnsRenamed({"a" + c: f"a{c}0" for c in "xyz"})
    names = [f"a{c}{i}" for i in range(len(eps2)) for c in "xyz"]
    return bodies.select("id").join(acted, "id", "left").fillna(dict.fromkeys(names, 0.0))


def within_parts(bodies: DataFrame, softening: float, gravity: float, part: str) -> DataFrame:
    """id, ax, ay, az, phi of each body by all others of its part."""
    blocks = _blocks(bodies)
    targets = cut(_packed(bodies, blocks, 0, F.col(part)))
    acted = _forces(targets, targets, blocks, (softening**2,), gravity, 0.0, True)
    return bodies.select("id").join(acted, "id", "left").fillna(dict.fromkeys(_FORCES, 0.0))


def potential_energy(bodies: DataFrame, softening: float = 0.0, gravity: float = 1.0) -> DataFrame:
    """One row: the energy of all pairs, each counted once.  Of two blocks one takes the
    pairs with the other: each has those that follow it, round the circle, to its far side."""
    blocks = _blocks(bodies)
    targets = cut(_packed(bodies, blocks, 0))
    ahead = targets.withColumn("_a", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks // 2)), lambda k: (F.col("of") + blocks - k) % blocks)))

    def finish(s: _Sums) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([gravity * float(s.mass @ s.phi[0])])], names=["e"])

    # within a block each pair is met twice
    inner = _acted(targets, targets.withColumn("role", F.lit(1)), blocks, (softening**2,), 0.0, True, finish, "e double", "phi")
    outer = _acted(targets, ahead.where("_a <> of").withColumn("role", F.lit(1)), blocks, (softening**2,), 0.0, True, finish, "e double", "phi")
    return inner.select((F.col("e") / 2).alias("e")).unionByName(outer).agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("potential"))


def by_records(bodies: DataFrame, records: DataFrame, softening: float = 0.0, gravity: float = 1.0, least_r2: float = 1e-12, part: str | None = None) -> DataFrame:
    """Accelerations and potential of bodies by point records (mass, cx, cy, cz) of
    other places; part: the bodies' column that must equal the records' dest."""
    blocks = _blocks(bodies)
    at = records.select("mass", *(F.col("c" + c).alias(c) for c in "xyz"), *(["dest"] if part else []))
    sources = _packed(at.withColumn("id", F.xxhash64("mass", *"xyz")), blocks, 1, F.col("dest") if part else None)
    return _forces(_packed(bodies, blocks, 0, F.col(part) if part else None), cut(sources), blocks, (softening**2,), gravity, least_r2, False)
