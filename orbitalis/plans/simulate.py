"""Time integration: a loop of queries, with lineage cut at each step."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitalis.operators import arrow_walk, direct, leaf_walk, motion, partitioned_walk, walk
from orbitalis.plans.config import SimConfig
from orbitalis.operators.scratch import cut
from orbitalis.sources import writers


class Timers:
    """Seconds by step and phase; phases that aren't enabled are not timed."""

    def __init__(self, enabled: set[str] | None = None):
        self.enabled, self.rows = enabled, []
        self.step = 0

    @contextmanager
    def phase(self, name: str):
        began = time.perf_counter()
        yield
        if self.enabled is None or name in self.enabled:
            self.rows.append((self.step, name, time.perf_counter() - began))

    def summary(self) -> dict[str, float]:
        total: dict[str, float] = defaultdict(float)
        for _, name, s in self.rows:
            total[name] += s
        return dict(total)


def accelerations(bodies: DataFrame, config: SimConfig) -> DataFrame:
    """id, ax, ay, az, phi by the configured algorithm and strategy."""
    if config.algorithm == "direct":
        return direct.accelerations(bodies, config.softening, config.gravity)
    strategy = config.strategy
    by_leaves = config.mac == "leaf_box" and config.quadrupole and config.digit == 3
    if strategy == "auto":
        n = bodies.count()
        strategy = "partitioned" if (by_leaves or config.mac == "body" and not config.quadrupole) and config.arrow_from <= n else "relational"
    if strategy == "partitioned":
        return (leaf_walk if by_leaves else partitioned_walk).accelerations(bodies, config).select("id", "ax", "ay", "az", "phi")
    if strategy == "arrow":
        return arrow_walk.accelerations(bodies, config).select("id", "ax", "ay", "az", "phi")
    return walk.Walk(bodies, config).accelerations()


def _with_forces(bodies: DataFrame, config: SimConfig, timers: Timers) -> DataFrame:
    with timers.phase("forces"):
        plain = bodies.select("id", "mass", "x", "y", "z", "vx", "vy", "vz")
        state = cut(plain.join(accelerations(plain, config), "id"))
    return motion.require_finite(state, f"step {timers.step}")


def run(bodies: DataFrame, config: SimConfig, on_step: Callable[[int, DataFrame], None] | None = None, timers: Timers | None = None) -> tuple[DataFrame, DataFrame]:
    """The bodies after all steps (with accelerations) and the energy log.

    Integrators: kdk (half kick, drift, forces, half kick), drift_first (as kdk,
    but the first step has no opening kick), leapfrog_fused (kicks of
    neighbouring steps in one; energies lack the closing half kick until the end)
    and split_kick (both kicks of a step by the forces at its start, the first a
    whole one).
    """
    timers = timers or Timers()
    spark, dt, log = bodies.sparkSession, config.dt, []
    state = _with_forces(motion.require_valid(bodies), config, timers)

    def note(step: int, at: DataFrame) -> None:
        if config.energy_every and (step % config.energy_every == 0 or step == config.steps):
            with timers.phase("energy"):
                e = motion.energies(at).first()
            log.append((step, step * dt, e["kinetic"], e["potential"], e["total"]))
        if config.snapshot_path and writers.due(step, config.snapshot_every, config.steps):
            with timers.phase("output"):
                writers.write_snapshot(at, f"{config.snapshot_path}/step{step:06d}")
        if on_step is not None:
            on_step(step, at)

    note(0, state)
    for step in range(1, config.steps + 1):
        timers.step = step
        if config.integrator == "kdk":
            state = motion.kick(_with_forces(motion.kick_drift(state, dt / 2, dt), config, timers), dt / 2)
        elif config.integrator == "drift_first":
            state = motion.kick(_with_forces(motion.kick_drift(state, dt / 2 if step > 1 else 0.0, dt), config, timers), dt / 2)
        elif config.integrator == "leapfrog_fused":
            state = _with_forces(motion.kick_drift(state, dt / 2 if step == 1 else dt, dt), config, timers)
            if step == config.steps:
                state = motion.kick(state, dt / 2)
        elif config.integrator == "split_kick":
            state = _with_forces(motion.kick(motion.kick_drift(state, dt if step == 1 else dt / 2, dt), dt / 2), config, timers)
        else:
            raise ValueError(f"unknown integrator {config.integrator!r}")
        note(step, state)
    table = spark.createDataFrame(log, "step int, time double, kinetic double, potential double, total double")
    return state, motion.drift_of_energy(table)


def compare_with_direct(bodies: DataFrame, config: SimConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Final states by tree and by direct sum, and their distance error."""
    from dataclasses import replace

    tree_end, _ = run(bodies, config)
    exact_end, _ = run(bodies, replace(config, algorithm="direct"))
    return tree_end, exact_end, motion.distance_error(tree_end, exact_end)


def report(log: DataFrame, timers: Timers, balance: DataFrame | None = None) -> dict:
    """A run's metrics: largest energy deviation, seconds by phase (summed, and the
    largest and mean step), and the row of partition.balance() if it is given."""
    worst = log.agg(F.max("rel_drift")).first()[0]
    steps: dict[str, list[float]] = defaultdict(list)
    for _, name, s in timers.rows:
        steps[name].append(s)
    out = {"max_energy_drift": worst, "seconds": timers.summary()}
    out["slowest_step"] = {k: max(v) for k, v in steps.items()}
    out["mean_step"] = {k: sum(v) / len(v) for k, v in steps.items()}
    return out | ({"balance": balance.first().asDict()} if balance is not None else {})


def lines(report: dict) -> list[str]:
    """A report as lines for a console."""
    out = [f"[ENERGY] largest relative drift {report['max_energy_drift']:.3e}"] if report.get("max_energy_drift") is not None else []
    out += [f"[TIMERS] {k}: {s:.3f} s, slowest step {report['slowest_step'][k]:.3f} s, mean {report['mean_step'][k]:.3f} s" for k, s in report["seconds"].items()]
    if b := report.get("balance"):
        out.append(f"[BALANCE] {b['n']} bodies in {b['parts']} parts: min {b['least']} max {b['most']} mean {b['mean']:.1f}, max/mean {b['ratio']:.3f}, {b['empty']} empty")
    return out
