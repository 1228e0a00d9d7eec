"""Commands: run a simulation, convert orbital elements, generate bodies.

    python -m orbitalis run bodies.csv --config run.toml --out folder
    python -m orbitalis convert first.csv [second.csv] --out folder
    python -m orbitalis generate --kind plummer --n 1000 --out bodies.csv
    python -m orbitalis generate --json systems.json --out bodies.tab --format preamble
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from orbitalis.operators import direct, elements, motion
from orbitalis.operators.domain import cubic_domain, keyed
from orbitalis.operators.partition import balance, key_histogram, splitters
from orbitalis.plans import simulate
from orbitalis.plans.config import DIALECTS, SimConfig
from orbitalis.sources import binary, generate, tables, writers

_CHECK = "[CHECK]"
FORMATS = ("csv", "preamble", "plain")


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # a configuration


def _save(bodies, path: str, kind: str) -> None:
    if kind == "csv":
        writers.write_state(bodies, path)
    else:
        binary.write_packed(bodies, path, kind == "preamble")


def run(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    config = SimConfig.from_toml(_text(spark, a.config)) if a.config else SimConfig.of(a.dialect)
    bodies, timers = tables.open_bodies(spark, a.input, a.kind), simulate.Timers()
    checked = [_checked(bodies, config, a.check)] if a.check is not None else []
    end, log = simulate.run(bodies, config, timers=timers)
    writers.write_state(end, f"{a.out}/state.csv")
    writers.append_energy(log.withColumnRenamed("time", "time_days"), f"{a.out}/energy.csv")
    placed = keyed(bodies, cubic_domain(bodies))
    hist = key_histogram(placed, 12)
    cuts, parts = splitters(hist, a.parts), a.parts
    report = simulate.report(log, timers, balance(placed.withColumn("part", _part(cuts)), parts))
    spark.createDataFrame([(writers.metrics_toml(report),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/metrics")
    return checked + simulate.lines(report)


def _checked(bodies, config: SimConfig, most: float) -> str:
    """Accelerations as configured against the exact pair sums; the relative error of
    all together may be `most`."""
    got = simulate.accelerations(bodies, config)
    error = motion.acceleration_error(got, direct.accelerations(bodies, config.softening, config.gravity)).first()["rms"] or 0.0  # none without bodies
    return f"{_CHECK} {'passed' if error <= most else 'failed'}: error {error:.3e}, allowed {most:.3e}"


def _part(cuts: list[int]):
    from pyspark.sql import functions as F

    bucket = F.shiftright("key", 63 - 12)
    return F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c < bucket))


def convert(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    done = [elements.state_vectors(tables.read_elements(spark, p)) for p in a.input]
    for i, states in enumerate(done, 1):
        writers.write_state(states, f"{a.out}/states{i}.csv")
    if len(done) == 2:
        both = elements.combine(*done)
        both.write.mode("overwrite").csv(f"{a.out}/combined.csv", header=True)
    return [f"{states.count()} bodies, {states.where('mass_missing').count()} without a mass" for states in done]


def make(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    if a.json:
        bodies = generate.from_json(spark, _text(spark, a.json))
    else:
        kinds = {"uniform": generate.uniform_cube, "plummer": generate.plummer, "collision": generate.collision, "mirrored": generate.mirrored, "clusters": generate.two_clusters, "disk": generate.disk}
        bodies = kinds[a.kind](spark, a.n, a.seed)
    _save(bodies, a.out, a.format)
    r = motion.validate(bodies).first()
    return [f"{r['n']} bodies, {r['repeated_ids']} repeated ids, {r['not_finite']} not finite"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orbitalis")
    sub = p.add_subparsers(required=True)
    one = sub.add_parser("run")
    one.add_argument("input")
    one.add_argument("--kind", choices=("strict", "tolerant", "named", "header", "preamble", "plain"))
    one.add_argument("--config")
    one.add_argument("--dialect", default="body", choices=sorted(DIALECTS))
    one.add_argument("--parts", type=int, default=8)
    one.add_argument("--check", type=float, metavar="ERROR", help="compare accelerations with exact sums; exit code 1 if their relative error is larger")
    one.add_argument("--out", required=True)
    one.set_defaults(f=run)
    one = sub.add_parser("convert")
    one.add_argument("input", nargs="+")
    one.add_argument("--out", required=True)
    one.set_defaults(f=convert)
    one = sub.add_parser("generate")
    one.add_argument("--kind", default="plummer", choices=("uniform", "plummer", "collision", "mirrored", "clusters", "disk"))
    one.add_argument("--n", type=int, default=1000)
    one.add_argument("--seed", type=int, default=1)
    one.add_argument("--json")
    one.add_argument("--format", default="csv", choices=FORMATS)
    one.add_argument("--out", required=True)
    one.set_defaults(f=make)
    return p


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    a = parser().parse_args(words)
    return a.f(spark or SparkSession.builder.appName("orbitalis").getOrCreate(), a)


if __name__ == "__main__":
    said = main()
    print("\n".join(said))
    sys.exit(any(line.startswith(f"{_CHECK} failed") for line in said))
