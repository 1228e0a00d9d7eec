"""Generated body sets; every body follows from the seed and its id alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitalis.operators import motion


def _unit(seed: int, name: str):
    """A uniform number in [0, 1) from the id, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(1 << 52)) / float(1 << 52)


def uniform_cube_of(ids: DataFrame, seed: int = 1, half: float = 1.0, speed: float = 0.0, masses: tuple[float, float] = (0.5, 1.5)) -> DataFrame:
    """A body in the cube for each row's id."""
    cols = {"mass": masses[0] + (masses[1] - masses[0]) * _unit(seed, "mass")}
    cols |= {c: (2 * _unit(seed, c) - 1) * half for c in "xyz"} | {"v" + c: (2 * _unit(seed, "v" + c) - 1) * speed for c in "xyz"}
    return ids.select("id", *(v.alias(k) for k, v in cols.items()))


def uniform_cube(spark: SparkSession, n: int, seed: int = 1, half: float = 1.0, speed: float = 0.0, masses: tuple[float, float] = (0.5, 1.5)) -> DataFrame:
    return uniform_cube_of(spark.range(n), seed, half, speed, masses)


def _exponential(seed: int, name: str):
    return -F.log(_unit(seed, name) + 2.0**-53)


def _half_square(seed: int, name: str):
    """Half the square of a normal number."""
    return _exponential(seed, name) * F.pow(F.cos(2 * np.pi * _unit(seed, name + "'")), 2)


def _directed(seed: int, name: str, size) -> list:
    """A vector of that size in a random direction."""
    z, phi = 2 * _unit(seed, name + "z") - 1, 2 * np.pi * _unit(seed, name + "phi")
    flat = size * F.sqrt(1 - z * z)
    return [flat * F.cos(phi), flat * F.sin(phi), size * z]


def plummer_of(ids: DataFrame, n: int, seed: int = 1, total_mass: float = 1.0, scale: float = 1.0, gravity: float = 1.0, cutoff: float = 9.0) -> DataFrame:
    """A body of a Plummer sphere of n for each row's id.  The radius comes from the mass
    within it, taken uniformly up to the cutoff's; the square of the speed, as a share
    of the escape speed's, is Beta(3/2, 9/2), as a share of two Gamma numbers."""
    within = (1 + cutoff**-2) ** -1.5
    r = 1 / F.sqrt(F.pow(within * (_unit(seed, "r") + 2.0**-53), -2 / 3) - 1)
    slow = _exponential(seed, "e0") + _half_square(seed, "g0")
    fast = sum((_exponential(seed, f"e{i}") for i in (2, 3, 4)), _exponential(seed, "e1")) + _half_square(seed, "g1")
    drawn = ids.select("id", r.alias("r"), (slow / (slow + fast)).alias("q2"))
    v = F.sqrt(F.col("q2") * 2 / F.sqrt(1 + F.col("r") * F.col("r"))) * (gravity * total_mass / scale) ** 0.5
    place, speed = _directed(seed, "p", F.col("r") * scale), _directed(seed, "v", v)
    return drawn.select("id", F.lit(total_mass / max(n, 1)).alias("mass"), *(c.alias(k) for k, c in zip(("x", "y", "z", "vx", "vy", "vz"), place + speed, strict=True)))


def plummer(spark: SparkSession, n: int, seed: int = 1, total_mass: float = 1.0, scale: float = 1.0, gravity: float = 1.0, cutoff: float = 9.0) -> DataFrame:
    return plummer_of(spark.range(n), n, seed, total_mass, scale, gravity, cutoff)


def collision(spark: SparkSession, n: int, seed: int = 1, apart: float = 4.0, approach: float = 0.5, total_mass: float = 1.0, **how) -> DataFrame:
    """Two Plummer spheres of half the mass each, in equilibrium, on their way to each other."""
    small = n // 2
    first, second = (plummer(spark, k, seed + i, total_mass=total_mass / 2, **how) for i, k in enumerate((n - small, small)))
    a = first.withColumns({"x": F.col("x") - apart / 2, "vx": F.col("vx") + approach / 2})
    b = second.withColumns({"id": F.col("id") + (n - small), "x": F.col("x") + apart / 2, "vx": F.col("vx") - approach / 2})
    return a.unionByName(b)


def mirrored(spark: SparkSession, n: int, seed: int = 1, shift: float = 4.0, total_mass: float = 1.0, scale: float = 9 * np.pi / 16, **how) -> DataFrame:
    """A Plummer sphere of half the bodies (rounded up) and their copies, moved along
    all axes, with the centre of mass and its speed taken away."""
    half = n - n // 2
    first = plummer(spark, half, seed, total_mass=total_mass, scale=scale, **how).withColumn("mass", F.lit(total_mass / max(n, 1)))
    moved = first.where(F.col("id") < n // 2).withColumns({"id": F.col("id") + half, **{c: F.col(c) + shift for c in "xyz"}})
    return motion.recentre(first.unionByName(moved))


def two_clusters(spark: SparkSession, n: int, seed: int = 1, spread: float = 1.0, apart: float = 100.0) -> DataFrame:
    cube = uniform_cube(spark, n, seed, spread)
    return cube.withColumn("x", F.col("x") + F.when(F.col("id") % 2 == 0, apart / 2).otherwise(-apart / 2))


def disk(spark: SparkSession, n: int, seed: int = 1, radius: float = 1.0, thickness: float = 0.1, masses: tuple[float, float] = (1.0, 1.0), centre_mass: float = 0.0, inclination: float = 0.0, azimuth: float = 0.0, gravity: float = 1.0) -> DataFrame:
    """An even disk around a central mass (body 0, if there is one), turning at the
    circular speed of the mass within each radius; angles in degrees."""
    share = F.sqrt(_unit(seed, "r"))
    r, phi = radius * share, 2 * np.pi * _unit(seed, "phi")
    inner = centre_mass + (masses[0] + masses[1]) / 2 * n * share * share
    v = F.when(r > 0, F.sqrt(gravity * inner / r)).otherwise(0.0)
    flat = {"x": r * F.cos(phi), "y": r * F.sin(phi), "z": (_unit(seed, "z") - 0.5) * thickness}
    speed = {"x": -v * F.sin(phi), "y": v * F.cos(phi), "z": F.lit(0.0)}
    ci, si, ca, sa = (f(np.radians(k)) for k in (inclination, azimuth) for f in (np.cos, np.sin))

    def turned(d):
        y, z = d["y"] * ci - d["z"] * si, d["y"] * si + d["z"] * ci
        return {"x": d["x"] * ca - y * sa, "y": d["x"] * sa + y * ca, "z": z}

    mass = masses[0] + (masses[1] - masses[0]) * _unit(seed, "mass")
    cols = {"mass": mass, **turned(flat), **{"v" + c: k for c, k in turned(speed).items()}}
    if centre_mass:
        cols = {c: F.when(F.col("id") == 0, float(centre_mass if c == "mass" else 0.0)).otherwise(k) for c, k in cols.items()}
    return spark.range(n).select("id", *(k.cast("double").alias(c) for c, k in cols.items()))


def from_json(spark: SparkSession, text: str, gravity: float = 1.0) -> DataFrame:
    """A generator's JSON configuration: one set (n, kind, seed, scale_radius,
    cutoff_radius, total_mass), or a list of Plummer `systems` or disk `galaxies`
    with their places and speeds; a galaxy may be put into orbit around another."""
    import json

    c = json.loads(text)
    seed = int(c.get("seed", 1))
    if "systems" in c or "galaxies" in c:
        return _assembled(spark, c, seed, gravity)
    how = {"total_mass": c.get("total_mass", 1.0)}
    how |= {"scale": c["scale_radius"]} if "scale_radius" in c else {}
    how |= {"cutoff": c["cutoff_radius"]} if "cutoff_radius" in c else {}
    make = {"plummer": plummer, "collision": collision, "mirrored": mirrored}[c.get("kind", "plummer")]
    return make(spark, int(c["n"]), seed, **how)


def _assembled(spark: SparkSession, c: dict, seed: int, gravity: float) -> DataFrame:
    out, before, at = None, 0, {}
    light = c.get("defaults", {}).get("mass", {})
    for i, one in enumerate([*c.get("systems", []), *c.get("galaxies", [])]):
        n = int(one["particles"])
        if "disk_radius" in one:
            masses = (float(light.get("particle_min", 1.0)), float(light.get("particle_max", 1.0)))
            hole, turn = float(light.get("black_hole_factor", 0.0)) * masses[1], one.get("disk_orientation", {})
            made = disk(spark, n, seed + i, one["disk_radius"], one.get("disk_thickness", 0.0), masses, hole, turn.get("inclination", 0.0), turn.get("azimuth", 0.0), gravity)
            total = hole + n * sum(masses) / 2
        else:
            scale, total = float(one.get("scale_radius", 1.0)), float(one.get("total_mass", 1.0))
            made = plummer(spark, n, seed + i, total, scale, gravity, one["cutoff_radius"] / scale if "cutoff_radius" in one else 9.0)
        place, speed = np.array(one.get("position", (0, 0, 0)), float), np.array(one.get("velocity", (0, 0, 0)), float)
        if "orbit" in one:
            o = one["orbit"]
            host_place, host_speed, host_mass = at[o["around"]]
            angle, apart = np.radians(o.get("angle", 0.0)), float(o["distance"])
            out_, along = np.array((np.cos(angle), np.sin(angle), 0.0)), np.array((-np.sin(angle), np.cos(angle), 0.0))
            circular = (gravity * host_mass / apart) ** 0.5
            place = host_place + apart * out_
            speed = host_speed + circular * (o.get("tangential_velocity_factor", 1.0) * along - o.get("radial_velocity_factor", 0.0) * out_)
        at[one.get("name", str(i))] = place, speed, total
        moved = made.withColumns({"id": F.col("id") + before, **{k: F.col(k) + float(d) for k, d in zip(("x", "y", "z", "vx", "vy", "vz"), (*place, *speed), strict=True)}})
        out, before = moved if out is None else out.unionByName(moved), before + n
    if out is None:
        raise ValueError("no systems")
    return out
