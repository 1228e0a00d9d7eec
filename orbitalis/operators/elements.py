"""From orbital elements to state vectors, as one query.

Rows without a class or an element needed are left out.  Missing albedo is drawn
from its class's range by a hash of the name, so it is the same in every run;
diameter follows from brightness, mass from volume and a density by albedo.
Satellites take their parent's gravity and are moved to where it is; a parent
may stand anywhere in the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitalis.operators.ranking import ranked

#: Gravitational constant in AU^3 kg^-1 day^-2, the Sun's mass in kg, the target epoch (fixed values).
GRAVITY = 1.48812e-34
SUN = 1.98847e30
EPOCH = 2451544.5
NEEDED = ("e", "a", "i", "om", "w", "ma", "epoch")
#: Albedo ranges by class (fixed values).
ALBEDO = {
    "AMO": (0.450, 0.550), "APO": (0.450, 0.550), "ATE": (0.450, 0.550), "IEO": (0.450, 0.550),
    "MCA": (0.450, 0.550), "PAA": (0.450, 0.550), "HYA": (0.450, 0.550), "AST": (0.450, 0.550),
    "IMB": (0.030, 0.103), "MBA": (0.097, 0.203), "OMB": (0.197, 0.500), "CEN": (0.450, 0.750),
    "TJN": (0.124, 0.188), "TNO": (0.022, 0.130),
}
OTHER_ALBEDO = (0.1, 0.2)


def eccentric_anomaly(mean: Column, e: Column, rounds: int = 50) -> Column:
    """Newton's method for Kepler's equation; more rounds don't move a solution."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), mean, lambda x, _: x - (x - e * F.sin(x) - mean) / (1 - e * F.cos(x)))


def imputed(elements: DataFrame) -> DataFrame:
    """elements with albedo, diameter and mass filled in; mass_missing marks those left at 0."""
    whole = lambda c: F.coalesce(F.round(F.col(c) * 1_000_000).cast("long").cast("string"), F.lit(""))
    seed = F.concat_ws("/", F.coalesce("name", F.lit("")), whole("a"), whole("e"))
    u = F.conv(F.substring(F.md5(seed), 1, 7), 16, 10).cast("long") / float(1 << 28)
    low, high = F.lit(OTHER_ALBEDO[0]), F.lit(OTHER_ALBEDO[1])
    for name, (lo, hi) in ALBEDO.items():
        low, high = F.when(F.col("class") == name, lo).otherwise(low), F.when(F.col("class") == name, hi).otherwise(high)
    out = elements.withColumn("albedo", F.coalesce("albedo", low + u * (high - low)))
    out = out.withColumn("diameter", F.coalesce("diameter", 1329 * F.pow("albedo", F.lit(-0.5)) * F.pow(F.lit(10.0), -0.2 * F.col("H"))))
    rho = F.when(F.col("albedo") < 0.1, 1380.0).when(F.col("albedo") <= 0.2, 2710.0).otherwise(5320.0)
    volume = 4 / 3 * math.pi * F.pow(F.col("diameter") / 2 * 1000, 3)
    known = F.coalesce("mass", F.lit(0.0))
    mass = F.when((known == 0) & (F.coalesce("diameter", F.lit(0.0)) > 0), volume * rho).otherwise(known)
    return out.withColumn("mass", mass).withColumn("mass_missing", F.col("mass") == 0)


def state_columns(mu: Column) -> dict[str, Column]:
    """x, y, z, vx, vy, vz (AU, AU/day) from e, a, i, om, w, ma (degrees) and epoch."""
    e, a = F.col("e"), F.col("a")
    inc, node, peri = (F.radians(c) for c in ("i", "om", "w"))
    turned = F.radians("ma") + F.sqrt(mu / F.pow(a, 3)) * (EPOCH - F.col("epoch"))
    big = eccentric_anomaly(F.pmod(turned, F.lit(2 * math.pi)), e)
    true = 2 * F.atan2(F.sqrt(1 + e) * F.sin(big / 2), F.sqrt(1 - e) * F.cos(big / 2))
    r = a * (1 - e * F.cos(big))
    h = F.sqrt(mu * a) / r
    px, py = r * F.cos(true), r * F.sin(true)
    vx, vy = -h * F.sin(big), h * F.sqrt(1 - e * e) * F.cos(big)
    co, so, ci, si, cw, sw = F.cos(node), F.sin(node), F.cos(inc), F.sin(inc), F.cos(peri), F.sin(peri)
    rows = ((co * cw - so * sw * ci, -co * sw - so * cw * ci), (so * cw + co * sw * ci, -so * sw + co * cw * ci), (sw * si, cw * si))
    out = {n: p * px + q * py for n, (p, q) in zip("xyz", rows, strict=True)}
    return out | {"v" + n: p * vx + q * vy for n, (p, q) in zip("xyz", rows, strict=True)}


def state_vectors(elements: DataFrame) -> DataFrame:
    """id, name, class, mass, x..vz in the order of `row` (file order), ids from 0."""
    good = elements.where((F.coalesce("class", F.lit("")) != ""))
    for c in NEEDED:
        good = good.where(F.col(c).isNotNull())
    if "central_body" not in good.columns:
        good = good.withColumn("central_body", F.lit("Sun"))
    full = imputed(good).withColumn("name", F.coalesce("name", F.lit("")))
    sun = F.lit(GRAVITY * SUN)
    around_sun = full.where(F.col("class").isin("PLA", "DWA"))
    latest = Window.partitionBy("name").orderBy(F.desc("row"))
    parents = around_sun.withColumns(state_columns(sun)).withColumn("_n", F.row_number().over(latest)).where("_n = 1")
    parents = parents.select(F.col("name").alias("_parent"), F.col("mass").alias("_m"), *(F.col(c).alias("_" + c) for c in ("x", "y", "z", "vx", "vy", "vz")))
    joined = full.join(parents, (full["class"] == "SAT") & (full["central_body"] == F.col("_parent")), "left")
    moved = joined.withColumns(state_columns(F.when(F.col("_m").isNotNull(), GRAVITY * F.col("_m")).otherwise(sun)))
    moved = moved.withColumns({c: F.col(c) + F.coalesce("_" + c, F.lit(0.0)) for c in ("x", "y", "z", "vx", "vy", "vz")})
    return ranked(moved, "id", "row").select("id", "name", "class", "mass", "x", "y", "z", "vx", "vy", "vz", "mass_missing", "row")


def combine(first: DataFrame, second: DataFrame, sun: bool = True) -> DataFrame:
    """Both catalogues after the Sun; of equal non-empty names the first stays; new ids.

    The catalogues have `row`, their own order.
    """
    names = ["name", "class", "mass", "x", "y", "z", "vx", "vy", "vz"]
    parts = [d.select(F.lit(i).alias("_file"), F.col("row").cast("long").alias("_row"), *names) for i, d in ((1, first), (2, second))]
    every = parts[0].union(parts[1])
    if sun:
        spark = first.sparkSession
        star = spark.range(1).select(F.lit(0).alias("_file"), F.lit(0).cast("long").alias("_row"), F.lit("Sun").alias("name"), F.lit("STA").alias("class"), F.lit(SUN).alias("mass"), *(F.lit(0.0).alias(c) for c in names[3:]))
        every = star.union(every)
    named = every.where("name <> ''").withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("_file", "_row"))).where("_n = 1").drop("_n")
    kept = named.unionByName(every.where("coalesce(name, '') = ''"))
    return ranked(kept, "id", "_file", "_row").select("id", *names)
