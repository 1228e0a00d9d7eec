"""Kicks, drifts, energies and the checks of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitalis.operators.domain import bounding_box
from orbitalis.operators.scratch import cut


def kick(bodies: DataFrame, h: float) -> DataFrame:
    """v += a h"""
    return bodies.withColumns({"v" + c: F.col("v" + c) + F.col("a" + c) * h for c in "xyz"})


def drift(bodies: DataFrame, dt: float) -> DataFrame:
    """x += v dt"""
    return bodies.withColumns({c: F.col(c) + F.col("v" + c) * dt for c in "xyz"})


def kick_drift(bodies: DataFrame, h: float, dt: float) -> DataFrame:
    """Both in one projection."""
    v = {c: F.col("v" + c) + F.col("a" + c) * h for c in "xyz"}
    return bodies.withColumns({**{"v" + c: v[c] for c in "xyz"}, **{c: F.col(c) + v[c] * dt for c in "xyz"}})


def recentre(bodies: DataFrame, momentum_only: bool = False) -> DataFrame:
    """Bodies without net momentum and, unless asked otherwise, with their centre of
    mass at the origin.  Six numbers come to the driver."""
    m = F.col("mass")
    r = bodies.agg(*((F.sum(m * F.col(c)) / F.sum(m)).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz"))).first()
    moved = ("vx", "vy", "vz") if momentum_only else ("x", "y", "z", "vx", "vy", "vz")
    return bodies.withColumns({c: F.col(c) - F.lit(r[c]) for c in moved}) if r["vx"] is not None else bodies


def kinetic(bodies: DataFrame) -> DataFrame:
    v2 = sum((F.pow(F.col("v" + c), 2) for c in "yz"), F.pow(F.col("vx"), 2))
    return bodies.agg(F.coalesce(F.sum(0.5 * F.col("mass") * v2), F.lit(0.0)).alias("kinetic"))


def energies(bodies: DataFrame) -> DataFrame:
    """One row: kinetic, and potential from phi (each pair counted once)."""
    v2 = sum((F.pow(F.col("v" + c), 2) for c in "yz"), F.pow(F.col("vx"), 2))
    e = bodies.agg(F.coalesce(F.sum(0.5 * F.col("mass") * v2), F.lit(0.0)).alias("kinetic"), F.coalesce(F.sum(0.5 * F.col("mass") * F.col("phi")), F.lit(0.0)).alias("potential"))
    return e.withColumns({"total": F.col("kinetic") + F.col("potential"), "virial": -2 * F.col("kinetic") / F.col("potential")})


def drift_of_energy(log: DataFrame) -> DataFrame:
    """The energy log with each step's relative deviation from the first."""
    first = F.min_by("total", "step").over(Window.partitionBy(F.lit(0)))
    return log.withColumn("rel_drift", F.abs((F.col("total") - first) / first))


def distance_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the summed distance of bodies with equal ids, their largest, and how many."""
    both = a.select("id", *(F.col(c).alias("a" + c) for c in "xyz")).join(b.select("id", *(F.col(c).alias("b" + c) for c in "xyz")), "id")
    d = F.sqrt(sum((F.pow(F.col("a" + c) - F.col("b" + c), 2) for c in "yz"), F.pow(F.col("ax") - F.col("bx"), 2)))
    return both.agg(F.sum(d).alias("summed"), F.max(d).alias("largest"), F.count("*").alias("n"))


def acceleration_error(got: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: rms and largest relative error of accelerations."""
    return error_of(got.select("id", *(F.col("a" + c).alias("p" + c) for c in "xyz")).join(exact.select("id", *(F.col("a" + c).alias("q" + c) for c in "xyz")), "id"))


def error_of(both: DataFrame) -> DataFrame:
    """The same of rows that have both: px, py, pz and the exact qx, qy, qz."""
    d2 = sum((F.pow(F.col("p" + c) - F.col("q" + c), 2) for c in "yz"), F.pow(F.col("px") - F.col("qx"), 2))
    q2 = sum((F.pow(F.col("q" + c), 2) for c in "yz"), F.pow(F.col("qx"), 2))
    e2 = F.when(q2 > 0, d2 / q2).otherwise(d2)
    return both.agg(F.sqrt(F.avg(e2)).alias("rms"), F.sqrt(F.max(e2)).alias("largest"))


def validate(bodies: DataFrame) -> DataFrame:
    """One row of counts of what a body table must not have."""
    finite = F.lit(True)
    for c in ("mass", "x", "y", "z", "vx", "vy", "vz"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    repeats = bodies.groupBy("id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_ids"))
    bad = lambda cond, name: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).alias(name)
    return bodies.agg(F.count("*").alias("n"), bad(~finite, "not_finite"), bad(~(F.col("mass") > 0), "mass_not_positive"), bad(F.col("id") < 0, "negative_ids")).join(repeats)


def require_valid(bodies: DataFrame) -> DataFrame:
    """bodies, or an error that names what is wrong."""
    r = validate(bodies).first().asDict()
    n = r.pop("n")
    if wrong := {k: v for k, v in r.items() if v}:
        raise ValueError(f"of {n} bodies: {wrong}")
    return bodies


def broken(bodies: DataFrame) -> DataFrame:
    """Bodies whose acceleration isn't a number."""
    return bodies.where(F.isnan("ax") | F.isnan("ay") | F.isnan("az"))


def require_finite(bodies: DataFrame, where: str = "") -> DataFrame:
    """bodies, or an error that names some whose acceleration isn't a number."""
    if bad := [r["id"] for r in broken(bodies).select("id").limit(5).collect()]:
        raise ArithmeticError(f"{where}: accelerations of bodies {bad} aren't numbers")
    return bodies


def post_drift_box(bodies: DataFrame, h: float, dt: float) -> DataFrame:
    """The bounding box that bodies will have after a kick and a drift."""
    return bounding_box(kick_drift(bodies, h, dt))


def by_levels(cells: DataFrame, visit, up: bool = False) -> list:
    """visit(depth, the cells of that depth) for each depth, from the root down or
    from the deepest cells up; what the visits return."""
    last = cells.agg(F.max("depth")).first()[0]
    order = range(last + 1) if last is not None else ()
    return [visit(d, cells.where(F.col("depth") == d)) for d in (reversed(order) if up else order)]


def check_tree(bodies: DataFrame, cells: DataFrame, digit: int = 3) -> DataFrame:
    """One row: bodies and mass of the table, the root and the leaves, and how many
    inner cells don't hold what their children hold."""
    kids = cells.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.shiftright("prefix", digit).alias("prefix")).agg(F.sum("n").alias("kn"))
    wrong = cells.where("not is_leaf").join(kids, ["depth", "prefix"], "left").where(~F.col("kn").eqNullSafe(F.col("n"))).agg(F.count("*").alias("wrong_cells"))
    root = cells.where("depth = 0").agg(F.sum("n").alias("root_n"), F.sum("mass").alias("root_mass"))
    leaf = cells.where("is_leaf").agg(F.sum("n").alias("leaf_n"), F.sum("mass").alias("leaf_mass"))
    return bodies.agg(F.count("*").alias("n"), F.sum("mass").alias("mass")).join(root).join(leaf).join(wrong)


def blocked_sum(bodies: DataFrame, value: str, order: str = "id", block: int = 16_384) -> float:
    """A sum whose result doesn't depend on partitioning: values in blocks of the
    order, each block added in order, then blocks of `block` sums, and so on, until
    one is left; the driver sees one number."""
    low = bodies.agg(F.min(order)).first()[0]
    if low is None:
        return 0.0
    sums = bodies.select((F.col(order) - low).alias("_o"), F.col(value).alias("_v"))
    while True:
        dealt = sums.withColumn("_b", F.floor(F.col("_o") / block))
        ordered = F.array_sort(F.collect_list(F.struct("_o", "_v")))  # a block's values
        sums = dealt.groupBy("_b").agg(F.aggregate(ordered, F.lit(0.0), lambda acc, x: acc + x["_v"]).alias("_v")).withColumnRenamed("_b", "_o")
        sums = cut(sums)
        if sums.agg(F.max("_o")).first()[0] == 0:
            return sums.first()["_v"]
