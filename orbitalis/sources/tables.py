"""Body catalogues from text files, under several acceptance rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitalis.operators.ranking import number_rows

STATE = "id long, mass double, x double, y double, z double, vx double, vy double, vz double"
NAMED = "id long, name string, class string, mass double, x double, y double, z double, vx double, vy double, vz double"
ELEMENTS = "e double, a double, i double, om double, w double, ma double, epoch double, H double, albedo double, diameter double, mass double, class string, name string, central_body string"
#: Names under which a column may stand in a header (fixed values), without case, blanks, quotes and underscores.
ALIASES = {
    "id": ("id", "bodyid"), "mass": ("mass", "m"),
    "x": ("posx", "x", "px"), "y": ("posy", "y", "py"), "z": ("posz", "z", "pz"),
    "vx": ("velx", "vx"), "vy": ("vely", "vy"), "vz": ("velz", "vz"),
}


def _plain(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """Eight columns without a header; a bad row is an error."""
    return spark.read.schema(STATE).csv(path, header=False, mode="FAILFAST")


def read_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """Eight columns; header lines (any that begin with an i) and bad rows are left out."""
    lines = spark.read.text(path).where(~F.lower(F.ltrim("value")).startswith("i"))
    fields = [f.split() for f in STATE.split(", ")]
    part = F.split("value", ",")
    parsed = lines.select(*(F.trim(F.get(part, F.lit(i))).try_cast(t).alias(n) for i, (n, t) in enumerate(fields)))
    good = F.lit(True)
    for n, _ in fields:
        good = good & F.col(n).isNotNull()
    return parsed.where(good)


def read_named(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Ten columns under a header; bad rows are dropped, ids are given anew in file order."""
    raw = spark.read.schema(NAMED).csv(path, header=True, mode="DROPMALFORMED", enforceSchema=True).where("vz is not null")
    return with_ids(raw.withColumn("row", F.monotonically_increasing_id()), limit)


def with_ids(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """ids from 0 in the order of `row` (a fresh monotonically_increasing_id); the
    first `limit` rows if one is given."""
    out = number_rows(rows.drop("id"), "id", "row")
    return out.where(F.col("id") < limit) if limit is not None else out


def resolve(df: DataFrame) -> DataFrame:
    """The eight state columns of a table whatever their headers' spelling, others dropped."""
    found = {_plain(c): c for c in df.columns}
    if {"e", "om", "ma"} <= set(found):
        raise ValueError("these are orbital elements, not state vectors")
    picked = {}
    for name, spellings in ALIASES.items():
        match = next((found[s] for s in spellings if s in found), None)
        if match is None and name != "id":
            raise ValueError(f"missing column: {name}")
        picked[name] = match
    out = [F.col(f"`{c}`").cast("long" if n == "id" else "double").alias(n) for n, c in picked.items() if c is not None]
    if picked["id"] is None:  # ids from 0 in the rows' order
        numbered = with_ids(df.select(*out, F.monotonically_increasing_id().alias("row")))
        return numbered.select("id", *(n for n in picked if n != "id"))
    return df.select(*out)


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """Any columns in any order under a header, with # comments; a bad value is an error."""
    raw = spark.read.csv(path, header=True, comment="#", mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return resolve(raw)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Orbital elements under a header, blanks as null, with `row` in file order."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    have = {c.strip('"'): c for c in raw.columns}
    fields = [f.split() for f in ELEMENTS.split(", ")]
    cols = [(F.col(f"`{have[n]}`").try_cast(t) if n in have else F.lit("Sun" if n == "central_body" else None).cast(t)).alias(n) for n, t in fields]
    return raw.select(*cols, F.monotonically_increasing_id().alias("row"))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, x double, y double, z double").csv(path, header=True)


def open_bodies(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """By kind or by ending: .csv (header), .tab (packed binary with preamble), .bin (plain binary)."""
    from orbitalis.sources import binary

    kind = kind or {"csv": "header", "tab": "preamble", "bin": "plain"}.get(path.rsplit(".", 1)[-1])
    readers = {"strict": read_strict, "tolerant": read_tolerant, "named": read_named, "header": read_header, "preamble": binary.read_preamble, "plain": binary.read_plain}
    if kind not in readers:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(readers)}")
    return readers[kind](spark, path)
