"""The jobs as registered queries: each is run twice into one new folder, and its
whole output read back; with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import decompose, workmap
from jobs.common import configured
from orbitalis.operators.scratch import folder
from orbitalis.plans.catalog import ALL, DOM, KEYED, PLACED


def _twice(spark: SparkSession, job, source: str) -> str:
    out = f"{folder(spark)}/jobs/{uuid.uuid4().hex}"
    for _ in range(2):
        job.run(spark, source, out)
    return out


def job1_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompose.read(spark, _twice(spark, decompose, f"{sf_dir}/lineitem.parquet"))


def job2_workmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _twice(spark, workmap, f"{sf_dir}/documents.parquet")
    done = workmap.read(spark, out, configured(workmap.__file__)["depth"])
    return done.withColumns({c: F.round(c, 6) + 0.0 for c in ("cx", "cy", "cz")})


def _parts(histogram: str, parts: int) -> str:
    """SQL of s (bucket, part): ranges of buckets whose counts (h: bucket, cnt) are about equal."""
    return f"""h AS ({histogram}),
o AS (SELECT bucket, sum(cnt) OVER (ORDER BY bucket) AS run, row_number() OVER (ORDER BY bucket) AS r FROM h),
e AS (SELECT CAST(ceil(sum(cnt) / {parts}.0) AS BIGINT) AS each FROM h),
s AS (SELECT 0::BIGINT AS r, 0::BIGINT AS closed, 0::BIGINT AS part, -1::BIGINT AS bucket
  UNION ALL SELECT o.r, CASE WHEN s.closed < {parts - 1} AND o.run >= (s.closed + 1) * e.each THEN s.closed + 1 ELSE s.closed END, s.closed, o.bucket FROM s JOIN o ON o.r = s.r + 1, e)"""


_LINES = """b AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mass, x, y, z, vx, vy, vz) AS r FROM (
  SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS id, CAST(l_quantity AS DOUBLE) AS mass, CAST(l_extendedprice AS DOUBLE) AS x, CAST(l_partkey * 50 AS DOUBLE) AS y,
    CAST(l_suppkey * 900 AS DOUBLE) AS z, CAST(l_discount AS DOUBLE) AS vx, CAST(l_tax AS DOUBLE) AS vy, CAST(0 AS DOUBLE) AS vz FROM lineitem) WHERE mass > 0) WHERE r = 1)"""
_TREE = """c AS MATERIALIZED (SELECT a.*, (a.n <= 16 OR a.depth = 21) AS is_leaf FROM c0 AS a LEFT JOIN c0 AS p ON p.depth = a.depth - 1 AND p.prefix = a.prefix >> 3
  WHERE a.depth = 0 OR p.n > 16)"""


def _bits(v: str, shift: int) -> str:
    return f"((({v} >> i) & 1) << (3 * i + {shift}))"


_POINTS = r"""t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS DOUBLE) AS words, CAST(length(text) AS DOUBLE) AS chars, CAST(strlen(text) + 1 AS DOUBLE) AS mass FROM t),
p AS (SELECT doc_id, sqrt(words) AS x, sqrt(chars) AS y, CASE WHEN words > 0 THEN chars / words ELSE 0.0 END AS z, mass FROM u)"""
_CELLS = f"""q AS (SELECT *, {", ".join(f"CAST(least(greatest(floor({c} / 512.0 * 2097152.0), 0), 2097151) AS BIGINT) AS i{c}" for c in "xyz")} FROM p),
k AS (SELECT *, CAST(list_sum([{" + ".join(_bits("i" + c, s) for s, c in enumerate("xyz"))} for i in range(21)]) AS BIGINT) >> 42 AS cell FROM q),
g AS (SELECT cell, count(*) AS n, CAST(sum(mass) AS BIGINT) AS bytes, {", ".join(f"round(sum(mass * {c}) / sum(mass), 6) + 0.0 AS c{c}" for c in "xyz")} FROM k GROUP BY cell)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_decompose": job1_decompose, "job2_workmap": job2_workmap}
SQL = {
    "job1_decompose": f"""WITH RECURSIVE {_LINES}, {DOM}, {KEYED}, {ALL}, {_TREE}, {PLACED},
{_parts("SELECT key >> 54 AS bucket, count(*) AS cnt FROM k GROUP BY 1", 6)}
SELECT id, mass, x, y, z, vx, vy, vz, key, CAST(leaf_depth AS INTEGER) AS leaf_depth, leaf_prefix, CAST(s.part AS INTEGER) AS part FROM pl JOIN s ON s.bucket = pl.key >> 54""",
    "job2_workmap": f"""WITH RECURSIVE {_POINTS}, {_CELLS},
{_parts("SELECT cell AS bucket, bytes AS cnt FROM g", 8)}
SELECT k.doc_id, CAST(k.mass AS BIGINT) AS doc_bytes, cell, n, bytes, cx, cy, cz, CAST(s.part AS INTEGER) AS part FROM k JOIN g USING (cell) JOIN s ON s.bucket = cell""",
}
