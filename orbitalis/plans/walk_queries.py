"""Queries of partitioned walks and essential trees, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitalis.operators import essential, partitioned_walk, walk
from orbitalis.operators.domain import cubic_domain, keyed
from orbitalis.operators.cells import tree
from orbitalis.plans import catalog
from orbitalis.plans.catalog import CONFIG, DOM, EMB, KEYED, SQL, query, rounded
from orbitalis.plans.config import SimConfig
from orbitalis.sources import views

FEW = 60  # bodies of a range: so small that there are several at any scale


@query(SQL["walk_accel"])
def walk_partitioned(spark, sf_dir):
    got = partitioned_walk.accelerations(views.bodies_emb(spark, sf_dir), SimConfig.of("body", **{**CONFIG, "theta": 0.8}), per_part=FEW)
    return rounded(got.select("id", "ax", "ay", "az", "phi"), 5, "ax", "ay", "az", "phi")


@query(SQL["walk_arrow"])
def walk_partitioned_leaves(spark, sf_dir):
    got = partitioned_walk.accelerations(views.bodies_emb(spark, sf_dir), SimConfig.of("body_exact", **CONFIG), per_part=FEW)
    return rounded(got.select("id", "ax", "ay", "az", "phi"), 5, "ax", "ay", "az", "phi")


@query(SQL["walk_counts"])
def walk_partitioned_counts(spark, sf_dir):
    got = partitioned_walk.accelerations(views.bodies_emb(spark, sf_dir), SimConfig.of("body_soft", **CONFIG), per_part=FEW)
    return got.agg(F.sum("n_approx").alias("n_approx"), F.sum("n_direct").alias("n_direct"))


@query(catalog._with(EMB) + " SELECT count(*) AS n, round(sum(mass), 6) AS mass FROM b")
def walk_partitioned_mass(spark, sf_dir):
    """What each range's tree stands for: one row, as all have the same."""
    got = partitioned_walk.received_mass(views.bodies_emb(spark, sf_dir), SimConfig.of("body", **CONFIG), per_part=FEW)
    return got.select("n", F.round("mass", 6).alias("mass")).distinct()


# ------------------------------------------- massless bodies, box sets, depth cuts

_MASSLESS = "x > 0 and y > 0 and z > 0"
_EMB0 = "e AS " + EMB[len("b AS ") :] + f", b AS (SELECT * REPLACE (CASE WHEN {_MASSLESS} THEN 0.0 ELSE mass END AS mass) FROM e)"
_ACTING = "(SELECT * FROM c WHERE mass > 0) AS c"


def massless(spark, sf_dir: str) -> DataFrame:
    """Bodies of which those in one octant have no mass."""
    return views.bodies_emb(spark, sf_dir).withColumn("mass", F.when(F.expr(_MASSLESS), 0.0).otherwise(F.col("mass")))


@query(SQL["walk_exact_leaves"].replace(EMB, _EMB0).replace("JOIN c ON c.depth", f"JOIN {_ACTING} ON c.depth").replace("FROM (SELECT * FROM far UNION ALL SELECT * FROM near)", "FROM (SELECT * FROM far UNION ALL SELECT * FROM near WHERE mass > 0)"))
def walk_massless(spark, sf_dir):
    """Cells without mass are left out of the walk; their bodies are moved by the others."""
    return rounded(walk.Walk(massless(spark, sf_dir), SimConfig.of("body_exact", **CONFIG)).accelerations(), 5, "ax", "ay", "az", "phi")


CUTS = (0, 1, 2, 3, 21)
_MIDDLES = ", ".join(
    f"d.l{c} + (CAST(list_sum([((c.prefix >> (3 * i + {o})) & 1) << i for i in range({21 - (o > 0)})]) AS BIGINT) + 0.5) * (d.s / (1 << c.depth)) AS m{c}" for o, c in enumerate("xyz")
)
_BOX_GAP = " + ".join(f"greatest(0, b.l{c} - (c.m{c} + c.side / 2), (c.m{c} - c.side / 2) - b.h{c}) ** 2" for c in "xyz")
_ACCOUNT = (
    catalog._with(_EMB0, DOM, KEYED, catalog.ALL, catalog._tree(8), catalog._PARTED)
    + f""", bs AS (SELECT part, key >> 60 AS o, {", ".join(f"{f}({x}) AS {n}{x}" for f, n in (("min", "l"), ("max", "h")) for x in "xyz")} FROM kp GROUP BY part, o),
  cm AS (SELECT c.depth, c.prefix, c.n, c.mass, c.is_leaf, d.s / (1 << c.depth) AS side, {_MIDDLES} FROM c, d),
  ac AS (SELECT c.depth, c.prefix, b.part AS dest, bool_and(c.side ** 2 < 0.7 * 0.7 * ({_BOX_GAP})) AS ok FROM cm AS c, bs AS b GROUP BY ALL),
  w AS (SELECT u.cut, a.dest, c.depth, c.prefix, c.n, c.mass, c.is_leaf, a.ok FROM cm AS c JOIN ac AS a USING (depth, prefix), (VALUES {", ".join(f"({k})" for k in CUTS)}) AS u(cut) WHERE c.depth = 0
    UNION ALL
    SELECT w.cut, w.dest, c.depth, c.prefix, c.n, c.mass, c.is_leaf, a.ok FROM w JOIN cm AS c ON c.depth = w.depth + 1 AND c.prefix >> 3 = w.prefix JOIN ac AS a ON a.depth = c.depth AND a.prefix = c.prefix AND a.dest = w.dest
    WHERE NOT w.ok AND NOT w.is_leaf AND w.depth < w.cut AND w.mass > 0),
  z AS (SELECT *, CASE WHEN NOT mass > 0 THEN 'skipped' WHEN ok THEN 'far' WHEN is_leaf THEN 'near' WHEN depth = cut THEN 'cut' ELSE 'opened' END AS state FROM w)
  SELECT CAST(cut AS INTEGER) AS max_depth, CAST(dest AS INTEGER) AS dest, state, CAST(sum(n) AS BIGINT) AS n, round(sum(mass), 6) AS mass FROM z WHERE state <> 'opened' GROUP BY cut, dest, state"""
)


@query(_ACCOUNT)
def essential_account(spark, sf_dir):
    """Bodies and mass by state, for destinations of several boxes, box to box, at several depth cuts."""
    bodies = massless(spark, sf_dir)
    dom = cubic_domain(bodies)
    placed = catalog._parted(keyed(bodies, dom))
    cells = tree(placed, 8, domain=dom)
    boxes = essential.part_boxes(placed.withColumn("_o", F.shiftright("key", 60)), "_o")
    out = None
    for k in CUTS:
        found = essential.interactions(cells, boxes, 0.7, dom.span, max_depth=k, domain=dom)
        one = essential.account(found).select(F.lit(k).alias("max_depth"), "dest", "state", "n", F.round("mass", 6).alias("mass"))
        out = one if out is None else out.unionByName(one)
    return out


@query(_ACCOUNT.rpartition("SELECT CAST(cut AS INTEGER)")[0] + " SELECT CAST(dest AS INTEGER) AS dest, CAST(depth AS INTEGER) AS depth, prefix, n, is_leaf, ok AS accepted FROM z WHERE cut = 21 AND state IN ('far', 'near')")
def essential_box_sets(spark, sf_dir):
    bodies = massless(spark, sf_dir)
    dom = cubic_domain(bodies)
    placed = catalog._parted(keyed(bodies, dom))
    boxes = essential.part_boxes(placed.withColumn("_o", F.shiftright("key", 60)), "_o")
    return essential.records(tree(placed, 8, domain=dom), boxes, 0.7, dom.span, domain=dom).select("dest", "depth", "prefix", "n", "is_leaf", "accepted")
