"""Connected components of a link table by alternating star contraction.

Each round points the neighbours of a node that are larger than it (large
stars), then those that are smaller (small stars), at the smallest node around,
until all links are stars.  Every step is a grouped minimum and a join; nothing
is gathered on the driver but one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitalis.llm.storage import materialize

_ROWS_PER_FILE = 200_000


def _toward_smallest(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v): each v around u is linked with the smallest of u and its v.

    The minima are written before the join.  So both of its sides come straight out
    of an exchange, and adaptive execution can split a node with very many
    neighbours over tasks.
    """
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
    linked = pairs.join(least, "u")
    out = linked.where("v > u").select("v", "m") if large else linked.select("v", "m").union(least.select(F.col("u").alias("v"), "m"))
    return out.where("v <> m").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and comp (the smallest node of its component) for all nodes but the smallest.

    Null nodes are no nodes: their links are left out.  Links of a node with itself
    and repeated links change nothing; no links give no rows.
    """
    good = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = materialize(good.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where("v <> m").distinct(), "links")
    state, files = None, max(4, -(-edges.count() // _ROWS_PER_FILE))  # rounds don't add links
    while True:
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("v")).union(edges.select(F.col("m").alias("u"), "v"))
        edges = materialize(_toward_smallest(both, True).coalesce(files), "links")
        edges = _toward_smallest(edges.select(F.col("v").alias("u"), F.col("m").alias("v")), False)
        edges = materialize(edges.coalesce(files), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "m"))).first()
        if now == state:
            return edges.select(F.col("v").alias("node"), F.col("m").alias("comp"))
        state = now
