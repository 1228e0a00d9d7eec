"""Leaves from neighbours in key order: those of the tree, whatever the ranges."""

import pytest
from pyspark.sql import functions as F

from jobs import decompose
from orbitalis.operators import cells, key_ranges
from orbitalis.operators.domain import cubic_domain, keyed
from orbitalis.sources import generate

KEPT = ("depth", "prefix", "n", "mass", "cx", "cy", "cz", "is_leaf")


def clumps(spark):
    """A sphere, and many bodies at a few places."""
    some = generate.plummer(spark, 150, 7).select("id", "mass", "x", "y", "z")
    same = spark.range(1000, 1090).select("id", F.lit(0.5).alias("mass"), *((F.col("id") % 3 * 0.125).alias(c) for c in "xyz"))
    return some.unionByName(same)


@pytest.mark.parametrize("capacity, per_range", [(1, 40), (5, 20), (16, 1_000), (400, 100)])
def test_leaves_and_cells_are_those_of_the_tree(spark, monkeypatch, capacity, per_range):
    monkeypatch.setattr(key_ranges, "PER_RANGE", per_range)
    b = clumps(spark)
    dom = cubic_domain(b)
    placed = keyed(b, dom)
    tree = cells.tree(placed, capacity, domain=dom)
    got = key_ranges.with_leaf_depth(b, dom, b.count(), capacity)
    rows = got.select("id", "key", "leaf_depth").collect()
    assert [r.key for r in rows] == sorted(r.key for r in rows)  # in order
    assert {r.id: r.leaf_depth for r in rows} == {r.id: r.leaf_depth for r in cells.with_leaf(placed, tree).collect()} and len(rows) == 240
    near = lambda df: sorted((r.depth, r.prefix, r.n, r.is_leaf, *(round(r[c], 9) + 0.0 for c in KEPT[3:7])) for r in df.collect())
    assert near(decompose.cells_of(got, dom)) == near(tree)


def test_decompose_makes_one_exchange_of_bodies(spark, monkeypatch, tmp_path):
    """The bodies' way to their parts: no tree is made first, nor are they joined with one."""
    monkeypatch.setattr(cells, "tree", None)
    monkeypatch.setattr(cells, "with_leaf", None)
    done = decompose.run(spark, "/root/testdata/sf0.001/lineitem.parquet", f"file://{tmp_path}/out")
    assert done["bodies"] and done["cells"] and spark.conf.get("spark.sql.shuffle.partitions") == "4"
