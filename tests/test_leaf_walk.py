"""The partitioned walk of leaves: interaction by interaction that of the relational one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitalis.operators import leaf_walk, walk
from orbitalis.plans.config import SimConfig
from orbitalis.sources import generate

NAMES = ["ax", "ay", "az", "phi"]


def bodies(spark):
    """A sphere, bodies at one place (some in other ranges than the rest) and some without mass."""
    some = generate.plummer(spark, 110, 7).select("id", "mass", "x", "y", "z")
    same = spark.range(1000, 1040).select("id", F.lit(0.01).alias("mass"), *(F.lit(0.25).alias(c) for c in "xyz"))
    far = spark.range(2000, 2012).select("id", F.lit(0.0).alias("mass"), *((F.col("id") % 4 * 0.01 + 9.0).alias(c) for c in "xyz"))
    return some.unionByName(same).unionByName(far)


@pytest.mark.parametrize("theta", [0.5, 1.5])
def test_leaves_in_ranges_give_the_same(spark, theta):
    config = SimConfig.of("leaf_box", theta=theta, softening=0.05, leaf_size=4, gravity=2.0)
    got = leaf_walk.accelerations(bodies(spark), config, per_part=12).toPandas().sort_values("id")
    w = walk.Walk(bodies(spark), config)
    want = w.accelerations().toPandas().sort_values("id")
    assert list(got["id"]) == list(want["id"]) and np.allclose(got[NAMES], want[NAMES], rtol=1e-9, atol=1e-9)
    approx, direct = w.counts().first()
    assert (got["n_approx"].sum(), got["n_direct"].sum()) == (approx, direct) and direct > 0


def test_queries_walk_no_frontier_of_rows(spark, monkeypatch):
    from orbitalis.plans import catalog, more_queries
    from tests.oracle import DATA

    monkeypatch.setattr(walk, "Walk", None)
    assert more_queries.walk_leafbox_accel(spark, DATA).count() == 500
    assert catalog.walk_leafbox(spark, DATA).first().n_approx > 0


def test_no_bodies(spark):
    assert leaf_walk.accelerations(bodies(spark).limit(0), SimConfig.of("leaf_box")).count() == 0


def test_runs_take_it_from_a_number_of_bodies_on(spark, monkeypatch):
    from orbitalis.plans import simulate

    config = SimConfig.of("leaf_box", softening=0.05, arrow_from=100)
    want = walk.Walk(bodies(spark), config).accelerations().toPandas().sort_values("id")
    monkeypatch.setattr(walk, "Walk", None)
    got = simulate.accelerations(bodies(spark), config).toPandas().sort_values("id")
    assert np.allclose(got[NAMES], want[NAMES], rtol=1e-9, atol=1e-9)
