"""Exact sums in blocks: against plain arrays, and without a row for each pair."""

import contextlib
import io

import numpy as np
import pytest

from orbitalis.operators import direct

STATE = "id long, mass double, x double, y double, z double"


def bodies(spark, n=130):
    r = np.random.default_rng(3)
    places = r.random((n, 3)).round(1)  # some coincide
    return spark.createDataFrame([(i, float(1 + i % 5), *map(float, p)) for i, p in enumerate(places)], STATE)


def brute(df, eps2):
    a = df.toPandas().sort_values("id")
    p, m = a[["x", "y", "z"]].to_numpy(), a["mass"].to_numpy()
    d = p[None] - p[:, None]
    q = (d * d).sum(2) + eps2
    np.fill_diagonal(q, np.inf)
    q[q == 0] = np.inf
    return (d * (m * q**-1.5)[..., None]).sum(1), -(m / np.sqrt(q)).sum(1), m


def plan(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("softening", [0.0, 0.1])
def test_blocks_hold_all_pairs(spark, monkeypatch, softening):
    monkeypatch.setattr(direct, "_CHUNK", 3)
    monkeypatch.setattr(direct, "_TILE", (2, 2))
    b = bodies(spark)
    acc, phi, mass = brute(b, softening**2)
    got = direct.accelerations(b.repartition(5), softening, 2.0).toPandas().sort_values("id")
    assert np.allclose(got[["ax", "ay", "az"]], 2 * acc) and np.allclose(got["phi"], 2 * phi)
    energy = direct.potential_energy(b, softening).first()[0]
    assert energy == pytest.approx((mass * phi).sum() / 2)


def test_no_row_for_a_pair(spark):
    b = bodies(spark, 40)
    for df in (direct.accelerations(b, 0.1), direct.potential_energy(b)):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_bodies_without_a_place_or_others(spark):
    one = spark.createDataFrame([(1, 2.0, 0.0, 0.0, 0.0)], STATE)
    assert tuple(direct.accelerations(one).first()) == (1, 0.0, 0.0, 0.0, 0.0)
    assert direct.potential_energy(one).first()[0] == 0.0 and direct.potential_energy(one.where("id = 2")).first()[0] == 0.0
    lost = one.unionByName(spark.createDataFrame([(2, 1.0, 1.0, None, 0.0), (3, 1.0, 2.0, 0.0, 0.0)], STATE))
    got = {r["id"]: r["phi"] for r in direct.accelerations(lost).collect()}
    assert got == {1: -0.5, 2: 0.0, 3: -1.0}


def test_virial_needs_no_forces(spark, monkeypatch):
    from orbitalis.plans import more_queries
    from tests.oracle import DATA

    monkeypatch.setattr(direct, "accelerations", None)
    n = spark.read.parquet(f"{DATA}/customer.parquet").count()
    assert more_queries.plummer_virial(spark, DATA).collect() == [(True, n)]


@pytest.mark.parametrize("softenings", [(0.1,), (0.1, 0.0, 1e-2)])
def test_pairs_are_met_once_for_all_softenings(spark, monkeypatch, softenings):
    monkeypatch.setattr(direct, "_CHUNK", 7)
    b = bodies(spark)
    got = direct.by_softenings(b, softenings, 2.0).toPandas().sort_values("id")
    for i, eps in enumerate(softenings):
        assert np.allclose(got[[f"a{c}{i}" for c in "xyz"]], 2 * brute(b, eps**2)[0])


def test_softening_error_sums_once(spark, monkeypatch):
    from orbitalis.plans import more_queries
    from tests.oracle import DATA

    steps = []
    acted = direct._acted
    monkeypatch.setattr(direct, "_acted", lambda *a: steps.append(1) or acted(*a))
    more_queries.softening_error(spark, DATA)
    assert len(steps) == 1
