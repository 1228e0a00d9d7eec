"""Limits of the energy of all pairs, and what they decide."""

import numpy as np
import pytest

from orbitalis.operators import direct, energy_bounds
from orbitalis.sources import generate
from tests.oracle import DATA

STATE = "id long, mass double, x double, y double, z double"


def table(spark, mass, pos):
    return spark.createDataFrame([(i, float(m), *map(float, p)) for i, (m, p) in enumerate(zip(mass, pos, strict=True))], STATE)


def sets(name):
    """Masses and places."""
    r = np.random.default_rng(11)
    mass = r.random(300) + 0.1
    if name == "even":
        return mass, r.random((300, 3))
    if name == "clumps":  # some far off, some dense, all far from 0
        return mass, r.normal(size=(300, 3)) * 10.0 ** -r.integers(0, 5, (300, 1)) + 1e3
    if name == "outlier":  # all others have one key
        return mass, np.concatenate((r.random((299, 3)), [[1e9, 0, 0]]))
    return np.where(r.random(300) < 0.2, 0.0, mass), r.random((300, 3)).round(1)  # many at one place, some without mass


def brute(mass, pos):
    d = np.sqrt(((pos[None] - pos[:, None]) ** 2).sum(2))
    d[d == 0] = np.inf
    return -(mass[:, None] * mass / d).sum() / 2


def no_sum(*a, **k):
    raise AssertionError("the sum over all pairs isn't needed")


@pytest.mark.parametrize("name", ["even", "clumps", "outlier", "places"])
@pytest.mark.parametrize("per_part", [20, 1000])
def test_limits_hold_the_sum(spark, monkeypatch, name, per_part):
    monkeypatch.setattr(energy_bounds, "_LEAF", 3)
    monkeypatch.setattr(energy_bounds, "_FRONT", 500)
    monkeypatch.setattr(energy_bounds, "_TILE", 100)
    mass, pos = sets(name)
    want, bodies, width = brute(mass, pos), table(spark, mass, pos), []
    for theta in (0.7, 0.3):
        least, most = energy_bounds.potential_bounds(bodies, 2.0, theta, per_part).first()
        assert least <= 2 * want <= most <= 0
        width.append(most - least)
    assert width[1] <= width[0] and width[1] < 0.1 * abs(2 * want)


def test_each_pair_is_met_once(spark):
    """With an angle at which no boxes but those of single bodies are far the limits are the sum."""
    mass, pos = sets("places")
    for per_part in (15, 1000):
        least, most = energy_bounds.potential_bounds(table(spark, mass, pos), theta=1e-4, per_part=per_part).first()
        assert least == pytest.approx(brute(mass, pos), rel=1e-8) and most == pytest.approx(brute(mass, pos), rel=1e-8)


def test_boxes_allow_for_all_that_bodies_may_do(monkeypatch):
    """A box of two bodies in line with a third, and across it: the worst that can be."""
    monkeypatch.setattr(energy_bounds, "_LEAF", 2)
    for ends in ([[-0.49, 0, 0], [0.49, 0, 0]], [[0, -0.49, 0], [0, 0.49, 0]], [[-0.245, 0, 0], [0.49, 0, 0]]):
        two, one = energy_bounds.Boxes(np.array([1.0, 1.0]), np.array(ends)), energy_bounds.Boxes(np.array([3.0]), np.array([[1.0, 0, 0]]))
        e = energy_bounds.Energy(0.99, 0.0)
        e.add(two, one)
        want = sum(3 / np.linalg.norm(np.array(p) - [1.0, 0, 0]) for p in ends)
        assert 0 < abs(want - e.sum) <= e.off


@pytest.mark.parametrize("n", [2, 7, 8])
def test_of_two_ranges_one_sends(n):
    r = np.random.default_rng(n)
    low = r.random((n, 4, 3))
    places = [(k + 3, low[k], low[k] + r.random((4, 3)) * (4.0 if k % 3 == 0 else 0.01)) for k in range(n)]
    first = energy_bounds.first_sends(places)
    assert first
    sends = {(k, to) for k in range(n) for to in energy_bounds.receivers(n, k, first)}
    assert all(((a, b) in sends) != ((b, a) in sends) for a in range(n) for b in range(a))


def test_scattered_ranges_send():
    """Bodies all around a dense core don't get the core's bodies, whatever the turn."""
    core = (0, np.zeros((1, 3)), np.ones((1, 3)))
    around = (1, np.array([[-9.0, -9, -9], [0, 0, 0]]), np.array([[0.0, 0, 0], [9, 9, 9]]))
    assert energy_bounds.first_sends([core, around]) == {(0, 1): False}
    assert energy_bounds.first_sends([around, core]) == {(0, 1): True}


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_ranges_may_be_more_or_fewer_than_asked_for(spark, monkeypatch, ranges):
    """A session may deal rows to another number of partitions."""
    mass, pos = sets("even")
    bodies = table(spark, mass, pos)
    deal = type(bodies).repartitionByRange
    monkeypatch.setattr(type(bodies), "repartitionByRange", lambda df, n, *cols: deal(df, ranges, *cols))
    least, most = energy_bounds.potential_bounds(bodies, theta=1e-4, per_part=30).first()
    assert least == pytest.approx(brute(mass, pos), rel=1e-8) and most == pytest.approx(brute(mass, pos), rel=1e-8)


def test_none_one_and_wrong_bodies(spark):
    one = table(spark, [2.0], [[1, 2, 3]])
    assert tuple(energy_bounds.potential_bounds(one).first()) == (0.0, 0.0) == tuple(energy_bounds.potential_bounds(one.where("id = 5")).first())
    lost = one.unionByName(spark.createDataFrame([(1, 3.0, 1.0, None, 0.0), (None, 3.0, 0.0, 0.0, 0.0), (3, 4.0, 1.0, 2.0, 7.0)], STATE))
    assert energy_bounds.potential_bounds(lost).first() == pytest.approx((-2.0, -2.0))
    with pytest.raises(ValueError, match="negative"):
        energy_bounds.potential_bounds(table(spark, [1.0, -1.0], [[0, 0, 0], [1, 0, 0]]))


def test_what_limits_do_not_decide_is_summed(spark, monkeypatch):
    monkeypatch.setattr(energy_bounds, "_LEAF", 3)
    bodies = generate.plummer(spark, 200, 3)
    kinetic = bodies.selectExpr("sum(mass * (vx * vx + vy * vy + vz * vz))").first()[0]
    a = bodies.toPandas()
    ratio = float(kinetic / -brute(a["mass"].to_numpy(), a[["x", "y", "z"]].to_numpy()))
    summed, whole = [], direct.potential_energy
    monkeypatch.setattr(direct, "potential_energy", lambda *b, **k: summed.append(1) or whole(*b, **k))
    for low, high, want in ((ratio - 1e-10, 9.0, True), (ratio + 1e-10, 9.0, False), (0.0, ratio + 1e-10, True), (0.0, ratio - 1e-10, False)):
        assert energy_bounds.virial_between(bodies, low, high, per_part=50) is want
    assert len(summed) == 4
    monkeypatch.setattr(direct, "potential_energy", no_sum)
    for low, high, want in ((ratio - 0.15, ratio + 0.15, True), (ratio + 0.15, 9.0, False), (0.0, ratio - 0.15, False)):
        assert energy_bounds.virial_between(bodies, low, high, per_part=50) is want


def test_virial_needs_no_sum_over_all_pairs(spark, monkeypatch):
    from orbitalis.plans import more_queries

    monkeypatch.setattr(direct, "potential_energy", no_sum)
    n = spark.read.parquet(f"{DATA}/customer.parquet").count()
    assert more_queries.plummer_virial(spark, DATA).collect() == [(True, n)]
