"""Second moments against two-pass sums, in one step and in bands of levels."""

import numpy as np
import pytest

from orbitalis.operators import cells, domain

STATE = "id long, mass double, x double, y double, z double"


def clusters(seed=5, n=400):
    """Clumps of very different widths, far apart, some bodies at one place."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        width = 10.0 ** -rng.integers(0, 7)
        middle = np.array([0.7, -0.9, 0.3]) * (i % 4)
        x = middle + width * rng.random(3) if i % 9 else middle
        out.append((i, 0.5 + float(rng.random()), *map(float, x)))
    return out


@pytest.mark.parametrize(("digit", "step"), [(3, None), (3, 1), (3, 2), (1, None), (1, 6)])
def test_moments_of_a_tree(spark, digit, step):
    b = spark.createDataFrame(clusters(), STATE)
    placed = domain.keyed(b, domain.cubic_domain(b)).cache()
    plain = cells.tree(placed, 6, 21 * 3 // digit, digit).cache()
    got = cells.second_moments(plain, cells.with_leaf(placed, plain, 21 * 3 // digit, digit), digit, step=step).collect()
    assert len(got) == plain.count()
    p = placed.toPandas()
    key = p.key.to_numpy(np.int64)
    for r in got:
        inside = p[(key >> (63 - digit * r["depth"])) == r["prefix"]]
        x, m = inside[["x", "y", "z"]].to_numpy(float), inside.mass.to_numpy(float)
        d = x - (m[:, None] * x).sum(0) / m.sum()
        want = np.einsum("i,ij,ik->jk", m, d, d)
        near = 1e-9 * abs(want).max() + 1e-28
        assert all(r[a] == pytest.approx(want[i, j], rel=1e-6, abs=near) for a, i, j in (("xx", 0, 0), ("yy", 1, 1), ("zz", 2, 2), ("xy", 0, 1), ("xz", 0, 2), ("yz", 1, 2)))


def test_trees_of_one_and_no_bodies(spark):
    for rows in ([], [(1, 2.0, 0.1, 0.2, 0.3)]):
        b = spark.createDataFrame(rows, STATE)
        got = cells.tree(domain.keyed(b, domain.cubic_domain(b)), 4, second=True).collect()
        assert [(r.depth, r.xx, r.yz) for r in got] == [(0, 0.0, 0.0)] * len(rows)
