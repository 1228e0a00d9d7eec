import pytest

from orbitalis.operators import cells, domain, partition
from orbitalis.plans import more_queries
from orbitalis.plans.catalog import SQL
from orbitalis.sources import generate
from tests.oracle import assert_same


def greedy(rows, budget):
    """Plain form: the most populous cell that stands is opened while its children fit."""
    kids, inner = {}, {(r["depth"], r["prefix"]): r["n"] for r in rows if not r["is_leaf"]}
    size = {(r["depth"], r["prefix"]): r["n"] for r in rows}
    for d, p in size:
        kids.setdefault((d - 1, p >> 3), []).append((d, p))
    stand = {(0, 0)} & set(size)
    while True:
        best = min(((-inner[c], c) for c in stand if c in inner), default=None)
        if best is None or len(stand) - 1 + len(kids[best[1]]) > budget:
            return sorted((d, p, size[d, p]) for d, p in stand)
        stand = stand - {best[1]} | set(kids[best[1]])


def test_frontier_is_that_of_plain_opening(spark):
    for bodies in (generate.collision(spark, 400, 2), generate.uniform_cube(spark, 300)):
        tree = cells.tree(domain.keyed(bodies, domain.cubic_domain(bodies)), 4).cache()
        rows = tree.collect()
        for budget in (1, 7, 8, 9, 50, 10_000):
            assert partition.frontier_cells(tree, budget) == greedy(rows, budget), budget
    assert partition.frontier_cells(tree.where("depth < 0"), 5) == []


@pytest.mark.parametrize("name", ["frontier_of_tree", "owned_ranges", "sunbound_element_files", "element_files"])
def test_queries_match_sql(spark, name):
    assert_same(spark, getattr(more_queries, name), SQL[name])


def test_check_mode(spark, tmp_path):
    from orbitalis.__main__ import main

    out = lambda name: f"file://{tmp_path}/{name}"
    main(["generate", "--n", "60", "--out", out("b.tab"), "--format", "preamble"], spark)
    (tmp_path / "c.toml").write_text('dialect = "body"\ntheta = 0.9\nsteps = 1\nleaf_size = 4\n')
    said = [main(["run", out("b.tab"), "--config", out("c.toml"), "--out", out("r"), "--check", most], spark)[0] for most in ("0.5", "1e-9")]
    assert said[0].startswith("[CHECK] passed: error ") and said[1].startswith("[CHECK] failed: error ")
