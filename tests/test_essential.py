"""Partitioned walks and essential trees: exactness, mass, odd tables, numbers of jobs."""

import uuid

import numpy as np
import pytest

from orbitalis.operators import arrow_walk, cells, direct, essential, partitioned_walk
from orbitalis.operators.domain import cubic_domain, keyed
from orbitalis.plans.config import SimConfig
from orbitalis.sources import generate

STATE = "id long, mass double, x double, y double, z double, vx double, vy double, vz double"


def table(spark, rows):
    return spark.createDataFrame([(i, float(m), *map(float, p), 0.0, 0.0, 0.0) for i, m, p in rows], STATE)


def by_id(df):
    return df.toPandas().sort_values("id", ignore_index=True)


def same(got, want):
    got, want = by_id(got), by_id(want)
    assert (got.id == want.id).all() and (got.n_approx == want.n_approx).all() and (got.n_direct == want.n_direct).all()
    for c in ("ax", "ay", "az", "phi"):
        assert np.allclose(got[c], want[c], rtol=1e-9, atol=1e-12 * (abs(want[c]).max() or 1))


@pytest.mark.parametrize(
    ("dialect", "more"),
    [("body", {"theta": 0.5}), ("body", {"theta": 1.2, "leaf_size": 1}), ("body_soft", {"softening": 0.2}), ("body_exact", {"theta": 0.9}), ("body", {"theta": 0.7, "max_depth": 3}), ("body", {"theta": 0.8, "digit": 1}), ("body", {"theta": 0.0})],
)
@pytest.mark.parametrize("per_part", [40, 10_000])
def test_ranges_walk_as_the_whole_tree_is_walked(spark, dialect, more, per_part):
    b = generate.collision(spark, 700, 3)
    config = SimConfig.of(dialect, **more)
    same(partitioned_walk.accelerations(b, config, per_part=per_part), arrow_walk.accelerations(b, config))
    if per_part == 40:
        total = b.agg({"mass": "sum"}).first()[0]
        got = partitioned_walk.received_mass(b, config, per_part=per_part).collect()
        assert len(got) >= 8 and all(r.n == 700 and r.mass == pytest.approx(total) for r in got)


def test_coincident_and_few_bodies(spark):
    config = SimConfig.of("body", theta=0.6, softening=0.01)
    rng = np.random.default_rng(1)
    clump = [(i, 1, (0.25, 0.5, 0.75)) for i in range(150)] + [(200 + i, 2, rng.random(3)) for i in range(60)]
    for rows in (clump, clump[:5], clump[:1], [(7, 1.0, (0, 0, 0)), (9, 3.0, (4, 0, 0))]):
        b = table(spark, rows)
        same(partitioned_walk.accelerations(b, config, per_part=20), arrow_walk.accelerations(b, config))
    assert partitioned_walk.accelerations(table(spark, []), config).count() == 0
    with pytest.raises(ValueError, match="targets"):
        partitioned_walk.accelerations(table(spark, clump), SimConfig.of("bucket"))


@pytest.mark.parametrize("max_depth", [0, 1, 2, 3, 21])
def test_what_is_received_has_the_mass_of_all(spark, max_depth):
    b = generate.collision(spark, 400, 9)
    dom = cubic_domain(b)
    placed = keyed(b, dom).withColumn("part", (b["id"] % 3).cast("int")).cache()
    tree = cells.tree(placed, 4, domain=dom).cache()
    total = b.agg({"mass": "sum"}).first()[0]
    for boxes in (essential.part_boxes(placed), essential.part_boxes(placed.withColumn("o", placed["key"] % 5), "o")):
        for domain in (None, dom):
            sent = essential.records(tree, boxes, 0.6, dom.span, max_depth=max_depth, domain=domain).cache()
            got = {r.dest: r for r in sent.groupBy("dest").agg({"n": "sum", "mass": "sum"}).collect()}
            assert set(got) == {0, 1, 2} and all(r["sum(n)"] == 400 and r["sum(mass)"] == pytest.approx(total) for r in got.values())
            assert sent.select("dest", "depth", "prefix").distinct().count() == sent.count()


def parts(spark, n, k):
    b = generate.plummer(spark, n, 4)
    dom = cubic_domain(b)
    return keyed(b, dom).withColumn("part", (b["id"] % k).cast("int")), dom


def test_parts_that_open_everything_are_exact(spark):
    config = SimConfig.of("body", theta=0.0, softening=0.05)
    placed, dom = parts(spark, 120, 5)
    got, want = by_id(essential.accelerations(placed, config, dom)), by_id(direct.accelerations(placed, 0.05))
    for c in ("ax", "ay", "az", "phi"):
        assert np.allclose(got[c], want[c], rtol=1e-9, atol=1e-10)


def test_jobs_do_not_grow_with_parts(spark):
    config, used = SimConfig.of("body", theta=0.5, leaf_size=4, max_depth=4), []
    for k in (2, 9):
        placed, dom = parts(spark, 90, k)
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "count")
        essential.accelerations(placed, config, dom).count()
        used.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        spark.sparkContext.setJobGroup("", "")
    assert used[1] <= used[0] + 12  # the depth of trees may differ, by a few levels


def test_tiles_within_parts(spark, monkeypatch):
    placed, _ = parts(spark, 90, 3)
    records = placed.select((2 - placed["part"]).alias("dest"), "mass", *(placed[c].alias("c" + c) for c in "xyz"))
    want = by_id(direct.by_records(placed, records, 0.1, part="part"))
    monkeypatch.setattr(direct, "_BROADCAST_ROWS", 5)
    whole = direct.pairs
    monkeypatch.setattr(direct, "pairs", lambda *a, **k: whole(*a, **{**k, "block_rows": 7}))
    got = by_id(direct.by_records(placed, records, 0.1, part="part"))
    assert len(got) == 90 and np.allclose(got[["ax", "ay", "az", "phi"]], want[["ax", "ay", "az", "phi"]])


def test_exact_parts_are_not_walked(spark, monkeypatch):
    """At opening angle 0 a walk would make a row for each body and cell of a part."""
    config = SimConfig.of("body", theta=0.0, softening=0.05)
    placed, dom = parts(spark, 70, 2)
    monkeypatch.setattr(essential.walk, "Walk", None)
    got, want = by_id(essential.accelerations(placed, config, dom, 0.2)), by_id(direct.accelerations(placed, 0.05))
    assert np.allclose(got[["ax", "ay", "az", "phi"]], want[["ax", "ay", "az", "phi"]], rtol=0.05, atol=0.05)
