import base64
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitalis.functions import durations, geometry, keys
from orbitalis.operators import arrow_walk, cells, direct, domain, elements, essential, motion, partition, walk
from orbitalis.plans import simulate
from orbitalis.plans.config import SimConfig
from orbitalis.sources import binary, generate, tables, writers

STATE = tables.STATE


def two(spark, m=3.0, d=4.0):
    return spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, m, d, 0.0, 0.0, 0.0, 0.0, 0.0)], STATE)


def exact_numpy(p, eps=0.0):
    x, m = p[["x", "y", "z"]].to_numpy(), p["mass"].to_numpy()
    d = x[None] - x[:, None]
    r2 = (d * d).sum(-1) + eps**2
    np.fill_diagonal(r2, np.inf)
    return (d * (m[None] * r2**-1.5)[..., None]).sum(1)


def test_pair_kernel(spark):
    a = {r["id"]: r for r in direct.accelerations(two(spark), gravity=2.0).collect()}
    assert a[0]["ax"] == pytest.approx(2 * 3 / 16, abs=1e-12) and a[0]["ay"] == 0
    soft = direct.accelerations(two(spark), softening=1.0, gravity=2.0).where("id = 0").first()["ax"]
    assert soft < a[0]["ax"]
    assert direct.potential_energy(two(spark)).first()[0] == pytest.approx(-3 / 4)


def test_zero_angle_is_the_direct_sum(spark):
    b = generate.uniform_cube(spark, 120, half=10).cache()
    exact = direct.accelerations(b, 1e-3)
    for dialect in ("body", "body_exact", "leaf_box", "bucket"):
        w = walk.Walk(b, SimConfig.of(dialect, theta=0.0, softening=1e-3, leaf_size=4, quadrupole=False))
        assert motion.acceleration_error(w.accelerations(), exact).first()["largest"] < 1e-8
        c = w.counts().first()
        # a bucket of one body has no radius: its mass point is the body itself
        assert c["n_approx"] + c["n_direct"] == 120 * 119 and (dialect == "bucket" or c["n_approx"] == 0)


def test_errors_fall_with_the_angle_and_arrow_agrees(spark):
    b = generate.plummer(spark, 400, 2).cache()
    exact = direct.accelerations(b, 1e-3).cache()
    last = np.inf
    for theta in (1.0, 0.5, 0.25):
        config = SimConfig.of("body", theta=theta, softening=1e-3, leaf_size=4)
        got = arrow_walk.accelerations(b, config).cache()
        rms = motion.acceleration_error(got, exact).first()["rms"]
        assert rms < last
        last = rms
    assert last < 1e-2
    w = walk.Walk(b, config)
    assert motion.acceleration_error(w.accelerations(), got).first()["largest"] < 1e-10
    assert w.counts().first().asDict() == got.agg(F.sum("n_approx").alias("n_approx"), F.sum("n_direct").alias("n_direct")).first().asDict()


def test_second_moments_of_small_cells(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 1.0 + float(m), *(0.9 + 1e-6 * x).tolist(), 0.0, 0.0, 0.0) for i, (m, x) in enumerate(zip(rng.random(40), rng.random((40, 3)), strict=True))] + [(99, 1.0, -1.0, -1.0, -1.0, 0.0, 0.0, 0.0), (98, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0)]
    b = spark.createDataFrame(rows, STATE)
    dom = domain.cubic_domain(b)
    for digit, depth in ((3, 21), (1, 63)):
        placed = domain.keyed(b, dom).cache()
        got = cells.all_cells(placed, depth, digit, second=True, domain=dom).where("n > 5").collect()
        p = placed.toPandas()
        for r in got:
            inside = p[(p.key.to_numpy(np.int64) >> (63 - digit * r["depth"])) == r["prefix"]]
            x, m = inside[["x", "y", "z"]].to_numpy(float), inside.mass.to_numpy(float)
            c = (m[:, None] * x).sum(0) / m.sum()
            want = np.einsum("i,ij,ik->jk", m, x - c, x - c)
            assert r["n"] == len(inside) and r["xx"] == pytest.approx(want[0, 0], rel=1e-6) and r["yz"] == pytest.approx(want[1, 2], rel=1e-5, abs=1e-9 * abs(want).max())


def test_second_moments_help(spark):
    b = generate.two_clusters(spark, 200).cache()
    exact = direct.accelerations(b, 1e-3).cache()
    rms = [motion.acceleration_error(walk.Walk(b, SimConfig.of("leaf_box", theta=0.6, softening=1e-3, leaf_size=4, quadrupole=q)).accelerations(), exact).first()["rms"] for q in (False, True)]
    assert rms[1] < rms[0]


def test_all_mass_acts_once_and_guard_holds(spark):
    b = generate.collision(spark, 200, 4).cache()
    total = b.agg(F.sum("mass")).first()[0]
    got = walk.Walk(b, SimConfig.of("body", theta=1.2, leaf_size=1)).interacted_mass().join(b.select("id", F.col("mass").alias("own")), "id")
    assert got.where(F.abs(F.col("mass") + F.col("own") - total) > 1e-12).count() == 0
    assert got.count() == 200


def test_tree_invariants(spark):
    b = generate.collision(spark, 300, 4)
    dom = domain.cubic_domain(b, pad=1e-9)
    placed = domain.keyed(b, dom).cache()
    r = motion.check_tree(placed, cells.tree(placed, 4)).first()
    assert r["n"] == r["root_n"] == r["leaf_n"] == 300 and r["wrong_cells"] == 0
    assert cells.tree(placed, 4).drop("mass", "cx", "cy", "cz").exceptAll(cells.tree_at_once(placed, 4).drop("mass", "cx", "cy", "cz")).count() == 0
    own = cells.with_leaf(placed, cells.tree(placed, 4))
    assert own.count() == 300 and own.where(keys.prefix_at(F.col("key"), F.col("leaf_depth")) != F.col("leaf_prefix")).count() == 0
    assert r["mass"] == pytest.approx(r["leaf_mass"], rel=1e-12)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_degenerate_sets(spark, n):
    b = generate.uniform_cube(spark, n)
    dom = domain.cubic_domain(b)
    tree = cells.tree(domain.keyed(b, dom), 8).collect()
    assert len(tree) == min(n, 1) and all(r["is_leaf"] for r in tree)
    assert walk.Walk(b, SimConfig.of("body")).accelerations().count() == n


def test_coincident_bodies_end_at_the_greatest_depth(spark):
    rows = [(i, 1.0, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0) for i in range(6)] + [(9, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    b = spark.createDataFrame(rows, STATE)
    w = walk.Walk(b, SimConfig.of("body", leaf_size=2, max_depth=5))
    assert w.cells.agg(F.max("depth")).first()[0] == 5
    assert not motion.broken(w.accelerations()).count()


def test_energy_is_kept(spark):
    b = generate.plummer(spark, 150, 7)
    _, log = simulate.run(b, SimConfig.of("body", steps=4, dt=0.01, softening=0.05, strategy="arrow", theta=0.3))
    rows = log.collect()
    assert max(r["rel_drift"] for r in rows) < 1e-3 and rows[0]["kinetic"] > 0 > rows[0]["potential"]


@pytest.mark.parametrize("integrator", ["drift_first", "leapfrog_fused", "split_kick"])
def test_integrators(spark, integrator):
    b = two(spark)
    dt = 0.1
    end, _ = simulate.run(b, SimConfig.of("body", algorithm="direct", integrator=integrator, dt=dt, steps=1))
    x = end.where("id = 0").first()["x"]
    first = {"drift_first": 0.0, "leapfrog_fused": dt / 2, "split_kick": dt}[integrator]
    assert x == pytest.approx(3 / 16 * first * dt, abs=1e-12)


def test_compare_with_direct_and_report(spark):
    t = simulate.Timers()
    _, _, err = simulate.compare_with_direct(two(spark), SimConfig.of("body", steps=1, dt=0.01))
    assert err.first()["summed"] < 1e-12
    _, log = simulate.run(two(spark), SimConfig.of("body", steps=1, dt=0.01, algorithm="direct"), timers=t)
    assert "forces" in simulate.report(log, t)["seconds"]


def test_config_is_strict():
    with pytest.raises(ValueError, match="unknown keys"):
        SimConfig.of("body", thetta=1)
    with pytest.raises(ValueError, match="unknown dialect"):
        SimConfig.of("other")
    with pytest.raises(ValueError):
        SimConfig.of("body", theta=-1)
    assert SimConfig.from_toml("theta = 0.7\nsteps = 3").steps == 3
    c = SimConfig.from_namelist("&run\n theta=0.4d0, ! angle\n NT = 5\n quadrupole=.true.\n/", {"nt": "steps"})
    assert (c.theta, c.steps, c.quadrupole) == (0.4, 5, True)


def test_keys(spark):
    rng = np.random.default_rng(0)
    pts = [(int(i), *map(int, rng.integers(0, 1 << 21, 3))) for i in range(200)]
    df = spark.createDataFrame(pts, "id long, ix long, iy long, iz long").withColumn("key", keys.interleave(F.col("ix"), F.col("iy"), F.col("iz")))
    for r in df.withColumns({"b" + c: k for c, k in zip("xyz", keys.decode(F.col("key")), strict=True)}).collect():
        want = sum(((r[f"i{c}"] >> b) & 1) << (3 * b + o) for b in range(21) for o, c in enumerate("xyz"))
        assert r["key"] == want and (r["bx"], r["by"], r["bz"]) == (r["ix"], r["iy"], r["iz"])
    one = df.limit(1).withColumn("p", keys.prefix_at(F.col("key"), 4))
    lo, hi = keys.key_range(F.lit(4), F.col("p"))
    r = one.select("key", lo.alias("lo"), hi.alias("hi"), keys.is_ancestor(F.lit(4), F.col("p"), F.lit(21), F.col("key")).alias("up"), keys.octant(F.col("p")).alias("o"), keys.parent(F.col("p")).alias("q"), "p").first()
    assert r["lo"] <= r["key"] <= r["hi"] and r["up"] and r["q"] * 8 + r["o"] == r["p"]


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 5.0, 1.0, 1.0)], "lx double, ly double, lz double, hx double, hy double, hz double, x double, y double, z double")
    low, high, p = geometry.cols("l"), geometry.cols("h"), geometry.cols()
    r = df.select(geometry.box_volume(low, high).alias("v"), geometry.point_gap2(p, low, high).alias("g"), geometry.box_contains(p, low, high).alias("c"), geometry.box_gap2(low, high, low, high).alias("z")).first()
    assert (r["v"], r["g"], r["c"], r["z"]) == (6.0, 16.0, False, 0.0)


def test_partitioning(spark):
    b = domain.keyed(generate.uniform_cube(spark, 500), domain.Domain((-1.0, -1.0, -1.0), 2.0)).cache()
    hist = partition.key_histogram(b, 9)
    cuts = partition.splitters(hist, 4)
    assert len(cuts) == 3 and cuts == sorted(cuts)
    assert partition.assign_parts(hist, cuts).agg(F.sum("cnt"), F.max("part")).first() == (500, 3)
    sizes = [r["n"] for r in partition.tiles(b, 7).collect()]
    assert sum(sizes) == 500 and max(sizes) - min(sizes) <= 1
    bins = partition.refine_bins(b, 60, 1000)
    assert sum(n for *_, n in bins) == 500 and max(n for *_, n in bins) <= 60
    assert len(partition.refine_bins(b, 60, 6)) <= 6
    tree = cells.tree(b, 8).cache()
    front = partition.frontier_cells(tree, 20)
    assert sum(n for *_, n in front) == 500 and len(front) <= 20
    assert partition.slice_starts(100, 3, 8) == [0, 32, 64]
    assert partition.by_owner(b, 3).count() == 500


def test_essential_trees(spark):
    b = generate.uniform_cube(spark, 300)
    dom = domain.cubic_domain(b)
    placed = domain.keyed(b, dom).withColumn("part", F.when(F.col("x") < 0, 0).otherwise(1)).cache()
    tree = cells.tree(placed, 4).cache()
    sent = essential.records(tree, essential.part_boxes(placed), 0.7, dom.span).cache()
    for r in sent.groupBy("dest").agg(F.sum("n").alias("n")).collect():
        assert r["n"] == 300  # every body is in one record for each part
    near = essential.with_bodies(sent, cells.with_leaf(placed, tree))
    assert near.count() == sent.where("not accepted").agg(F.sum("n")).first()[0]
    grown = essential.merged(tree.select("depth", "prefix", "n", "mass", "cx", "cy", "cz", "is_leaf"), tree.select("depth", "prefix", "n", "mass", "cx", "cy", "cz", "is_leaf"))
    assert grown.where("depth = 0").first()["n"] == 600
    half = cells.with_leaf(placed.where("id % 2 = 0"), tree)
    assert essential.residual(tree, half).agg(F.sum("mass")).first()[0] == pytest.approx(placed.where("id % 2 = 1").agg(F.sum("mass")).first()[0])
    far = direct.by_records(b, sent.where("dest = 0 and accepted"), 0.01)
    assert far.count() == 300


def test_validation(spark):
    bad = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, -1.0, math.nan, 0.0, 0.0, 0.0, 0.0, 0.0), (-2, 1.0, 0.0, None, 0.0, 0.0, 0.0, 0.0)], STATE)
    assert motion.validate(bad).first().asDict() == {"n": 3, "not_finite": 2, "mass_not_positive": 1, "negative_ids": 1, "repeated_ids": 1}
    with pytest.raises(ValueError, match="repeated_ids"):
        motion.require_valid(bad)


def test_blocked_sum_ignores_partitioning(spark):
    b = generate.uniform_cube(spark, 1000)
    got = {motion.blocked_sum(b.repartition(n), "mass", block=64) for n in (1, 3, 7)}
    assert len(got) == 1 and got.pop() == pytest.approx(b.agg(F.sum("mass")).first()[0])


def test_text_sources(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("0,1,0,0,0,0,0,0\n1,2,1,0,0,0,0,0\n")
    assert tables.read_strict(spark, str(tmp_path / "plain.csv")).count() == 2
    (tmp_path / "bad.csv").write_text("id,mass,x\n0,1,0,0,0,0,0,0\nx,2\n1,2,1,0,0,0,0,0\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        tables.read_strict(spark, str(tmp_path / "bad.csv")).collect()
    assert tables.read_tolerant(spark, str(tmp_path / "bad.csv")).count() == 2
    (tmp_path / "named.csv").write_text("id,name,class,mass,pos_x,pos_y,pos_z,vel_x,vel_y,vel_z\n7,a,PLA,1,0,0,0,0,0,0\n8,b,PLA,2,1,0,0,0,0,0\n9,c,PLA,3,2,0,0,0,0,0\n")
    assert [r["id"] for r in tables.read_named(spark, str(tmp_path / "named.csv"), 2).orderBy("id").collect()] == [0, 1]
    (tmp_path / "head.csv").write_text('# comment\nextra,"Pos_X",posY,POS_Z,vel_x,vel_y,vel_z,M,body_id\r\n5,1,2,3,4,5,6,9,3\r\n')
    r = tables.open_bodies(spark, str(tmp_path / "head.csv")).first()
    assert (r["id"], r["mass"], r["x"], r["vz"]) == (3, 9.0, 1.0, 6.0)
    with pytest.raises(ValueError, match="orbital"):
        tables.resolve(spark.createDataFrame([(1.0, 2.0, 3.0)], "e double, om double, ma double"))
    with pytest.raises(ValueError, match="missing column"):
        tables.resolve(spark.createDataFrame([(1.0,)], "x double"))


def test_binary_sources(spark, tmp_path):
    b = generate.uniform_cube(spark, 50, speed=1.0)
    (tmp_path / "a.tab").write_bytes(binary.packed(b, True))
    (tmp_path / "a.bin").write_bytes(binary.packed(b, False))
    for name in ("a.tab", "a.bin"):
        assert motion.distance_error(b, tables.open_bodies(spark, str(tmp_path / name))).first()["summed"] == 0
    (tmp_path / "cut.tab").write_bytes(struct.pack("<iid", 2, 3, 0.0))
    with pytest.raises(Exception, match="don't fit"):
        binary.read_preamble(spark, str(tmp_path / "cut.tab")).collect()
    raw = struct.pack("<I", 16) + np.array([1.5, 2.5]).tobytes()
    doc = f'<VTKFile byte_order="LittleEndian"><DataArray type="Float64" Name="m" format="binary">{base64.b64encode(raw).decode()}</DataArray></VTKFile>'
    assert binary.read_vtu_points(doc)["m"].tolist() == [1.5, 2.5]


def test_writers(spark, tmp_path):
    b = generate.uniform_cube(spark, 20).repartition(2)
    writers.write_state(b, str(tmp_path / "s"), merged=True)
    assert motion.distance_error(b, tables.read_header(spark, str(tmp_path / "s"))).first()["summed"] == 0
    pieces = writers.write_snapshot(b, str(tmp_path / "v"))
    assert len(pieces) == 2 and 'NumberOfPoints="' in (tmp_path / "v" / pieces[0]).read_text()
    assert pieces[0] in writers.piece_index(pieces) and "0.5" in writers.timeline([(0.5, "a")])
    assert binary.read_points(spark, str(tmp_path / "v")).join(b, "id").where("id is null").count() == 0
    writers.write_snapshot(b.coalesce(1), str(tmp_path / "k"), "vtk")
    assert any("POINTS 20 double" in f.read_text() for f in (tmp_path / "k").glob("part*"))
    names = writers.write_appended(b.withColumn("phi", F.lit(-1.0)), str(tmp_path / "raw" / "run"), 7)
    arrays = [binary.read_vtu_points((tmp_path / "raw" / n).read_bytes()) for n in names]
    assert names[0].startswith("run_00007_pe") and sum(len(a["mass"]) for a in arrays) == 20 and (arrays[0]["potential"] == -1).all() and arrays[0]["velocity"].shape[1] == 3
    assert motion.distance_error(b, binary.read_points(spark, str(tmp_path / "raw"))).first().asDict() == {"summed": 0.0, "largest": 0.0, "n": 20}
    assert writers.due(4, 2, 9) and not writers.due(3, 2, 9) and writers.due_at(1.0, 1.0, 0.5) == (True, 1.5)
    assert "[t]\nx = 1" in writers.metrics_toml({"a": 1.5, "t": {"x": 1}})
    writers.write_positions(b, str(tmp_path / "p"))
    assert tables.read_positions(spark, str(tmp_path / "p")).count() == 20
    tree = cells.tree(domain.keyed(b, domain.cubic_domain(b)), 4)
    writers.write_boxes(tree, str(tmp_path / "b"), domain.cubic_domain(b))
    text = "".join(f.read_text() for f in (tmp_path / "b").glob("part*"))
    assert text.count("UnstructuredGrid version") + text.count("</UnstructuredGrid>") >= 1 and "12" in text
    hist = writers.histogram_cells(partition.key_histogram(domain.keyed(b, domain.cubic_domain(b)), 6), 6)
    assert hist.agg(F.sum("n")).first()[0] == 20
    assert writers.graphviz(tree).where("value like '%->%'").count() == tree.count() - 1


def test_generators(spark):
    p = generate.plummer(spark, 300, 5)
    assert motion.distance_error(p, generate.plummer(spark, 300, 5).repartition(3)).first()["summed"] == 0
    assert p.where("x*x + y*y + z*z > 81").count() == 0
    m = generate.mirrored(spark, 100).toPandas().set_index("id")
    assert np.allclose(m.loc[50:, "x"].to_numpy() - m.loc[:49, "x"].to_numpy(), 4)
    assert generate.from_json(spark, '{"n": 10, "kind": "collision"}').count() == 10
    odd = generate.mirrored(spark, 7).agg(F.count("*"), F.sum("mass"), F.sum(F.col("mass") * F.col("x"))).first()
    assert odd[0] == 7 and odd[1] == pytest.approx(1) and abs(odd[2]) < 1e-12
    both = generate.collision(spark, 2000, 3, apart=1000.0, approach=0.0)
    for side in ("x < 0", "x > 0"):  # each sphere is in equilibrium by itself
        one = both.where(side)
        e = motion.energies(one.join(direct.accelerations(one), "id")).first()
        assert e["virial"] == pytest.approx(1, abs=0.1)
    assert both.agg(F.sum("mass")).first()[0] == pytest.approx(1)
    text = """{"seed": 3, "defaults": {"mass": {"particle_min": 1, "particle_max": 2, "black_hole_factor": 10}},
      "systems": [{"name": "main", "particles": 40, "total_mass": 1000, "scale_radius": 3.0, "cutoff_radius": 30.0, "position": [5, 0, 0], "velocity": [0, 1, 0]}],
      "galaxies": [{"name": "disk", "particles": 30, "disk_radius": 2.0, "disk_thickness": 0.1, "disk_orientation": {"inclination": 90}, "orbit": {"around": "main", "distance": 50.0, "angle": 90}}]}"""
    got = generate.from_json(spark, text).toPandas().set_index("id")
    assert len(got) == 70 and got.index.is_unique and got.mass[:40].sum() == pytest.approx(1000) and got.mass[40] == 20
    assert np.allclose(got.loc[40, ["x", "y", "z"]], [5, 50, 0]) and got.loc[40, "vx"] == pytest.approx(-((1000 / 50) ** 0.5)) and np.hypot(got.x[:40] - 5, got.y[:40]).max() <= 30
    assert np.abs(got.y[41:] - 50).max() <= 0.06 and np.hypot(got.x[41:] - 5, got.z[41:]).max() <= 2
    r = motion.recentre(p).agg(F.sum(F.col("mass") * F.col("x")), F.sum(F.col("mass") * F.col("vx"))).first()
    assert abs(r[0]) < 1e-12 and abs(r[1]) < 1e-12


def test_elements(spark, tmp_path):
    head = "e,a,i,om,w,ma,epoch,H,albedo,diameter,mass,class,name,central_body\n"
    (tmp_path / "e.csv").write_text(head + "0.05,0.003,1,2,3,4,2451544.5,,,,7e22,SAT,Moon,Earth\n0.0167,1.0,0.01,10,20,30,2451544.5,,,,6e24,PLA,Earth,Sun\n0.1,2.0,1,1,1,1,2451544.5,15,,,,MBA,,Sun\n0.1,,1,1,1,1,2451544.5,15,,,,MBA,x,Sun\n0.1,2.0,1,1,1,1,2451544.5,15,,,,,y,Sun\n")
    table = tables.read_elements(spark, str(tmp_path / "e.csv"))
    rows = {r["name"]: r for r in elements.state_vectors(table).collect()}
    assert set(rows) == {"Moon", "Earth", ""}
    d = math.dist([rows["Moon"][c] for c in "xyz"], [rows["Earth"][c] for c in "xyz"])
    assert 0.0028 < d < 0.0032 and rows[""]["mass"] > 0
    both = elements.combine(elements.state_vectors(table), elements.state_vectors(table)).orderBy("id").collect()
    assert [r["name"] for r in both] == ["Sun", "Moon", "Earth", "", ""] and [r["id"] for r in both] == list(range(5))


def test_kepler_equation(spark):
    df = spark.createDataFrame([(e, m) for e in (0.0, 0.3, 0.9, 0.97) for m in (0.0, 0.1, 1.0, 3.1, 6.0)], "e double, m double")
    got = df.withColumn("x", elements.eccentric_anomaly(F.col("m"), F.col("e")))
    assert got.where(F.abs(F.col("x") - F.col("e") * F.sin("x") - F.col("m")) > 1e-8).count() == 0


def test_durations(spark):
    df = spark.createDataFrame([("12h", 0.5), (" 2.5d ", 2.5), ("1Y", 365.25), ("3", 3.0), ("x", None), ("1m", None)], "t string, want double")
    assert df.where(~F.col("want").eqNullSafe(durations.parse_duration(F.col("t")))).count() == 0
    assert df.where("t = '1m'").select(durations.parse_duration(F.col("t"), durations.ROUNDED)).first()[0] == pytest.approx(30.4167)
    assert df.limit(1).select(durations.format_duration(F.lit(0.5))).first()[0] == "12.00h"


def test_results_do_not_depend_on_partitions(spark):
    b = generate.uniform_cube(spark, 150)
    config = SimConfig.of("body", leaf_size=4, softening=0.01)
    one, many = (walk.Walk(b.repartition(n), config).accelerations() for n in (1, 5))
    assert motion.acceleration_error(one, many).first()["largest"] < 1e-10


def test_sql_functions(spark):
    from orbitalis.functions import sql

    sql.register(spark)
    df = spark.createDataFrame([(5, 1 << 20, 77), (0, 0, (1 << 21) - 1)], "ix long, iy long, iz long")
    df.createOrReplaceTempView("cellsof")
    got = spark.sql("SELECT morton_key(ix, iy, iz) AS k, morton_prefix(morton_key(ix, iy, iz), 3) AS p FROM cellsof").collect()
    want = df.select(keys.interleave(F.col("ix"), F.col("iy"), F.col("iz")).alias("k")).withColumn("p", keys.prefix_at(F.col("k"), 3)).collect()
    assert got == want
    assert spark.sql("SELECT morton_cell(0.5D, 0D, 1D), cell_side(2, 8D), duration_days('12h')").first() == (1 << 20, 2.0, 0.5)
    assert spark.sql("SELECT duration_days(' -2e1D '), duration_days('1Y'), duration_days('3'), duration_days('1m'), duration_days('')").first() == (-20.0, 365.25, 3.0, None, None)


def test_scratch_tables_can_be_cleared(spark):
    from orbitalis.operators import scratch

    scratch.clear(spark)
    assert scratch.cut(spark.range(3)).count() == 3 and scratch.clear(spark) == 1 and scratch.clear(spark) == 0


def test_more_functions(spark):
    df = spark.createDataFrame([(1, 0, -1), (2, 5, 2), (3, 1 << 40, 40)], "n long, x long, bit int")
    assert df.where(keys.top_bit(F.col("x")) != F.col("bit")).count() == 0
    assert [r[0] for r in df.select(keys.log2_ceiling(F.col("n"))).collect()] == [0, 1, 2]
    assert [r[0] for r in df.select(keys.top_bit_value(F.col("x"))).collect()] == [0, 4, 1 << 40]
    assert df.select(keys.first_at_or_after(F.array(*map(F.lit, (1, 4, 9))), F.col("x"))).first()[0] == 0
    box = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 3.0, 0.5, -1.0)], "lx double, ly double, lz double, hx double, hy double, hz double, x double, y double, z double")
    low, high, p = geometry.cols("l"), geometry.cols("h"), geometry.cols()
    a, b = geometry.box_grown(p, low, high)
    c, d = geometry.box_shifted(low, high, p)
    r = box.select(*a, *b, *c, *d, *geometry.box_centre(low, high), geometry.box_empty(low, high), geometry.box_empty(high, low)).first()
    assert tuple(r) == (0.0, 0.0, -1.0, 3.0, 1.0, 1.0, 3.0, 0.5, -1.0, 4.0, 1.5, 0.0, 0.5, 0.5, 0.5, False, True)


def test_balance_levels_and_errors(spark):
    b = domain.keyed(generate.uniform_cube(spark, 200), domain.Domain((-1.0, -1.0, -1.0), 2.0)).withColumn("part", F.when(F.col("x") < 0, 0).otherwise(2))
    r = partition.balance(b, 4).first()
    assert (r["n"], r["parts"], r["empty"]) == (200, 4, 2) and r["ratio"] == pytest.approx(r["most"] / 50)
    assert partition.where_it_runs(b.repartition(3)).agg(F.sum("n"), F.count("*")).first() == (200, 3)
    tree = cells.tree(b, 8).cache()
    depths = motion.by_levels(tree, lambda d, c: (d, c.count()))
    assert depths[0] == (0, 1) and sum(n for _, n in depths) == tree.count() and motion.by_levels(tree, lambda d, c: d, up=True)[-1] == 0
    assert cells.find(tree, spark.createDataFrame([(0, 0), (9, -5)], "depth int, prefix long")).where("n = 200").count() == 1
    with pytest.raises(ArithmeticError, match="aren't numbers"):
        motion.require_finite(b.withColumns({"a" + c: F.lit(float("nan")) for c in "xyz"}))
    sticky = cells.merge_records(*(tree.where("depth = 0").withColumn("is_leaf", F.lit(x)) for x in (True, False)), sticky=True)
    assert sticky.first()["is_leaf"] and sticky.first()["n"] == 400
    timers = simulate.Timers()
    _, log = simulate.run(two(spark), SimConfig.of("body", steps=2, dt=0.01, algorithm="direct"), timers=timers)
    text = simulate.lines(simulate.report(log, timers, partition.balance(b, 4)))
    assert text[0].startswith("[ENERGY]") and any(x.startswith("[TIMERS] forces") for x in text) and text[-1].startswith("[BALANCE] 200 bodies in 4 parts")
    assert writers.read_metrics(writers.metrics_toml({"a": 1.5, "t": {"x": 1}})) == {"a": 1.5, "t": {"x": 1}}


def test_direct_sums_in_blocks(spark, monkeypatch):
    b = generate.uniform_cube(spark, 90)
    want = direct.accelerations(b, 0.01)
    monkeypatch.setattr(direct, "_BROADCAST_ROWS", 10)
    whole = direct.pairs
    monkeypatch.setattr(direct, "pairs", lambda t, s, c: whole(t, s, c, block_rows=17))
    assert motion.acceleration_error(direct.accelerations(b, 0.01), want).first()["largest"] < 1e-10


def test_parts_with_essential_trees(spark):
    b = generate.uniform_cube(spark, 300, half=5)
    dom = domain.cubic_domain(b)
    placed = domain.keyed(b, dom).withColumn("part", (F.col("id") % 3).cast("int"))
    config = SimConfig.of("body", theta=0.3, leaf_size=4, softening=0.01)
    got = essential.accelerations(placed, config, dom)
    assert got.count() == 300 and motion.acceleration_error(got, direct.accelerations(b, 0.01)).first()["rms"] < 0.02


def test_files_of_a_folder_have_ids_of_their_own(spark, tmp_path):
    b = generate.uniform_cube(spark, 30)
    for i, part in enumerate((b.where("id < 10"), b.where("id >= 10"))):
        binary.write_packed(part, f"file://{tmp_path}/many/p{i}.bin", False)
    assert motion.distance_error(b, binary.read_plain(spark, str(tmp_path / "many"))).first().asDict() == {"summed": 0.0, "largest": 0.0, "n": 30}
    assert sorted(r["id"] for r in binary.read_plain(spark, str(tmp_path / "many"), 12).collect()) == list(range(12))
    nameless = b.drop("id").coalesce(1)
    assert sorted(r["id"] for r in tables.resolve(nameless).collect()) == list(range(30))


def test_commands(spark, tmp_path):
    from orbitalis.__main__ import main

    out = lambda name: f"file://{tmp_path}/{name}"
    assert main(["generate", "--kind", "uniform", "--n", "40", "--out", out("b.tab"), "--format", "preamble"], spark) == ["40 bodies, 0 repeated ids, 0 not finite"]
    (tmp_path / "c.toml").write_text('dialect = "body"\nalgorithm = "direct"\nsteps = 1\nsoftening = 0.1\n')
    said = main(["run", out("b.tab"), "--config", out("c.toml"), "--out", out("r")], spark)
    assert any(x.startswith("[BALANCE] 40 bodies in 8 parts") for x in said)
    assert tables.read_header(spark, out("r/state.csv")).count() == 40
    (tmp_path / "j.json").write_text('{"systems": [{"particles": 12}]}')
    main(["generate", "--json", out("j.json"), "--out", out("g.csv")], spark)
    assert tables.open_bodies(spark, out("g.csv")).count() == 12
    head = "e,a,i,om,w,ma,epoch,H,albedo,diameter,mass,class,name,central_body\n"
    for i in (1, 2):
        (tmp_path / f"e{i}.csv").write_text(head + f"0.1,{i}.0,1,2,3,4,2451544.5,,,,7e22,PLA,p{i},Sun\n")
    assert main(["convert", out("e1.csv"), out("e2.csv"), "--out", out("s")], spark) == ["1 bodies, 0 without a mass"] * 2
    assert tables.read_header(spark, out("s/states1.csv")).count() == 1 and spark.read.csv(out("s/combined.csv"), header=True).count() == 3
