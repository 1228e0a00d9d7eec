import numpy as np
from pyspark.sql import functions as F

from orbitalis.operators import motion
from orbitalis.plans import more_queries
from orbitalis.plans.catalog import SQL
from orbitalis.sources import generate, series, writers
from tests.oracle import assert_same


def test_series_match_sql(spark):
    for name in ("series_files", "appended_series_files", "legacy_point_data", "snapshot_files", "legacy_snapshot_files"):
        assert_same(spark, getattr(more_queries, name), SQL[name])


def test_only_wanted_frames_are_read(spark, tmp_path):
    b = generate.uniform_cube(spark, 30, speed=1.0).repartition(2)
    for step in (1, 2, 3):
        series.extend_collection(spark, str(tmp_path), step * 0.5, series.write_frame(b.withColumn("x", F.col("x") + step), str(tmp_path), step))
    path = str(tmp_path / "series.pvd")
    assert series.frames(spark, path) == [(0.5, "frame_00001.pvtp"), (1.0, "frame_00002.pvtp"), (1.5, "frame_00003.pvtp")]
    one = series.read_series(spark, path, 0.9, 1.1)
    assert len(one.inputFiles()) == 2 and one.select("timestep").distinct().collect()[0][0] == 1.0
    assert motion.distance_error(b.withColumn("x", F.col("x") + 2), one).first()["summed"] == 0
    assert dict(one.dtypes) == dict.fromkeys(("timestep", "x", "y", "z", "mass", "speed", "vx", "vy", "vz"), "double") | {"id": "bigint", "rank": "bigint"}
    assert series.read_series(spark, path, 7.0).count() == 0
    series.extend_collection(spark, str(tmp_path), 0.5, "frame_00001.pvtp")  # again
    assert len(series.frames(spark, path)) == 3


def test_ids_beyond_doubles(spark, tmp_path):
    b = generate.uniform_cube(spark, 4).withColumn("id", F.col("id") + (1 << 53) + 1).coalesce(1)
    series.write_frame(b, str(tmp_path), 0)
    series.extend_collection(spark, str(tmp_path), 0.0, "frame_00000.pvtp")
    writers.write_snapshot(b, f"{tmp_path}/legacy", "vtk")
    for got in (series.read_series(spark, str(tmp_path / "series.pvd")), series.read_legacy(spark, f"{tmp_path}/legacy", ("id", "mass"))):
        assert sorted(r["id"] for r in got.collect()) == [(1 << 53) + 1 + i for i in range(4)]


def test_empty_snapshots_and_missing_arrays(spark, tmp_path):
    b = generate.uniform_cube(spark, 5).coalesce(1)
    for step, some in ((0, b), (1, b.drop("mass")), (2, b.where("id < 0"))):
        for appended in (False, True):
            folder = f"{tmp_path}/{appended}"
            series.extend_collection(spark, folder, float(step), series.write_frame(some, folder, step, appended))
    for appended in (False, True):
        got = series.read_series(spark, f"{tmp_path}/{appended}/series.pvd")
        assert sorted((r["timestep"], r["mass"] is None) for r in got.collect()) == [(0.0, False)] * 5 + [(1.0, True)] * 5


def test_legacy_arrays():
    text = "# vtk DataFile Version 3.0\nt\nASCII\nDATASET POLYDATA\nPOINTS 2 double\n1 2 3\n4 5 6\nVERTICES 2 4\n1 0\n1 1\nPOINT_DATA 2\nSCALARS id long 1\nLOOKUP_TABLE default\n7\n8\nSCALARS m double 1\nLOOKUP_TABLE default\n0.5\n1e300\nVECTORS v double\n0 0 1\n-1 0 0\n"
    a = series.legacy_arrays(text)
    assert a["position"].tolist() == [[1, 2, 3], [4, 5, 6]] and a["id"].tolist() == [7, 8] and a["id"].dtype == np.int64
    assert a["m"].tolist() == [0.5, 1e300] and a["v"].tolist() == [[0, 0, 1], [-1, 0, 0]]


def test_plummer_spheres_follow_the_model(spark):
    n = 200_000
    b = generate.plummer(spark, n, 3, total_mass=2.0, scale=3.0, gravity=0.5, cutoff=9.0)
    r2, v2 = (sum((F.pow(F.col(p + c), 2) for c in "yz"), F.pow(F.col(p + "x"), 2)) for p in ("", "v"))
    q2 = v2 * F.sqrt(r2 + 9) / 2  # as a share of the square of the escape speed: 2 G M / sqrt(r^2 + a^2)
    row = b.agg(F.count("*"), F.avg((r2 <= 9).cast("int")), F.max(F.sqrt(r2)), F.avg(q2), F.var_samp(q2), F.max(q2), *(F.avg(c) for c in ("x", "y", "z", "vx", "vy", "vz"))).first()
    assert row[0] == n and abs(row[1] - 0.5**1.5 * (1 + 1 / 81) ** 1.5) < 0.005 and 20 < row[2] <= 27 * (1 + 1e-12)
    assert abs(row[3] - 1 / 4) < 0.002 and abs(row[4] - 6.75 / 252) < 0.0005 and row[5] < 1 and max(map(abs, row[6:9])) < 0.1 and max(map(abs, row[9:])) < 0.01
    assert generate.plummer(spark, 0).count() == 0 and generate.plummer(spark, 1).count() == 1
    plan = b._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
