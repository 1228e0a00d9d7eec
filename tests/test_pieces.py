import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitalis.operators import motion
from orbitalis.plans import more_queries
from orbitalis.plans.catalog import SQL
from orbitalis.sources import binary, generate, pieces, writers
from tests.oracle import assert_same

NOTHING = {"summed": 0.0, "largest": 0.0}


def exact(a, b):
    row = motion.distance_error(a, b).first().asDict()
    return {k: row[k] for k in NOTHING} == NOTHING and row["n"]


def test_a_file_is_read_by_ranges(spark, tmp_path):
    b = generate.uniform_cube(spark, 1000, speed=1.0)
    for head, name in ((True, "a.tab"), (False, "a.bin")):
        (tmp_path / name).write_bytes(binary.packed(b, head))
        read = binary.read_preamble if head else binary.read_plain
        got = read(spark, str(tmp_path / name), rows=130)
        assert got.rdd.getNumPartitions() == 8 and exact(b, got) == 1000
        middle = read(spark, str(tmp_path / name), 300, start=250, rows=130)
        assert middle.rdd.getNumPartitions() == 3 and [r[0] for r in middle.select("id").orderBy("id").collect()] == list(range(250, 550))
        assert read(spark, str(tmp_path / name), 0).count() == 0 and read(spark, str(tmp_path / name), 5, start=2000).count() == 0


def test_large_files_are_many_ranges(spark, tmp_path):
    """A sparse file of 3 GB, read at its end alone."""
    n = 50_000_000
    with open(tmp_path / "big.tab", "wb") as f:
        f.write(struct.pack("<iid", n, 3, 0.0))
        f.seek(16 + 64 * (n - 1))
        f.write(np.arange(8.0).tobytes())
    whole = binary.read_preamble(spark, str(tmp_path / "big.tab"))
    assert whole.rdd.getNumPartitions() == 48
    r = binary.read_preamble(spark, str(tmp_path / "big.tab"), start=n - 2).orderBy("id").collect()
    assert [(x["id"], x["mass"], x["vz"]) for x in r] == [(n - 2, 0.0, 0.0), (n - 1, 6.0, 5.0)]


def test_folders_of_files(spark, tmp_path):
    b = generate.uniform_cube(spark, 1000, speed=1.0).repartition(5)
    for head in (True, False):
        path = f"{tmp_path}/{head}"
        for _ in range(2):  # the second time over the first
            binary.write_folder(b, path, head, 0.1, 2.0, rows=300)
            names = sorted(p.name for p in (tmp_path / str(head)).iterdir())
            assert len(names) == 4 and not any("staging" in n for n in names)
        assert exact(b, (binary.read_preamble if head else binary.read_plain)(spark, path)) == 1000
    n, dims, time = struct.unpack_from("<iid", (tmp_path / "True" / names[0].replace("bin", "tab")).read_bytes())
    assert 200 < n < 400 and (dims, time) == (3, 2.0)
    binary.write_folder(b.where("id < 100"), path, False, rows=300)  # fewer files than before
    assert [p.name for p in (tmp_path / "False").iterdir()] == ["part-00000000.bin"]
    assert exact(b.where("id < 100"), binary.read_plain(spark, path)) == 100
    binary.write_folder(b.where("id < 0"), f"{tmp_path}/none", True)
    assert not list((tmp_path / "none").glob("part*"))


def test_an_empty_file_and_a_wrong_one(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "0.tab").write_bytes(struct.pack("<iid", 0, 3, 0.0))
    (tmp_path / "a" / "1.tab").write_bytes(struct.pack("<iid", 1, 3, 0.0) + np.ones(8).tobytes())
    assert [r["id"] for r in binary.read_preamble(spark, str(tmp_path / "a")).collect()] == [0]
    (tmp_path / "a" / "0.tab").write_bytes(struct.pack("<iid", 0, 2, 0.0))
    with pytest.raises(Exception, match="don't fit"):
        binary.read_preamble(spark, str(tmp_path / "a")).collect()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("p"), F.spark_partition_id()).alias("name"), F.when(F.col("id") < 35, F.lit(b"x")).otherwise(F.raise_error(F.lit("lost"))).cast("binary").alias("raw"))
    with pytest.raises(Exception, match="lost"):
        pieces.write_pieces(rows, f"{tmp_path}/out")
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
    pieces.write_pieces(rows.where("id < 35"), f"{tmp_path}/out")
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {"p0": b"x" * 10, "p1": b"x" * 10, "p2": b"x" * 10, "p3": b"x" * 5}


def test_file_systems_that_arrow_does_not_know(spark, tmp_path, monkeypatch):
    b = generate.uniform_cube(spark, 100, speed=1.0)
    monkeypatch.setattr(pieces, "reachable", lambda path: False)
    binary.write_folder(b, f"{tmp_path}/a", False, rows=40)
    assert exact(b, binary.read_plain(spark, f"{tmp_path}/a")) == 100
    assert sorted(r["id"] for r in binary.read_plain(spark, f"{tmp_path}/a", 50, start=30).collect()) == list(range(30, 80))


def test_appended_pieces_keep_other_steps(spark, tmp_path):
    b = generate.uniform_cube(spark, 20).repartition(2)
    first, second = (writers.write_appended(b, f"{tmp_path}/run", step) for step in (1, 2))
    assert len(first) == len(second) == 2 and sorted(first + second) == sorted(p.name for p in tmp_path.iterdir())


def test_ranges_match_sql(spark):
    for name in ("body_ranges", "packed_files", "preamble_files", "appended_snapshot_files"):
        assert_same(spark, getattr(more_queries, name), SQL[name])
