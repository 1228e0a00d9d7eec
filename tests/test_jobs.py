"""The jobs on copies of the tables: reruns, growth, interruption, bad rows."""

import math
import re
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobs import decompose, queries, workmap
from jobs.common import configured
from tests.oracle import DATA, assert_same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    assert_same(spark, queries.QUERIES[name], queries.SQL[name])
    assert before == {k: spark.conf.get(k, None) for k in before}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ------------------------------------------------------------------ decompose


def test_decompose_sets_bad_rows_aside_and_reruns(spark, tmp_path):
    nan, inf = math.nan, math.inf
    good = [(i, 1.0 + i % 3, float(i % 17), float(i * 7 % 31), float(i // 10), 0.0, 0.0, 0.0) for i in range(300)]
    bad = [(None, 1.0, *[0.0] * 6), (None, 2.0, *[0.0] * 6), (-4, 1.0, *[0.0] * 6), (900, 0.0, *[0.0] * 6), (901, None, *[0.0] * 6), (902, 1.0, nan, *[0.0] * 5), (903, 1.0, 0.0, inf, *[0.0] * 4)]
    copies = [good[5]] * 4 + [(6, 0.5, *good[6][2:])]
    kind = "id long, mass double, x double, y double, z double, vx double, vy double, vz double"
    spark.createDataFrame(good + bad + copies, kind).repartition(5).write.parquet(f"file://{tmp_path}/in")
    config = configured(decompose.__file__, 'parts = 4\nleaf_size = 8\n[body]\nid="id"\nmass="mass"\nx="x"\ny="y"\nz="z"\nvx="vx"\nvy="vy"\nvz="vz"')
    out = f"file://{tmp_path}/out"
    first = decompose.run(spark, f"file://{tmp_path}/in", out, config)
    assert first["read"] == len(good + bad + copies) and first["bodies"] == 300 and first["rejected"] == 8
    bodies = decompose.read(spark, out).collect()
    want = {r[0]: r for r in good} | {6: (6, 0.5, *good[6][2:])}
    assert {b.id: tuple(b)[:8] for b in bodies} == want
    aside = {(r.reason, r.id): r.n for r in spark.read.parquet(f"{out}/rejected").collect()}
    assert aside == {("id", None): 2, ("id", -4): 1, ("mass", 900): 1, ("not finite", 901): 1, ("not finite", 902): 1, ("not finite", 903): 1, ("repeated id", 5): 4, ("repeated id", 6): 1}
    # parts are ranges of keys, in order, and the summary says so
    parts = sorted(spark.read.parquet(f"{out}/parts").collect(), key=lambda p: p.part)
    assert sum(p.n for p in parts) == 300 and all(a.last_key < b.first_key for a, b in zip(parts, parts[1:], strict=False))
    assert max(Counter(b.part for b in bodies).values()) < 2 * 300 / 4
    leaves = Counter((b.leaf_depth, b.leaf_prefix) for b in bodies)
    assert leaves == {(c.depth, c.prefix): c.n for c in spark.read.parquet(f"{out}/cells").where("is_leaf").collect()}
    # files are in key order
    for (path,) in spark.read.parquet(f"{out}/bodies").select(F.input_file_name()).distinct().collect():
        inside = [r.key for r in spark.read.parquet(path).collect()]
        assert inside == sorted(inside)
    again = decompose.run(spark, f"file://{tmp_path}/in", out, config)
    assert again == first and rows(decompose.read(spark, out)) == sorted(map(tuple, bodies), key=str)


def test_decompose_of_nothing_and_unknown_settings(spark, tmp_path):
    spark.createDataFrame([], "id long, m double").write.parquet(f"file://{tmp_path}/in")
    config = configured(decompose.__file__, '[body]\nid="id"\nmass="m"\nx="m"\ny="m"\nz="m"\nvx="m"\nvy="m"\nvz="m"')
    done = decompose.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", config)
    assert set(done.values()) == {0} and decompose.read(spark, f"file://{tmp_path}/out").count() == 0
    with pytest.raises(ValueError, match="unknown settings: pieces"):
        configured(decompose.__file__, "pieces = 3")


# -------------------------------------------------------------------- workmap


@pytest.fixture(scope="module")
def docs(spark):
    some = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").limit(60).collect()
    return [*map(tuple, some), (None, None, "x"), (1000, "", None), (1001, "word", None), (1001, "word", None), (1002, "w " * 200_000, None)]


def add(spark, rows_, path):
    spark.createDataFrame(rows_, "doc_id long, text string, lang string").coalesce(1).write.mode("append").parquet(path)


def plain_map(rows_, config):
    """cell -> (n, bytes), and the cell of each row, by plain arithmetic."""
    cells, where = {}, []
    for doc_id, text, _ in rows_:
        text = text or ""
        words = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        at = (math.sqrt(words), math.sqrt(len(text)), len(text) / words if words else 0.0)
        ints = [min(int(v / config["span"] * 2**config["depth"]), 2 ** config["depth"] - 1) for v in at]
        cell = sum(((v >> i) & 1) << (3 * i + k) for k, v in enumerate(ints) for i in range(config["depth"]))
        n, size = cells.get(cell, (0, 0))
        cells[cell] = (n + 1, size + len(text.encode()) + 1)
        where.append((doc_id, cell))
    return cells, where


def check_map(spark, out, rows_, config):
    cells, where = plain_map(rows_, config)
    got = workmap.read_map(spark, out).collect()
    assert {r.cell: (r.n, r.bytes) for r in got} == cells
    assert sorted(map(str, where)) == sorted(str((r.doc_id, r.cell)) for r in workmap.read(spark, out, config["depth"]).collect())
    by_cell = [r.part for r in sorted(got, key=lambda r: r.cell)]
    assert by_cell == sorted(by_cell)  # parts are ranges of cells


def test_workmap_takes_only_what_is_new(spark, tmp_path, docs):
    source, out, config = f"file://{tmp_path}/in", f"file://{tmp_path}/out", configured(workmap.__file__, "parts = 3\nfiles = 1")
    add(spark, docs[:40], source)
    assert workmap.run(spark, source, out, config)["read"] == 40
    check_map(spark, out, docs[:40], config)
    add(spark, docs[40:55], source)
    add(spark, docs[55:], source)
    grown = workmap.run(spark, source, out, config)
    assert grown["read"] == len(docs) - 40 and grown["batches"] == 2
    check_map(spark, out, docs, config)
    before = rows(workmap.read_map(spark, out))
    idle = workmap.run(spark, source, out, config)
    assert idle["read"] == 0 and rows(workmap.read_map(spark, out)) == before
    # all at once gives the same map but for the last digits of centres
    workmap.run(spark, source, f"file://{tmp_path}/once", config | {"files": 64})
    tidy = lambda df: rows(df.withColumns({c: F.round(c, 6) for c in ("cx", "cy", "cz")}))
    assert tidy(workmap.read_map(spark, f"file://{tmp_path}/once")) == tidy(workmap.read_map(spark, out))


def test_workmap_after_an_interrupted_batch(spark, tmp_path, docs, monkeypatch):
    source, out, config = f"file://{tmp_path}/in", f"file://{tmp_path}/out", configured(workmap.__file__)
    add(spark, docs[:10], source)
    workmap.run(spark, source, out, config)
    add(spark, docs[10:], source)
    whole = workmap.tree.all_cells
    monkeypatch.setattr(workmap.tree, "all_cells", lambda *a, **k: 1 / 0)
    with pytest.raises(Exception, match="division by zero"):
        workmap.run(spark, source, out, config)
    assert spark.read.schema(workmap.DOCUMENTS).parquet(f"{out}/documents").count() == len(docs)  # the batch was half written
    monkeypatch.setattr(workmap.tree, "all_cells", whole)
    assert workmap.run(spark, source, out, config)["read"] == len(docs) - 10
    check_map(spark, out, docs, config)


def test_workmap_of_no_files(spark, tmp_path):
    add(spark, [], f"file://{tmp_path}/in")
    done = workmap.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    assert done["read"] == 0 and workmap.read_map(spark, f"file://{tmp_path}/out").count() == 0


@pytest.mark.parametrize(("job", "table", "key"), [("decompose", "lineitem", "bodies"), ("workmap", "documents", "map")])
def test_command_lines(spark, tmp_path, job, table, key):
    (tmp_path / "own.toml").write_text("parts = 2\n")
    for _ in range(2):
        done = subprocess.run([sys.executable, "-m", f"jobs.{job}", f"{DATA}/{table}.parquet", f"{tmp_path}/out", "--config", f"{tmp_path}/own.toml"], capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and "wrote" in done.stderr, done.stderr[-2000:]
    assert {r[0] for r in spark.read.parquet(f"{tmp_path}/out/{key}").select("part").distinct().collect()} == {0, 1}
