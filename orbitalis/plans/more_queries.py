"""More registered queries: files written and read back, satellites, further
integrators and walks, essential trees, key and box functions, generators.

Queries about files write below the shared scratch folder and return what the
reader finds there; their SQL is that of the table that was written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitalis.functions import geometry, keys, sql
from orbitalis.operators import arrow_walk, cells, direct, domain, elements, energy_bounds, essential, leaf_walk, motion, partition, walk
from orbitalis.operators.domain import cubic_domain, keyed
from orbitalis.operators.scratch import folder
from orbitalis.plans import catalog, simulate
from orbitalis.plans.catalog import DOM, EMB, EMB_TREE, EPS2, KEYED, ORD, ORD_TREE, PLACED, query, rounded
from orbitalis.plans.config import SimConfig
from orbitalis.sources import binary, generate, series, tables, views, writers

STATE = ("id", "mass", "x", "y", "z", "vx", "vy", "vz")
_BODIES = "SELECT id, mass, x, y, z, vx, vy, vz FROM b"
with_ = catalog._with


def place(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/orbitalis/files/{uuid.uuid4().hex}/{name}"


# ------------------------------------------------------------------------ files


@query(with_(EMB) + " " + _BODIES)
def state_files(spark, sf_dir):
    path = place(spark, "state.csv")
    writers.write_state(views.bodies_emb(spark, sf_dir).repartition(3), path)
    return tables.open_bodies(spark, path).select(*STATE)


@query(with_(EMB) + " " + _BODIES)
def merged_state_file(spark, sf_dir):
    path = place(spark, "state")
    writers.write_state(views.bodies_emb(spark, sf_dir).repartition(3), path, merged=True)
    return tables.read_header(spark, path).select(*STATE)


@query(with_(EMB) + " " + _BODIES)
def strict_files(spark, sf_dir):
    path = place(spark, "plain")
    views.bodies_emb(spark, sf_dir).repartition(3).write.csv(path)
    return tables.read_strict(spark, path)


@query(with_(EMB) + " " + _BODIES + " WHERE id % 10 > 2")
def tolerant_files(spark, sf_dir):
    path, last = place(spark, "mixed"), F.col("id") % 10
    good = F.concat_ws(",", *(F.col(c).cast("string") for c in STATE))
    bad = F.when(last == 0, F.concat(F.lit("id,"), "id")).when(last == 1, F.concat("id", F.lit(",1,2"))).when(last == 2, F.concat("id", F.lit(",x,0,0,0,0,0,0")))
    views.bodies_emb(spark, sf_dir).select(F.coalesce(bad, good).alias("value")).write.text(path)
    return tables.read_tolerant(spark, path)


@query(with_(EMB) + " SELECT row_number() OVER (ORDER BY id) - 1 AS id, concat('body', id) AS name, mass, x, vz FROM b WHERE id % 7 <> 0 ORDER BY id LIMIT 100")
def named_files(spark, sf_dir):
    path = place(spark, "named")
    b = views.bodies_emb(spark, sf_dir).withColumns({"name": F.concat(F.lit("body"), "id"), "class": F.lit("AST"), "mass": F.when(F.col("id") % 7 == 0, F.lit("bad")).otherwise(F.col("mass").cast("string"))})
    b.orderBy("id").coalesce(1).select("id", "name", "class", "mass", "x", "y", "z", "vx", "vy", "vz").write.csv(path, header=True)
    return tables.read_named(spark, path, 100).select("id", "name", "mass", "x", "vz")


@query(with_(EMB) + " " + _BODIES)
def aliased_files(spark, sf_dir):
    path = place(spark, "aliases.csv")
    spelled = {"vz": "Vel_Z", "id": "body_id", "mass": "M", "x": "PosX", "extra": "extra", "y": '"pos_y"', "z": "pz", "vx": "velx", "vy": "VY"}
    b = views.bodies_emb(spark, sf_dir).withColumn("extra", F.lit(5))
    b.select(*(F.col(c).alias(s.strip('"')) for c, s in spelled.items())).write.csv(path, header=True)
    return tables.open_bodies(spark, path).select(*STATE)


@query(with_(EMB) + " SELECT id, x, y, z FROM b")
def position_files(spark, sf_dir):
    path = place(spark, "positions")
    writers.write_positions(views.bodies_emb(spark, sf_dir), path)
    return tables.read_positions(spark, path)


@query("SELECT n_nationkey AS step, n_nationkey * 0.5 AS time_days, CAST(n_regionkey AS DOUBLE) AS kinetic, CAST(-n_regionkey AS DOUBLE) AS potential, 0.0 AS total, n_nationkey / 1000.0 AS rel_drift FROM nation")
def energy_files(spark, sf_dir):
    path, n = place(spark, "energy"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    k, r = F.col("n_nationkey"), F.col("n_regionkey").cast("double")
    log = n.select(k.cast("int").alias("step"), (k * 0.5).alias("time_days"), r.alias("kinetic"), (-r).alias("potential"), F.lit(0.0).alias("total"), (k / 1000.0).alias("rel_drift"))
    for half in (log.where("step < 10"), log.where("step >= 10")):
        writers.append_energy(half, path)
    return spark.read.schema(log.schema).csv(path, header=True).select("step", "time_days", "kinetic", "potential", F.abs("total").alias("total"), "rel_drift")


_RANKED = "SELECT row_number() OVER (ORDER BY id) - 1 AS id, mass, x, y, z, vx, vy, vz FROM b"


@query(with_(EMB) + " " + _RANKED)
def preamble_files(spark, sf_dir):
    path = place(spark, "bodies.tab")
    binary.write_packed(views.bodies_emb(spark, sf_dir), path, True, 0.1, 2.0)
    return tables.open_bodies(spark, path)


@query(with_(EMB) + f" SELECT * FROM ({_RANKED}) WHERE id < 300")
def packed_files(spark, sf_dir):
    path, b = place(spark, "many"), views.bodies_emb(spark, sf_dir)
    for i, some in enumerate((b.where("id < 200"), b.where("id >= 200"))):
        binary.write_packed(some, f"{path}/part{i}.bin", False)
    return binary.read_plain(spark, path, 300, rows=70)


@query(with_(EMB) + f" SELECT * FROM ({_RANKED}) WHERE id BETWEEN 120 AND 419")
def body_ranges(spark, sf_dir):
    """Files of 90 bodies each, written by tasks, and ranges of 40 read from the middle."""
    path = place(spark, "ranges")
    binary.write_folder(views.bodies_emb(spark, sf_dir), path, True, 0.1, 2.0, rows=90)
    return binary.read_preamble(spark, path, 300, start=120, rows=40)


@query(with_(EMB) + " SELECT id, mass, x, y, z FROM b")
def snapshot_files(spark, sf_dir):
    path = place(spark, "frame")
    writers.write_snapshot(views.bodies_emb(spark, sf_dir).repartition(3), path)
    return binary.read_points(spark, path)


@query(with_(EMB) + " SELECT id, mass, x, y, z FROM b")
def appended_snapshot_files(spark, sf_dir):
    path = place(spark, "frames")
    b = views.bodies_emb(spark, sf_dir).withColumns({"ax": F.col("x"), "ay": F.col("y"), "az": F.col("z"), "phi": F.lit(-1.0)}).repartition(3)
    writers.write_appended(b, f"{path}/run", 3)
    return binary.read_points(spark, path)


@query(with_(EMB) + " SELECT x, y, z, count(*) AS n FROM b GROUP BY ALL")
def legacy_snapshot_files(spark, sf_dir):
    path = place(spark, "legacy")
    writers.write_snapshot(views.bodies_emb(spark, sf_dir).repartition(2), path, "vtk")
    text = spark.read.text(path, wholetext=True)
    lines = F.slice(F.split("value", "\n"), 6, F.regexp_extract("value", r"POINTS (\d+) double", 1).cast("int"))
    part = F.split("line", " ")
    points = text.select(F.explode(lines).alias("line")).select(*(F.get(part, F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")))
    return points.groupBy("x", "y", "z").agg(F.count("*").alias("n"))


def _moved(spark: SparkSession, sf_dir: str, by: float) -> DataFrame:
    b = views.bodies_emb(spark, sf_dir)
    return b.withColumns({"x": F.col("x") + by, "ax": F.col("y"), "ay": F.col("z"), "az": F.col("x"), "phi": -F.col("mass"), "key": F.col("id") * 7}).repartition(3)


_TIMES = "SELECT 0.5::DOUBLE AS timestep, 1.0::DOUBLE AS m UNION ALL SELECT 1.5, 2.0"


@query(with_(EMB) + f" SELECT timestep, id, mass, x + m AS x, y, z, vx, vy, vz, y AS ax, z AS ay, x AS az, -mass AS phi, id * 7 AS key, round(sqrt(vx * vx + vy * vy + vz * vz), 9) + 0.0 AS speed, round(sqrt(y * y + z * z + x * x), 9) + 0.0 AS a_size FROM b, ({_TIMES}) AS t")
def series_files(spark, sf_dir):
    """Two frames in text, each with its index, read through their collection."""
    path = place(spark, "series")
    for step, by in ((1, 1.0), (2, 2.0)):
        series.extend_collection(spark, path, step - 0.5, series.write_frame(_moved(spark, sf_dir, by), path, step))
    return rounded(series.read_series(spark, f"{path}/series.pvd").drop("rank"), 9, "speed", "a_size")


@query(with_(EMB) + " SELECT 1.5::DOUBLE AS timestep, id, mass, x + 2.0 AS x, y, z, vx, vy, vz, y AS ax, z AS ay, x AS az, -mass AS phi, id * 7 AS key FROM b")
def appended_series_files(spark, sf_dir):
    """Frames of raw appended arrays, of which one is read by its time."""
    path = place(spark, "series")
    for step, by in ((1, 1.0), (2, 2.0)):
        series.extend_collection(spark, path, step - 0.5, series.write_frame(_moved(spark, sf_dir, by), path, step, appended=True))
    return series.read_series(spark, f"{path}/series.pvd", first=1.0).drop("pe")


@query(with_(EMB) + " SELECT id, mass, x + 1.0 AS x, y, z, vx, vy, vz, y AS ax, z AS ay, x AS az, -mass AS phi FROM b")
def legacy_point_data(spark, sf_dir):
    path = place(spark, "legacy")
    writers.write_snapshot(_moved(spark, sf_dir, 1.0), path, "vtk")
    return series.read_legacy(spark, path, ("id", "mass", "phi"), ("v", "a"))


@query("SELECT 0.5 * s_suppkey AS timestep, concat('frame', s_suppkey, '.pvtp') AS file FROM supplier WHERE s_suppkey <= 20")
def snapshot_index(spark, sf_dir):
    some = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey <= 20").select("s_suppkey").collect())
    text = spark.createDataFrame([(writers.timeline([(0.5 * k, f"frame{k}.pvtp") for k in some]),)], "value string")
    one = text.select(F.explode(F.regexp_extract_all("value", F.lit('timestep="([^"]+)" part="0" file="[^"]+"'), 0)).alias("x"))
    return one.select(F.regexp_extract("x", 'timestep="([^"]+)"', 1).cast("double").alias("timestep"), F.regexp_extract("x", 'file="([^"]+)"', 1).alias("file"))


@query(with_(ORD, DOM, KEYED) + " SELECT CAST(count(*) AS BIGINT) AS boxes, CAST(sum(cnt) AS BIGINT) AS n, CAST(8 * count(*) AS BIGINT) AS corners FROM (SELECT key >> 54 AS bucket, count(*) AS cnt FROM k GROUP BY 1)")
def histogram_boxes(spark, sf_dir):
    path, bodies = place(spark, "boxes"), views.bodies_ord(spark, sf_dir)
    dom = cubic_domain(bodies)
    writers.write_boxes(writers.histogram_cells(partition.key_histogram(keyed(bodies, dom), 9), 9), path, dom)
    return _box_counts(spark, path)


def _box_counts(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    n = F.split(F.regexp_extract("value", 'Name="n" [^>]*>([^<]*)<', 1), " ")
    total = F.aggregate(F.filter(n, lambda x: x != ""), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    count = lambda name: F.regexp_extract("value", f'{name}="([0-9]+)"', 1).cast("long")
    return text.agg(F.sum(count("NumberOfCells")).alias("boxes"), F.sum(total).alias("n"), F.sum(count("NumberOfPoints")).alias("corners"))


@query(EMB_TREE + ", " + catalog._PARTED + f""", w AS (SELECT t.part AS dest, t.lx, t.hx, t.ly, t.hy, t.lz, t.hz, c.depth, c.prefix, c.n, c.is_leaf, {catalog._LET} AS accepted FROM bx AS t JOIN c ON c.depth = 0, d
    UNION ALL
    SELECT t.dest, t.lx, t.hx, t.ly, t.hy, t.lz, t.hz, c.depth, c.prefix, c.n, c.is_leaf, {catalog._LET} FROM w AS t JOIN c ON c.depth = t.depth + 1 AND c.prefix >> 3 = t.prefix, d WHERE NOT t.accepted AND NOT t.is_leaf)
  SELECT count(*) AS boxes, CAST(sum(n) AS BIGINT) AS n, 8 * count(*) AS corners FROM w WHERE accepted OR is_leaf""")  # fmt: skip
def essential_boxes(spark, sf_dir):
    placed, tree, dom = catalog._emb_tree(spark, sf_dir)
    path = place(spark, "boxes")
    writers.write_boxes(essential.records(tree, essential.part_boxes(catalog._parted(placed)), 0.5, dom.span), path, dom)
    return _box_counts(spark, path)


@query(EMB_TREE + " SELECT count(*) AS nodes, CAST(sum(CASE WHEN depth > 0 THEN 1 ELSE 0 END) AS BIGINT) AS edges, CAST(sum(n) AS BIGINT) AS n FROM c")
def graph_lines(spark, sf_dir):
    _, tree, _ = catalog._emb_tree(spark, sf_dir)
    edge = F.col("value").contains("->")
    return writers.graphviz(tree).agg(F.sum(F.when(edge, 0).otherwise(1)).alias("nodes"), F.sum(F.when(edge, 1).otherwise(0)).alias("edges"), F.sum(F.regexp_extract("value", "n=([0-9]+)", 1).try_cast("long")).alias("n"))


@query("SELECT replace(n_name, '_', ' ') AS name, CAST(n_nationkey AS DOUBLE) AS value FROM nation")
def metrics_files(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", "n_nationkey").collect()
    path = place(spark, "metrics")
    text = writers.metrics_toml({"count": len(rows), "nations": {r[0].replace(" ", "_"): float(r[1]) for r in rows}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    read = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame([(k.replace("_", " "), v) for k, v in writers.read_metrics(read)["nations"].items()], "name string, value double")


@query("SELECT s_suppkey % 4 AS ord, CAST(count(*) AS BIGINT) AS n FROM supplier GROUP BY 1")
def points_by_key(spark, sf_dir):
    some = spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn("k", F.col("s_suppkey") % 4)
    at = keys.first_at_or_after(F.array(*(F.lit(x).cast("long") for x in range(4))), F.col("k"))
    return some.groupBy(at.cast("long").alias("ord")).agg(F.count("*").alias("n"))


# ---------------------------------------------------- elements and satellites

_SAT = """p AS (SELECT n_nationkey AS k, 0 AS f, n_name AS name, 'PLA' AS class, 'Sun' AS central, (n_nationkey % 10) / 20.0 AS e, 1.0 + n_nationkey AS a, n_nationkey * 3.0 AS i, n_nationkey * 11.0 AS om, n_nationkey * 7.0 AS w, n_nationkey * 13.0 AS ma,
    2451540.0 AS epoch, CAST(NULL AS DOUBLE) AS h, CAST(NULL AS DOUBLE) AS albedo, 1e24 * (1 + n_nationkey) AS mass FROM nation),
  s AS (SELECT s_suppkey, 1, concat('moon', s_suppkey), 'SAT', coalesce(n_name, 'nowhere'), (s_suppkey % 9) / 30.0, 0.001 * (1 + s_suppkey % 17), s_suppkey % 60 * 1.0, s_suppkey % 350 * 1.0, s_suppkey * 5 % 360 * 1.0, s_suppkey * 17 % 360 * 1.0,
    2451540.0, NULL, NULL, 1e20 * s_suppkey FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey % 30),
  r AS (SELECT p_partkey, 2, concat('rock', p_partkey), CASE p_partkey % 5 WHEN 0 THEN 'MBA' WHEN 1 THEN 'TNO' WHEN 2 THEN 'XYZ' WHEN 3 THEN 'AMO' ELSE '' END, 'Sun', (p_size % 50) / 60.0, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 1 + (p_partkey % 40) / 10.0 END,
    p_partkey % 90 * 1.0, p_partkey % 360 * 1.0, 5.0, 6.0, 2451540.0, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 10 + p_size / 10.0 END, NULL, NULL FROM part WHERE p_partkey % 3 = 0),
  t AS (SELECT * FROM p UNION ALL SELECT * FROM s UNION ALL SELECT * FROM r)"""


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planets (nation), satellites (supplier; some without a parent) and asteroids
    (part; some without a class or an element) as orbital elements."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    n, s, p = F.col("n_nationkey"), F.col("s_suppkey"), F.col("p_partkey")
    none = F.lit(None).cast("double")

    def rows(df, f, k, name, kind, central, e, a, i, om, w, ma, h, mass):
        cols = {"e": e, "a": a, "i": i, "om": om, "w": w, "ma": ma, "epoch": F.lit(2451540.0), "H": h, "albedo": none, "diameter": none, "mass": mass}
        return df.select(*(v.cast("double").alias(c) for c, v in cols.items()), kind.alias("class"), name.alias("name"), central.alias("central_body"), (F.lit(f * 10**9) + k).cast("long").alias("row"))

    sun, planets = F.lit("Sun"), read("nation")
    out = rows(planets, 0, n, F.col("n_name"), F.lit("PLA"), sun, (n % 10) / 20.0, 1.0 + n, n * 3.0, n * 11.0, n * 7.0, n * 13.0, none, 1e24 * (1 + n))
    moons = read("supplier").join(planets, n == s % 30, "left")
    out = out.union(rows(moons, 1, s, F.concat(F.lit("moon"), s), F.lit("SAT"), F.coalesce("n_name", F.lit("nowhere")), (s % 9) / 30.0, 0.001 * (1 + s % 17), s % 60, s % 350, s * 5 % 360, s * 17 % 360, none, 1e20 * s))
    kind = F.element_at(F.array(*map(F.lit, ("MBA", "TNO", "XYZ", "AMO", ""))), (p % 5 + 1).cast("int"))
    rocks = read("part").where(p % 3 == 0)
    a = F.when(p % 11 != 0, 1 + (p % 40) / 10.0)
    return out.union(rows(rocks, 2, p, F.concat(F.lit("rock"), p), kind, sun, (F.col("p_size") % 50) / 60.0, a, p % 90, p % 360, F.lit(5.0), F.lit(6.0), F.when(p % 6 != 0, 10 + F.col("p_size") / 10.0), none))


_DRAWN = """g AS (SELECT *, CAST(concat('0x', substr(md5(concat(name, '/', CAST(CAST(round(a * 1000000) AS BIGINT) AS VARCHAR), '/', CAST(CAST(round(e * 1000000) AS BIGINT) AS VARCHAR))), 1, 7)) AS BIGINT) / 268435456.0 AS u
    FROM t WHERE class <> '' AND a IS NOT NULL),
  al AS (SELECT *, coalesce(albedo, CASE class WHEN 'MBA' THEN 0.097 + u * (0.203 - 0.097) WHEN 'TNO' THEN 0.022 + u * (0.130 - 0.022) WHEN 'AMO' THEN 0.45 + u * 0.1 ELSE 0.1 + u * 0.1 END) AS alb FROM g),
  di AS (SELECT *, 1329 * alb ** -0.5 * 10.0 ** (-0.2 * h) AS dia FROM al),
  ms AS (SELECT *, CASE WHEN coalesce(mass, 0) = 0 AND coalesce(dia, 0) > 0 THEN 4.0 / 3 * pi() * (dia / 2 * 1000) ** 3 * CASE WHEN alb < 0.1 THEN 1380 WHEN alb <= 0.2 THEN 2710 ELSE 5320 END ELSE coalesce(mass, 0) END AS m FROM di)"""


@query("WITH " + _SAT + ", " + _DRAWN + " SELECT name, round(alb, 7) + 0.0 AS albedo, round(dia, 5) + 0.0 AS diameter, round(ln(1 + m), 6) + 0.0 AS log_mass, m = 0 AS mass_missing FROM ms")
def drawn_albedos(spark, sf_dir):
    done = elements.imputed(_catalogue(spark, sf_dir).where("class <> '' and a is not null"))
    return done.select("name", (F.round("albedo", 7) + 0.0).alias("albedo"), (F.round("diameter", 5) + 0.0).alias("diameter"), (F.round(F.log(1 + F.col("mass")), 6) + 0.0).alias("log_mass"), "mass_missing")


def _orbit(source: str, out: str, mu: str) -> str:
    """CTEs from elements in `source` to states in `out`; mu is the pull."""
    newton = ", ".join(f"{out}n{i} AS (SELECT *, u{i - 1} - (u{i - 1} - e * sin(u{i - 1}) - mm) / (1 - e * cos(u{i - 1})) AS u{i} FROM {out}n{i - 1})" for i in range(1, 16))
    return f"""{out}0 AS (SELECT *, {mu} AS mu FROM {source}), {out}1 AS (SELECT *, radians(ma) + sqrt(mu / a ** 3) * (2451544.5 - epoch) AS tt FROM {out}0),
  {out}n0 AS (SELECT *, tt - floor(tt / (2 * pi())) * 2 * pi() AS mm, tt - floor(tt / (2 * pi())) * 2 * pi() AS u0 FROM {out}1), {newton},
  {out}2 AS (SELECT *, 2 * atan2(sqrt(1 + e) * sin(u15 / 2), sqrt(1 - e) * cos(u15 / 2)) AS nu, a * (1 - e * cos(u15)) AS rr, radians(i) AS ii, radians(om) AS oo, radians(w) AS ww FROM {out}n15),
  {out}3 AS (SELECT *, rr * cos(nu) AS px, rr * sin(nu) AS py, -sqrt(mu * a) / rr * sin(u15) AS qx, sqrt(mu * a) / rr * sqrt(1 - e * e) * cos(u15) AS qy, cos(oo) * cos(ww) - sin(oo) * sin(ww) * cos(ii) AS a11,
    -cos(oo) * sin(ww) - sin(oo) * cos(ww) * cos(ii) AS a12, sin(oo) * cos(ww) + cos(oo) * sin(ww) * cos(ii) AS a21, -sin(oo) * sin(ww) + cos(oo) * cos(ww) * cos(ii) AS a22, sin(ww) * sin(ii) AS a31, cos(ww) * sin(ii) AS a32 FROM {out}2),
  {out} AS (SELECT *, a11 * px + a12 * py AS x, a21 * px + a22 * py AS y, a31 * px + a32 * py AS z, a11 * qx + a12 * qy AS vx, a21 * qx + a22 * qy AS vy, a31 * qx + a32 * qy AS vz FROM {out}3)"""


_SUN = "1.48812e-34 * 1.98847e30"


@query("WITH " + _SAT + ", " + _DRAWN + ", " + _orbit("(SELECT * FROM ms WHERE class = 'PLA')", "pp", _SUN) + ", jj AS (SELECT ms.*, pp.m AS pm, pp.x AS qqx, pp.y AS qqy, pp.z AS qqz, pp.vx AS qvx, pp.vy AS qvy, pp.vz AS qvz FROM ms LEFT JOIN pp ON ms.class = 'SAT' AND pp.name = ms.central), "
       + _orbit("jj", "ss", f"CASE WHEN pm IS NOT NULL THEN 1.48812e-34 * pm ELSE {_SUN} END")
       + " SELECT row_number() OVER (ORDER BY f, k) - 1 AS id, name, class, " + ", ".join(f"round({c} + coalesce({q}, 0), 6) + 0.0 AS {c}" for c, q in (("x", "qqx"), ("y", "qqy"), ("z", "qqz"), ("vx", "qvx"), ("vy", "qvy"), ("vz", "qvz"))) + " FROM ss")
def satellites(spark, sf_dir):
    states = elements.state_vectors(_catalogue(spark, sf_dir))
    six = ("x", "y", "z", "vx", "vy", "vz")
    return rounded(states.select("id", "name", "class", *six), 6, *six)


@query("WITH " + _SAT + " SELECT name, class, central AS central_body, round(e, 9) + 0.0 AS e, round(a, 9) + 0.0 AS a, round(ma, 9) + 0.0 AS ma, round(h, 9) + 0.0 AS h FROM t")
def element_files(spark, sf_dir):
    path, table = place(spark, "elements"), _catalogue(spark, sf_dir)
    table.drop("row").write.csv(path, header=True)
    back = tables.read_elements(spark, path)
    return rounded(back.select("name", F.coalesce("class", F.lit("")).alias("class"), "central_body", "e", "a", "ma", F.col("H").alias("h")), 9, "e", "a", "ma", "h")


@query("WITH " + _SAT + " SELECT name, class, 'Sun' AS central_body, round(e, 9) + 0.0 AS e, round(a, 9) + 0.0 AS a FROM t")
def sunbound_element_files(spark, sf_dir):
    """Files without the column of the central body: all are bound to the Sun."""
    path = place(spark, "elements")
    _catalogue(spark, sf_dir).drop("row", "central_body").write.csv(path, header=True)
    back = tables.read_elements(spark, path)
    return rounded(back.select("name", F.coalesce("class", F.lit("")).alias("class"), "central_body", "e", "a"), 9, "e", "a")


@query(catalog.SQL["durations_days"])
def durations_sql(spark, sf_dir):
    sql.register(spark)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    unit = F.element_at(F.array(F.lit("h"), F.lit(" d"), F.lit("Y"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    part.select(F.col("p_partkey").cast("long").alias("id"), F.concat(F.when(F.col("p_partkey") % 4 == 3, (F.col("p_size") * 0.5).cast("string")).otherwise(F.col("p_size").cast("string")), unit).alias("t")).createOrReplaceTempView("orbitalis_durations")
    return spark.sql("SELECT id, round(duration_days(t), 6) + 0.0D AS days FROM orbitalis_durations")


# ------------------------------------------------------------ keys, boxes, parts


def _dec(p: str, o: int) -> str:
    return f"CAST(list_sum([(({p} >> (3 * i + {o})) & 1) << i for i in range(7)]) AS BIGINT)"


@query(with_(EMB, DOM, KEYED, f"e AS (SELECT id, key, key >> 42 AS p, {_dec('(key >> 42)', 0)} AS cx, {_dec('(key >> 42)', 1)} AS cy, {_dec('(key >> 42)', 2)} AS cz FROM k)") + """
  SELECT id, p & 7 AS octant, p >> 3 AS parent, p << 42 AS first_key, ((p + 1) << 42) - 1 AS last_key, cx IN (0, 127) OR cy IN (0, 127) OR cz IN (0, 127) AS edge,
    (cx - 64) ** 2 + (cy - 64) ** 2 + (cz - 64) ** 2 AS apart2, CASE WHEN key = 0 THEN -1 ELSE length(bin(key)) - 1 END AS top_bit, CASE WHEN id <= 1 THEN 0 ELSE length(bin(id - 1)) END AS log2 FROM e""")  # fmt: skip
def key_functions(spark, sf_dir):
    bodies = views.bodies_emb(spark, sf_dir)
    p, depth = F.col("p"), F.lit(7)
    low, high = keys.key_range(depth, p)
    middle = keys.interleave(*(F.lit(64).cast("long") for _ in range(3)))
    out = keyed(bodies, cubic_domain(bodies)).withColumn("p", keys.prefix_at(F.col("key"), 7))
    return out.select("id", keys.octant(p).alias("octant"), keys.parent(p).alias("parent"), low.alias("first_key"), high.alias("last_key"), keys.at_boundary(p, depth).alias("edge"), keys.steps_apart2(p, middle).cast("double").alias("apart2"),
                      keys.top_bit(F.col("key")).cast("long").alias("top_bit"), keys.log2_ceiling(F.col("id")).cast("long").alias("log2"))


@query(with_(ORD, "o AS (SELECT mass, min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS hx, max(y) AS hy, max(z) AS hz FROM b GROUP BY mass)") + """ SELECT u.mass AS a, v.mass AS b, least(u.lx, v.lx) AS ux, greatest(u.hz, v.hz) AS uz,
  round((u.hx - u.lx) * (u.hy - u.ly) * (u.hz - u.lz) / 1e12, 3) + 0.0 AS volume, (u.lx + u.hx) / 2 AS middle, u.lx + v.lx AS shifted, v.lx BETWEEN u.lx AND u.hx AND v.ly BETWEEN u.ly AND u.hy AND v.lz BETWEEN u.lz AND u.hz AS holds,
  greatest(0, v.lx - u.hx, u.lx - v.hx) ** 2 + greatest(0, v.ly - u.hy, u.ly - v.hy) ** 2 + greatest(0, v.lz - u.hz, u.lz - v.hz) ** 2 AS gap2 FROM o AS u JOIN o AS v ON u.mass < v.mass""")  # fmt: skip
def box_functions(spark, sf_dir):
    boxes = views.bodies_ord(spark, sf_dir).groupBy("mass").agg(*(f(c).alias(p + c) for p, f in (("l", F.min), ("h", F.max)) for c in "xyz"))
    u = boxes.select(F.col("mass").alias("a"), *(F.col(p + c).alias("u" + p + c) for p in "lh" for c in "xyz"))
    v = boxes.select(F.col("mass").alias("b"), *(F.col(p + c).alias("v" + p + c) for p in "lh" for c in "xyz"))
    ul, uh, vl, vh = (geometry.cols(x) for x in ("ul", "uh", "vl", "vh"))
    low, high = geometry.box_union(ul, uh, vl, vh)
    shifted, _ = geometry.box_shifted(ul, uh, vl)
    return u.join(v, F.col("a") < F.col("b")).select(
        "a", "b", low[0].alias("ux"), high[2].alias("uz"), (F.round(geometry.box_volume(ul, uh) / 1e12, 3) + 0.0).alias("volume"), geometry.box_centre(ul, uh)[0].alias("middle"), shifted[0].alias("shifted"),
        geometry.box_contains(vl, ul, uh).alias("holds"), geometry.box_gap2(ul, uh, vl, vh).alias("gap2"),
    )


_OPENED = """kids AS (SELECT depth - 1 AS depth, prefix >> 3 AS prefix, count(*) AS kids FROM c WHERE depth > 0 GROUP BY ALL),
  steps AS (SELECT c.depth, c.prefix, 1 + sum(kids - 1) OVER (ORDER BY n DESC, c.depth, c.prefix ROWS UNBOUNDED PRECEDING) AS stand FROM c JOIN kids USING (depth, prefix)),
  opened AS (SELECT depth, prefix FROM steps WHERE stand <= 40)"""


@query(EMB_TREE + ", " + _OPENED + " SELECT depth, prefix, n FROM c WHERE (depth = 0 OR (depth - 1, prefix >> 3) IN (SELECT (depth, prefix) FROM opened)) AND (depth, prefix) NOT IN (SELECT (depth, prefix) FROM opened)")
def frontier_of_tree(spark, sf_dir):
    """The 40 cells, at most, that the most populous cells are opened into."""
    return partition.frontier(catalog._emb_tree(spark, sf_dir)[1], 40)


@query("SELECT count(*) AS n, true AS apart FROM orders")
def owned_ranges(spark, sf_dir):
    """Bodies at the owners of their keys: no two owners' ranges of keys meet."""
    bodies = views.bodies_ord(spark, sf_dir)
    owned = partition.by_owner(keyed(bodies, cubic_domain(bodies)), 8).withColumn("owner", F.spark_partition_id())
    ranges = owned.groupBy("owner").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    before = F.max("high").over(Window.orderBy("owner").rowsBetween(Window.unboundedPreceding, -1))  # a row for each owner
    return ranges.select("n", F.coalesce(F.col("low") > before, F.lit(True)).alias("apart")).agg(F.sum("n").alias("n"), F.bool_and("apart").alias("apart"))


@query("WITH g AS (" + catalog.SQL["splitters"] + """), t AS (SELECT CAST(sum(cnt) AS BIGINT) AS k FROM g GROUP BY part) SELECT CAST(sum(k) AS BIGINT) AS n, 6::BIGINT AS parts, 6 - count(*) AS empty, CASE WHEN count(*) < 6 THEN 0 ELSE min(k) END AS least, max(k) AS most,
  sum(k) / 6.0 AS mean, round(max(k) * 6 / sum(k), 9) + 0.0 AS ratio FROM t""")  # fmt: skip
def part_balance(spark, sf_dir):
    bodies = views.bodies_ord(spark, sf_dir)
    placed = keyed(bodies, cubic_domain(bodies)).withColumn("bucket", F.shiftright("key", 54))
    cuts = partition.splitters(partition.key_histogram(placed, 9), 6)
    return rounded(partition.balance(partition.assign_parts(placed, cuts), 6), 9, "ratio")


@query("SELECT count(*) AS n, CAST(8 AS BIGINT) AS tasks FROM orders")
def task_probe(spark, sf_dir):
    return partition.where_it_runs(views.bodies_ord(spark, sf_dir).repartition(8)).agg(F.sum("n").alias("n"), F.count_distinct("partition").alias("tasks"))


@query(ORD_TREE + " SELECT CAST(depth AS INTEGER) AS depth, count(*) AS cells, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY depth")
def cells_by_level(spark, sf_dir):
    _, tree, _ = catalog._ord_tree(spark, sf_dir)
    tree = catalog.cut(tree)
    rows = motion.by_levels(tree, lambda d, c: (d, *c.agg(F.count("*"), F.sum("n")).first()))
    return spark.createDataFrame(rows, "depth int, cells long, n long")


@query(ORD_TREE + " SELECT CAST(s.depth AS INTEGER) AS depth, s.prefix, c.n, c.is_leaf FROM (SELECT depth, prefix FROM c0 WHERE depth IN (2, 5)) AS s LEFT JOIN c ON c.depth = s.depth AND c.prefix = s.prefix")
def found_cells(spark, sf_dir):
    placed, tree, _ = catalog._ord_tree(spark, sf_dir)
    wanted = [placed.select(F.lit(d).alias("depth"), keys.prefix_at(F.col("key"), d).alias("prefix")).distinct() for d in (2, 5)]
    return cells.find(tree, wanted[0].union(wanted[1])).select("depth", "prefix", "n", "is_leaf")


@query(with_(ORD) + " SELECT sum(mass) AS total FROM b")
def blocked_mass(spark, sf_dir):
    return spark.createDataFrame([(motion.blocked_sum(views.bodies_ord(spark, sf_dir), "mass", block=512),)], "total double")


@query(EMB_TREE + ", " + PLACED + """, o AS (SELECT leaf_depth, leaf_prefix, sum(mass) AS m, sum(mass * x) AS wx FROM pl WHERE id % 2 = 0 GROUP BY ALL)
  SELECT CAST(c.depth AS INTEGER) AS depth, c.prefix, round(c.mass - coalesce(o.m, 0), 6) + 0.0 AS mass, round((c.mass * c.cx - coalesce(wx, 0)) / (c.mass - coalesce(o.m, 0)), 6) + 0.0 AS cx
  FROM c LEFT JOIN o ON o.leaf_depth = c.depth AND o.leaf_prefix = c.prefix WHERE c.is_leaf AND c.mass - coalesce(o.m, 0) > 0""")  # fmt: skip
def leaf_residuals(spark, sf_dir):
    placed, tree, _ = catalog._emb_tree(spark, sf_dir)
    tree = catalog.cut(tree)
    rest = essential.residual(tree, cells.with_leaf(placed.where("id % 2 = 0"), tree))
    return rounded(rest.select("depth", "prefix", "mass", "cx"), 6, "mass", "cx")


@query(EMB_TREE + """, t AS (SELECT depth, prefix, n, mass, is_leaf FROM c UNION ALL SELECT depth, prefix, n, mass, true FROM c WHERE depth = 1)
  SELECT CAST(depth AS INTEGER) AS depth, prefix, CAST(sum(n) AS BIGINT) AS n, round(sum(mass), 6) + 0.0 AS mass, bool_or(is_leaf) AS is_leaf FROM t GROUP BY ALL""")  # fmt: skip
def sticky_merge(spark, sf_dir):
    _, tree, _ = catalog._emb_tree(spark, sf_dir)
    done = cells.merge_records(tree, tree.where("depth = 1").withColumn("is_leaf", F.lit(True)), sticky=True)
    return rounded(done.select("depth", "prefix", "n", "mass", "is_leaf"), 6, "mass")


# ------------------------------------------------------------------- motion

_SIX = ("x", "y", "z", "vx", "vy", "vz")


def _run_sql(steps: list[tuple[float, float, float]], last: float, dt: float) -> str:
    """A run by direct sums; of each step the kick before the drift, the kick after it
    by the forces from before, and the kick by the new forces."""
    force = lambda src, name: catalog._forces_sql(src, name).replace("AS (SELECT", "AS MATERIALIZED (SELECT", 1)
    parts, state = [EMB, force("b", "f0")], "f0"
    for i, (first, old, new) in enumerate(steps, 1):
        v = ", ".join(f"v{c} + a{c} * {first} + a{c} * {old} AS v{c}" for c in "xyz")
        x = ", ".join(f"{c} + (v{c} + a{c} * {first}) * {dt} AS {c}" for c in "xyz")
        parts += [f"m{i} AS MATERIALIZED (SELECT id, mass, {x}, {v} FROM {state})", force(f"m{i}", f"f{i}"), catalog._kicked_sql(f"f{i}", f"e{i}", new)]
        state = f"e{i}"
    parts.append(catalog._kicked_sql(state, "done", last))
    return with_(*parts) + f" SELECT {catalog._STATE} FROM done"


def _run(spark, sf_dir, integrator: str) -> DataFrame:
    end, _ = simulate.run(views.bodies_emb(spark, sf_dir), SimConfig.of("body", integrator=integrator, **catalog._RUN))
    return rounded(end.select("id", *_SIX), 6, *_SIX)


_H = 5e-5


@query(_run_sql([(0.0, 0.0, _H), (_H, 0.0, _H)], 0.0, 1e-4))
def run_drift_first(spark, sf_dir):
    return _run(spark, sf_dir, "drift_first")


@query(_run_sql([(_H, 0.0, 0.0), (1e-4, 0.0, 0.0)], _H, 1e-4))
def run_fused(spark, sf_dir):
    return _run(spark, sf_dir, "leapfrog_fused")


@query(_run_sql([(1e-4, _H, 0.0), (_H, _H, 0.0)], 0.0, 1e-4))
def run_split_kick(spark, sf_dir):
    return _run(spark, sf_dir, "split_kick")


@query(with_(EMB) + " SELECT " + ", ".join(f"{f}({c} + (v{c} + {c} * 0.5) * 0.25) AS {p}{c}" for p, f in (("l", "min"), ("h", "max")) for c in "xyz") + " FROM b")
def post_drift_box(spark, sf_dir):
    bodies = views.bodies_emb(spark, sf_dir).withColumns({"a" + c: F.col(c) for c in "xyz"})
    return motion.post_drift_box(bodies, 0.5, 0.25)


def _sums(name: str, eps2: float) -> str:
    return f"""{name} AS (SELECT t.id, {', '.join(f'sum(s.mass * (s.{c} - t.{c}) * ((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2 + {eps2}) ** -1.5) AS a{c}' for c in 'xyz')} FROM b AS t JOIN b AS s ON s.id <> t.id GROUP BY t.id)"""


@query(with_(EMB, _sums("p", 0.01), _sums("q", 1e-4), "e AS (SELECT ((p.ax - q.ax) ** 2 + (p.ay - q.ay) ** 2 + (p.az - q.az) ** 2) / (q.ax ** 2 + q.ay ** 2 + q.az ** 2) AS e2 FROM p JOIN q USING (id))") + " SELECT round(sqrt(avg(e2)), 6) + 0.0 AS rms, round(sqrt(max(e2)), 6) + 0.0 AS largest FROM e")
def softening_error(spark, sf_dir):
    bodies = views.bodies_emb(spark, sf_dir)
    both = direct.by_softenings(bodies, (0.1, 1e-2)).withColumnsRenamed({f"a{c}{i}": n + c for i, n in enumerate("pq") for c in "xyz"})
    return rounded(motion.error_of(both), 6, "rms", "largest")


@query(with_(EMB) + " SELECT round(0.0, 3) + 0.0 AS summed, count(*) AS n FROM b")
def tree_against_direct(spark, sf_dir):
    """At opening angle 0 a run by tree walks ends where one by direct sums does."""
    config = SimConfig.of("body", theta=0.0, softening=0.1, dt=1e-4, steps=1)
    _, _, error = simulate.compare_with_direct(views.bodies_emb(spark, sf_dir), config)
    return rounded(error.select("summed", "n"), 3, "summed")


# ---------------------------------------------------------------------- walks

_LEAFBOX = catalog.SQL["walk_leafbox"]
_MOMENTS = """m AS (SELECT lv.depth, lv.prefix, sum(lv.mass * (x - cx) * (x - cx)) AS xx, sum(lv.mass * (y - cy) * (y - cy)) AS yy, sum(lv.mass * (z - cz) * (z - cz)) AS zz,
    sum(lv.mass * (x - cx) * (y - cy)) AS xy, sum(lv.mass * (x - cx) * (z - cz)) AS xz, sum(lv.mass * (y - cy) * (z - cz)) AS yz FROM lv JOIN c ON c.depth = lv.depth AND c.prefix = lv.prefix GROUP BY lv.depth, lv.prefix)"""


def _acted(moments: bool, target: str, eps2: float) -> str:
    """From w (target leaf td, tp; cell; ok) to rounded accelerations; target and source
    bodies have their leaf in `target`."""
    far = f"SELECT t.id, c.mass, c.cx - t.x AS dx, c.cy - t.y AS dy, c.cz - t.z AS dz{', m.xx, m.yy, m.zz, m.xy, m.xz, m.yz' if moments else ''} FROM w JOIN {target} AS t ON t.leaf_depth = w.td AND t.leaf_prefix = w.tp JOIN c ON c.depth = w.depth AND c.prefix = w.prefix"
    far += " JOIN m ON m.depth = w.depth AND m.prefix = w.prefix WHERE ok" if moments else " WHERE ok"
    near = f"SELECT t.id, s.mass, s.x - t.x AS dx, s.y - t.y AS dy, s.z - t.z AS dz{', 0, 0, 0, 0, 0, 0' if moments else ''} FROM w JOIN {target} AS t ON t.leaf_depth = w.td AND t.leaf_prefix = w.tp JOIN {target} AS s ON s.leaf_depth = w.depth AND s.leaf_prefix = w.prefix AND s.id <> t.id WHERE NOT ok AND is_leaf"
    both = f"r0 AS (SELECT *, dx ** 2 + dy ** 2 + dz ** 2 + {eps2} AS r2 FROM ({far} UNION ALL {near}))"
    more = dict.fromkeys("xyz", "0")
    if moments:
        q = {"x": "(2 * xx - yy - zz) * dx + 3 * xy * dy + 3 * xz * dz", "y": "3 * xy * dx + (2 * yy - xx - zz) * dy + 3 * yz * dz", "z": "3 * xz * dx + 3 * yz * dy + (2 * zz - xx - yy) * dz"}
        both += ", r1 AS (SELECT *, " + ", ".join(f"{v} AS q{k}" for k, v in q.items()) + " FROM r0), r AS (SELECT *, qx * dx + qy * dy + qz * dz AS dqd FROM r1)"
        more = {c: f"(2.5 * dqd * r2 ** -3.5 * d{c} - r2 ** -2.5 * q{c})" for c in "xyz"}
    else:
        both += ", r AS (SELECT * FROM r0)"
    sums = ", ".join(f"round(sum(mass * d{c} * r2 ** -1.5 + {more[c]}), 4) + 0.0 AS a{c}" for c in "xyz")
    return f"{both} SELECT id, {sums}, round(sum(-mass / sqrt(r2)), 4) + 0.0 AS phi FROM r GROUP BY id"


def _before(sql_text: str, mark: str) -> str:
    return sql_text[: sql_text.rindex(mark)]


@query(_before(_LEAFBOX, "SELECT CAST(sum(CASE WHEN ok") .rstrip() + ", " + PLACED + ", " + _MOMENTS + ", " + _acted(True, "pl", EPS2))
def walk_leafbox_accel(spark, sf_dir):
    got = leaf_walk.accelerations(views.bodies_emb(spark, sf_dir), SimConfig.of("leaf_box", **catalog.CONFIG))
    return rounded(got.select("id", "ax", "ay", "az", "phi"), 4, "ax", "ay", "az", "phi")


@query(_before(catalog.SQL["walk_bucket"], "SELECT CAST(sum(CASE WHEN ok").rstrip() + ", pl AS (SELECT lv.*, c.depth AS leaf_depth, c.prefix AS leaf_prefix FROM lv JOIN c ON c.depth = lv.depth AND c.prefix = lv.prefix AND c.is_leaf), " + _acted(False, "pl", EPS2))
def walk_bucket_accel(spark, sf_dir):
    return rounded(catalog._emb_walk(spark, sf_dir, "bucket").accelerations(), 4, "ax", "ay", "az", "phi")


@query(catalog._walk_sql(catalog._EXACT) + " SELECT (SELECT count(*) FROM far) AS n_approx, (SELECT count(*) FROM near) AS n_direct")
def walk_arrow_counts(spark, sf_dir):
    got = arrow_walk.accelerations(views.bodies_emb(spark, sf_dir), SimConfig.of("body_exact", **catalog.CONFIG))
    return got.agg(F.sum("n_approx").alias("n_approx"), F.sum("n_direct").alias("n_direct"))


@query(catalog.SQL["walk_accel"])
def walk_tiny_broadcasts(spark, sf_dir):
    """The walk with all joins as shuffles gives the same."""
    kept, walk._BROADCAST_CELLS = walk._BROADCAST_CELLS, -1
    try:
        return rounded(catalog._emb_walk(spark, sf_dir, "body", theta=0.8).accelerations(), 5, "ax", "ay", "az", "phi")
    finally:
        walk._BROADCAST_CELLS = kept


def _part_sql(q: int) -> str:
    """The tree of part q's bodies, and what it sends to the other part."""
    accept = catalog._LET
    return f"""k{q} AS MATERIALIZED (SELECT * FROM kp WHERE part = {q}), l{q} AS MATERIALIZED (SELECT k{q}.*, depth, key >> CAST(63 - 3 * depth AS BIGINT) AS prefix FROM k{q}, range(0, 22) AS t(depth)),
  z{q} AS MATERIALIZED (SELECT depth, prefix, count(*) AS n, sum(mass) AS mass, sum(mass * x) / sum(mass) AS cx, sum(mass * y) / sum(mass) AS cy, sum(mass * z) / sum(mass) AS cz FROM l{q} GROUP BY depth, prefix),
  c{q} AS MATERIALIZED (SELECT a.*, (a.n <= 8 OR a.depth = 21) AS is_leaf FROM z{q} AS a LEFT JOIN z{q} AS p ON p.depth = a.depth - 1 AND p.prefix = a.prefix >> 3 WHERE a.depth = 0 OR p.n > 8),
  w{q} AS (SELECT t.part AS dest, t.lx, t.hx, t.ly, t.hy, t.lz, t.hz, c.*, {accept} AS accepted FROM bx AS t JOIN c{q} AS c ON c.depth = 0 AND t.part <> {q}, d
    UNION ALL
    SELECT t.dest, t.lx, t.hx, t.ly, t.hy, t.lz, t.hz, c.*, {accept} FROM w{q} AS t JOIN c{q} AS c ON c.depth = t.depth + 1 AND c.prefix >> 3 = t.prefix, d WHERE NOT t.accepted AND NOT t.is_leaf)"""


def _sent_sql(q: int) -> str:
    return f"SELECT dest, mass, cx, cy, cz FROM w{q} WHERE accepted UNION ALL SELECT w.dest, l.mass, l.x, l.y, l.z FROM w{q} AS w JOIN l{q} AS l ON l.depth = w.depth AND l.prefix = w.prefix WHERE NOT w.accepted AND w.is_leaf"


@query(with_(EMB, DOM, KEYED, catalog._PARTED, _part_sql(0), _part_sql(1), f"sent AS ({_sent_sql(0)} UNION ALL {_sent_sql(1)})",
             f"""i AS (SELECT t.id, s.mass, s.cx - t.x AS dx, s.cy - t.y AS dy, s.cz - t.z AS dz FROM kp AS t JOIN sent AS s ON s.dest = t.part UNION ALL SELECT t.id, s.mass, s.x - t.x, s.y - t.y, s.z - t.z FROM kp AS t JOIN kp AS s ON s.part = t.part AND s.id <> t.id),
  a AS (SELECT *, dx ** 2 + dy ** 2 + dz ** 2 + {EPS2} AS r2 FROM i)""")
       + " SELECT id, " + ", ".join(f"round(sum(mass * d{c} * r2 ** -1.5), 4) + 0.0 AS a{c}" for c in "xyz") + ", round(sum(-mass / sqrt(r2)), 4) + 0.0 AS phi FROM a GROUP BY id")
def walk_essential(spark, sf_dir):
    bodies = views.bodies_emb(spark, sf_dir)
    dom = cubic_domain(bodies)
    config = SimConfig.of("body", theta=0.0, **catalog.CONFIG)
    return rounded(essential.accelerations(catalog._parted(keyed(bodies, dom)), config, dom, 0.5), 4, "ax", "ay", "az", "phi")


@query(with_(EMB, DOM, KEYED, "s AS (SELECT key >> 54 AS p, sum(mass) AS mass, sum(mass * x) / sum(mass) AS cx, sum(mass * y) / sum(mass) AS cy, sum(mass * z) / sum(mass) AS cz FROM k GROUP BY 1)",
             "i AS (SELECT b.id, s.mass, cx - x AS dx, cy - y AS dy, cz - z AS dz FROM b, s)", f"a AS (SELECT *, dx ** 2 + dy ** 2 + dz ** 2 + {EPS2} AS r2 FROM i WHERE dx ** 2 + dy ** 2 + dz ** 2 + {EPS2} > 1e-12)")
       + " SELECT id, " + ", ".join(f"round(sum(mass * d{c} * r2 ** -1.5), 4) + 0.0 AS a{c}" for c in "xyz") + " FROM a GROUP BY id")
def direct_records(spark, sf_dir):
    bodies = views.bodies_emb(spark, sf_dir)
    records = cells.all_cells(keyed(bodies, cubic_domain(bodies)), 3).where("depth = 3")
    return rounded(direct.by_records(bodies, records, 1e-2).drop("phi"), 4, "ax", "ay", "az")


# ------------------------------------------------------------------ generators


def _facts(df: DataFrame, name: str) -> DataFrame:
    m = F.col("mass")
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct("id").alias("ids"), (F.round(F.sum(m), 6) + 0.0).alias("mass"), *((F.round(F.abs(F.sum(m * F.col(c))), 6) + 0.0).alias("m" + c) for c in ("x", "vx")))


@query("""SELECT t.name, CAST(p.n + t.more AS BIGINT) AS n, CAST(p.n + t.more AS BIGINT) AS ids, t.mass, 0.0::DOUBLE AS mx, 0.0::DOUBLE AS mvx
  FROM (SELECT count(*) AS n FROM part) AS p, (VALUES ('mirrored', 1, 1.0::DOUBLE), ('collision', 0, 1.0), ('plummer', 0, 5.0), ('systems', 20, 7.0)) AS t(name, more, mass)""")
def generated_sets(spark, sf_dir):
    """Sets of as many bodies as there are parts."""
    n = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    config = f'{{"seed": 4, "systems": [{{"particles": {n}, "total_mass": 4, "scale_radius": 2}}, {{"particles": 20, "total_mass": 3, "position": [9, 0, 0]}}]}}'
    sets = {
        "mirrored": generate.mirrored(spark, n + 1, 2), "collision": motion.recentre(generate.collision(spark, n, 3)),
        "plummer": motion.recentre(generate.plummer(spark, n, 1, total_mass=5.0)), "systems": motion.recentre(generate.from_json(spark, config)),
    }
    out = [_facts(df, name) for name, df in sets.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("SELECT l_linenumber AS line, count(*) AS n, count(*) AS inside, count(*) AS masses FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1")
def uniform_set(spark, sf_dir):
    """A body in a cube for each order's line."""
    keys_ = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    b = generate.uniform_cube_of(keys_.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")), 5, half=10.0, speed=1.0)
    inside = F.lit(True)
    for c in "xyz":
        inside = inside & F.col(c).between(-10, 10) & F.col("v" + c).between(-1, 1)
    count = lambda test: F.sum(test.cast("long"))
    return b.groupBy((F.col("id") % 8).cast("int").alias("line")).agg(F.count("*").alias("n"), count(inside).alias("inside"), count(F.col("mass").between(0.5, 1.5)).alias("masses"))


@query("SELECT true AS bound, count(*) AS n FROM customer")
def plummer_virial(spark, sf_dir):
    """A sphere, with a body for each customer, is in equilibrium: twice its kinetic
    energy is about its potential one.  Only if limits of that one don't tell are all pairs summed."""
    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"))
    n = ids.count()
    bound = energy_bounds.virial_between(generate.plummer_of(ids, n, 3), 0.8, 1.2)
    return spark.range(1).select(F.lit(bound).alias("bound"), F.lit(n).alias("n"))
