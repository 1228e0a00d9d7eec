"""The registered queries and the SQL that gives the same rows.

Physics is rounded where sums depend on their order.  SQL texts are built from
shared common table expressions: bodies, domain, keys, cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitalis.functions import durations, geometry, keys
from orbitalis.operators import arrow_walk, cells, direct, elements, essential, leaf_walk, motion, partition, ranking, walk
from orbitalis.operators.scratch import cut  # noqa: F401
from orbitalis.operators.domain import Domain, bounding_box, cubic_domain, keyed
from orbitalis.plans import simulate
from orbitalis.plans.config import SimConfig
from orbitalis.sources import generate, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


# ---------------------------------------------------------------- shared SQL

EMB = """b AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(label + 1 AS DOUBLE) AS mass, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
  CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS vx, CAST(embedding[5] AS DOUBLE) AS vy, CAST(embedding[6] AS DOUBLE) AS vz FROM embeddings)"""
ORD = """b AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(1 + o_custkey % 7 AS DOUBLE) AS mass, CAST(o_totalprice AS DOUBLE) AS x, CAST(o_custkey * 100 AS DOUBLE) AS y,
  CAST((o_orderkey % 997) * 100 AS DOUBLE) AS z FROM orders)"""
DOM = "d AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS s FROM b)"


def _q(c: str) -> str:
    return f"CAST(least(greatest(floor((b.{c} - d.l{c}) / d.s * 2097152.0), 0), 2097151) AS BIGINT)"


def _interleave(x: str, y: str, z: str) -> str:
    return f"CAST(list_sum([((({x} >> i) & 1) << (3 * i)) + ((({y} >> i) & 1) << (3 * i + 1)) + ((({z} >> i) & 1) << (3 * i + 2)) for i in range(21)]) AS BIGINT)"


KEYED = f"q AS (SELECT b.*, {_q('x')} AS ix, {_q('y')} AS iy, {_q('z')} AS iz FROM b, d), k AS MATERIALIZED (SELECT *, {_interleave('ix', 'iy', 'iz')} AS key FROM q)"
ALL = """lv AS MATERIALIZED (SELECT k.*, depth, key >> CAST(63 - 3 * depth AS BIGINT) AS prefix FROM k, range(0, 22) AS t(depth)),
  c0 AS MATERIALIZED (SELECT depth, prefix, count(*) AS n, sum(mass) AS mass, sum(mass * x) / sum(mass) AS cx, sum(mass * y) / sum(mass) AS cy, sum(mass * z) / sum(mass) AS cz,
    min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM lv GROUP BY depth, prefix)"""


def _tree(cap: int) -> str:
    return f"""c AS MATERIALIZED (SELECT a.*, (a.n <= {cap} OR a.depth = 21) AS is_leaf FROM c0 AS a LEFT JOIN c0 AS p ON p.depth = a.depth - 1 AND p.prefix = a.prefix >> 3
    WHERE a.depth = 0 OR p.n > {cap})"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)


EMB_TREE = _with(EMB, DOM, KEYED, ALL, _tree(8))
ORD_TREE = _with(ORD, DOM, KEYED, ALL, _tree(16))
PLACED = "pl AS (SELECT lv.*, c.depth AS leaf_depth, c.prefix AS leaf_prefix FROM lv JOIN c ON c.depth = lv.depth AND c.prefix = lv.prefix AND c.is_leaf)"
EPS2 = 1e-4
CONFIG = {"leaf_size": 8, "softening": 1e-2, "pad": 0.0}


def _ord_tree(spark: SparkSession, sf_dir: str, **more) -> tuple[DataFrame, DataFrame, Domain]:
    bodies = views.bodies_ord(spark, sf_dir)
    domain = cubic_domain(bodies)
    placed = keyed(bodies, domain)
    middle = tuple(lo + domain.span / 2 for lo in domain.low)
    return placed, cells.tree(placed, 16, origin=middle, **more), domain


def _emb_tree(spark: SparkSession, sf_dir: str, **more) -> tuple[DataFrame, DataFrame, Domain]:
    bodies = views.bodies_emb(spark, sf_dir)
    domain = cubic_domain(bodies)
    return keyed(bodies, domain), cells.tree(keyed(bodies, domain), 8, domain=domain, **more), domain


# ------------------------------------------------------------- keys and cells


@query(_with(ORD) + " SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS hx, max(y) AS hy, max(z) AS hz FROM b")
def bbox(spark, sf_dir):
    return bounding_box(views.bodies_ord(spark, sf_dir))


@query(_with(ORD, DOM, KEYED) + " SELECT id, key FROM k")
def morton_keys(spark, sf_dir):
    bodies = views.bodies_ord(spark, sf_dir)
    return keyed(bodies, cubic_domain(bodies)).select("id", "key")


@query(_with(ORD, DOM, KEYED) + " SELECT id, ix, iy, iz FROM k")
def morton_roundtrip(spark, sf_dir):
    bodies = views.bodies_ord(spark, sf_dir)
    return keyed(bodies, cubic_domain(bodies)).select("id", *(c.alias("i" + n) for c, n in zip(keys.decode(F.col("key")), "xyz", strict=True)))


@query(_with(ORD, DOM, KEYED) + " SELECT id, key, row_number() OVER (ORDER BY key, id) - 1 AS place FROM k")
def key_order(spark, sf_dir):
    bodies = views.bodies_ord(spark, sf_dir)
    return ranking.ranked(keyed(bodies, cubic_domain(bodies)).select("id", "key"), "place", "key", "id")


@query(ORD_TREE + " SELECT CAST(depth AS INTEGER) AS depth, prefix, n, round(mass, 6) AS mass, round(mass * cx, 2) + 0.0 AS mx, round(mass * cy, 2) + 0.0 AS my, round(mass * cz, 2) + 0.0 AS mz, is_leaf FROM c")
def tree_cells(spark, sf_dir):
    _, tree, _ = _ord_tree(spark, sf_dir)
    moments = {"m" + c: F.round(F.col("mass") * F.col("c" + c), 2) + 0.0 for c in "xyz"}  # exact in cents
    return tree.select("depth", "prefix", "n", F.round("mass", 6).alias("mass"), *(v.alias(k) for k, v in moments.items()), "is_leaf")


@query(ORD_TREE + " SELECT CAST(depth AS INTEGER) AS depth, prefix, n, is_leaf FROM c")
def tree_by_levels(spark, sf_dir):
    placed, _, _ = _ord_tree(spark, sf_dir)
    return cells.tree_by_levels(placed, 16, step=3).select("depth", "prefix", "n", "is_leaf")


@query(
    EMB_TREE
    + """, m AS (SELECT lv.depth, lv.prefix, sum(lv.mass * (x - cx) * (x - cx)) AS xx, sum(lv.mass * (y - cy) * (y - cy)) AS yy, sum(lv.mass * (z - cz) * (z - cz)) AS zz,
    sum(lv.mass * (x - cx) * (y - cy)) AS xy, sum(lv.mass * (x - cx) * (z - cz)) AS xz, sum(lv.mass * (y - cy) * (z - cz)) AS yz
    FROM lv JOIN c ON c.depth = lv.depth AND c.prefix = lv.prefix GROUP BY lv.depth, lv.prefix)
  SELECT CAST(depth AS INTEGER) AS depth, prefix, round(xx, 6) + 0.0 AS xx, round(yy, 6) + 0.0 AS yy, round(zz, 6) + 0.0 AS zz, round(xy, 6) + 0.0 AS xy, round(xz, 6) + 0.0 AS xz, round(yz, 6) + 0.0 AS yz FROM m"""
)
def cells_quadrupole(spark, sf_dir):
    _, tree, _ = _emb_tree(spark, sf_dir, second=True)
    return rounded(tree.select("depth", "prefix", *cells.SECOND), 6, *cells.SECOND)


@query(ORD_TREE + ", " + PLACED + " SELECT CAST(leaf_depth AS INTEGER) AS leaf_depth, leaf_prefix, count(*) AS n, min(id) AS first_id FROM pl GROUP BY leaf_depth, leaf_prefix")
def leaf_occupancy(spark, sf_dir):
    placed, tree, _ = _ord_tree(spark, sf_dir)
    return cells.with_leaf(placed, tree).groupBy("leaf_depth", "leaf_prefix").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(ORD_TREE + " SELECT CAST(depth AS INTEGER) AS depth, prefix, n FROM c WHERE is_leaf ORDER BY n DESC, depth, prefix LIMIT 20")
def heaviest_leaves(spark, sf_dir):
    _, tree, _ = _ord_tree(spark, sf_dir)
    return partition.heaviest(tree.where("is_leaf").select("depth", "prefix", "n"), 20)


@query(
    ORD_TREE
    + """ SELECT CAST(depth AS INTEGER) AS depth, prefix, round(d.s / (1 << depth), 6) + 0.0 AS side,
  round(d.lx + (list_sum([((prefix >> (3 * i)) & 1) << i for i in range(21)]) + 0.5) * (d.s / (1 << depth)), 3) + 0.0 AS mx,
  round(d.ly + (list_sum([((prefix >> (3 * i + 1)) & 1) << i for i in range(20)]) + 0.5) * (d.s / (1 << depth)), 3) + 0.0 AS my,
  round(d.lz + (list_sum([((prefix >> (3 * i + 2)) & 1) << i for i in range(20)]) + 0.5) * (d.s / (1 << depth)), 3) + 0.0 AS mz FROM c, d WHERE depth <= 20"""
)
def cell_boxes(spark, sf_dir):
    _, tree, domain = _ord_tree(spark, sf_dir)
    middle = geometry.cell_centre(F.col("depth"), F.col("prefix"), domain)
    out = tree.where("depth <= 20").select("depth", "prefix", geometry.cell_side(F.col("depth"), domain.span).alias("side"), *(m.alias("m" + c) for m, c in zip(middle, "xyz", strict=True)))
    return rounded(rounded(out, 6, "side"), 3, "mx", "my", "mz")


@query(ORD_TREE + f""", nb AS (SELECT depth, prefix, CAST(list_sum([((prefix >> (3 * i)) & 1) << i for i in range(21)]) AS BIGINT) + 1 AS ix,
    CAST(list_sum([((prefix >> (3 * i + 1)) & 1) << i for i in range(20)]) AS BIGINT) AS iy, CAST(list_sum([((prefix >> (3 * i + 2)) & 1) << i for i in range(20)]) AS BIGINT) AS iz FROM c WHERE is_leaf AND depth <= 20)
  SELECT CAST(depth AS INTEGER) AS depth, prefix, CASE WHEN ix < (1 << depth) THEN {_interleave('ix', 'iy', 'iz')} END AS right_prefix FROM nb""")  # fmt: skip
def cell_neighbours(spark, sf_dir):
    _, tree, _ = _ord_tree(spark, sf_dir)
    return tree.where("is_leaf and depth <= 20").select("depth", "prefix", keys.neighbour(F.col("prefix"), F.col("depth"), 1, 0, 0).alias("right_prefix"))


@query(ORD_TREE + """, kid AS (SELECT depth - 1 AS depth, prefix >> 3 AS prefix, sum(n) AS kn FROM c WHERE depth > 0 GROUP BY ALL)
  SELECT (SELECT count(*) FROM b) AS n, (SELECT sum(mass) FROM b) AS mass, (SELECT CAST(sum(n) AS BIGINT) FROM c WHERE depth = 0) AS root_n, (SELECT sum(mass) FROM c WHERE depth = 0) AS root_mass,
    (SELECT CAST(sum(n) AS BIGINT) FROM c WHERE is_leaf) AS leaf_n, (SELECT sum(mass) FROM c WHERE is_leaf) AS leaf_mass,
    (SELECT count(*) FROM c LEFT JOIN kid USING (depth, prefix) WHERE NOT is_leaf AND kn IS DISTINCT FROM n) AS wrong_cells""")  # fmt: skip
def tree_invariants(spark, sf_dir):
    placed, tree, _ = _ord_tree(spark, sf_dir)
    return motion.check_tree(placed, tree)


# ------------------------------------------------------------- partitioning


@query(_with(ORD, DOM, KEYED) + " SELECT key >> 54 AS bucket, count(*) AS cnt FROM k GROUP BY 1")
def key_histogram(spark, sf_dir):
    bodies = views.bodies_ord(spark, sf_dir)
    return partition.key_histogram(keyed(bodies, cubic_domain(bodies)), 9)


def _splitters_sql(parts: int) -> str:
    # at most one splitter a bucket: walk the buckets in order with the number of closed parts
    return _with(
        ORD, DOM, KEYED, "h AS (SELECT key >> 54 AS bucket, count(*) AS cnt FROM k GROUP BY 1)",
        "o AS (SELECT bucket, cnt, sum(cnt) OVER (ORDER BY bucket) AS run, row_number() OVER (ORDER BY bucket) AS r FROM h)",
        f"e AS (SELECT CAST(ceil(sum(cnt) / {parts}.0) AS BIGINT) AS each FROM h)",
        f"""s AS (SELECT 0::BIGINT AS r, 0::BIGINT AS closed, 0::BIGINT AS part, -1::BIGINT AS bucket, 0::BIGINT AS cnt
        UNION ALL SELECT o.r, CASE WHEN s.closed < {parts - 1} AND o.run >= (s.closed + 1) * e.each THEN s.closed + 1 ELSE s.closed END, s.closed, o.bucket, o.cnt
        FROM s JOIN o ON o.r = s.r + 1, e)""",
    ) + " SELECT bucket, cnt, CAST(part AS INTEGER) AS part FROM s WHERE r > 0"


@query(_splitters_sql(6))
def splitters(spark, sf_dir):
    hist = key_histogram(spark, sf_dir)
    return partition.assign_parts(hist, partition.splitters(hist, 6))


@query(_with(ORD, DOM, KEYED) + " SELECT CAST(tile AS INTEGER) AS tile, count(*) AS n FROM (SELECT ntile(7) OVER (ORDER BY key, id) AS tile FROM k) GROUP BY 1")
def key_tiles(spark, sf_dir):
    bodies = views.bodies_ord(spark, sf_dir)
    return partition.tiles(keyed(bodies, cubic_domain(bodies)), 7)


_REFINE = ",\n".join(
    [f"g0 AS (SELECT 0::BIGINT AS prefix, count(*) AS n FROM k), s0 AS (SELECT prefix FROM g0 WHERE n > 400)"]
    + [f"g{d} AS (SELECT key >> {63 - d} AS prefix, count(*) AS n FROM k WHERE key >> {64 - d} IN (SELECT prefix FROM s{d - 1}) GROUP BY 1), s{d} AS (SELECT prefix FROM g{d} WHERE n > 400)" for d in range(1, 64)]
)


@query(_with(ORD, DOM, KEYED, _REFINE) + " " + " UNION ALL ".join(f"SELECT {d} AS depth, prefix, n FROM g{d} WHERE n <= 400 OR {d} = 63" for d in range(64)))
def refine_bins(spark, sf_dir):
    bodies = views.bodies_ord(spark, sf_dir)
    return spark.createDataFrame(partition.refine_bins(keyed(bodies, cubic_domain(bodies)), 400, 1 << 20), "depth int, prefix long, n long")


@query("SELECT CAST(s AS INTEGER) AS slice, CAST(floor(s * n / (5 * 16)) * 16 AS BIGINT) AS start FROM range(5) AS t(s), (SELECT count(*) AS n FROM orders)")
def slices(spark, sf_dir):
    n = views.bodies_ord(spark, sf_dir).count()
    return spark.createDataFrame(list(enumerate(partition.slice_starts(n, 5, 16))), "slice int, start long")


# ---------------------------------------------------------- exact interactions

_PAIR = f"""p AS (SELECT t.id, s.mass AS m, s.x - t.x AS dx, s.y - t.y AS dy, s.z - t.z AS dz, (s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2 + {EPS2} AS r2 FROM b AS t JOIN b AS s ON s.id <> t.id)"""


@query(_with(EMB, _PAIR) + """ SELECT id, round(sum(m * dx * r2 ** -1.5), 5) + 0.0 AS ax, round(sum(m * dy * r2 ** -1.5), 5) + 0.0 AS ay, round(sum(m * dz * r2 ** -1.5), 5) + 0.0 AS az,
  round(sum(-m / sqrt(r2)), 5) + 0.0 AS phi FROM p GROUP BY id""")  # fmt: skip
def direct_accel(spark, sf_dir):
    return rounded(direct.accelerations(views.bodies_emb(spark, sf_dir), 1e-2), 5, "ax", "ay", "az", "phi")


@query(_with(EMB) + " SELECT round(sum(-t.mass * s.mass / sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2)), 3) + 0.0 AS potential FROM b AS t JOIN b AS s ON t.id < s.id")
def direct_potential(spark, sf_dir):
    return rounded(direct.potential_energy(views.bodies_emb(spark, sf_dir)), 3, "potential")


@query(_with(EMB) + " SELECT round(sum(0.5 * mass * (vx ** 2 + vy ** 2 + vz ** 2)), 6) + 0.0 AS kinetic FROM b")
def kinetic(spark, sf_dir):
    return rounded(motion.kinetic(views.bodies_emb(spark, sf_dir)), 6, "kinetic")


# ------------------------------------------------------------------ tree walks


def _walk_sql(accept: str) -> str:
    cell = "c.depth, c.prefix, c.is_leaf, c.mass, c.cx, c.cy, c.cz"
    return (
        EMB_TREE + ", " + PLACED + f""", w AS (
    SELECT t.id AS tid, t.x AS tx, t.y AS ty, t.z AS tz, t.key AS tkey, {cell}, {accept} AS ok FROM k AS t JOIN c ON c.depth = 0, d
    UNION ALL
    SELECT t.tid, t.tx, t.ty, t.tz, t.tkey, {cell}, {accept.replace('t.x', 't.tx').replace('t.y', 't.ty').replace('t.z', 't.tz').replace('t.key', 't.tkey')} AS ok
    FROM w AS t JOIN c ON c.depth = t.depth + 1 AND c.prefix >> 3 = t.prefix, d WHERE NOT t.ok AND NOT t.is_leaf),
  far AS (SELECT tid, mass, cx - tx AS dx, cy - ty AS dy, cz - tz AS dz FROM w WHERE ok),
  near AS (SELECT w.tid, s.mass, s.x - w.tx AS dx, s.y - w.ty AS dy, s.z - w.tz AS dz FROM w JOIN pl AS s ON s.leaf_depth = w.depth AND s.leaf_prefix = w.prefix AND s.id <> w.tid WHERE NOT w.ok AND w.is_leaf)"""
    )


_D2 = "((c.cx - t.x) ** 2 + (c.cy - t.y) ** 2 + (c.cz - t.z) ** 2)"
_SIDE2 = "(d.s / (1 << c.depth)) ** 2"
_GUARDED = f"({_SIDE2} < 0.8 * 0.8 * {_D2} AND t.key >> CAST(63 - 3 * c.depth AS BIGINT) <> c.prefix)"
_EXACT = f"(NOT c.is_leaf AND {_SIDE2} < 0.25 * {_D2})"
_SOFT = f"({_SIDE2} < 0.25 * ({_D2} + {EPS2}))"
_ACTED = f"""a AS (SELECT tid, mass, dx, dy, dz, dx ** 2 + dy ** 2 + dz ** 2 + {EPS2} AS r2 FROM (SELECT * FROM far UNION ALL SELECT * FROM near))
  SELECT tid AS id, round(sum(mass * dx * r2 ** -1.5), 5) + 0.0 AS ax, round(sum(mass * dy * r2 ** -1.5), 5) + 0.0 AS ay, round(sum(mass * dz * r2 ** -1.5), 5) + 0.0 AS az,
    round(sum(-mass / sqrt(r2)), 5) + 0.0 AS phi FROM a GROUP BY tid"""


def _emb_walk(spark, sf_dir, dialect: str, **more) -> walk.Walk:
    return walk.Walk(views.bodies_emb(spark, sf_dir), SimConfig.of(dialect, **{**CONFIG, **more}))


@query(_walk_sql(_GUARDED) + ", " + _ACTED)
def walk_accel(spark, sf_dir):
    return rounded(_emb_walk(spark, sf_dir, "body", theta=0.8).accelerations(), 5, "ax", "ay", "az", "phi")


@query(_walk_sql(_EXACT) + ", " + _ACTED)
def walk_exact_leaves(spark, sf_dir):
    return rounded(_emb_walk(spark, sf_dir, "body_exact").accelerations(), 5, "ax", "ay", "az", "phi")


@query(_walk_sql(_EXACT) + ", " + _ACTED)
def walk_arrow(spark, sf_dir):
    got = arrow_walk.accelerations(views.bodies_emb(spark, sf_dir), SimConfig.of("body_exact", **CONFIG))
    return rounded(got.select("id", "ax", "ay", "az", "phi"), 5, "ax", "ay", "az", "phi")


@query(_walk_sql(_SOFT) + " SELECT (SELECT count(*) FROM far) AS n_approx, (SELECT count(*) FROM near) AS n_direct")
def walk_counts(spark, sf_dir):
    return _emb_walk(spark, sf_dir, "body_soft").counts()


@query(_with(EMB) + " SELECT id, round((SELECT sum(mass) FROM b) - mass, 6) + 0.0 AS mass FROM b")
def walk_mass(spark, sf_dir):
    return rounded(_emb_walk(spark, sf_dir, "body", theta=0.8).interacted_mass(), 6, "mass")


def _leaf_walk_sql() -> str:
    middle = ", ".join(
        f"d.l{c} + (CAST(list_sum([((c.prefix >> (3 * i + {o})) & 1) << i for i in range({21 - (o > 0)})]) AS BIGINT) + 0.5) * (d.s / (1 << c.depth)) AS t{c}" for o, c in enumerate("xyz")
    )
    accept = f"(NOT c.is_leaf AND d.s / (1 << c.depth) < 0.5 * (sqrt({_D2.replace('t.x', 't.tx').replace('t.y', 't.ty').replace('t.z', 't.tz')}) - sqrt(3.0) * t.half))"
    return (
        EMB_TREE + f""", tg AS (SELECT c.depth AS td, c.prefix AS tp, c.n AS tn, {middle}, d.s / (1 << c.depth) / 2 AS half FROM c, d WHERE c.is_leaf),
  w AS (SELECT t.*, c.depth, c.prefix, c.is_leaf, c.n, {accept} AS ok FROM tg AS t JOIN c ON c.depth = 0, d
    UNION ALL
    SELECT t.td, t.tp, t.tn, t.tx, t.ty, t.tz, t.half, c.depth, c.prefix, c.is_leaf, c.n, {accept} FROM w AS t JOIN c ON c.depth = t.depth + 1 AND c.prefix >> 3 = t.prefix, d WHERE NOT t.ok AND NOT t.is_leaf)
  SELECT CAST(sum(CASE WHEN ok THEN tn ELSE 0 END) AS BIGINT) AS n_approx,
    CAST(sum(CASE WHEN NOT ok AND is_leaf THEN tn * n - CASE WHEN td = depth AND tp = prefix THEN tn ELSE 0 END ELSE 0 END) AS BIGINT) AS n_direct FROM w"""
    )


@query(_leaf_walk_sql())
def walk_leafbox(spark, sf_dir):
    got = leaf_walk.accelerations(views.bodies_emb(spark, sf_dir), SimConfig.of("leaf_box", **{**CONFIG, "softening": 0.0}))
    return got.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_approx", "n_direct")))


_BIN = """lv AS MATERIALIZED (SELECT k.*, depth, key >> CAST(63 - depth AS BIGINT) AS prefix FROM k, range(0, 64) AS t(depth)),
  c0 AS MATERIALIZED (SELECT depth, prefix, count(*) AS n, sum(mass) AS mass, sum(mass * x) / sum(mass) AS cx, sum(mass * y) / sum(mass) AS cy, sum(mass * z) / sum(mass) AS cz,
    min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM lv GROUP BY depth, prefix),
  c1 AS MATERIALIZED (SELECT a.*, (a.n <= 8 OR a.depth = 63) AS is_leaf FROM c0 AS a LEFT JOIN c0 AS p ON p.depth = a.depth - 1 AND p.prefix = a.prefix >> 1 WHERE a.depth = 0 OR p.n > 8),
  far2 AS (SELECT lv.depth, lv.prefix, max((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) AS f FROM lv JOIN c1 ON c1.depth = lv.depth AND c1.prefix = lv.prefix AND is_leaf GROUP BY ALL),
  c AS (SELECT c1.*, coalesce(f, greatest(hx - cx, cx - lx) ** 2 + greatest(hy - cy, cy - ly) ** 2 + greatest(hz - cz, cz - lz) ** 2) AS rsq FROM c1 LEFT JOIN far2 USING (depth, prefix))"""
_BUCKET = "(NOT (t.td = c.depth AND t.tp = c.prefix) AND NOT (0.25 * ((c.cx - t.tx) ** 2 + (c.cy - t.ty) ** 2 + (c.cz - t.tz) ** 2) < c.rsq))"


@query(_with(EMB, DOM, KEYED, _BIN) + f""", tg AS (SELECT depth AS td, prefix AS tp, n AS tn, cx AS tx, cy AS ty, cz AS tz FROM c WHERE is_leaf),
  w AS (SELECT t.*, c.depth, c.prefix, c.is_leaf, c.n, {_BUCKET} AS ok FROM tg AS t JOIN c ON c.depth = 0
    UNION ALL
    SELECT t.td, t.tp, t.tn, t.tx, t.ty, t.tz, c.depth, c.prefix, c.is_leaf, c.n, {_BUCKET} FROM w AS t JOIN c ON c.depth = t.depth + 1 AND c.prefix >> 1 = t.prefix WHERE NOT t.ok AND NOT t.is_leaf)
  SELECT CAST(sum(CASE WHEN ok THEN tn ELSE 0 END) AS BIGINT) AS n_approx,
    CAST(sum(CASE WHEN NOT ok AND is_leaf THEN tn * n - CASE WHEN td = depth AND tp = prefix THEN tn ELSE 0 END ELSE 0 END) AS BIGINT) AS n_direct FROM w""")  # fmt: skip
def walk_bucket(spark, sf_dir):
    return _emb_walk(spark, sf_dir, "bucket").counts()


# -------------------------------------------------- essential and merged trees

_PARTED = "kp AS (SELECT *, CASE WHEN x < 0 THEN 0 ELSE 1 END AS part FROM k), bx AS (SELECT part, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM kp GROUP BY part)"
_GAP2 = " + ".join(f"greatest(0, t.l{c} - c.c{c}, c.c{c} - t.h{c}) ** 2" for c in "xyz")
_LET = f"({_SIDE2} < 0.25 * ({_GAP2}))"


def _parted(placed: DataFrame) -> DataFrame:
    return placed.withColumn("part", F.when(F.col("x") < 0, 0).otherwise(1))


@query(EMB_TREE + ", " + _PARTED + f""", w AS (SELECT t.part AS dest, t.lx, t.hx, t.ly, t.hy, t.lz, t.hz, c.depth, c.prefix, c.n, c.is_leaf, {_LET} AS accepted FROM bx AS t JOIN c ON c.depth = 0, d
    UNION ALL
    SELECT t.dest, t.lx, t.hx, t.ly, t.hy, t.lz, t.hz, c.depth, c.prefix, c.n, c.is_leaf, {_LET} FROM w AS t JOIN c ON c.depth = t.depth + 1 AND c.prefix >> 3 = t.prefix, d WHERE NOT t.accepted AND NOT t.is_leaf)
  SELECT CAST(dest AS INTEGER) AS dest, CAST(depth AS INTEGER) AS depth, prefix, n, is_leaf, accepted FROM w WHERE accepted OR is_leaf""")  # fmt: skip
def essential_records(spark, sf_dir):
    placed, tree, domain = _emb_tree(spark, sf_dir)
    sent = essential.records(tree, essential.part_boxes(_parted(placed)), 0.5, domain.span)
    return sent.select("dest", "depth", "prefix", "n", "is_leaf", "accepted")


@query(EMB_TREE + ", " + _PARTED + """ SELECT CAST(c.depth AS INTEGER) AS depth, c.prefix, c.n, o.owners FROM c JOIN
  (SELECT depth, key >> CAST(63 - 3 * depth AS BIGINT) AS prefix, count(DISTINCT part) AS owners FROM kp, range(0, 4) AS t(depth) GROUP BY ALL) AS o ON o.depth = c.depth AND o.prefix = c.prefix""")  # fmt: skip
def coarse_tree(spark, sf_dir):
    placed, tree, _ = _emb_tree(spark, sf_dir)
    return essential.coarse(tree, _parted(placed), 3).select("depth", "prefix", "n", "owners")


@query(_with(EMB, DOM, KEYED, ALL) + " SELECT CAST(depth AS INTEGER) AS depth, prefix, n, round(mass, 6) + 0.0 AS mass, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, round(cz, 6) + 0.0 AS cz FROM c0 WHERE depth <= 6")
def merged_trees(spark, sf_dir):
    bodies = views.bodies_emb(spark, sf_dir)
    placed = keyed(bodies, cubic_domain(bodies))
    halves = [cells.all_cells(placed.where(cond), 6).withColumn("is_leaf", F.lit(True)) for cond in ("id % 2 = 0", "id % 2 <> 0")]
    return rounded(cells.merge_records(*halves).drop("is_leaf"), 6, "mass", "cx", "cy", "cz")


@query(EMB_TREE + " SELECT CAST(depth AS INTEGER) AS depth, prefix, n, round(mass, 6) + 0.0 AS mass, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, round(cz, 6) + 0.0 AS cz, is_leaf FROM c")
def tree_from_leaves(spark, sf_dir):
    _, tree, _ = _emb_tree(spark, sf_dir)
    return rounded(cells.from_leaves(tree.where("is_leaf")), 6, "mass", "cx", "cy", "cz")


# ------------------------------------------------------------------- motion

_STATE = "id, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("x", "y", "z", "vx", "vy", "vz"))


def _forces_sql(state: str, name: str) -> str:
    """CTE: the state's bodies with direct accelerations, in id order."""
    return f"""{name} AS (SELECT t.*, f.ax, f.ay, f.az, f.phi FROM {state} AS t JOIN (SELECT t.id, sum(s.mass * (s.x - t.x) * r2 ** -1.5) AS ax, sum(s.mass * (s.y - t.y) * r2 ** -1.5) AS ay,
      sum(s.mass * (s.z - t.z) * r2 ** -1.5) AS az, sum(-s.mass / sqrt(r2)) AS phi
      FROM (SELECT t.id, t.x, t.y, t.z, s.id AS sid, (s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2 + 0.01 AS r2 FROM {state} AS t JOIN {state} AS s ON s.id <> t.id) AS t JOIN {state} AS s ON s.id = t.sid GROUP BY t.id) AS f USING (id))"""


def _moved_sql(src: str, name: str, h: float, dt: float) -> str:
    v = ", ".join(f"v{c} + a{c} * {h} AS v{c}" for c in "xyz")
    x = ", ".join(f"{c} + (v{c} + a{c} * {h}) * {dt} AS {c}" for c in "xyz")
    return f"{name} AS MATERIALIZED (SELECT id, mass, {x}, {v} FROM {src})"


def _kicked_sql(src: str, name: str, h: float) -> str:
    return f"{name} AS MATERIALIZED (SELECT id, mass, x, y, z, {', '.join(f'v{c} + a{c} * {h} AS v{c}' for c in 'xyz')}, ax, ay, az, phi FROM {src})"


def _leapfrog_sql(steps: int, dt: float) -> list[str]:
    out = [_forces_sql("b", "f0").replace("AS (SELECT", "AS MATERIALIZED (SELECT", 1), "e0 AS (SELECT * FROM f0)"]
    for i in range(steps):
        out += [_moved_sql(f"e{i}", f"m{i + 1}", dt / 2, dt), _forces_sql(f"m{i + 1}", f"f{i + 1}").replace("AS (SELECT", "AS MATERIALIZED (SELECT", 1), _kicked_sql(f"f{i + 1}", f"e{i + 1}", dt / 2)]
    return out


_RUN = {"algorithm": "direct", "softening": 0.1, "dt": 1e-4, "steps": 2}


@query(_with(EMB, *_leapfrog_sql(2, 1e-4)) + f" SELECT {_STATE} FROM e2")
def leapfrog(spark, sf_dir):
    end, _ = simulate.run(views.bodies_emb(spark, sf_dir), SimConfig.of("body", **_RUN))
    return rounded(end.select("id", "x", "y", "z", "vx", "vy", "vz"), 6, "x", "y", "z", "vx", "vy", "vz")


def _energy_sql() -> str:
    one = "SELECT {i} AS step, sum(0.5 * mass * (vx ** 2 + vy ** 2 + vz ** 2)) AS kinetic, sum(0.5 * mass * phi) AS potential FROM e{i}"
    every = " UNION ALL ".join(one.format(i=i) for i in range(3))
    return _with(EMB, *_leapfrog_sql(2, 1e-4), f"g AS (SELECT *, kinetic + potential AS total FROM ({every}))") + """ SELECT step, round(kinetic, 3) + 0.0 AS kinetic, round(potential, 3) + 0.0 AS potential, round(total, 3) + 0.0 AS total,
      round(abs((total - first_value(total) OVER (ORDER BY step)) / first_value(total) OVER (ORDER BY step)), 9) + 0.0 AS rel_drift FROM g"""


@query(_energy_sql())
def energy_drift(spark, sf_dir):
    _, log = simulate.run(views.bodies_emb(spark, sf_dir), SimConfig.of("body", **_RUN))
    return rounded(rounded(log.drop("time"), 3, "kinetic", "potential", "total"), 9, "rel_drift")


@query(_with(EMB, "a AS (SELECT *, x AS ax, y AS ay, z AS az FROM b)", _moved_sql("a", "m", 0.5, 0.25)) + f" SELECT {_STATE} FROM m")
def kick_drift(spark, sf_dir):
    bodies = views.bodies_emb(spark, sf_dir).withColumns({"a" + c: F.col(c) for c in "xyz"})
    return rounded(motion.kick_drift(bodies, 0.5, 0.25).select("id", "x", "y", "z", "vx", "vy", "vz"), 6, "x", "y", "z", "vx", "vy", "vz")


@query(_with(EMB, "g AS (SELECT " + ", ".join(f"sum(mass * {c}) / sum(mass) AS g{c}" for c in ("x", "y", "z", "vx", "vy", "vz")) + " FROM b)", "m AS (SELECT id, " + ", ".join(f"{c} - g{c} AS {c}" for c in ("x", "y", "z", "vx", "vy", "vz")) + " FROM b, g)") + f" SELECT {_STATE} FROM m")
def recentred(spark, sf_dir):
    return rounded(motion.recentre(views.bodies_emb(spark, sf_dir)).select("id", "x", "y", "z", "vx", "vy", "vz"), 6, "x", "y", "z", "vx", "vy", "vz")


@query(_with(EMB, "e AS (SELECT sqrt((vx * 0.5) ** 2 + (vy * 0.5) ** 2 + (vz * 0.5) ** 2) AS d FROM b)") + " SELECT round(sum(d), 5) + 0.0 AS summed, round(max(d), 6) + 0.0 AS largest, count(*) AS n FROM e")
def distance_error(spark, sf_dir):
    bodies = views.bodies_emb(spark, sf_dir)
    return rounded(rounded(motion.distance_error(bodies, motion.drift(bodies, 0.5)), 5, "summed"), 6, "largest")


@query(
    """SELECT count(*) AS n, 0::BIGINT AS not_finite, CAST(sum(CASE WHEN NOT l_discount > 0 THEN 1 ELSE 0 END) AS BIGINT) AS mass_not_positive, 0::BIGINT AS negative_ids,
  count(*) - count(DISTINCT l_orderkey * 10 + l_linenumber) AS repeated_ids FROM lineitem"""
)
def validation(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    bodies = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), F.col("l_discount").cast("double").alias("mass"), *(F.col("l_quantity").cast("double").alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")))
    return motion.validate(bodies)


# ------------------------------------------------- elements, text and generators

_ELEMENTS = """el AS (SELECT p_partkey AS k, (p_size % 50) / 60.0 AS e, 1 + (p_partkey % 40) / 10.0 AS a, radians(p_partkey % 90) AS i, radians(p_partkey % 360) AS om, radians((p_partkey * 7) % 360) AS w,
    radians((p_partkey * 13) % 360) AS ma, 2451544.5 - p_size AS epoch, p_size AS s FROM part),
  m1 AS (SELECT *, 1.48812e-34 * 1.98847e30 AS mu FROM el), m2 AS (SELECT *, ma + sqrt(mu / a ** 3) * (2451544.5 - epoch) AS t FROM m1),
  m3 AS (SELECT *, t - floor(t / (2 * pi())) * 2 * pi() AS mm FROM m2)"""
_NEWTON = ", ".join(f"n{i} AS (SELECT *, u{i - 1} - (u{i - 1} - e * sin(u{i - 1}) - mm) / (1 - e * cos(u{i - 1})) AS u{i} FROM n{i - 1})" for i in range(1, 16))


@query(_with(_ELEMENTS, "n0 AS (SELECT *, mm AS u0 FROM m3)", _NEWTON) + """, o AS (SELECT *, u15 AS big, 2 * atan2(sqrt(1 + e) * sin(u15 / 2), sqrt(1 - e) * cos(u15 / 2)) AS nu, a * (1 - e * cos(u15)) AS r FROM n15),
  f AS (SELECT *, r * cos(nu) AS px, r * sin(nu) AS py, -sqrt(mu * a) / r * sin(big) AS qx, sqrt(mu * a) / r * sqrt(1 - e * e) * cos(big) AS qy,
    cos(om) * cos(w) - sin(om) * sin(w) * cos(i) AS a11, -cos(om) * sin(w) - sin(om) * cos(w) * cos(i) AS a12, sin(om) * cos(w) + cos(om) * sin(w) * cos(i) AS a21,
    -sin(om) * sin(w) + cos(om) * cos(w) * cos(i) AS a22, sin(w) * sin(i) AS a31, cos(w) * sin(i) AS a32 FROM o)
  SELECT row_number() OVER (ORDER BY k) - 1 AS id, round(a11 * px + a12 * py, 6) + 0.0 AS x, round(a21 * px + a22 * py, 6) + 0.0 AS y, round(a31 * px + a32 * py, 6) + 0.0 AS z,
    round(a11 * qx + a12 * qy, 6) + 0.0 AS vx, round(a21 * qx + a22 * qy, 6) + 0.0 AS vy, round(a31 * qx + a32 * qy, 6) + 0.0 AS vz FROM f""")  # fmt: skip
def kepler_states(spark, sf_dir):
    states = elements.state_vectors(views.elements_part(spark, sf_dir))
    return rounded(states.select("id", "x", "y", "z", "vx", "vy", "vz"), 6, "x", "y", "z", "vx", "vy", "vz")


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s, 0.05 + (p_size % 5) / 10.0 AS al FROM part WHERE p_partkey % 10 = 0), q AS (SELECT *, 1329 * al ** -0.5 * 10.0 ** (-0.2 * (15.0 + s / 10.0)) AS dia FROM p)
  SELECT CAST(k AS BIGINT) AS part, round(dia, 6) + 0.0 AS diameter, round(4.0 / 3 * pi() * (dia / 2 * 1000) ** 3 * CASE WHEN al < 0.1 THEN 1380 WHEN al <= 0.2 THEN 2710 ELSE 5320 END / 1e9, 2) + 0.0 AS mass_1e9 FROM q""")  # fmt: skip
def imputed_masses(spark, sf_dir):
    done = elements.imputed(views.elements_part(spark, sf_dir).where("mass is null"))
    return done.select(F.col("row").alias("part"), (F.round("diameter", 6) + 0.0).alias("diameter"), (F.round(F.col("mass") / 1e9, 2) + 0.0).alias("mass_1e9"))


@query("""WITH u AS (SELECT 0 AS f, 0 AS r, 'Sun' AS name, 1.98847e30 AS mass UNION ALL SELECT 1, p_partkey, concat('part', p_partkey % 100), CAST(p_size AS DOUBLE) FROM part
    UNION ALL SELECT 2, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('part', s_suppkey % 150) END, 7.0 FROM supplier),
  n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY f, r) AS o FROM u)
  SELECT row_number() OVER (ORDER BY f, r) - 1 AS id, name, mass FROM n WHERE o = 1 OR name = ''""")  # fmt: skip
def combined_catalogues(spark, sf_dir):
    def catalogue(name, key, label, mass):
        t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return t.select(F.col(key).cast("long").alias("row"), label.alias("name"), F.lit("AST").alias("class"), mass.alias("mass"), *(F.lit(0.0).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")))

    first = catalogue("part", "p_partkey", F.concat(F.lit("part"), F.col("p_partkey") % 100), F.col("p_size").cast("double"))
    second = catalogue("supplier", "s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("part"), F.col("s_suppkey") % 150)), F.lit(7.0))
    return elements.combine(first, second).select("id", "name", "mass")


@query("""WITH t AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_size AS s, p_partkey % 4 AS u FROM part)
  SELECT id, round(CASE u WHEN 0 THEN s / 24.0 WHEN 1 THEN s WHEN 2 THEN s * 365.25 ELSE s * 0.5 END, 6) + 0.0 AS days FROM t""")  # fmt: skip
def durations_days(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    unit = F.element_at(F.array(F.lit("h"), F.lit(" d"), F.lit("Y"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    text = F.concat(F.when(F.col("p_partkey") % 4 == 3, (F.col("p_size") * 0.5).cast("string")).otherwise(F.col("p_size").cast("string")), unit)
    return part.select(F.col("p_partkey").cast("long").alias("id"), (F.round(durations.parse_duration(text), 6) + 0.0).alias("days"))


@query("SELECT CAST(p_partkey AS BIGINT) AS id, round(3.0 / count(*) OVER (), 12) + 0.0 AS mass, true AS inside, true AS bound FROM part")
def plummer_sphere(spark, sf_dir):
    """A body of a sphere for each part: all within the cutoff and slower than they could escape."""
    ids = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"))
    r2, v2 = (sum((F.pow(F.col(p + c), 2) for c in "yz"), F.pow(F.col(p + "x"), 2)) for p in ("", "v"))
    b = generate.plummer_of(ids, ids.count(), 3, total_mass=3.0, scale=2.0, cutoff=8.0)
    return b.select("id", (F.round("mass", 12) + 0.0).alias("mass"), (r2 <= 256 * (1 + 1e-9)).alias("inside"), (v2 <= 6 / F.sqrt(r2 + 4) * (1 + 1e-9)).alias("bound"))


@query()
def tree_run(spark, sf_dir):
    _, log = simulate.run(generate.collision(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").count(), 5), SimConfig.of("body", steps=2, dt=0.01, softening=0.05, strategy="arrow"))
    return log
