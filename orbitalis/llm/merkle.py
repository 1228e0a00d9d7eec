"""A Merkle manifest of a table, by supersteps in the manner of Pregel.

Every row is a leaf; the rows of one language, in the order of their ids, are
the leaves of a tree whose nodes have up to `ARITY` children; the trees' roots,
in the order of the languages, are the leaves of one more such tree.

Leaves are hashed where the texts are read, by Spark's own functions.  Only
digests travel after that.  Upwards, a superstep on pair RDDs sends each node's
digest to its parent; a parent has all children at the end of the step, hashes
them and goes on as a node of the next one.  A tree is done when its first parent
has a single child.  Downwards, a superstep joins the parents' paths (siblings
of all steps up to the root) with their children's groups, so a path travels
once for all rows of a group.  At the leaves the path gives the proof and is
folded with the row's digest, that of the tampered row where there is one.

Groups of siblings have at most `ARITY` rows, and ids are ranked in key ranges, so
one language may hold any share of the rows.  Each upward step is written to the
shared folder, so a lost executor costs one step at most.

Edge cases: a null field is hashed as "-"; null languages are a language of their
own, the first; rows with equal or null ids stand in the order of their digests,
then of the files; a language of one row has its leaf as its root, and a table of one
language that language's root; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitalis.llm.storage import materialize, row_key

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_GROUPS = 4_000  # of siblings, in a partition of a superstep


def digest_of(fields: Iterable[Column]) -> Column:
    """The hash of a row's fields, each with its length before it."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*(one(c) for c in fields)), 256)


def hashed(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def tampered_text(text: Column) -> Column:
    """The text with A-Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", id_col: str = "doc_id", text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """doc_id, lang (the tree's name), leaf and changed (the leaf of the tampered row,
    null for rows that aren't) of each row, and what tells rows apart."""
    docs, row = row_key(docs)
    own = [F.col(c) for c in fields]
    other = [tampered_text(F.col(c)) if c == text_col else F.col(c) for c in fields]
    chosen = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 0 if tampered is None else tampered
    return docs.select(F.col(id_col).alias("doc_id"), F.col(tree).cast("string").alias("lang"), digest_of(own).alias("leaf"), F.when(chosen, digest_of(other)).alias("changed"), row.alias("row"))


_PLACED = ("doc_id", "lang", "leaf", "changed")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows with the number of their tree and their place in it, both within the partition."""
    run, at, last = -1, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        lang = b.column("lang").dictionary_encode()
        code = lang.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        names = lang.dictionary.to_pylist()
        new = np.concatenate(([True], code[1:] != code[:-1]))
        first = names[code[0]] if code[0] >= 0 else None
        joined = run >= 0 and first == last
        new[0] = not joined
        runs = run + np.cumsum(new)
        begin = np.maximum.accumulate(np.where(new, np.arange(len(code)), -1))
        places = np.where(begin >= 0, np.arange(len(code)) - begin, at + np.arange(len(code)))
        run, at, last = int(runs[-1]), int(places[-1]) + 1, names[code[-1]] if code[-1] >= 0 else None
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("part", *_PLACED)), pa.array(runs.astype(np.int64)), pa.array(places.astype(np.int64))], names=["part", *_PLACED, "run", "place"])


def numbered(nodes: DataFrame) -> DataFrame:
    """Rows of leaves() with tree (from 0, in the order of the names, null first) and
    place (from 0, in the order of the ids).

    Ranges of (name, id) are numbered on their own; what each range adds to those
    after it, one row for each range, is summed on the driver.
    """
    kind = nodes.schema["doc_id"].dataType.simpleString()
    order = ["lang", "doc_id", "leaf", "row"]
    ranged = nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    fixed = materialize(ranged.select("part", *_PLACED).mapInArrow(_counted, f"part int, doc_id {kind}, lang string, leaf string, changed string, run long, place long"), "numbered")
    ends = fixed.groupBy("part").agg(F.max_by(F.struct("run", "place", "lang"), F.struct("run", "place")).alias("last"), F.min_by(F.struct("lang"), F.struct("run", "place")).alias("first"))
    before, tree, place, name = [], -1, 0, None
    for part, last, first in sorted(ends.collect(), key=lambda r: r[0]):
        same = tree >= 0 and first[0] == name
        before.append((part, tree if same else tree + 1, place if same else 0))
        tree = before[-1][1] + last["run"]
        place = last["place"] + 1 + (before[-1][2] if last["run"] == 0 else 0)
        name = last["lang"]
    base = F.broadcast(nodes.sparkSession.createDataFrame(before, "part int, tree0 long, place0 long"))  # a row for each range
    placed = fixed.join(base, "part")
    return placed.select((F.col("tree0") + F.col("run")).alias("tree"), (F.col("place") + F.when(F.col("run") == 0, F.col("place0")).otherwise(0)).alias("place"), *_PLACED)


def _table(spark: SparkSession, rows: RDD, schema: str, name: str) -> DataFrame:
    return materialize(spark.createDataFrame(rows, schema, verifySchema=False), name)


def _parts(spark: SparkSession, groups: int) -> int:
    """Partitions of a superstep over so many groups: the session's, or as many as keep them small."""
    usual, least = int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups // _GROUPS)
    return max(1, min(usual, least), least // 16)


_GROUPED = "tree long, parent long, digests array<string>"


def _received(messages: RDD, parts: int) -> RDD:
    """((tree, parent), children in order) from ((tree, parent), [(slot, child)])."""

    def whole(children: list) -> list:
        children.sort(key=lambda c: c[0])
        if [c[0] for c in children] != list(range(len(children))):
            raise ArithmeticError("a parent has not received all its children")
        return [c[1] for c in children]

    return messages.reduceByKey(lambda a, b: a + b, parts).mapValues(whole)


def upward(spark: SparkSession, nodes: Callable[[], RDD], count: int) -> tuple[list[DataFrame], DataFrame]:
    """All supersteps from nodes (tree, place, digest) up: for each the groups (tree,
    parent, digests) whose parents go on, and the roots (tree, root)."""
    levels: list[DataFrame] = []
    roots: DataFrame | None = None
    while count:
        parts = _parts(spark, -(-count // ARITY))
        sent = nodes().map(lambda n: ((n[0], n[1] // ARITY), [(n[1] % ARITY, n[2])]))
        groups = _table(spark, _received(sent, parts).map(lambda g: (g[0][0], g[0][1], g[1])), _GROUPED, "groups")
        alone = (F.col("parent") == 0) & (F.size("digests") == 1)
        done = groups.where(alone).select("tree", F.get("digests", F.lit(0)).alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        going = groups.where(~alone)
        count = going.count()
        if count:
            levels.append(going)
            nodes = lambda going=going: going.rdd.map(lambda g: (g[0], g[1], hashed(g[2])))
    return levels, roots


Path = list[tuple[str, str]]  # the digests to the left and to the right of a node, step by step


def _beside(digests: list[str], slot: int) -> tuple[str, str]:
    return "".join(digests[:slot]), "".join(digests[slot + 1 :])


def downward(spark: SparkSession, levels: list[DataFrame], roots: RDD) -> RDD:
    """((tree, place), value, path) of each leaf: roots has (tree, (value, path)),
    where value is handed down as it is."""

    def to_children(group) -> list:
        (tree, parent), (digests, (value, path)) = group
        return [((tree, parent * ARITY + i), (value, [_beside(digests, i), *path])) for i in range(len(digests))]

    at = roots.map(lambda r: ((r[0], 0), r[1]))  # a root is node 0 of its level; trees join where they are done
    for groups in reversed(levels):
        parts = _parts(spark, groups.count())
        own = groups.rdd.map(lambda g: ((g[0], g[1]), list(g[2])))
        met = at.leftOuterJoin(own, parts)  # a tree that is done already hands on what it has
        at = met.flatMap(lambda m: [(m[0], m[1][0])] if m[1][1] is None else to_children((m[0], (m[1][1], m[1][0]))))
    return at


def folded(digest: str, path: Path) -> str:
    """The root that a digest and its siblings give."""
    for left, right in path:
        digest = hashed((left, digest, right))
    return digest


def proof_of(path: Path) -> str:
    """The hash of all siblings, step by step, left to right."""
    return hashed(x for pair in path for x in pair)


RESULT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", id_col: str = "doc_id", text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """Each row's leaf, subroot, root and proof, and the root that its tampered (else its
    own) leaf gives with the siblings of the untampered table."""
    spark = docs.sparkSession
    rows = numbered(materialize(leaves(docs, fields, tree, id_col, text_col, tampered), "digests"))  # ranges are sampled; texts are read once
    total = rows.count()
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, {RESULT}"
    if not total:
        return spark.createDataFrame([], schema)
    # leaves and their groups
    parts = _parts(spark, -(-total // ARITY))
    sent = rows.select("tree", "place", "doc_id", "leaf", "changed").rdd.map(lambda r: ((r[0], r[1] // ARITY), [(r[1] % ARITY, (r[2], r[3], r[4]))]))
    kind = f"tree long, parent long, rows array<struct<doc_id:{docs.schema[id_col].dataType.simpleString()},leaf:string,changed:string>>"
    bottom = _table(spark, _received(sent, parts).map(lambda g: (g[0][0], g[0][1], g[1])), kind, "leaves")
    alone = (F.col("parent") == 0) & (F.size("rows") == 1)
    above = bottom.where(~alone)
    levels, roots = upward(spark, lambda: above.rdd.map(lambda g: (g[0], g[1], hashed(x[1] for x in g[2]))), above.count())
    single = bottom.where(alone).select("tree", F.get("rows", F.lit(0))["leaf"].alias("root"))
    subroots = materialize(single if roots is None else single.unionByName(roots), "subroots")
    # the tree of trees
    tops, top = upward(spark, lambda: subroots.rdd.map(lambda r: (0, r[0], r[1])), subroots.count())
    root = top.first()["root"]
    paths = downward(spark, tops, spark.sparkContext.parallelize([(0, (root, []))], 1)).map(lambda p: (p[0][1], p[1]))
    begun = subroots.rdd.map(lambda r: (r[0], r[1])).join(paths, _parts(spark, subroots.count()))
    # down to the leaves: the value handed down is (subroot, root)
    at = downward(spark, levels, begun.map(lambda b: (b[0], ((b[1][0], b[1][1][0]), b[1][1][1]))))

    def finish(met) -> list:
        _, (group, ((subroot, root), path)) = met
        digests = [x[1] for x in group]
        out = []
        for i, (doc_id, leaf, changed) in enumerate(group):
            own = path if single_of(met) else [_beside(digests, i), *path]
            found = folded(leaf if changed is None else changed, own)
            out.append((doc_id, leaf, subroot, root, proof_of(own), found, found == root))
        return out

    def single_of(met) -> bool:  # a tree of one leaf, which is its own root
        (_, parent), (group, _) = met
        return parent == 0 and len(group) == 1

    met = bottom.rdd.map(lambda g: ((g[0], g[1]), [tuple(x) for x in g[2]])).join(at, parts)
    return spark.createDataFrame(met.flatMap(finish), schema, verifySchema=False)


def _sql_levels(name: str, key: str, count: int) -> str:
    """SQL of a tree's levels: {name}k (key, i, d, single, l, r) from {name}_0 (key, i, d)."""
    out = []
    for k in range(count):
        run = f"PARTITION BY {key}, i // {ARITY} ORDER BY i"
        out.append(f"""{name}{k} AS (SELECT {key}, i, d, count(*) OVER (PARTITION BY {key}) = 1 AS single,
    coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}_{k})""")
        out.append(f"{name}_{k + 1} AS (SELECT {key}, i // {ARITY} AS i, CASE WHEN bool_or(single) THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}{k} GROUP BY {key}, i // {ARITY})")
    return ",\n".join(out)


def oracle(levels: int = 8, tops: int = 4) -> str:
    """SQL of the manifest of documents for languages of up to ARITY ** levels rows."""
    one = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = " || ".join(map(one, FIELDS))
    other = " || ".join(map(one, [low if c == "text" else c for c in FIELDS]))
    bits = "list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, x: {bits}), 4294967295)"
    steps = [("a", f"a{k}", f"a{k}.lang IS NOT DISTINCT FROM g.lang AND a{k}.i = g.i // {ARITY**k}") for k in range(levels)]
    steps += [("s", f"s{k}", f"s{k}.i = g.top // {ARITY**k}") for k in range(tops)]
    joins = "\n".join(f"  JOIN {t} ON {on}" for _, t, on in steps)
    picked = ", ".join(f"{t}.single AS {t}_one, {t}.l AS {t}_l, {t}.r AS {t}_r" for _, t, _ in steps)
    proof = " || ".join(f"{t}_l || {t}_r" for _, t, _ in steps)
    fold, last = [], "f0"
    for n, (_, t, _) in enumerate(steps, 1):
        fold.append(f"f{n} AS (SELECT * REPLACE (CASE WHEN {t}_one THEN x ELSE sha256({t}_l || x || {t}_r) END AS x) FROM {last})")
        last = f"f{n}"
    return f"""
WITH h AS (SELECT doc_id, lang, sha256({leaf}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({other}) END AS changed FROM documents),
g0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS top FROM h),
a_0 AS (SELECT lang, i, leaf AS d FROM g0),
{_sql_levels("a", "lang", levels)},
s_0 AS (SELECT 0 AS one, t.top AS i, a.d FROM a_{levels} AS a JOIN (SELECT DISTINCT lang, top FROM g0) AS t ON a.lang IS NOT DISTINCT FROM t.lang),
{_sql_levels("s", "one", tops)},
g AS (SELECT * FROM g0),
f0 AS (SELECT g.doc_id, g.leaf, sub.d AS subroot, root.d AS root, coalesce(g.changed, g.leaf) AS x, {picked}
  FROM g JOIN a_{levels} AS sub ON sub.lang IS NOT DISTINCT FROM g.lang CROSS JOIN s_{tops} AS root
{joins}),
{",".join(fold)}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, x AS folded_root, x = root AS verified FROM {last}
"""
