"""The Merkle manifest against a plain version."""

import hashlib
import random
import zlib

import pytest

from orbitalis.llm import catalog, merkle
from tests.oracle import assert_same

KIND = "doc_id long, text string, lang string, source string, n_chars long, tree int, place string, row string, leaf int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])))


def plain_tree(nodes):
    """The root and each node's siblings, step by step."""
    paths, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for j in range(len(run)):
                for i in own[a + j]:
                    paths[i].append((run[:j], run[j + 1 :]))
            up.append(H(*run))
            held.append(sum(own[a : a + 8], []))
        nodes, own = up, held
    return nodes[0], paths


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    mine = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for x in langs}
    trees = [plain_tree([leaf_of(r) for r in mine[x]]) for x in langs]
    root, above = plain_tree([t[0] for t in trees])
    out = []
    for x, (subroot, paths), more in zip(langs, trees, above, strict=True):
        for r, path in zip(mine[x], paths, strict=True):
            path = path + more
            found = leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                found = leaf_of((r[0], r[1].translate({c: c + 32 for c in range(65, 91)}), *r[2:]))
            for left, right in path:
                found = H(*left, found, *right)
            out.append((r[0], leaf_of(r), subroot, root, H(*(d for a, b in path for d in a + b)), found, found == root))
    return out


def table(seed, n, langs):
    rng = random.Random(seed)
    some = ["Ünder the Stone", "", None, "plain words", "ABC", "x" * 5000]
    return [(rng.choice([i, i, i, 7, None]), rng.choice(some), rng.choice(langs), rng.choice(["a", None, "long source"]), rng.choice([None, i]), 1, "p", "q", 2) for i in range(n)]


def same(spark, rows):
    got = merkle.manifest(spark.createDataFrame(rows, KIND).repartition(3)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize(("n", "langs"), [(1, ["en"]), (8, [None]), (9, ["en"]), (65, ["en"]), (150, [None, "", "en", "de", "é", "z"]), (700, ["en"] * 9 + ["fr", None])])
def test_manifest_is_that_of_the_plain_version(spark, n, langs):
    same(spark, table(n, n, langs))


def test_many_trees_and_repeated_rows(spark):
    same(spark, [(i, f"Text {i}", f"l{i % 90:03d}", "s", i, 1, "p", "q", 2) for i in range(250)] + [(3, "Same", "l001", "s", 5, 1, "p", "q", 2)] * 20)


def test_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], KIND)).count() == 0


def test_every_change_of_a_text_is_seen(spark):
    rows = [(i, f"text {i}", "en", "s", i, 1, "p", "q", 2) for i in range(40)]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, KIND)
    got = {r.doc_id: r for r in merkle.manifest(docs.withColumn("text", F.upper("text")), tampered=F.col("doc_id") % 2 == 0).collect()}
    assert all(r.verified == (i % 2 == 1) for i, r in got.items())
    assert all((r.folded_root == r.root) == r.verified for r in got.values())


def test_a_lost_child_is_an_error(spark):
    sent = spark.sparkContext.parallelize([((0, 0), [(0, "a")]), ((0, 0), [(2, "c")])])
    with pytest.raises(Exception, match="all its children"):
        merkle._received(sent, 2).collect()


def test_query_matches_sql(spark):
    assert_same(spark, catalog.op12_merkle, merkle.oracle())
