"""Spot signatures against plain Python versions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from orbitalis.llm import spotsigs, textkernel
from tests.llm.fixtures import WORDS, corpus, frame, prose

COMMON = set(spotsigs.COMMON.split())
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def fold(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def word_hash(w):
    data = np.frombuffer(w.encode(), np.uint8)
    return int(textkernel.span_hashes(data, np.array([0]), np.array([len(data)]), fold=True)[0])


def plain_chains(text):
    """The chains of a text as tuples of words."""
    raw = WORDS.findall(text or "")
    words = [w for w in (fold(x.strip(PUNCTUATION)) for x in raw) if w]
    content = [w for w in words if w not in COMMON]
    if len(content) < 3:
        return {tuple(content or words or raw)} - {()}
    starts, seen = {0}, 0
    for w in words:
        seen += w not in COMMON
        if w in COMMON or word_hash(w) % 16 == 0:
            starts.add(seen)
    return {tuple(content[i : i + 3]) for i in starts if i + 3 <= len(content)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts():
    rng = random.Random(4)
    words = ["the", "of", "Stone,", "river", "(light)", "Über", "is", "la", "...", "kept", "one-two", "day!", "été", "no"]
    some = [" ".join(rng.choice(words) + rng.choice(["", "", str(rng.randrange(30))]) for _ in range(rng.choice([1, 2, 3, 4, 9, 40, 200]))) for _ in range(150)]
    return [*some, None, "", " \n ", "...", "--- !!!", "the", "the of", "The the", "stone", "the stone river", "a b c d e f g h", "the " * 500, prose(rng, 4000)]


def test_chains_are_those_of_the_plain_version():
    every = texts()
    got = spotsigs.column_sets(pa.array(every))
    known: dict = {}
    for text, spots in zip(every, got, strict=True):
        want = plain_chains(text)
        assert len(spots) == len(want) and (np.diff(spots.astype(object)) > 0).all()
        # equal sets of chains have equal hashes, others have others
        assert known.setdefault(frozenset(want), spots.tobytes()) == spots.tobytes()
    assert len(set(known.values())) == len(known)
    for a, b in zip(every, every[1:], strict=False):
        x, y = (spotsigs.column_sets(pa.array([t], pa.string()))[0] for t in (a, b))
        assert spotsigs.likeness(x, y) == pytest.approx(jaccard(plain_chains(a), plain_chains(b)))


def test_fingerprints_tell_their_sets():
    spots = spotsigs.column_sets(pa.array(["the stone of the river is kept in light and day", ""]))
    for s in spots:
        assert spotsigs.spots_of(spotsigs.fingerprint(s)).tolist() == s.tolist()
    assert spotsigs.fingerprint(spots[1]) == ""
    assert spotsigs.likeness(spots[0], spots[1]) == 0 and spotsigs.likeness(spots[1], spots[1]) == 1
    assert spotsigs.likeness(np.arange(10, dtype=np.uint64), np.arange(4, dtype=np.uint64), 0.5) == 0


@pytest.mark.parametrize("blocks", [1, 7])
def test_edits_take_the_next_document(spark, blocks):
    rows = corpus(3) + [(5, "a copy of an id"), (None, "the id is null"), (None, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", blocks)
    try:
        got = spotsigs.compare_with_edits(frame(spark, rows).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    by_id = {i: t or "" for i, t in rows if i is not None and i != 5}
    ids, mine = sorted(by_id), {r.doc_id: r for r in got if r.doc_id is not None}
    for i, j in zip(ids, ids[1:], strict=False):
        if 5 in (i + 1, i, j):
            continue
        a, b, r = by_id[i], by_id[j], mine[i]
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(plain_chains(a), plain_chains(edited)))
        assert r.near_next == pytest.approx(jaccard(plain_chains(a), plain_chains(b)))
        assert (r.edited_fingerprint == r.fingerprint) == (plain_chains(a) == plain_chains(edited))
    # after the last comes the first: a null id
    a, r = by_id[ids[-1]], mine[ids[-1]]
    half = len(a) // 2
    assert r.edited_sha256 in {hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest() for b in ("the id is null", "")}


def test_edits_of_very_small_tables(spark):
    kind = "doc_id long, text string"
    assert spotsigs.compare_with_edits(spark.createDataFrame([], kind)).count() == 0
    (r,) = spotsigs.compare_with_edits(spark.createDataFrame([(4, "the one and only text of it")], kind)).collect()
    assert r.near_next == 1 and r.edited_sha256 == hashlib.sha256(("the one and only text of it"[:14] + "the one and only text of it"[:13]).encode()).hexdigest()


def components(rows, num=75, den=100):
    sets = [plain_chains(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {rows[i][0]: (len(sets[i]), rows[top(i)][0]) for i in range(len(rows))}


def test_classes_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    rows = corpus(6, 80)
    base = prose(rng, 120).split()
    for k in range(40):  # a chain of near copies, each changed a little more
        base[rng.randrange(len(base))] = f"new{k}"
        rows.append((1000 + k, " ".join(base)))
    got = {r.doc_id: (r.n_spots, r.class_id) for r in spotsigs.similarity_classes(frame(spark, rows)).collect()}
    assert got == components(rows)
    assert len({c for i, (_, c) in got.items() if i >= 1000}) < 5
    assert spotsigs.similarity_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_of_the_plain_version_are_those_of_the_pattern():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a b\x0bc d") == WORDS.findall("a b\x0bc d")
