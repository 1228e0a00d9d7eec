"""Document fingerprints by spot signatures.

A spot is the chain of the next `CHAIN` content words after an anchor.  Anchors
are common words of four languages, the beginning of the text and, since lists
and other languages have none of these words, every content word whose hash is
a multiple of `SPARE`.  Content words are all words that are not common; words
are taken in lower case (A-Z) without ASCII punctuation around them.  The set of
the chains' hashes is the document's fingerprint; two fingerprints are compared
by the Jaccard similarity of their sets.

For a join the sets are partitioned by length: partners of a set of n chains
have at most n / t, so they are in its partition or the next.  Within a
partition sets meet on their rarest chains only (prefix filter); pairs whose
lengths or parity sketches are too far apart are pruned before the sets are
compared.  Groups of similar sets aren't expanded into all pairs (see
parity_join, whose contraction is used).

Edge cases: a null text is an empty one; a text without words has the empty
fingerprint "", which equals itself (likeness 1), is unlike all others
(likeness 0) and links with nothing; a text with fewer content words than a
chain has all of them as its one chain, one without content words all its words;
null ids come first in the order of ids and equal ids are in the order of the
files; repeated rows have equal fingerprints; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitalis.llm import parity_join as pj
from orbitalis.llm import textkernel as tk
from orbitalis.llm.components import connected_components
from orbitalis.llm.storage import materialize, row_key

CHAIN = 3
SPARE = 16
#: Common words of English, German, French and Spanish (fixed values).
COMMON = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "aber als auf aus das dem den der des die ein eine für ist im mit nicht sich und von zu "
    "au aux ce dans des du elle en est et il la le les ne par pas pour que qui un une "
    "con de del el en es las los no para por que se su un una y"
)
_U = np.uint64


@functools.cache
def _common_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(sorted(set(COMMON.split()))).encode(), np.uint8)
    return np.sort(tk.Words(data, np.array([0, len(data)])).hashes(fold=True))


@functools.cache
def _punctuation() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
    return table


def _bare(words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end without the punctuation around them; words of
    nothing else are empty."""
    plain, at = ~_punctuation()[words.data], np.arange(len(words.data))
    last = np.maximum.accumulate(np.where(plain, at, -1)) if len(at) else at
    following = np.minimum.accumulate(np.where(plain, at, len(at))[::-1])[::-1] if len(at) else at
    start = np.minimum(following[words.start], words.end)
    return start, np.maximum(last[words.end - 1] + 1, start)


def spot_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct chain hashes of each text of a run."""
    words = tk.Words(data, off)
    start, end = _bare(words)
    keep = end > start
    first = np.concatenate(([0], np.cumsum(keep)))[words.first]
    h = tk.span_hashes(data, start[keep], end[keep], fold=True)
    known = _common_hashes()
    common = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    content = np.flatnonzero(~common)
    own = np.searchsorted(content, first)  # each text's first content word
    chains = tk.windows(h[content], CHAIN)
    anchor = np.flatnonzero(common | (h % _U(SPARE) == 0))
    text = np.concatenate((np.searchsorted(first, anchor, "right") - 1, np.arange(len(off) - 1)))
    at = np.concatenate((np.cumsum(~common)[anchor], own[:-1]))
    whole = at + CHAIN <= own[text + 1]
    text, spots = text[whole], chains[at[whole]]
    order = np.lexsort((spots, text))
    text, spots = text[order], spots[order]
    if len(text):
        fresh = np.concatenate(([True], (text[1:] != text[:-1]) | (spots[1:] != spots[:-1])))
        text, spots = text[fresh], spots[fresh]
    cuts = np.searchsorted(text, np.arange(len(off)))
    out = [spots[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for i in np.flatnonzero((np.diff(own) < CHAIN) & (np.diff(words.first) > 0)).tolist():
        few = h[content[own[i] : own[i + 1]]]
        if not len(few):
            few = h[first[i] : first[i + 1]] + _U(1)
        if not len(few):  # punctuation only
            few = words_hashes(words, i) + _U(2)
        out[i] = tk.windows(few, len(few))
    return out


def words_hashes(words: tk.Words, i: int) -> np.ndarray:
    """The hashes of one text's words as they stand."""
    a, b = words.first[i], words.first[i + 1]
    return tk.span_hashes(words.data, words.start[a:b], words.end[a:b])


def column_sets(column: pa.Array) -> list[np.ndarray]:
    """The chain hashes of each text of an Arrow column."""
    data, off = tk.text_bytes(column)
    out: list[np.ndarray] = []
    for a, b in tk.runs(off):
        out += spot_sets(data[off[a] : off[b]], off[a : b + 1] - off[a])
    return out


def fingerprint(spots: np.ndarray) -> str:
    """A set of chain hashes as text."""
    return base64.b64encode(spots.astype("<u8").tobytes()).decode()


def spots_of(fingerprint: str) -> np.ndarray:
    """The set of chain hashes of a fingerprint."""
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """The Jaccard similarity of two sets; 0 without a look at them if their lengths
    alone keep it below `least`."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


# ------------------------------------------------------------ neighbours by id

_BOUND = "array<struct<k:boolean,d:bigint,f:bigint,i:bigint>>"
_SAMPLES = 32  # of ids for each block


def _place(id_col: str, row: Column) -> Column:
    return F.struct(F.col(id_col).isNotNull().alias("k"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("d"), row["f"].alias("f"), row["i"].alias("i"))


def in_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text in runs of neighbouring ids: block, extra, in order within
    partitions.  The row after a block's last (after the last of all, the first) stands
    at its end as an extra row, so that each row's next one is in its block.

    Texts go through one exchange.  Where blocks begin is taken from a sample of
    the ids, of `_SAMPLES` rows for each shuffle partition; each begins at a row that is
    there, and a block's number is looked up by halving.
    """
    spark = docs.sparkSession
    docs, row = row_key(docs)
    placed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), row.alias("_row")).withColumn("_at", _place("doc_id", F.col("_row")))
    blocks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total, least = placed.agg(F.count("*"), F.min("_at")).first()
    if not total:
        return placed.select(F.lit(0).alias("block"), F.lit(False).alias("extra"), "doc_id", "text")
    every = max(1, total // (_SAMPLES * blocks))
    some = sorted(tuple(r[0]) for r in placed.where(F.pmod(F.xxhash64("_row"), F.lit(every)) == 0).select("_at").collect())
    bounds = sorted({tuple(least), *(some[len(some) * b // blocks] for b in range(1, blocks) if some)})
    table = F.from_json(F.lit(json.dumps([dict(zip("kdfi", b, strict=True)) for b in bounds])), _BOUND)
    steps = F.array(*(F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))))
    block = F.aggregate(steps, F.lit(-1), lambda at, s: F.when(F.get(table, at + s) <= F.col("_at"), at + s).otherwise(at))
    before = F.pmod(F.col("block") - 1, F.lit(len(bounds)))
    begins = F.get(table, F.col("block")) == F.col("_at")
    to = F.when(begins, F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("x")), F.struct(before.alias("b"), F.lit(True).alias("x")))).otherwise(F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("x"))))
    dealt = placed.withColumn("block", block).withColumn("_to", F.explode(to))
    dealt = dealt.select(F.col("_to.b").alias("block"), F.col("_to.x").alias("extra"), "_at", "doc_id", "text")
    dealt = dealt.repartitionById(len(bounds), "block") if len(bounds) > 1 else dealt.repartition(1)
    return dealt.sortWithinPartitions("block", "extra", "_at").select("block", "extra", "doc_id", "text")


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_spots long"


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of the text with its second half replaced by
    the beginning of the next document, and how alike it is to that and to the next."""
    placed = in_blocks(docs, id_col, text_col)
    kind = placed.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # block, id, text, spots
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            rows = list(zip(batch.column("block").to_pylist(), ids, texts, column_sets(batch.column("text")), strict=True))
            if not rows:
                continue
            before = [last, *rows[:-1]]
            pairs = [(a, b) for a, b in zip(before, rows, strict=True) if a is not None and a[0] == b[0]]
            last = rows[-1]
            edited = [a[2][: len(a[2]) - len(a[2]) // 2] + b[2][: len(a[2]) // 2] for a, b in pairs]
            changed = column_sets(pa.array(edited, pa.large_string()))
            cols = [
                pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([fingerprint(a[3]) for a, _ in pairs], pa.string()),
                pa.array([fingerprint(c) for c in changed], pa.string()),
                pa.array([likeness(a[3], c) for (a, _), c in zip(pairs, changed, strict=True)], pa.float64()),
                pa.array([likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
                pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([a[1] for a, _ in pairs], batch.column("doc_id").type), *cols], names=["doc_id", *(c.split()[0] for c in _RESULT.split(", "))])
            tk.release()

    return placed.mapInArrow(run, f"doc_id {kind.simpleString()}, {_RESULT}")


# ------------------------------------------------------------ similarity join


def _set_table(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, class (two longs) and spots of each row of docs (doc_id, text, row)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = column_sets(batch.column(1))
            c = np.frombuffer(b"".join(map(pj.class_of, sets)), np.int64).reshape(-1, 2)
            flat = np.concatenate([np.zeros(0, _U), *sets])
            ends = np.cumsum([0, *map(len, sets)])
            spots = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat.view(np.int64))).cast(pa.list_(pa.int64()))
            cols = [batch.column(0), batch.column(2), pa.array(np.diff(ends)), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy()), spots]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "n_shingles", "cls", "cls2", "spots"])
            tk.release()

    return docs.select("doc_id", "text", "row").mapInArrow(run, f"doc_id {kind}, row struct<f:long,i:long>, n_shingles long, cls long, cls2 long, spots array<long>")


def _meeting(sets: DataFrame, shape: pj.Shape) -> DataFrame:
    """Rows (sig, cls, pivot): similar sets share a sig, which is one of their rarest
    chains in a partition of lengths; pivot is the longest set of each sig."""
    n, num, den = F.col("n"), shape.num, shape.den
    chains = sets.select("cls", "n", F.explode("spots").alias("s"))
    held = chains.groupBy("s").agg(F.count("*").alias("df"))
    own = Window.partitionBy("cls").orderBy("df", "s")
    ranked = chains.join(held, "s").withColumn("r", F.row_number().over(own))
    rare = ranked.where((F.col("df") > 1) & (F.col("r") <= n - F.floor((n * num + den - 1) / den) + 1))
    lows = F.lit([x for x in shape.lows if x < 1 << 40]).cast("array<long>")
    part = F.size(F.filter(lows, lambda low: low <= n))
    both = rare.withColumn("part", F.explode(F.array(part, part + 1)))  # with those of its length and with longer ones
    both = both.select(F.xxhash64("part", "s").alias("sig"), "cls", "n")
    met = both.groupBy("sig").agg(F.count("*").alias("m"), F.max(F.struct("n", "cls")).alias("top")).where("m > 1")
    return materialize(both.join(met, "sig").select("sig", "cls", F.col("top.cls").alias("pivot")), "meeting")


def _sketched(sets: DataFrame) -> DataFrame:
    """Sets with the words of a brief parity sketch, which prunes pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            brief = [pj.folded(pj.parity_bits(np.array(s, np.int64).view(_U))) for s in batch.column(2).to_pylist()]
            b = np.frombuffer(b"".join(brief), np.int64).reshape(-1, len(pj._BRIEF))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), *(pa.array(b[:, i].copy()) for i in range(b.shape[1]))], names=["cls", "n", *pj._BRIEF])

    return sets.select("cls", "n", "spots").mapInArrow(run, "cls long, n int, " + ", ".join(f"{b} long" for b in pj._BRIEF))


def _similar(pairs: DataFrame, sets: DataFrame, shape: pj.Shape) -> DataFrame:
    """Those of the pairs (a, b) of classes that are similar."""
    a = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("spots").alias("xa"))
    b = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("spots").alias("xb"))
    least, most = F.least("na", "nb"), F.greatest("na", "nb")
    both = F.size(F.array_intersect("xa", "xb"))
    met = pairs.join(a, "a").join(b, "b").where(least * shape.den >= most * shape.num)
    return met.where(both * shape.den >= (F.col("na") + F.col("nb") - both) * shape.num).select("a", "b")


def similarity_classes(docs: DataFrame, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_spots and class_id (the smallest id that links of similar fingerprints
    reach) of each row."""
    shape = pj.Shape(num, den)
    docs, row = row_key(docs)
    every = materialize(_set_table(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), row.alias("row"))), "spots")
    sets = materialize(every.where("n_shingles > 0").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.first("spots").alias("spots")), "sets")
    telling = _meeting(sets, shape)
    stars = materialize(telling.where("cls <> pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b")).distinct(), "stars")
    links = materialize(_similar(stars, sets, shape), "links")
    comps = connected_components(links)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    across = pj._across(telling, comps, materialize(_sketched(sets), "sketches"), shape, parts).join(stars, ["a", "b"], "left_anti")
    more = materialize(_similar(materialize(across, "across"), sets, shape), "links")
    comps = connected_components(links.union(more))
    named = comps.withColumnRenamed("node", "cls").unionByName(comps.select(F.col("comp").alias("cls"), "comp").distinct())
    keyed = every.drop("spots").join(pj._sized(materialize(named, "named")), "cls", "left")
    classes = keyed.select("doc_id", "row", "n_shingles", F.coalesce("comp", "cls").alias("key"), F.when(F.col("comp").isNull(), F.col("cls2")).otherwise(0).alias("key2"))
    out = pj._by_class(classes, F.struct(F.min("doc_id").alias("doc_id")), "least")
    known = F.when((F.col("n_shingles") > 0) & F.col("least").isNotNull(), F.col("least.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n_shingles").alias("n_spots"), known.alias("class_id"))
