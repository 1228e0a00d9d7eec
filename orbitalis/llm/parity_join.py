"""Similarity join on sets of word shingles by parity sketches.

Adding a token to a parity sketch XORs its hash into one band of the sketch, so
two sketches of the same shape differ in at most as many bands as their sets
differ in tokens.  Sets with Jaccard similarity of t or more and sizes a <= b
differ in D = (a + b)(1 - t)/(1 + t) tokens at most.  Sizes fall into bands with
ratio 1/t; sets whose sizes can pair within a size band are sketched with
k > D bands, so similar ones have k - D bands in common (pigeonhole).  Each
non-empty band's value is a signature, and sets are joined on signatures.

Sets so small that too many of their bands are empty also give the first
n - ceil(t n) + 1 of their tokens by hash as signatures; two such sets that
are similar share one of them.

Candidates are checked in two steps: a compact sketch of parity bits, whose
Hamming distance is a lower bound of the difference, and then the shingles.

Rows are told apart by where they stand, not by their ids, so null and repeated
ids do no harm.

Only what joins documents is needed, so signatures with many sets aren't
expanded into pairs.  Sets with too few shared signatures and the most frequent
ones of the others go first (see _telling).  Then each set is checked against the most central
set of each of its signatures.  Links found join components.  Then all pairs in
different components that share a signature are checked; within a component no
pair is.  A signature with more sets than a tile holds is cut into tiles, and
pairs of tiles go to different tasks.  Equal sets are one
class from the start, and stand in the exchange once for each task.

Edge cases: null, empty and blank texts have an empty set, and link with
nothing; a text with fewer words than a shingle has its whole sequence as one
shingle; repeated rows are equal sets; a null id is no smallest id unless its
whole component has no other; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitalis.llm import textkernel as tk
from orbitalis.llm.components import connected_components
from orbitalis.llm.storage import materialize, row_key

_U = np.uint64
BRIEF = 1024  # bits of the sketch that candidates carry along
PREFIX = 0xFFFF  # stands for a size band where the signature is a token


class Shape:
    """Size bands and sketch shapes for a similarity of num/den."""

    def __init__(self, num: int = 75, den: int = 100):
        self.num, self.den = num, den

    def most_apart(self, a, b):
        """The largest symmetric difference of similar sets of these sizes."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    @functools.cached_property
    def lows(self) -> list[int]:
        """The smallest size of each size band; the last is beyond any text."""
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, -(-lows[-1] * self.den // self.num)))
        return lows

    def bands(self, j: int) -> int:
        """Bands of a sketch for sets in size band j."""
        most = self.most_apart(self.lows[j + 1] - 1, self.lows[j + 1] - 1)
        return most + 2 + most // 10

    def roles(self, n: int) -> list[tuple[int, int]]:
        """Size bands in which a set of n tokens may have partners of its size or
        more, and the largest difference from those."""
        j = int(np.searchsorted(self.lows, n, "right")) - 1
        top, out = n * self.den // self.num, []
        while self.lows[j] <= max(top, n):
            out.append((j, self.most_apart(n, min(top, self.lows[j + 1] - 1))))
            j += 1
        return out


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a run."""
    words = tk.Words(data, off)
    h, first = words.hashes(fold=True), words.first.tolist()
    s = tk.windows(h, width)
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            yield np.unique(s[a : b - width + 1])
        elif b > a:
            yield tk.windows(h[a:b], b - a)
        else:
            yield np.zeros(0, _U)


def class_of(tokens: np.ndarray) -> bytes:
    """16 bytes that equal sets have in common."""
    x = np.bitwise_xor.reduce(tk.mix(tokens + _U(1))) if len(tokens) else _U(0)
    y = np.add.reduce(tk.mix(tokens ^ _U(0x5851F42D4C957F2D))) if len(tokens) else _U(0)
    return np.array([x, y + _U(len(tokens))], _U).tobytes()


def signatures(tokens: np.ndarray, shape: Shape) -> list[tuple[int, int, np.ndarray]]:
    """(size band or PREFIX, least number in common with a partner, signatures) of a set."""
    n, out, risky = len(tokens), [], False
    high, mixed = tokens >> _U(32), tk.mix(tokens ^ _U(0x2545F4914F6CDD1D))
    for j, apart in shape.roles(n):
        k = shape.bands(j)
        band = (high * _U(k)) >> _U(32)
        begin = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
        value = np.bitwise_xor.reduceat(mixed, begin)
        common = len(begin) - apart  # k bands less those that differ less the empty ones
        out.append((j, max(1, common), tk.mix(value ^ tk.mix(band[begin] + _U(j << 32)))))
        risky |= common < 1
    if risky:
        some = n - -(-n * shape.num // shape.den) + 1
        out.append((PREFIX, 1, tk.mix(tokens[:some] ^ _U(0x9FB21C651E98DF25))))
    return out


def parity_bits(tokens: np.ndarray) -> bytes:
    """The sketch of parity bits, four or more bits for each token, a power of two."""
    size = 1 << max(BRIEF.bit_length() - 1, (4 * len(tokens) - 1).bit_length() if len(tokens) else 0)
    bits = np.bincount((tk.mix(tokens + _U(7)) & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, the longer one folded to the other's size."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def folded(sketch: bytes, bits: int = BRIEF) -> bytes:
    """A shorter sketch of the same set: the parities of its halves, again and again."""
    x = np.frombuffer(sketch, np.uint8)
    while 8 * len(x) > bits:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def _each_run(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, off = tk.text_bytes(column)
    for a, b in tk.runs(off):
        yield a, data[off[a] : off[b]], off[a : b + 1] - off[a]


_ROW = "row struct<f:long,i:long>"


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row, n_shingles, class (two longs) of each row of docs (doc_id, text, row)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, raw = [], []
            for _, data, off in _each_run(batch.column(1)):
                for tokens in shingle_sets(data, off, width):
                    n.append(len(tokens))
                    raw.append(class_of(tokens))
            c = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy())], names=["doc_id", "row", "n_shingles", "cls", "cls2"])
            tk.release()

    return docs.select("doc_id", "text", "row").mapInArrow(run, f"doc_id {kind}, {_ROW}, n_shingles long, cls long, cls2 long")


_ASKED = "part int, sigs binary, owner binary, cls binary, band binary, least binary"
_FLUSH = 1_000_000
_MOST_OWNERS = 60_000


def _asked(sigs: list[np.ndarray], cls: list[int], band: list[int], least: list[int], parts: int) -> pa.RecordBatch:
    """A task's signatures by part: 48 bits each, with a 16-bit index into the part's owners."""
    sig = np.concatenate(sigs)
    owner = np.repeat(np.arange(len(sigs), dtype=np.uint32), [len(s) for s in sigs])
    part = (((sig >> _U(32)) * _U(parts)) >> _U(32)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
    order = np.lexsort((owner, part))
    sig, owner, part = sig[order], owner[order], part[order]
    begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))  # of the parts that occur, however many there are
    fresh = np.concatenate(([True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])))
    used = owner[fresh]
    index = np.cumsum(fresh) - 1
    index -= np.repeat(index[begin], np.diff(np.append(begin, len(part))))
    assert index.max(initial=0) < 1 << 16, "owners of a part have 16 bits"

    def packed(values: np.ndarray, count: np.ndarray) -> pa.Array:
        ends = np.concatenate(([0], np.cumsum(count * (values.nbytes // max(1, len(values))))))
        return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

    rows, owners = np.diff(np.append(begin, len(part))), np.add.reduceat(fresh.astype(np.int64), begin)
    low = np.ascontiguousarray(sig.view(np.uint8).reshape(-1, 8)[:, :6])
    tables = [packed(t[used], owners) for t in (np.array(cls, np.int64), np.array(band, np.uint16), np.array(least, np.uint32))]
    return pa.RecordBatch.from_arrays([pa.array(part[begin].astype(np.int32)), packed(low, rows), packed(index.astype(np.uint16), rows), *tables], names=["part", "sigs", "owner", "cls", "band", "least"])


_SHARED = "sig long, cls long, band int, least int"


def shared_signatures(docs: DataFrame, shape: Shape, width: int, parts: int) -> DataFrame:
    """Rows (sig, cls, band, least) for signatures of two classes or more."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [])
        size, seen = 0, set()
        for batch in batches:
            for _, data, off in _each_run(batch.column(0)):
                for tokens in shingle_sets(data, off, width):
                    if not len(tokens) or (c := class_of(tokens)) in seen:
                        continue
                    seen.add(c)
                    own = int.from_bytes(c[:8], "little", signed=True)
                    for band, least, sigs in signatures(tokens, shape):
                        for to, x in zip(held, (sigs, own, band, least), strict=True):
                            to.append(x)
                        size += len(sigs)
                    if size > _FLUSH or len(held[0]) > _MOST_OWNERS:  # after each text: owners have 16 bits
                        yield _asked(*held, parts)
                        held, size = ([], [], [], []), 0
                        if len(seen) > 1 << 18:
                            seen.clear()
        if held[0]:
            yield _asked(*held, parts)
        held, seen = ([], [], [], []), set()
        tk.release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, owners, cls, band, least, base = [], [], [], [], [], 0
        for b in batches:
            for s, o, c, j, e in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                low = np.frombuffer(s, np.uint8).reshape(-1, 6)
                full = np.zeros((len(low), 8), np.uint8)
                full[:, :6] = low
                sigs.append(full.view(_U).ravel())
                owners.append(np.frombuffer(o, np.uint16).astype(np.int32) + base)
                for to, x, t in ((cls, c, np.int64), (band, j, np.uint16), (least, e, np.uint32)):
                    to.append(np.frombuffer(x, t))
                base += len(cls[-1])
        if not sigs:
            return
        sig, own = np.concatenate(sigs), np.concatenate(owners)
        sigs.clear(), owners.clear()
        cls_, band_, least_ = (np.concatenate(x) for x in (cls, band, least))
        order = np.argsort(sig, kind="stable")
        s = sig[order]
        same = np.concatenate(([False], s[1:] == s[:-1], [False]))
        keep = order[same[1:] | same[:-1]]  # the signature occurs twice at least
        s, c, o = sig[keep], cls_[own[keep]], own[keep]
        del sig, own, order, same
        order = np.lexsort((c, s))
        s, c, o = s[order], c[order], o[order]
        fresh = np.concatenate(([True], (s[1:] != s[:-1]) | (c[1:] != c[:-1]))) if len(s) else np.zeros(0, bool)
        s, c, o = s[fresh], c[fresh], o[fresh]  # a class once for each signature
        begin = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate((begin, [len(s)])))
        many = np.flatnonzero(np.repeat(count > 1, count))
        for at in range(0, len(many), 200_000):
            x = many[at : at + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(s[x].view(np.int64)), pa.array(c[x]), pa.array(band_[o[x]].astype(np.int32)), pa.array(least_[o[x]].astype(np.int32))], names=["sig", "cls", "band", "least"])
        del s, c, o, keep, cls, band, least, cls_, band_, least_
        tk.release()

    asked = docs.select("text").mapInArrow(ask, _ASKED).repartitionById(parts, "part")
    return asked.drop("part").mapInArrow(meet, _SHARED)


_BROADCAST_ROWS = 200_000
_BRIEF = [f"s{i}" for i in range(BRIEF // 64)]


def _sized(small: DataFrame) -> DataFrame:
    """small (written already, a few longs a row) with a broadcast hint if it is small indeed."""
    return F.broadcast(small) if small.count() <= _BROADCAST_ROWS else small


def _telling(shared: DataFrame) -> DataFrame:
    """Rows (sig, cls, pivot) that are enough to find every similar pair.  pivot is
    the signature's set that meets others most often: the source of its copies,
    rather than one of them.

    A set must share `least` signatures with any partner.  One that has fewer
    shared signatures at all is out.  Of the others, only the rarest count, all
    but least - 1 of them: partners share one among these (prefix filter), and
    signatures of passages that very many documents share come last.
    """
    for _ in range(2):
        enough = shared.groupBy("cls", "band").agg(F.count("*").alias("m"), F.max("least").alias("l")).where("m >= l").select("cls", "band")
        some = shared.join(_sized(materialize(enough, "enough")), ["cls", "band"], "left_semi")
        groups = some.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1")
        wide = materialize(some.join(groups, "sig"), "shared")
        shared = wide.select("sig", "cls", "band", "least")
    own = Window.partitionBy("cls", "band")
    ranked = wide.withColumns({"m": F.count("*").over(own), "r": F.row_number().over(own.orderBy("size", "sig"))})
    rare = ranked.withColumn("w", F.sum("size").over(own)).where("r <= m - least + 1").select("sig", "cls", "w")
    groups = rare.groupBy("sig").agg(F.count("*").alias("size"), F.max(F.struct("w", "cls")).alias("top")).where("size > 1")
    return materialize(rare.join(groups, "sig").select("sig", "cls", F.col("top.cls").alias("pivot")), "telling")


def _texts(docs: DataFrame, sets: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """cls, n, sketch and text of one document of each wanted class."""
    first = materialize(sets.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("row").alias("row")), "representatives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sketch, brief, good = [], [], [], []
            cls = batch.column(0).to_pylist()
            for a, data, off in _each_run(batch.column(1)):
                for i, tokens in enumerate(shingle_sets(data, off, width)):
                    good.append(int.from_bytes(class_of(tokens)[:8], "little", signed=True) == cls[a + i])
                    n.append(len(tokens))
                    sketch.append(parity_bits(tokens))
                    brief.append(folded(sketch[-1]))
            b = np.frombuffer(b"".join(brief), np.int64).reshape(-1, BRIEF // 64)
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(sketch, pa.binary()), *(pa.array(b[:, i].copy()) for i in range(b.shape[1])), batch.column(1)],
                names=["cls", "n", "sketch", *_BRIEF, "text"],
            )
            yield out.filter(pa.array(good, pa.bool_()))
            tk.release()

    picked = docs.join(_sized(first), "row").select("cls", "text").mapInArrow(run, "cls long, n int, sketch binary, " + "".join(f"{b} long, " for b in _BRIEF) + "text string")
    return materialize(picked, "texts")


def _verified(pairs: DataFrame, texts: DataFrame, shape: Shape, width: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, x, y = (batch.column(n).to_pylist() for n in ("na", "nb", "xa", "xb"))
            ok = [differing_bits(p, q) <= shape.most_apart(m, n) for m, n, p, q in zip(na, nb, x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, _U))
        for batch in batches:
            a = batch.column("a").to_pylist()
            sets_b = [t for _, d, o in _each_run(batch.column("tb")) for t in shingle_sets(d, o, width)]
            ok = []
            for i, mine in enumerate(a):
                if mine != last[0]:
                    one, off = tk.text_bytes(batch.column("ta").slice(i, 1))
                    last = (mine, next(shingle_sets(one, off, width)))
                both = len(np.intersect1d(last[1], sets_b[i], assume_unique=True))
                ok.append(shape.den * both >= shape.num * (len(last[1]) + len(sets_b[i]) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a = texts.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("xa"))
    b = texts.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("xb"))
    close = pairs.join(a, "a").join(b, "b").mapInArrow(near, "a long, b long")
    close = materialize(close.distinct(), "close")
    a = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"))
    return close.join(a, "a").join(b, "b").mapInArrow(exact, "a long, b long").distinct()


_TILE = 8192  # sets of a signature that are compared in one place
_FIELDS = ["sig", "lo", "hi", "tile", "comp", "cls", "n", *_BRIEF]


def _near_pairs(g: np.ndarray, h: np.ndarray | None, shape: Shape, limit: int) -> Iterator[np.ndarray]:
    """Pairs of classes across the components of rows g (in order of comp), or of g
    and h, whose brief sketches are near enough; some rows of g at a time."""
    comp, cls, size, first = (_FIELDS.index(x) for x in ("comp", "cls", "n", _BRIEF[0]))
    other = g if h is None else h
    begin = np.searchsorted(g[:, comp], g[:, comp], "right") if h is None else np.zeros(len(g), np.int64)
    n = len(other) - begin
    at = 0
    while at < len(g):
        to = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), limit, "right")) + at)
        k = n[at:to]
        i, j = np.repeat(np.arange(at, to), k), tk.spans_of(begin[at:to], k)
        if h is not None:
            differ = g[i, comp] != other[j, comp]
            i, j = i[differ], j[differ]
        apart = np.zeros(len(i), np.int64)
        for c in range(first, len(_FIELDS)):
            apart += np.bitwise_count((g[i, c] ^ other[j, c]).view(_U))
        near = apart <= shape.most_apart(g[i, size], other[j, size])
        a, b = g[i[near], cls], other[j[near], cls]
        yield np.stack((np.minimum(a, b), np.maximum(a, b)), 1)
        at = to


def _across(telling: DataFrame, comps: DataFrame, texts: DataFrame, shape: Shape, parts: int) -> DataFrame:
    """Pairs (a, b) of classes in different components that share a signature and
    whose brief sketches differ no more than those of similar sets may."""
    known = _sized(materialize(texts.select("cls", "n", *_BRIEF).distinct(), "brief"))
    marked = telling.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("sig", "cls", F.coalesce("comp", "cls").alias("comp"))
    marked = materialize(marked, "marked")
    open_ = materialize(marked.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")).where("x <> y").select("sig", "m"), "open")
    marked = marked.join(open_, "sig").join(known, "cls")
    if open_.where(F.col("m") > _TILE).isEmpty():
        tiled = marked.withColumns({x: F.lit(0).cast("long") for x in ("lo", "hi", "tile")})
    else:  # a set goes to all pairs of tiles that its own is in
        tiles = F.ceil(F.col("m") / _TILE)
        tiled = marked.withColumn("tile", F.pmod(F.xxhash64("cls"), tiles)).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
        tiled = tiled.withColumns({"lo": F.least("tile", "to"), "hi": F.greatest("tile", "to")})
    key = ["sig", "lo", "hi"]
    ordered = tiled.select(*(F.col(x).cast("long").alias(x) for x in _FIELDS)).repartition(parts, *key).sortWithinPartitions(*key, "tile", "comp")
    limit = 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            rows = np.unique(np.concatenate(held), axis=0)
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy())], names=["a", "b"])

        def groups() -> Iterator[np.ndarray]:
            """The rows of each signature, or pair of its tiles."""
            rest: list[np.ndarray] = []
            for batch in batches:
                now = np.stack([batch.column(i).to_numpy() for i in range(len(_FIELDS))], 1)
                if not len(now):
                    continue
                cuts = (np.flatnonzero((now[1:, :3] != now[:-1, :3]).any(1)) + 1).tolist()
                if rest and (rest[-1][-1, :3] != now[0, :3]).any():
                    yield np.concatenate(rest)
                    rest = []
                for lo, hi in zip([0, *cuts], [*cuts, len(now)], strict=True):
                    rest.append(now[lo:hi])
                    if hi < len(now):
                        yield np.concatenate(rest) if len(rest) > 1 else rest[0]
                        rest = []
            if rest:
                yield np.concatenate(rest)

        for g in groups():
            if g[0, 1] == g[0, 2]:
                found = _near_pairs(g, None, shape, limit)
            else:
                middle = int(np.searchsorted(g[:, 3], g[0, 2]))
                found = _near_pairs(g[:middle], g[middle:], shape, limit)
            for rows in found:
                held.append(rows)
                size += len(rows)
                if size > limit:
                    yield flush()
        if held:
            yield flush()
        tk.release()

    return ordered.mapInArrow(run, "a long, b long").distinct()


_SIGNATURES_PER_PART = 4_000_000  # bounds what a task holds of them


def _classes(docs: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """doc_id, row, n_shingles and the key (two longs) of its class of each row of
    docs (doc_id, text, row); similar rows have a common key."""
    shape = Shape(num, den)
    sets = materialize(set_table(docs, width), "sets")
    shingles = sets.agg(F.sum("n_shingles")).first()[0] or 0  # about as many signatures
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles // _SIGNATURES_PER_PART))
    telling = _telling(materialize(shared_signatures(docs, shape, width, parts), "signatures"))
    texts = _texts(docs, sets, telling.select("cls").distinct(), width)
    stars = materialize(telling.where("cls <> pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b")).distinct(), "stars")
    links = materialize(_verified(stars, texts, shape, width), "links")
    comps = connected_components(links)
    across = _across(telling, comps, texts, shape, parts).join(stars, ["a", "b"], "left_anti")
    more = materialize(_verified(materialize(across, "across"), texts, shape, width), "links")
    comps = connected_components(links.union(more))
    # linked classes go by their component, all others by their full class
    roots = comps.select(F.col("comp").alias("cls"), "comp").distinct()
    named = comps.withColumnRenamed("node", "cls").unionByName(roots)
    keyed = sets.join(_sized(materialize(named, "named")), "cls", "left")
    return keyed.select("doc_id", "row", "n_shingles", F.coalesce("comp", "cls").alias("key"), F.when(F.col("comp").isNull(), F.col("cls2")).otherwise(0).alias("key2"))


_HOT_KEYS = 1000


def _by_class(classes: DataFrame, value, name: str) -> DataFrame:
    """classes with an aggregate over the rows of each key, null for keys with one
    row.  Keys with more than a thousandth of the rows, a thousand at most, are
    looked up in a broadcast table; their rows don't meet in one task."""
    classes = materialize(classes, "classes")
    some = classes.where("n_shingles > 0")
    found = materialize(some.groupBy("key", "key2").agg(value.alias(name), F.count("*").alias("_m")).where("_m > 1"), "keys")
    total = classes.count()
    hot = found.where(F.col("_m") * _HOT_KEYS > total).select("key", "key2", F.col(name).alias("_hot"))
    out = classes.join(F.broadcast(hot), ["key", "key2"], "left")
    spread = F.col("_hot").isNotNull()
    out = out.withColumns({"_k": F.when(spread, F.xxhash64("row")).otherwise(F.col("key")), "_k2": F.when(spread, F.lit(0)).otherwise(F.col("key2"))})
    cold = found.where(F.col("_m") * _HOT_KEYS <= total).select(F.col("key").alias("_k"), F.col("key2").alias("_k2"), F.col(name).alias("_cold"))
    return out.join(cold, ["_k", "_k2"], "left").withColumn(name, F.coalesce("_hot", "_cold")).drop("_k", "_k2", "_hot", "_cold")


def similarity_classes(docs: DataFrame, num: int = 75, den: int = 100, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach) of each row."""
    docs, row = row_key(docs)
    classes = _classes(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), row.alias("row")), num, den, width)
    out = _by_class(classes, F.struct(F.min("doc_id").alias("doc_id")), "least")
    known = F.when((F.col("n_shingles") > 0) & F.col("least").isNotNull(), F.col("least.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", known.alias("component_id"))


def one_of_each(docs: DataFrame, num: int = 75, den: int = 100, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without all but one of each group of similar ones: that with
    the smallest id (null ids come last), the first in its file among equals."""
    names = docs.columns
    docs, row = row_key(docs)
    classes = _classes(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), row.alias("row")), num, den, width)
    own = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("c"))
    best = _by_class(classes, F.min(own), "best")
    copies = materialize(best.where("n_shingles > 0 and best is not null and best.c <> row").select(F.col("row").alias("copy")), "copies")
    kept = docs.select(F.struct(*(docs[f"`{c}`"] for c in names)).alias("doc"), row.alias("key"))  # whatever their columns are called
    return kept.join(_sized(copies), F.col("key") == F.col("copy"), "left_anti").select("doc.*")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN size AS p ON p.doc_id = x.doc_id JOIN size AS q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n
  HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM w LEFT JOIN size USING (doc_id) JOIN reach ON reach.a = w.doc_id
GROUP BY w.doc_id, n
"""
