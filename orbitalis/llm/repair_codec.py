"""Token-id output files with Re-Pair grammar compression.

Documents are range-partitioned and sorted by id; each partition is written as
blocks of about `block_ids` ids.  A block is a shard of the output that stands
on its own: its grammar (rules with their expansion lengths), the compressed
sequence, the documents' ids and where each begins, in symbols and in ids.  One
document can so be decoded by expanding only its own symbols.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new symbol,
again and again, until no pair occurs `least` times.  Here a round takes all
pairs down to a threshold at once, which falls by `ratio` from round to round;
where two of them overlap, the one with the higher count has the place, and the
other waits.  Counts are exact and without overlaps.  Rounds go on until no pair
occurs `least` times any more (or the block's symbol space is full, which takes
more than half a million rules in a block of usual size).  A round only looks at
places whose pair was frequent, or has changed: no count ever rises but that of
pairs with a new symbol.  A pair never spans two documents.

Blocks are rows of a Parquet table in the shared folder, written through
Spark's committer, so a lost executor leaves no half-written file.

Edge cases: a null text is an empty text and holds the end id alone; documents
with equal ids are ordered by their text's hash; null ids come first and are
read back as null; a text is never cut, so memory follows the longest one where
that is longer than a block; an empty table gives an empty table; extra columns
of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitalis.llm import textkernel as tk
from orbitalis.llm.storage import materialize
from orbitalis.llm.textkernel import spans_of
from orbitalis.llm.tokens import encoder

MAGIC = b"RPG2"
_HEAD = struct.Struct("<4sIIIIIBBxx")
_U = np.uint64
BLOCKS = "shard int, block int, shard_start long, n_docs long, n_ids long, payload binary"
BLOCK_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])


class _Sequence:
    """A sequence of symbols in which pairs are replaced; replaced places are skipped."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        n = self.n = len(ids)
        self.symbol = ids.astype(np.int32)
        self.next, self.before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        self.shut = np.append(ends, True)  # no pair begins here: a document's end, or a place that is gone
        self.gone = np.zeros(n, bool)
        self.rank = np.zeros(n + 1, np.int32)  # of the chosen pair that begins here
        self.place_bits = _U(max(1, n.bit_length()))
        self.symbol_bits = (_U(64) - self.place_bits) // _U(2)

    def pairs(self, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that begin at these places: their codes, where each one's places
        begin among all places, these places, and which of them are to be left out."""
        key = self.symbol[at].astype(_U)
        key <<= self.symbol_bits
        key |= self.symbol[self.next[at]].view(np.uint32)
        key <<= self.place_bits
        key |= at.view(np.uint32)
        key.sort()
        place = (key & ((_U(1) << self.place_bits) - _U(1))).astype(np.int32)
        key >>= self.place_bits
        begin = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        codes = key[begin[:-1]]
        # in a run of one symbol, every second pair overlaps the one before
        twin = np.flatnonzero(((codes >> self.symbol_bits) == (codes & ((_U(1) << self.symbol_bits) - _U(1)))) & (begin[1:] - begin[:-1] >= least))
        if len(twin):
            size = begin[twin + 1] - begin[twin]
            twin, of = spans_of(begin[twin], size), np.repeat(twin, size)
            chain = np.concatenate(([False], (of[1:] == of[:-1]) & (self.next[place[twin][:-1]] == place[twin][1:])))
            i = np.arange(len(twin))
            twin = twin[(i - np.maximum.accumulate(np.where(chain, 0, i))) % 2 == 1]
        return codes, begin, place, twin

    def replace(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Puts symbols for the pairs at these places; places where pairs have changed."""
        second = self.next[at]
        after = self.next[second]
        self.symbol[at], self.next[at], self.shut[at] = symbols, after, self.shut[second]
        inside = after < self.n
        self.before[after[inside]] = at[inside]
        self.shut[second] = self.gone[second] = True
        return np.concatenate((at, self.before[at]))


def compress(ids: np.ndarray, ends: np.ndarray, vocab: int, least: int = 4, ratio: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules, their expansion lengths and the compressed sequence; ends marks each document's last id."""
    seq = _Sequence(ids, ends)
    most = (1 << int(seq.symbol_bits)) - 1
    rules, made, at, limit = [], vocab, np.flatnonzero(~seq.shut[: seq.n]).astype(np.int32), 0
    while len(at) and made < most:
        codes, begin, place, left_out = seq.pairs(at, least)
        size = np.diff(begin)
        count = size.copy()
        if len(left_out):
            count -= np.bincount(np.searchsorted(begin, left_out, "right") - 1, minlength=len(count))
        top = int(count.max())
        if top < least:
            break
        limit = max(least, min(limit or top, top) // ratio)
        chosen = np.flatnonzero(count >= limit)
        if len(chosen) > most - made:
            chosen = np.sort(chosen[np.argsort(-count[chosen], kind="stable")[: most - made]])
        rank = np.empty(len(chosen), np.int32)  # by count, all different
        rank[np.argsort(np.minimum(count[chosen], 65_535).astype(np.uint16), kind="stable")] = np.arange(1, len(chosen) + 1)
        if 4 * int(size[chosen].sum()) < len(place):
            of, spot = np.repeat(np.arange(len(chosen), dtype=np.int32), size[chosen]), spans_of(begin[:-1][chosen], size[chosen])
            if len(left_out):
                out = np.zeros(len(place), bool)
                out[left_out] = True
                of, spot = of[~out[spot]], spot[~out[spot]]
            spot = place[spot]
        else:
            number = np.full(len(count), -1, np.int32)
            number[chosen] = np.arange(len(chosen))
            of = np.repeat(number, size)
            of[left_out] = -1
            ok = of >= 0
            of, spot = of[ok], place[ok]
        mine = rank[of]
        seq.rank[spot] = mine
        wins = mine > np.maximum(seq.rank[seq.before[spot]], seq.rank[seq.next[spot]])
        seq.rank[spot] = 0
        spot, of = spot[wins], of[wins]
        got = np.bincount(of, minlength=len(chosen))
        good = got >= max(least, limit // 2)
        good[np.argmax(rank)] = True  # it has won all its places
        stays = good[of]
        changed = seq.replace(spot[stays], (made + np.cumsum(good) - 1)[of[stays]])
        pair = codes[chosen[good]]
        rules.append(np.stack((pair >> seq.symbol_bits, pair & ((_U(1) << seq.symbol_bits) - _U(1))), 1).astype(np.int64))
        made += len(pair)
        at = np.concatenate((place[np.repeat(count >= least, size)], changed))
        if len(at) > seq.n // 16:
            live = np.zeros(seq.n + 1, bool)
            live[at] = True
            at = np.flatnonzero((live & ~seq.shut)[: seq.n]).astype(np.int32)
        else:
            at = np.unique(at[at >= 0])
            at = at[~seq.shut[at]]
    rule = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    lengths = np.ones(made, np.int64)
    for lo, hi in _layers(rules, vocab):  # the rules of a round hold symbols of earlier ones only
        lengths[lo:hi] = lengths[rule[lo - vocab : hi - vocab]].sum(1)
    return rule, lengths[vocab:], seq.symbol[~seq.gone]


def _layers(rules: list[np.ndarray], vocab: int) -> Iterator[tuple[int, int]]:
    at = vocab
    for x in rules:
        yield at, at + len(x)
        at += len(x)


def _packed(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def _unpacked(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 4), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.view("<u4").ravel().astype(np.int64)


def write_block(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, vocab: int, **how: int) -> bytes:
    """The block of these documents; counts: how many ids each has."""
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(counts) - 1] = True
    rules, lengths, seq = compress(ids, ends, vocab, **how)
    size = np.concatenate((np.ones(vocab, np.int64), lengths))
    begins = np.concatenate(([0], np.searchsorted(np.cumsum(size[seq]), np.cumsum(counts)) + 1))
    width = 2 if vocab + len(rules) <= 1 << 16 else 3 if vocab + len(rules) <= 1 << 24 else 4
    return b"".join((
        _HEAD.pack(MAGIC, vocab, len(doc_ids), len(rules), len(seq), len(ids), width, 0),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        counts.astype("<u4").tobytes(), begins.astype("<u4").tobytes(),
        _packed(rules.ravel(), width), lengths.astype("<u4").tobytes(), _packed(seq, width),
    ))


class Block:
    """A block's parts, and its documents' ids on demand."""

    def __init__(self, payload: bytes):
        magic, vocab, n_docs, n_rules, n_seq, self.n_ids, width, _ = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(payload, kind, n, at)
            at += got.nbytes
            return got

        self.vocab = vocab
        self.doc_ids, self.unknown = take("<i8", n_docs), take("u1", n_docs).astype(bool)
        self.counts, self.begins = take("<u4", n_docs), take("<u4", n_docs + 1).astype(np.int64)
        self.rules = _unpacked(take("u1", 2 * n_rules * width), width).reshape(-1, 2)
        self.lengths = take("<u4", n_rules)
        self.seq = _unpacked(take("u1", n_seq * width), width)
        # the expansions of all symbols, one after another
        self._size = np.concatenate((np.ones(vocab, np.int64), self.lengths.astype(np.int64)))
        self._from = np.cumsum(self._size) - self._size
        self._flat = np.empty(int(self._size.sum()), "<u4")
        self._flat[:vocab] = np.arange(vocab)
        lo = 0
        while lo < n_rules:  # as many rules at a time as hold only symbols from before
            later = np.flatnonzero(self.rules[lo:].max(1) >= vocab + lo)
            hi = lo + int(later[0]) if len(later) else n_rules
            for side, shift in ((0, 0), (1, self._size[self.rules[lo:hi, 0]])):
                part = self.rules[lo:hi, side]
                self._flat[spans_of(self._from[vocab + lo : vocab + hi] + shift, self._size[part])] = self._flat[spans_of(self._from[part], self._size[part])]
            lo = hi

    def ids_of_documents(self) -> pa.Array:
        return pa.array(self.doc_ids.astype(np.int64), pa.int64(), mask=self.unknown)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self._flat[spans_of(self._from[symbols], self._size[symbols])]

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, without decoding the others."""
        return self.expand(self.seq[self.begins[i] : self.begins[i + 1]])

    def all_ids(self, symbols: int = 1 << 18) -> Iterator[tuple[int, np.ndarray]]:
        """Index of the first document and the ids of runs of documents."""
        n, at = len(self.doc_ids), 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(self.begins, self.begins[at] + symbols, "right")) - 1)
            yield at, self.expand(self.seq[self.begins[at] : self.begins[to]])
            at = to


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 0, block_ids: int = 1_000_000, vocab: int = 50_257, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The table of blocks, in the shared folder; see the module's text."""
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .select("doc_id", "text", F.spark_partition_id().alias("shard"))
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        docs_: list[int | None] = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = block = start = shard = 0

        def out() -> pa.RecordBatch:
            nonlocal size, block, start
            payload = write_block(docs_, np.concatenate(counts), np.concatenate(held), vocab, **how)
            row = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, block, start, len(docs_), size, payload), BLOCK_SCHEMA.types, strict=True)], schema=BLOCK_SCHEMA)
            start, block, size = start + size, block + 1, 0
            for x in (docs_, held, counts):
                x.clear()
            return row

        for batch in batches:
            if batch.num_rows:
                shard = batch.column(2)[0].as_py()
            for a, b, ids, off in enc.runs(batch.column(1)):
                docs_ += batch.column(0).slice(a, b - a).to_pylist()
                held.append(np.insert(ids, off[1:], end_id))
                counts.append(np.diff(off) + 1)
                size += len(held[-1])
                if size >= block_ids:
                    yield out()
        if docs_:
            yield out()
        tk.release()

    return materialize(ordered.mapInArrow(encode, BLOCKS), "blocks")


def read_token_files(blocks: DataFrame) -> DataFrame:
    """Per document, from the blocks: doc_id, start, n_tokens, ids_crc32.

    Only one number for each shard (its ids) comes to the driver.
    """
    totals = dict(blocks.groupBy("shard").agg(F.sum("n_ids")).collect())
    bases, base = {}, 0
    for shard in sorted(totals):
        bases[shard], base = base, base + totals[shard]
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # a block at a time
                shard, start, payload = (batch.column(i)[row].as_py() for i in range(3))
                block = Block(payload)
                counts = block.counts.astype(np.int64)
                crc = []
                for first, ids in block.all_ids():
                    raw, at = ids.tobytes(), 0
                    for n in counts[first:].tolist():
                        if at == len(raw):
                            break
                        crc.append(zlib.crc32(raw[at : at + 4 * n]))
                        at += 4 * n
                starts = bases[shard] + start + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays([block.ids_of_documents(), pa.array(starts), pa.array(counts), pa.array(crc, pa.int64())], schema=schema)

    return blocks.select("shard", "shard_start", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents_ids(spark: SparkSession, blocks: DataFrame, wanted: list[int]) -> DataFrame:
    """Random access: the ids (array) of the stated documents."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                block = Block(payload)
                hit = np.flatnonzero(np.isin(block.doc_ids, wanted) & ~block.unknown).tolist()
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(block.doc_ids[hit], pa.int64()), "ids": pa.array([block.document(i).tolist() for i in hit], pa.list_(pa.int64()))})

    return blocks.select("payload").mapInArrow(some, "doc_id long, ids array<long>")
