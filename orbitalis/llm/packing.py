"""Packing of token sequences: shortest-pack-first over the length histogram.

Documents are cut into full sequences and one remainder.  Only the histogram of
piece lengths (at most `limit` numbers) comes to the driver.  There lengths are
placed longest first; each goes to the pack pattern with the least content, as
long as it fits, and a pattern's count is split when fewer pieces than packs
are left.  The plan is a list of segments "pieces of length l with ranks from a
to b go to sequences from s on, at offset o, m to a sequence", whose number
depends on `limit` alone.  Pieces then find their segment by their rank within
their length, which is computed from salted groups so that a length shared by a
third of all documents is spread over many tasks.

Where packs are left with more room than `most_padding` of all ids, the emptiest
packs are taken apart and their documents fill the others' gaps: donors and gaps
are both laid end to end, and a donor is cut where its stretch crosses a gap's
border.  What is over makes new sequences, so one of them at most isn't full.
Only donors are tokenized again.

Edge cases: a null text is an empty text and yields its end id alone; repeated
rows are packed once each; an empty table gives no rows; extra columns of the
input are ignored; ties in a length are ordered by id, start and hash.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitalis.llm import textkernel as tk
from orbitalis.llm.storage import materialize
from orbitalis.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PIECE_SCHEMA = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])


def cut_lengths(total: int, limit: int) -> list[int]:
    """Full sequences and one remainder."""
    full, rest = divmod(total, limit)
    return [limit] * full + [rest] * (rest > 0)


def tokenize_pieces(docs: DataFrame, vocabulary: str, limit: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document, with a checksum of their ids."""
    tail = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for a, b, ids, off in enc.runs(batch.column(1)):
                rows, flat = [], ids.astype("<u4").tobytes()
                for doc, lo, hi in zip(batch.column(0).slice(a, b - a).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                    raw, start = flat[4 * lo : 4 * hi] + tail, 0
                    for n in cut_lengths(hi - lo + 1, limit):
                        rows.append((doc, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), hi - lo + 1))
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=PIECE_SCHEMA)
            del batch
            tk.release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


@dataclass
class Pattern:
    """`count` sequences of equal make: (length, how many) from the start on."""

    fill: int
    count: int
    parts: tuple[tuple[int, int], ...]


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[Pattern]:
    """Pack patterns for a histogram of lengths from 1 to limit.

    Longest first, each piece goes to the pack with the least content if it fits
    there, or else opens a pack.  Packs of one pattern take a piece each at a time;
    where all are too full, the pieces of a length fill new packs one after another.
    """
    heap: list[tuple[int, int, Pattern]] = []  # by content, then by age
    made = itertools.count()
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if not heap or heap[0][0] + length > limit:
                each = limit // length  # a new pack is the only one with room until it is full
                for n, count in ((each, left // each), (left % each, 1)):
                    if n and count:
                        heapq.heappush(heap, (n * length, next(made), Pattern(n * length, count, ((length, n),))))
                break
            fill, age, host = heapq.heappop(heap)
            used = min(host.count, left)
            if used < host.count:
                heapq.heappush(heap, (fill, age, Pattern(fill, host.count - used, host.parts)))
            *before, (last, n) = host.parts
            parts = (*before, (last, n + 1)) if last == length else (*host.parts, (length, 1))
            heapq.heappush(heap, (fill + length, next(made), Pattern(fill + length, used, parts)))
            left -= used
    return [p for _, _, p in sorted(heap, key=lambda x: x[:2])]


@dataclass
class Plan:
    """Where pieces go, by length and rank.

    whole: rows (length, first rank, sequence, offset, pieces a sequence); where
    the sequence is -1 the pieces are donors and the offset is the first one's
    place in the donors' stretch.  gaps: rows (place, gap, sequence, offset) of
    classes of gaps, laid end to end.
    """

    whole: np.ndarray
    gaps: np.ndarray


def make_plan(histogram: dict[int, int], limit: int, most_padding: float) -> Plan:
    patterns = sorted(shortest_pack_first(histogram, limit), key=lambda p: p.fill)
    room = sum((limit - p.fill) * p.count for p in patterns)
    donors: list[Pattern] = []
    if room > most_padding * sum(n * c for n, c in histogram.items()):
        given = 0
        while given < room:  # the emptiest packs, as many as the others have room for
            p = patterns[0]
            need = room - given
            # with each pack taken apart, its content is given and its own room is gone
            n = min(p.count, max(1, -(-need // limit)))
            given, room = given + n * p.fill, room - n * (limit - p.fill)
            donors.append(Pattern(p.fill, n, p.parts))
            if n < p.count:
                patterns[0] = Pattern(p.fill, p.count - n, p.parts)
            else:
                del patterns[0]
    taken: dict[int, int] = {}
    rows, gaps, sequence, place = [], [], 0, 0
    for p in patterns:
        offset = 0
        for length, each in p.parts:
            rank = taken.get(length, 0)
            rows.append((length, rank, sequence, offset, each))
            taken[length] = rank + p.count * each
            offset += length * each
        if p.fill < limit and donors:
            gaps.append((place, limit - p.fill, sequence, p.fill))
            place += (limit - p.fill) * p.count
        sequence += p.count
    gaps.append((place, limit, sequence, 0))
    place = 0
    for p in donors:
        for length, each in p.parts:
            rank = taken.get(length, 0)
            rows.append((length, rank, -1, place, 1))
            taken[length] = rank + p.count * each
            place += length * each * p.count
    return Plan(np.array(sorted(rows), np.int64).reshape(-1, 5), np.array(gaps, np.int64).reshape(-1, 4))


def place(plan: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks; for donors -1
    and the place in their stretch."""
    table = plan.whole
    base = np.searchsorted(table[:, 0], np.arange(table[:, 0].max() + 2))
    out_s, out_o = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    for n in np.unique(length):
        rows = table[base[n] : base[n + 1]]
        mine = np.flatnonzero(length == n)
        k = np.searchsorted(rows[:, 1], rank[mine], "right") - 1
        inside = rank[mine] - rows[k, 1]
        donor = rows[k, 2] < 0
        out_s[mine] = np.where(donor, -1, rows[k, 2] + inside // rows[k, 4])
        out_o[mine] = rows[k, 3] + np.where(donor, inside, inside % rows[k, 4]) * n
    return out_s, out_o


def cuts(plan: Plan, start: int, length: int) -> list[tuple[int, int, int, int]]:
    """The parts (begin, size, sequence, offset) of a donor at a place in the stretch."""
    out, at, end = [], start, start + length
    while at < end:
        first, gap, sequence, offset = plan.gaps[np.searchsorted(plan.gaps[:, 0], at, "right") - 1].tolist()
        which, inside = divmod(at - first, gap)
        size = min(gap - inside, end - at)
        out.append((at - start, size, sequence + which, offset + inside))
        at += size
    return out


def with_rank(pieces: DataFrame, rows_per_group: int = 50_000) -> DataFrame:
    """A rank from 0 within each length, computed in salted groups."""
    total = pieces.count()
    salts = max(16, -(-total // rows_per_group))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").count()
    before = counts.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).drop("count")
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")
    return (
        salted.withColumn("_n", F.row_number().over(inside).cast("long") - 1)
        .join(before, ["length", "_salt"])
        .withColumn("rank", F.col("_n") + F.col("_before"))
        .drop("_n", "_before", "_salt")
    )


PLACED = PIECES + ", sequence_id long, offset long"
PLACED_SCHEMA = pa.schema([*PIECE_SCHEMA, ("sequence_id", pa.int64()), ("offset", pa.int64())])
_BROADCAST_ROWS = 200_000


def pack(docs: DataFrame, vocabulary: str, limit: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", most_padding: float = 0.005) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = materialize(tokenize_pieces(docs, vocabulary, limit, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `limit` rows
    plan = make_plan(histogram, limit, most_padding)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                where = place(plan, b.column("length").to_numpy(), b.column("rank").to_numpy())
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in PIECE_SCHEMA.names), *map(pa.array, where)], schema=PLACED_SCHEMA)

    placed = with_rank(pieces).mapInArrow(assign, PLACED)
    if not (plan.whole[:, 2] < 0).any():
        return placed
    placed = materialize(placed, "placed")
    return placed.where("sequence_id >= 0").unionByName(_cut_donors(docs, placed.where("sequence_id < 0"), plan, vocabulary, end_id, id_col, text_col))


def _cut_donors(docs: DataFrame, donors: DataFrame, plan: Plan, vocabulary: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The parts of the donors, from their texts."""
    tail = int(end_id).to_bytes(4, "little")
    # a row of donors is known by its place in the stretch
    wanted = donors.select(F.col("doc_id").alias("_id"), "start", "length", F.col("ids_crc32").alias("crc"), F.col("offset").alias("at"))
    wanted = F.broadcast(wanted) if wanted.count() <= _BROADCAST_ROWS else wanted
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "start", "length", "crc", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part, rows = batch.slice(lo, 500), []
                doc, text, start, length, crc, at = (part.column(i).to_pylist() for i in range(6))
                for d, raw, s, n, c, a in zip(doc, enc.encode(text), start, length, crc, at, strict=True):
                    raw += tail
                    if zlib.crc32(raw[4 * s : 4 * (s + n)]) != c:
                        continue  # another row of the same id
                    for begin, size, sequence, offset in cuts(plan, a, n):
                        x = raw[4 * (s + begin) : 4 * (s + begin + size)]
                        rows.append((d, s + begin, size, zlib.crc32(x), len(raw) // 4, sequence, offset))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=PLACED_SCHEMA)
            del batch
            tk.release()

    return both.mapInArrow(cut, PLACED).dropDuplicates(["sequence_id", "offset"])


def padding(lengths: np.ndarray, limit: int) -> int:
    """Padding ids for sequences of these lengths; a power of two needs none."""
    power = (lengths & (lengths - 1)) == 0
    return int(np.where(power, 0, limit - lengths).sum())
