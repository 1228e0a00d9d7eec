"""Removal of repeated passages with difference-cover anchors.

A passage is a window of `window` words that starts in more than one place of
the corpus.  Let D be a difference cover modulo v: for any two places i and j
there is a shift s < v with (i + s) mod v and (j + s) mod v both in D.  So if
two windows are equal, so are two anchors, short windows of window - v + 1 words
that begin at cover positions of their documents, at the same shift.  Only
anchors (|D| in v words) are hashed and compared over the corpus.  A repeated
anchor is then extended: every full window around it is hashed and compared,
and those found again are passages.

Documents are dealt into chunks by a hash of id and text, as many as there are
`chunk_bytes` of text.  A chunk asks for its
distinct hashes, and is told which of them occur elsewhere as well (or twice
within it).  A hash shared by a third of all documents costs each chunk one
entry.  Anchors go by 64 bits, as they only say where to look; windows by 128,
two independent hashes over independently hashed words.  The texts are exchanged
once and reused in all three passes.

Edge cases: a null or empty text has no words and keeps an empty text; texts
with fewer words than a window lose nothing; a text that occurs twice is
removed in both places if it has a window; repeated rows, null and equal ids are
rows of their own; an empty table gives no rows; extra columns are ignored; a
text longer than a chunk is held whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitalis.llm import textkernel as tk

#: A perfect difference cover modulo 21 (fixed values).
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
REQUESTS = "part int, chunk int, once binary, often binary"
ANSWERS = "chunk int, found binary"
_REQUEST = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("once", pa.binary()), ("often", pa.binary())])


def _sorted(rows: np.ndarray) -> np.ndarray:
    """Rows of one or two hashes in order."""
    return np.sort(rows, axis=0) if rows.shape[1] == 1 else rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and how often each occurs."""
    rows = _sorted(rows)
    begin = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(1)))) if len(rows) else np.zeros(0, np.int64)
    return rows[begin], np.diff(np.concatenate((begin, [len(rows)])))


def _packed(values: np.ndarray, keep: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The bytes of the rows to keep of each stretch, as one binary value a stretch."""
    count = np.add.reduceat(keep.astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(count * values.itemsize * values.shape[1])))
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values[keep]))])


def requests(chunk: int, hashes: np.ndarray, parts: int) -> pa.RecordBatch:
    """The chunk's distinct hashes (rows of one or two) by part, those that it has
    once and oftener apart.  Only parts that occur have a row, however many there are."""
    values, n = _distinct(hashes)
    part = (((values[:, 0] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)
    begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    cols = pa.array(part[begin]), pa.array(np.full(len(begin), chunk, np.int32)), _packed(values, n == 1, begin), _packed(values, n > 1, begin)
    return pa.RecordBatch.from_arrays(list(cols), schema=_REQUEST)


def answers(asked: DataFrame, parts: int, wide: int) -> DataFrame:
    """For each chunk those of its hashes (`wide` 64-bit numbers each) that occur more
    than once over all chunks."""

    def read(raw: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint64).reshape(-1, wide) for x in raw]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, once, often = [], [], []
        for b in batches:
            chunks += b.column(0).to_pylist()
            once += read(b.column(1).to_pylist())
            often += read(b.column(2).to_pylist())
        if not chunks:
            return
        every, n = _distinct(np.concatenate([*once, *often]))
        twice = every[n > 1]
        for chunk, a, b in zip(chunks, once, often, strict=True):
            mine = a[_among(a, twice)]
            if len(mine) or len(b):
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "found": pa.array([mine.tobytes() + b.tobytes()], pa.binary())})
        del every, twice, once, often
        tk.release()

    return asked.repartitionById(parts, "part").select("chunk", "once", "often").mapInArrow(run, ANSWERS)


class _Run:
    """The words of a run of texts and where their windows may start."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.words = tk.Words(data, off)
        self.hash = self.words.hashes()
        self._second: np.ndarray | None = None
        self.first = self.words.first
        n = np.diff(self.first)
        self.place = np.arange(len(self.hash)) - np.repeat(self.first[:-1], n)  # within the text
        self.after = np.repeat(self.first[1:], n) - np.arange(len(self.hash))  # words from here to the text's end

    def starts(self, size: int) -> np.ndarray:
        return self.after >= size

    def windows(self, size: int, start: np.ndarray) -> np.ndarray:
        """Two hashes of the windows that start at these places."""
        if self._second is None:
            self._second = self.words.hashes(family=1)
        return np.stack([tk.windows(h, size)[start] for h in (self.hash, self._second)], 1)

    def anchors(self, size: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors and their hashes; texts shorter than a window have none."""
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        at = np.flatnonzero(cover[self.place % PERIOD] & self.starts(size) & (self.place + self.after >= window))
        return at, tk.windows(self.hash, size)[at] if len(at) else np.zeros(0, np.uint64)

    def candidates(self, at: np.ndarray, window: int) -> np.ndarray:
        """Starts of windows that hold one of the anchors at these places."""
        seen = np.zeros(len(self.hash) + PERIOD + 1, np.int64)
        seen[at + 1] = 1
        np.cumsum(seen, out=seen)
        i = np.arange(len(self.hash))
        return np.flatnonzero(self.starts(window) & (seen[i + PERIOD] > seen[i]))


def _runs(texts: pa.Array) -> Iterator[tuple[int, int, _Run, np.ndarray, np.ndarray]]:
    data, off = tk.text_bytes(texts)
    for a, b in tk.runs(off):
        d, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
        yield a, b, _Run(d, o), d, o


def _found(right: pa.Table, wide: int) -> np.ndarray:
    got = [np.frombuffer(x, np.uint64).reshape(-1, wide) for x in right.column("found").to_pylist()]
    return _distinct(np.concatenate(got))[0] if got else np.zeros((0, wide), np.uint64)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each row is among the known ones, which are in order."""
    out = np.zeros(len(x), bool)
    left, at = np.arange(len(x)), np.searchsorted(known[:, 0], x[:, 0])
    while len(left):
        on = (at < len(known)) & (known[np.minimum(at, len(known) - 1), 0] == x[left, 0]) if len(known) else np.zeros(len(left), bool)
        left, at = left[on], at[on]
        same = (known[at] == x[left]).all(1)
        out[left[same]] = True
        left, at = left[~same], at[~same] + 1  # another row with that first hash
    return out


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words, joined by spaces) of each row."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    size = window - PERIOD + 1
    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    dealt = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = dealt.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (8 * chunk_bytes)))
    chunks = max(parts, -(-total // chunk_bytes))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).repartition(chunks if chunks < 4 * parts else parts, "chunk")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            own = batch.column("chunk").to_numpy()
            for a, b, run, _, _ in _runs(batch.column("text")):
                at, h = run.anchors(size, window)
                of = np.repeat(own[a:b], np.diff(run.first))[at]
                for chunk in np.unique(own[a:b]).tolist():
                    held.setdefault(chunk, []).append(h[of == chunk])
        for chunk, got in held.items():
            yield requests(chunk, np.concatenate(got)[:, None], parts)
        del held
        tk.release()

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        known, out = _found(right, 1), []
        if not len(known):
            return _REQUEST.empty_table()
        for _, _, run, _, _ in _runs(left.column("text")):
            at, h = run.anchors(size, window)
            start = run.candidates(at[_among(h[:, None], known)], window)
            if len(start):
                out.append(run.windows(window, start))
        if not out:
            return _REQUEST.empty_table()
        return pa.Table.from_batches([requests(left.column("chunk")[0].as_py(), np.concatenate(out), parts)])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        known = _found(right, 2)
        n_words, n_removed, kept = [], [], []
        for a, b, run, data, off in _runs(left.column("text")):
            n = np.diff(run.first)
            covered = np.zeros(len(run.hash) + 1, np.int64)
            if len(known) and len(run.hash) >= window:
                h = tk.windows(run.hash, window)
                start = np.flatnonzero(run.starts(window)[: len(h)])
                first = known[:, 0]  # most windows aren't known by their first hash already
                start = start[first[np.minimum(np.searchsorted(first, h[start]), len(first) - 1)] == h[start]]
                start = start[_among(run.windows(window, start), known)] if len(start) else start
                np.add.at(covered, start, 1)
                np.add.at(covered, start + window, -1)
            gone = np.cumsum(covered)[:-1] > 0
            total = np.concatenate(([0], np.cumsum(gone)))
            lost = total[run.first[1:]] - total[run.first[:-1]]
            raw = data.tobytes()
            for i in range(b - a):
                words = raw[off[i] : off[i + 1]].split()
                if lost[i]:
                    words = compress(words, (~gone[run.first[i] : run.first[i + 1]]).tolist())
                kept.append(b" ".join(words).decode())
            n_words += n.tolist()
            n_removed += lost.tolist()
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    # all passes read all columns, so that they have one exchange in common
    first = answers(dealt.mapInArrow(ask, REQUESTS), parts, 1)
    second = answers(dealt.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(extend, REQUESTS), parts, 2)
    return dealt.groupBy("chunk").cogroup(second.groupBy("chunk")).applyInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), spot AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM spot
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT DISTINCT doc_id, i + k AS p FROM dup, range(35) AS t(k)
), word AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM word ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
