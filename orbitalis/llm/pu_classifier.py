"""Quality classifier by positive-unlabelled learning.

Trusted positives are the labelled good documents among those given for
training; unlabelled text is every document of the table.  With class prior p,
the risk of a linear score f under the logistic loss is

    p E_pos[l(f)] + max(0, E_all[l(-f)] - p E_pos[l(-f)])

(the non-negative estimator).  As l(f) - l(-f) = -f, the unclipped risk is
convex.  So is the risk with the second part left out (p E_pos[l(f)]), and the
estimator is the larger of the two: a convex function, whose minimum lies in the
one's domain, in the other's, or on the border where the second part is 0.  There
it is the minimum of a mixture of both, p E_pos[l(f)] + m (E_all[l(-f)] - p E_pos[l(-f)])
with a multiplier m between 0 and 1.  Newton steps minimise the mixture for one m,
from m = 1; if the second part is negative there, m is found by safeguarded
Newton steps on that part as a function of m.  Each pass is one distributed sum
of gradients and curvatures over a narrow feature table that is written once;
partitions' sums are added in a fixed order, so equal inputs give equal scores.

The prior comes from positives and unlabelled rows only; no label 0 is used for
anything.  A first fit on half of the positives, with a prior of 0.5, ranks all rows and the other half.  If among the best
rows, down to any score, there are no bad ones, the share of all rows there is p
times the share of positives there; with bad ones it is more.  So the least ratio
of these shares over thresholds, of those that a third of the positives reach,
is the estimate, less one standard error of the positives' share.  Too small a prior
moves the threshold little, too large a one puts bad rows above it, so the
estimate should err downwards, and does, the more the fewer positives there are
(README has figures).

Features are hashed n-grams (shares of words in WORD_BUCKETS and of byte trigrams
in BYTE_BUCKETS buckets) and numbers on form: length, shares of symbols,
capitals, repeated words, repeated trigrams, stuttering words and the like, over
the whole text.  N-grams have a stronger ridge.  Labels, language, source and id
are never features.

Edge cases: a null or empty text has the features of no words and a score; a
document that is labelled more than once counts as positive only if all its
training labels are 1; null labels are no labels; without any positive, all
scores are 0.5; a fit that `passes` passes don't complete is an error that says so; repeated rows are scored each; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitalis.llm import textkernel as tk
from orbitalis.llm.storage import map_rows, materialize

#: Classes of bytes: 1 capital, 2 other letter, 3 markup symbol, 4 digit, 5 punctuation.
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[192:] = 2
_CLASS[list(b"#*$%&|<>")] = 3
_CLASS[ord("0") : ord("9") + 1] = 4
_CLASS[list(b"!?.,;:\"'")] = 5

RAW = 11
WORD_BUCKETS, BYTE_BUCKETS = 64, 128
GRAMS = WORD_BUCKETS + BYTE_BUCKETS
FORM = 32
FEATURES = FORM + GRAMS


def _running(mask: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))


def raw_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """RAW numbers for each text of a run."""
    n_docs = len(off) - 1
    words = tk.Words(data, off)
    h, first = words.hashes(), words.first
    doc, n = tk.spread(first), np.diff(first)
    kinds = _CLASS[data]
    totals = [_running(kinds == k) for k in range(1, 6)]
    capital, letter, symbol, digit, point = (t[off[1:]] - t[off[:-1]] for t in totals)

    def inside(t: np.ndarray) -> np.ndarray:
        return t[words.end] - t[words.start]

    def per_doc(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=x, minlength=n_docs)

    def distinct(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        salted = tk.mix(keys ^ tk.mix(of.astype(np.uint64) + np.uint64(1)))
        return np.bincount(of[np.unique(salted, return_index=True)[1]], minlength=n_docs)

    stutter = np.zeros(len(h), bool)
    stutter[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    tri = tk.windows(h, 3)
    own = doc[: len(tri)]
    whole = own == doc[2:] if len(tri) else np.zeros(0, bool)
    shouted = (inside(totals[0]) > 1) & (inside(totals[1]) == 0)
    some, size = np.maximum(n, 1), np.maximum(np.diff(off), 1)
    return np.stack(
        [
            np.log1p(n) / 10,
            10 * symbol / size,
            capital / np.maximum(capital + letter, 1),
            per_doc(inside(totals[2]) > 0) / some,
            per_doc(shouted) / some,
            np.where(n > 0, 1 - distinct(h, doc) / some, 0),
            np.where(n > 2, 1 - distinct(tri[whole], own[whole]) / np.maximum(n - 2, 1), 0),
            per_doc(stutter) / some,
            per_doc(words.end - words.start) / some / 10,
            10 * point / size,
            10 * digit / size,
        ],
        1,
    )


def gram_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """GRAMS bytes for each text of a run: 255 times the roots of the n-grams' shares."""
    n_docs, words = len(off) - 1, tk.Words(data, off)
    word = (words.hashes(fold=True) >> np.uint64(58)).astype(np.int64)
    counts = np.bincount(tk.spread(words.first) * WORD_BUCKETS + word, minlength=n_docs * WORD_BUCKETS).reshape(n_docs, -1)
    x = data.astype(np.uint32)
    tri = (x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))) * np.uint32(0x9E3779B1) >> np.uint32(25) if len(x) > 2 else np.zeros(0, np.uint32)
    doc = np.repeat(np.arange(n_docs), np.diff(off))[: len(tri)]
    whole = np.arange(len(tri)) + 2 < off[1:][doc]
    byte = np.bincount(doc[whole] * BYTE_BUCKETS + tri[whole], minlength=n_docs * BYTE_BUCKETS).reshape(n_docs, -1)
    share = [c / np.maximum(c.sum(1, keepdims=True), 1) for c in (counts, byte)]
    return np.round(255 * np.sqrt(np.concatenate(share, 1))).astype(np.uint8)


def expand(raw: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """FEATURES bounded columns: a constant, the raw ones, their roots and a few steps, and the n-grams."""
    x = np.clip(raw, 0, 1.5)
    return np.concatenate([np.ones((len(x), 1)), x, np.sqrt(x[:, 1:]), x[:, [1, 3, 4, 6, 7]] > 0.02, x[:, [2, 6, 7, 4, 3]] > 0.15, grams / 255.0], 1)


def _features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, raw and n-gram features of runs of texts."""
    data, off = tk.text_bytes(texts)
    for a, b in tk.runs(off):
        d, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
        yield a, b, raw_features(d, o).astype(np.float32), gram_features(d, o)


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its features (floats, and a byte for each n-gram bucket), written once."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, grams in _features(batch.column(1)):
                flat = pa.FixedSizeListArray.from_arrays(pa.array(raw.ravel()), RAW).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), flat, pa.array([x.tobytes() for x in grams], pa.binary())], names=["doc_id", "raw", "grams"])
            tk.release()

    return materialize(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, raw array<float>, grams binary"), "features")


def _matrix(raw: pa.Array, grams: pa.Array) -> np.ndarray:
    return expand(raw.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, RAW), np.frombuffer(b"".join(grams.to_pylist()), np.uint8).reshape(-1, GRAMS))


_BATCH = 2000  # rows expanded at a time


def _added(partial: DataFrame, files: int, size: int) -> np.ndarray:
    """The sum of all partitions' sums (part, x), in the order of the partitions."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if rows:
            total = np.zeros(size)
            for _, x in rows:
                total += np.frombuffer(x)
            yield pa.RecordBatch.from_pydict({"part": pa.array([rows[0][0]], pa.int32()), "x": pa.array([total.tobytes()], pa.binary())})

    groups = max(1, math.isqrt(files))  # each adds as many sums as the driver then does
    out = np.zeros(size)
    for _, x in sorted(partial.repartitionById(groups, F.col("part") % groups).mapInArrow(add, "part int, x binary").collect()):
        out += np.frombuffer(x)
    return out


def _partial(acc: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "x": pa.array([acc.tobytes()], pa.binary())})


class Risk:
    """Sums over a table of (raw, grams, positive) rows for weights w."""

    def __init__(self, table: DataFrame):
        self.columns = table.select("raw", "grams", "positive")
        self.files = table.rdd.getNumPartitions()
        self.passes = 0

    def sums(self, w: np.ndarray) -> tuple[float, ...]:
        """Over all rows and over the positives: their number, mean loss of the
        negative label, its gradient, mean features and curvature."""
        d = len(w)
        size = 2 * (2 + 2 * d + d * d)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((2, size // 2))
            for whole in batches:
                for at in range(0, whole.num_rows, _BATCH):
                    batch = whole.slice(at, _BATCH)
                    z, pos = _matrix(batch.column(0), batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
                    f = z @ w
                    s, soft = 1 / (1 + np.exp(-f)), np.logaddexp(0, f)
                    for a, k in zip(acc, (slice(None), pos), strict=True):
                        x, t = z[k], s[k]
                        if len(x):
                            a[:2] += len(x), soft[k].sum()
                            a[2 : 2 + d] += t @ x
                            a[2 + d : 2 + 2 * d] += x.sum(0)
                            a[2 + 2 * d :] += (x.T @ (x * (t * (1 - t))[:, None])).ravel()
            yield _partial(acc.ravel())

        self.passes += 1
        out = _added(self.columns.mapInArrow(run, "part int, x binary"), self.files, size).reshape(2, -1)
        mean = [a[1:] / max(a[0], 1) for a in out]
        return tuple((a[0], m[0], m[1 : 1 + d], m[1 + d : 1 + 2 * d], m[1 + 2 * d :].reshape(d, d)) for a, m in zip(out, mean, strict=True))


def fit(table: DataFrame, prior: float, ridge: float = 1e-3, gram_ridge: float = 1e-2, tolerance: float = 1e-2, passes: int = 60, start: np.ndarray | None = None) -> np.ndarray:
    """Weights that minimise the non-negative risk over a table of (raw, grams,
    positive) rows; an error if `passes` aren't enough."""
    d, risk = FEATURES, Risk(table)
    ridges = np.concatenate((np.full(FORM, ridge), np.full(GRAMS, gram_ridge)))

    def at(w: np.ndarray, m: float):
        """The mixture at w, its gradient and curvature, the second part and its gradient."""
        if risk.passes >= passes:
            raise ArithmeticError(f"no minimum of the risk within {passes} passes")
        (n, soft, g, _, h), (n_pos, soft_pos, g_pos, x_pos, h_pos) = risk.sums(w)
        if not n or not n_pos:
            return None
        rest, slope = soft - prior * soft_pos, g - prior * g_pos
        value = prior * (soft_pos - x_pos @ w) + m * rest + (ridges * w * w).sum() / 2
        return value, prior * (g_pos - x_pos) + m * slope + ridges * w, prior * (1 - m) * h_pos + m * h + np.diag(ridges), rest, slope

    def least(w: np.ndarray, m: float):
        """The mixture's minimum, the second part there and how that grows with m."""
        now = at(w, m)
        while now is not None:
            step = -np.linalg.solve(now[2], now[1])
            if np.abs(step).max() < tolerance:
                return w, now[3], -now[4] @ np.linalg.solve(now[2], now[4])
            size, found = 1.0, at(w + step, m)
            while found[0] > now[0] + 1e-12:  # too far
                size /= 2
                found = at(w + size * step, m)
            w, now = w + size * step, found
        return None

    first = least(np.zeros(d) if start is None else start, 1.0)
    if first is None:  # nothing to learn from
        return np.zeros(d)
    w, rest, slope = first
    low, high, m, lowest = 0.0, 1.0, 1.0, False
    while abs(rest) > _CLOSE and (rest < 0 if m == 1 else rest > 0 if m == 0 else high - low > 1e-9):
        low, high = (low, m) if rest < 0 else (m, high)
        m = m - rest / slope if slope < 0 else -1.0
        if not low < m < high:
            m, lowest = (0.0, True) if not low and not lowest else ((low + high) / 2, lowest)
        w, rest, slope = least(w, m)
    return w


_CLOSE = 1e-4  # how near to the border counts as on it
_BINS = 1000
START_PRIOR = 0.5


def estimate_prior(table: DataFrame, w: np.ndarray, share: float = 1 / 3) -> float:
    """The prior from the scores of all rows and of positives (see above), with scores
    in _BINS bins."""
    size = 2 * _BINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((2, _BINS))
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(at, _BATCH)
                place = np.minimum((_scores(_matrix(batch.column(0), batch.column(1)), w) * _BINS).astype(np.int64), _BINS - 1)
                acc[0] += np.bincount(place, minlength=_BINS)
                acc[1] += np.bincount(place[batch.column(2).to_numpy(zero_copy_only=False).astype(bool)], minlength=_BINS)
        yield _partial(acc.ravel())

    every, positive = _added(table.select("raw", "grams", "positive").mapInArrow(run, "part int, x binary"), table.rdd.getNumPartitions(), size).reshape(2, -1)
    n, n_pos = every.sum(), positive.sum()
    if not n or not n_pos:
        return START_PRIOR
    a, b = np.cumsum(every[::-1]) / n, np.cumsum(positive[::-1]) / n_pos
    enough = b >= share
    error = np.sqrt(b * (1 - b) / n_pos)
    return float(np.clip((a[enough] / (b + error)[enough]).min(), 0.01, 0.99))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True where crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(table: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights from a feature table; labels (doc_id, quality): only rows of label 1 that
    aren't held out are learned from."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    positive = known.where("quality = 1").select("_id", F.lit(True).alias("positive"))
    marks = F.coalesce("positive", F.lit(False)), F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    marked = materialize(table.join(positive, table.doc_id == positive["_id"], "left").select("raw", "grams", marks[0].alias("positive"), (marks[0] & marks[1]).alias("half")), "training")
    own, others = (marked.select("raw", "grams", x.alias("positive")) for x in (F.col("half"), F.col("positive") & ~F.col("half")))
    first = fit(own, START_PRIOR, tolerance=0.1)
    return fit(marked, estimate_prior(others, first), start=first)


def _scores(raw: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(raw @ w)))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs, after train()."""
    table = feature_table(docs, id_col, text_col)
    w = train(table, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(_matrix(batch.column(1), batch.column(2)), w)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = table.schema["doc_id"].dataType.simpleString()
    scored = table.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def good_rows(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier predicts to be good, each judged by its
    own text: features are computed anew, which spares an exchange of all texts."""
    w, at = train(feature_table(docs, id_col, text_col), labels), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_scores(expand(raw.astype(np.float64), grams), w) >= threshold for _, _, raw, grams in _features(batch.column(at).cast(pa.string()))]
            yield batch.filter(pa.array(np.concatenate(good) if good else [], pa.bool_()))
            tk.release()

    return map_rows(docs, run)
