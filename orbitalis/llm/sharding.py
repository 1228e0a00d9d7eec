"""Uniform shuffle into shards of exact size through a communication matrix.

Rows lie in source partitions.  Each partition permutes its rows locally (a sort
by a random number within the partition, no exchange) and is written so.  How
many rows of each partition go to each shard is drawn, exactly, from the
multivariate hypergeometric law that a uniform shuffle of all rows would give;
its row sums are the partitions' sizes and its column sums the shards' sizes.
A partition's first rows go to shard 0, the next to shard 1 and so on, and each
shard permutes what it has received.  All steps on rows are DataFrame
expressions; the driver sees one number for each source partition.

A shard's second permutation ranks rows by a random key.  The rank is computed
in buckets of the key's range and added up, so no task holds a whole shard.

Edge cases: a null text has 0 bytes and the checksum of an empty text; repeated
rows are rows of their own; null and equal keys are dealt like others; an empty
table gives no rows; all columns of the input are kept, so select what is to be
exchanged first; columns named shard or slot are an error.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitalis.llm.storage import materialize


def shard_sizes(total: int, shards: int) -> np.ndarray:
    """Sizes that differ by one row at most."""
    return np.array([total // shards + (i < total % shards) for i in range(shards)], np.int64)


#: The library's own generator is limited to this many rows.
_LIBRARY_ROWS = 1_000_000_000


def _stirling_error(n: int) -> float:
    """log(n!) less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def _deviance(x: float, np_: float) -> float:
    """x log(x / np) + np - x without cancellation."""
    if abs(x - np_) < 0.1 * (x + np_):
        v = (x - np_) / (x + np_)
        total, term, j = (x - np_) * v, 2 * x * v, 1
        while True:
            term *= v * v
            more = total + term / (2 * j + 1)
            if more == total:
                return total
            total, j = more, j + 1
    return x * math.log(x / np_) + np_ - x


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """log of the binomial probability, by saddle-point expansion."""
    if x == 0:
        return -_deviance(n, n * q) - n * p if p < 0.1 else n * math.log(q) if n else 0.0
    if x == n:
        return -_deviance(n, n * p) - n * q if q < 0.1 else n * math.log(p)
    c = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return c + 0.5 * (math.log(n) - math.log(2 * math.pi) - math.log(x) - math.log(n - x))


def large_hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of `sample` rows drawn from good + bad are good, for any size.

    Ratio of uniforms with a table mountain hat over the exact probabilities,
    which stay accurate to a few parts in 10^12 at 10^12 rows, where
    differences of log-gamma values don't.
    """
    total = good + bad
    if 2 * sample > total:
        return good - large_hypergeometric(rng, good, bad, total - sample)
    if 2 * good > total:
        return sample - large_hypergeometric(rng, bad, good, sample)
    if not good or not sample:
        return 0
    p, q = sample / total, (total - sample) / total

    def log_p(x: int) -> float:
        return _log_binomial(x, good, p, q) + _log_binomial(sample - x, bad, p, q)

    mode = (sample + 1) * (good + 1) // (total + 2)
    top = log_p(mode)
    middle = sample * good / total + 0.5
    spread = math.sqrt((total - sample) * sample * good * bad / total / total / max(total - 1, 1) + 0.5)
    width, d = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)
    h = width * spread + d
    while True:
        u, v = rng.random(), rng.random()
        if not u:
            continue
        x = math.floor(middle + h * (v - 0.5) / u)
        if 0 <= x <= min(good, sample) and 2 * math.log(u) <= log_p(x) - top:
            return x


def _draw(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    if good + bad < _LIBRARY_ROWS:
        return int(rng.hypergeometric(good, bad, sample)) if sample else 0
    return large_hypergeometric(rng, good, bad, sample)


def communication_matrix(sources: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Rows from each source to each shard, as a uniform shuffle would deal them."""
    rng = np.random.default_rng(seed)
    left, out = [int(x) for x in sizes], np.zeros((len(sources), len(sizes)), np.int64)
    for i, n in enumerate(sources):
        rest, other = int(n), sum(left)
        for j in range(len(left) - 1):  # one shard after another: a hypergeometric draw each
            other -= left[j]
            out[i, j] = _draw(rng, left[j], other, rest)
            rest -= int(out[i, j])
        out[i, -1] = rest
        left = [x - int(k) for x, k in zip(left, out[i], strict=True)]
    return out


_IN_PARTITION = (1 << 33) - 1  # the part of a monotonically increasing id that counts within a partition


def shuffle_into_shards(df: DataFrame, shards: int = 8, seed: int = 7, rows_per_bucket: int = 20_000) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (from 0, without gaps, in each shard).

    df should be narrow: it is written once, each partition in its random order,
    so that partitions and order stay the same if later tasks are repeated.
    """
    if taken := {"shard", "slot"} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns that the result adds: {sorted(taken)}")
    names = df.columns
    fixed = df.select(F.struct(*(df[f"`{c}`"] for c in names)).alias("row"), F.rand(seed).alias("u")).sortWithinPartitions("u")
    fixed = fixed.select("row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    fixed = materialize(fixed.withColumn("rank", F.col("at").bitwiseAND(F.lit(_IN_PARTITION))), "rows")
    sources = dict(fixed.groupBy("part").count().collect())  # one number for each partition
    parts = sorted(sources)
    total = sum(sources.values())
    matrix = communication_matrix([sources[p] for p in parts], shard_sizes(total, shards), seed)
    bounds = df.sparkSession.createDataFrame([(int(p), [int(x) for x in np.cumsum(row)[:-1]]) for p, row in zip(parts, matrix, strict=True)], "part int, bounds array<long>")
    past = (F.when(F.col("rank") >= F.get("bounds", F.lit(j)), 1).otherwise(0) for j in range(shards - 1))
    dealt = fixed.join(F.broadcast(bounds), "part").select("row", "at", sum(past, F.lit(0)).cast("int").alias("shard"))  # a few numbers for each source partition
    buckets = max(1, -(-total // (shards * rows_per_bucket)))
    order = F.xxhash64(F.lit(seed + 1), F.col("at"))
    keyed = dealt.withColumn("order", order).withColumn("bucket", F.pmod(F.shiftright("order", 20), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("shard", "bucket").count()
    before = sizes.select("shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("before"))
    inside = Window.partitionBy("shard", "bucket").orderBy("order", "at")
    placed = keyed.withColumn("n", F.row_number().over(inside).cast("long") - 1).join(before, ["shard", "bucket"])
    return placed.select("row.*", "shard", (F.col("n") + F.col("before")).alias("slot"))


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1) and text_crc32 of each document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
