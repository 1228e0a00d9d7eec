"""Partitioning by key: histograms, splitters, refinement, tiles and slices."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitalis.functions import keys
from orbitalis.operators.ranking import ranked
from orbitalis.operators.scratch import cut


def key_histogram(bodies: DataFrame, bits: int) -> DataFrame:
    """bucket (the key's top bits) and cnt; empty buckets are left out."""
    return bodies.groupBy(F.shiftright("key", keys.KEY_BITS - bits).alias("bucket")).agg(F.count("*").alias("cnt"))


def splitters(histogram: DataFrame, parts: int) -> list[int]:
    """The last bucket of each part but the last: part k closes with the bucket at
    which the running count reaches (k + 1) ceil(N / parts); a bucket closes one
    part at most.  The histogram has at most 2 ** bits rows."""
    rows = sorted((r["bucket"], r["cnt"]) for r in histogram.collect())
    each = math.ceil(sum(c for _, c in rows) / parts) if rows else 0
    out, total = [], 0
    for bucket, cnt in rows:
        total += cnt
        if len(out) < parts - 1 and total >= (len(out) + 1) * each:
            out.append(bucket)
    return out


def assign_parts(histogram: DataFrame, cuts: list[int]) -> DataFrame:
    """bucket, cnt and part: the number of splitters below the bucket."""
    below = F.lit(sorted(cuts)).cast("array<long>")  # one list, whatever the number of parts
    return histogram.withColumn("part", F.size(F.filter(below, lambda c: c < F.col("bucket"))))


def balance(parted: DataFrame, parts: int, part: str = "part") -> DataFrame:
    """One row on how evenly rows lie in parts 0 to parts - 1: n, parts, empty, least,
    most, mean and ratio (most / mean)."""
    sizes = parted.groupBy(part).agg(F.count("*").alias("k"))
    full = parted.sparkSession.range(parts).join(sizes, F.col("id") == F.col(part), "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    total, most = F.sum("k"), F.max("k")
    return full.agg(
        total.alias("n"), F.count("*").alias("parts"), F.sum(F.when(F.col("k") == 0, 1).otherwise(0)).alias("empty"), F.min("k").alias("least"), most.alias("most"),
        (total / parts).alias("mean"), F.when(total > 0, most * parts / total).otherwise(0.0).alias("ratio"),
    )


def where_it_runs(df: DataFrame) -> DataFrame:
    """partition, host, process and rows of each task that reads df: a look at how
    work is dealt out, for diagnosis."""
    import os
    import socket

    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_pydict({"partition": pa.array([TaskContext.get().partitionId()], pa.int32()), "host": [socket.gethostname()], "process": pa.array([os.getpid()], pa.int64()), "n": pa.array([n], pa.int64())})

    return df.mapInArrow(run, "partition int, host string, process long, n long")


def heaviest(counts: DataFrame, k: int, count: str = "n", by: tuple[str, ...] = ("depth", "prefix")) -> DataFrame:
    """The k heaviest rows; ties go to the smaller cell."""
    return counts.orderBy(F.desc(count), *by).limit(k)


def refine_bins(bodies: DataFrame, most: float, budget: int, digit: int = 1, depth: int = 63) -> list[tuple[int, int, int]]:
    """(depth, prefix, n) of bins that split, level by level, the most populous
    first, while they hold more than `most` bodies and fewer than `budget` bins
    exist.  Bodies are counted by key once; a round counts the keys of bins that
    split, found by a semi-join, at some levels at once (see _counted), and keeps only
    these for the next.  The driver sees `budget` rows of a round at most, or those of one level."""
    left = cut(bodies.groupBy("key").agg(F.count("*").alias("n")))
    n = left.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    done: list[tuple[int, int, int]] = []
    active = [(0, 0, n)] if n else []
    known, stubborn, below = 0, 0, {}  # the children of bins down to this level
    for level in range(depth):
        heavy = sorted((b for b in active if b[2] > most), key=lambda b: (-b[2], b[1]))
        room = budget - len(done) - len(active)
        split = {b[1]: b[2] for b in heavy[: max(0, room) // ((1 << digit) - 1)]}
        done += [b for b in active if b[1] not in split]
        if not split:
            return sorted(done)
        if level == known:
            usual = sum(split.values()) / len(split)
            enough = 1 + math.ceil(math.log2(max(usual / max(most, 1), 2)))  # levels until an even bin has been split enough
            step, stubborn = min(9, max(enough, stubborn)) // digit, stubborn + 3  # bins that are still left are few
            left, known, rows = _counted(left, sorted(split), level, min(max(1, step), depth - level), most, budget, digit)
            below = {}
            for d, prefix, k in rows:
                below.setdefault((d, prefix >> digit), []).append((d, prefix, k))
        active = [b for p in split for b in below[level + 1, p]]
    return sorted(done + active)


def _counted(left: DataFrame, split: list[int], level: int, step: int, most: float, budget: int, digit: int) -> tuple[DataFrame, int, list]:
    """The keys (key, n) of the bins `split` of a level, the level down to which they
    were counted, and (depth, prefix, n) of bins below them whose parents hold more than
    `most` bodies.  Keys are summed at the lowest of `step` levels, and these sums
    up to those above; the levels shrink to one if that gives more than `budget` rows."""
    if level:
        bins = left.sparkSession.createDataFrame([(b,) for b in split], "_bin long")
        left = cut(left.join(F.broadcast(bins), keys.prefix_at(F.col("key"), level, digit) == F.col("_bin"), "left_semi"))
    while True:
        last = level + step
        low = cut(left.groupBy(keys.prefix_at(F.col("key"), last, digit).alias("prefix")).agg(F.sum("n").alias("n")))
        up = F.call_function("shiftright", "prefix", ((last - F.col("depth")) * digit).cast("int"))
        nested = low.withColumn("depth", F.explode(F.sequence(F.lit(level + 1), F.lit(last)))).withColumn("prefix", up)
        every = cut(nested.groupBy("depth", "prefix").agg(F.sum("n").alias("n"))) if step > 1 else nested.select("depth", "prefix", "n")
        first = F.col("depth") == level + 1
        crowded = every.where(F.col("n") > most).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_up"))
        kept = every.where(~first).withColumn("_up", keys.parent(F.col("prefix"), digit)).join(crowded, ["depth", "_up"], "left_semi")
        found = cut(every.where(first).unionByName(kept.select("depth", "prefix", "n"))) if step > 1 else every
        if step == 1 or found.count() <= budget:
            return left, last, [tuple(r) for r in found.select("depth", "prefix", "n").collect()]
        step = max(1, step // 2)


def tiles(bodies: DataFrame, k: int) -> DataFrame:
    """Near-equal runs of the key order: tile and its size (sizes differ by one at most)."""
    placed = ranked(bodies.select("key", "id"), "_rank", "key", "id")
    small, more = divmod(bodies.count(), k)
    rank, large = F.col("_rank"), more * (small + 1)
    tile = F.when(rank < large, F.floor(rank / (small + 1))).otherwise(F.floor((rank - large) / max(small, 1)) + more)
    return placed.groupBy((tile + 1).cast("int").alias("tile")).agg(F.count("*").alias("n"))


def slice_starts(n: int, parts: int, grain: int) -> list[int]:
    """Where each of `parts` slices of n rows starts, at multiples of the grain."""
    return [s * n // (parts * grain) * grain for s in range(parts)]


def by_owner(bodies: DataFrame, parts: int) -> DataFrame:
    """Bodies moved to the owners of their key ranges."""
    return bodies.repartitionByRange(parts, "key")


def frontier(cells: DataFrame, budget: int, digit: int = 3) -> DataFrame:
    """depth, prefix, n: from the root, the most populous cell (of equal ones the smaller
    key) gives way to its children while at most `budget` cells stand.  A cell has no more
    bodies than its parent, so cells give way in the order of their numbers, and those
    that do are a run of that order in which the cells standing never exceed the budget.
    The budget's most populous inner cells are all that can be needed: `budget` rows
    are broadcast and summed in one task."""
    inner = cells.where("not is_leaf").orderBy(F.desc("n"), "depth", "prefix").limit(budget).select(F.col("depth").alias("_d"), F.col("prefix").alias("_p"), F.col("n").alias("_n"))
    child = cells.where("depth > 0").select("depth", "prefix", "n", (F.col("depth") - 1).alias("_d"), keys.parent(F.col("prefix"), digit).alias("_p"))
    below = child.join(F.broadcast(inner), ["_d", "_p"])
    stand = 1 + F.sum(F.col("_kids") - 1).over(Window.orderBy(F.desc("_n"), "_d", "_p").rowsBetween(Window.unboundedPreceding, 0))
    opened = below.groupBy("_d", "_p", "_n").agg(F.count("*").alias("_kids")).select("_d", "_p", stand.alias("_stand")).where(F.col("_stand") <= budget).select("_d", "_p")
    met = cells.where("depth = 0").select("depth", "prefix", "n").union(below.join(F.broadcast(opened), ["_d", "_p"]).select("depth", "prefix", "n"))
    return met.join(F.broadcast(opened), (F.col("depth") == F.col("_d")) & (F.col("prefix") == F.col("_p")), "left_anti")


def frontier_cells(cells: DataFrame, budget: int, digit: int = 3) -> list[tuple[int, int, int]]:
    """The rows of frontier(), at most `budget`, in order."""
    return sorted(tuple(r) for r in frontier(cells, budget, digit).collect())
