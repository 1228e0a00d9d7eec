"""Global ranks without a global sort in one task.

Rows are range-partitioned, sorted within partitions and written once with a
row number that holds the partition and the place in it, so that neither changes
if tasks are repeated.  A rank is the place plus the sizes of the partitions
before it; one number for each partition comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitalis.operators.scratch import cut

_PLACE = (1 << 33) - 1  # monotonically_increasing_id: the partition above, the place below


def number_rows(rows: DataFrame, name: str, row: str = "_row") -> DataFrame:
    """Ranks from 0 in the order of `row`, a fresh monotonically_increasing_id."""
    fixed = cut(rows)
    part = F.shiftright(row, 33)
    sizes = dict(fixed.groupBy(part).count().collect())
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    if not before:
        return fixed.drop(row).withColumn(name, F.lit(0).cast("long"))
    base = F.broadcast(rows.sparkSession.createDataFrame(before, "_part long, _before long"))  # a row for each partition
    placed = fixed.withColumn("_part", part).join(base, "_part")
    rank = F.col("_before") + F.col(row).bitwiseAND(F.lit(_PLACE))
    return placed.withColumn("_rank", rank).drop("_part", "_before", row).withColumnRenamed("_rank", name)


def ranked(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with the rank (from 0) of each row in the order of the columns."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return number_rows(ordered.withColumn("_row", F.monotonically_increasing_id()), name)
