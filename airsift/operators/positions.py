"""Places in a total order, for any number of rows.

A window over one large group would put it into one task. Here rows are dealt into ranges of
the order, sorted and numbered inside their range, and written once. What is left are prefix
sums over the ranges, of which there are as many as shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airsift.plans.workspace import written

# monotonically_increasing_id(): the partition above, the row in it below.
_ROW_BITS = 33


def ranged(df: DataFrame, order: list[Column], folder: str) -> DataFrame:
    """`df` written in ranges of `order`, with `_part` (BIGINT, the range) and `_row` (BIGINT,
    the place in it, from 0).

    `order` must tell all rows apart, else equal rows stay in one range. Rows are shuffled
    once; the ranges are fixed by the written table, whatever is lost later.
    """
    number = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("_row", number).select(
        "*", F.shiftright("_row", _ROW_BITS).alias("_part")
    )
    mask = (1 << _ROW_BITS) - 1
    return written(rows.withColumn("_row", F.col("_row").bitwiseAND(F.lit(mask))), folder)


def _before(counts: DataFrame, keys: list[str], n: str, into: str) -> DataFrame:
    """Sum of `n` over the earlier ranges of a group: one row per range and group that meet."""
    window = Window.partitionBy(*keys).orderBy("_part")
    return counts.withColumn(into, F.sum(n).over(window) - F.col(n))


def positions(rows: DataFrame, into: str = "position") -> DataFrame:
    """The place of every row of a `ranged` table, from 1."""
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = _before(counts, [], "_n", "_offset").drop("_n")
    # One row per range: as many as there were shuffle partitions.
    placed = rows.join(F.broadcast(offsets), "_part")
    return placed.withColumn(into, F.col("_offset") + F.col("_row") + 1).drop(
        "_part", "_row", "_offset"
    )


def group_ranks(rows: DataFrame, group: list[str], into: str = "rank") -> DataFrame:
    """The place of every row in its group, from 1, of a table `ranged` by `group` first.

    A group that begins in one range and goes on in others is counted once per range, so a
    group of any size is as many rows here as it has ranges.
    """
    met = rows.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    starts = _before(met, group, "_n", "_offset").select(
        F.col("_part").alias("_at"),
        F.expr("_offset - _first + 1").alias("_shift"),
        *[F.col(c).alias(f"_group_{i}") for i, c in enumerate(group)],
    )
    same = F.col("_part") == F.col("_at")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_group_{i}"))
    placed = rows.join(starts, same).withColumn(into, F.col("_row") + F.col("_shift"))
    return placed.drop("_part", "_row", "_at", "_shift", *[f"_group_{i}" for i in range(len(group))])
