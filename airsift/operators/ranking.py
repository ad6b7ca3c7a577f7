"""Ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airsift.operators.positions import group_ranks, ranged
from airsift.plans.workspace import new_work_folder

_GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of every group with their rank (INT, from 1).

    Up to the length at which Spark limits groups before the shuffle (1,000 unless the
    session says otherwise), a hot group sends k rows per task, whatever its size. Longer
    lists are cut from the ranks of all rows, and `order` should tell the rows of a group
    apart.
    """
    if k > int(df.sparkSession.conf.get(_GROUP_LIMIT, "1000")):
        ranked = ranks(df, group, order)
        return ranked.where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("int"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= max(k, 0))


def ranks(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Add `rank` (BIGINT, from 1) by `order` in the group, for every row.

    `order` must tell the rows of a group apart. The rows are read once and shuffled once,
    into ranges of (group, order); a group of any size goes on over as many tasks as it fills.
    """
    folder = new_work_folder(df.sparkSession)
    return group_ranks(ranged(df, [*[F.col(c) for c in group], *order], folder), group)


def exact_rank(
    df: DataFrame, group: list[str], count: str, order: str, tie: str
) -> DataFrame:
    """Add `rank` (BIGINT, from 1) by `count` descending, `order`, `tie`, for every row."""
    return ranks(df, group, [F.desc(count), F.asc(order), F.asc(tie)])
