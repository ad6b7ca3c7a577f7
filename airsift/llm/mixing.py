"""Mixing sources to target weights: capped water-filling and seeded repetitions.

DataFrame operations only. Sources share the size of the corpus by weight; none may exceed
`max_epochs` times its own size, and what a source cannot take is shared again by weight.
A source whose target is r times its size gives every document floor(r) times, and once more
the documents that come first in a seeded order, until the target is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airsift.llm.common import WORD_PATTERN, stored, work_folder
from airsift.operators.positions import group_ranks, ranged

WEIGHTS = (1, 2, 3)


def word_count(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def seeded_key(doc_id: str, text: str, seed: int) -> Column:
    """Where a document stands in the seeded order: 64 hexadecimal digits, first of its id,
    then of its text. Rows of one key are equal in both."""
    name = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
    said = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return F.concat(
        F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), F.md5(said.cast("binary"))
    )


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3
) -> DataFrame:
    """Water-filling over (source, source_size): adds `weight` and `target`.

    Sources in code point order, null last, weigh as `weights`, repeating. Filling sorts
    sources by cap per weight: those whose cap lies under the common level are clamped, and
    the level is what is left of the total by what is left of the weights. The table has one
    row per source, the only rows that meet in one task.
    """
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*map(F.lit, weights)), (F.row_number().over(in_order) - 1) % len(weights) + 1
    )
    caps = sizes.select(
        "source", "source_size", weight.cast("bigint").alias("weight")
    ).withColumn("cap", F.col("source_size") * max_epochs)
    by_level = W.orderBy(
        F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()
    )
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, W.unboundedFollowing)
    everything = by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left.cast("double") / F.sum("weight").over(after)
    levels = caps.withColumn("level", level).withColumn(
        "clamped", F.col("cap") <= F.col("level") * F.col("weight")
    )
    # Past the first source that is not clamped the running levels only fall.
    common = F.max(F.when(~F.col("clamped"), F.col("level"))).over(
        W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(
        common * F.col("weight")
    )
    return levels.select("source", "source_size", "weight", target.alias("target"))


def source_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = 3,
    seed: int = 17,
    digits: int = 3,
) -> DataFrame:
    """One row per source: size, target, whole repetitions and how far the extra one goes: to
    `last_key`, and of the rows of `edge_key` to `edge_rows`.

    `docs` has (source, size, key). The running sum in key order is taken in two steps, so
    that a source of any size is spread over 16**digits ranges of keys: sums per range, and
    a running sum inside the one range where the target falls. Of the rows of the key where
    it falls, all of one size, as many are taken as come nearest to it. Where that is all or
    none of them, `edge_key` is null.
    """
    rank = F.substring("key", 1, digits)
    ranges = (
        docs.groupBy("source", rank.alias("range"))
        .agg(F.sum("size").alias("range_size"))
    )
    ranges = stored(ranges, "mix-ranges")
    sizes = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    # A target within half a word of a multiple counts as that multiple.
    repeats = F.when(
        F.col("source_size") > 0, F.floor((F.col("target") + 0.5) / F.col("source_size"))
    )
    plan = source_targets(sizes, weights, max_epochs).withColumn(
        "whole", F.coalesce(repeats, F.lit(0)).cast("bigint")
    )
    need = F.col("target") - F.col("whole") * F.col("source_size")
    plan = plan.withColumn("need", F.greatest(need, F.lit(0.0)))
    plan = stored(plan, "mix-plan")
    keyed = plan.withColumnRenamed("source", "_source")
    running = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    begun = ranges.withColumn("begun", F.coalesce(F.sum("range_size").over(running), F.lit(0)))
    open_range = begun.join(keyed, F.col("source").eqNullSafe(F.col("_source"))).where(
        (F.col("begun") <= F.col("need")) & (F.col("begun") + F.col("range_size") > F.col("need"))
    )
    open_range = open_range.select("_source", "range", "begun", "need")
    inside = (
        docs.join(
            open_range,
            F.col("source").eqNullSafe(F.col("_source")) & (rank == F.col("range")),
        )
        .groupBy("source", "range", "begun", "need", "key")
        .agg(F.sum("size").alias("key_size"), F.count("*").alias("n"))
    )
    so_far = W.partitionBy("source", "range").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("begun") + F.coalesce(F.sum("key_size").over(so_far), F.lit(0))
    rows = F.try_divide(F.col("need") - F.col("before"), F.col("key_size") / F.col("n"))
    fitting = F.ceil(rows - 0.5)
    taken = F.when(F.col("before") + F.col("key_size") <= F.col("need"), F.col("n")).when(
        F.col("before") <= F.col("need"), F.least(fitting.cast("bigint"), F.col("n"))
    )
    cut = inside.withColumn("before", before).withColumn("taken", taken).groupBy("source").agg(
        F.max(F.when(F.col("taken") == F.col("n"), F.col("key"))).alias("last_key"),
        F.max(F.when(F.col("taken").between(1, F.col("n") - 1), F.struct("key", "taken"))).alias("edge"),
    )
    cut = cut.withColumnRenamed("source", "_taken")
    # Without a key that fits whole inside the open range, the extra repetition ends before it.
    first = open_range.select(F.col("_source").alias("_open"), F.col("range").alias("open_range"))
    return (
        plan.join(first, F.col("source").eqNullSafe(F.col("_open")), "left")
        .join(cut, F.col("source").eqNullSafe(F.col("_taken")), "left")
        .select(
            "source",
            "source_size",
            "weight",
            "target",
            "whole",
            F.coalesce("last_key", "open_range", F.lit("")).alias("last_key"),
            F.col("edge.key").alias("edge_key"),
            F.col("edge.taken").alias("edge_rows"),
        )
    )


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = 3,
    seed: int = 17,
) -> DataFrame:
    """Add size, source_size, target, copies and taken (copies times size) to every row.

    A null text has size 0; a null source is a source of its own, last in order; a null id
    sorts as empty text. Other texts of one id, and rows that repeat id and text, are taken
    one by one; which of equal rows are does not show in id, text and source. A source without
    words has target 0. An empty table gives an empty table. An input column with the name of
    a result column is replaced. Order and result follow from ids, texts and `seed` alone, so a
    rerun agrees. Texts are read once for their sizes and never shuffled, but for the rows of a
    key that the target divides: those are numbered in a table of their own. The plan is one
    row per source, stored before it is joined, so Spark broadcasts it where its size allows.
    """
    result = ["size", "source_size", "target", "copies", "taken"]
    key = seeded_key(doc_id, text, seed)
    small = docs.select(
        F.col(f"`{source}`").alias("source"), word_count(text).alias("size"), key.alias("key")
    )
    small = stored(small, "mix-sizes")
    plan = stored(source_plan(small, weights, max_epochs, seed), "mix-sources")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in result]
    wide = docs.select(
        F.struct(*kept, F.lit(True).alias("_")).alias("row"),
        F.col(f"`{source}`").alias("_source"),
        word_count(text).alias("size"),
        key.alias("key"),
    )
    planned = wide.join(plan, F.col("_source").eqNullSafe(F.col("source")), "inner")
    extra = (F.col("key") <= F.col("last_key")).cast("bigint")
    divided = F.coalesce(F.col("key") == F.col("edge_key"), F.lit(False))
    mixed = planned.withColumn("extra", extra)
    if not plan.where("edge_key IS NOT NULL").isEmpty():
        place = F.monotonically_increasing_id()
        edges = stored(planned.where(divided).withColumn("place", place), "mix-edges")
        order = [F.col("source"), F.col("place")]
        numbered = ranged(edges, order, work_folder(docs.sparkSession, "mix-numbered"))
        taken = group_ranks(numbered, ["source"], "turn")
        taken = taken.withColumn("extra", (F.col("turn") <= F.col("edge_rows")).cast("bigint"))
        mixed = mixed.where(~divided).unionByName(taken.drop("place", "turn"))
    copies = F.col("whole") + F.col("extra")
    return mixed.select(
        *[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in result],
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """Every document as often as the mix takes it."""
    times = F.sequence(F.lit(1).cast("bigint"), F.col("copies"))
    return (
        mixed.where("copies > 0")
        .withColumn("_copy", F.explode(times))
        .drop("_copy")
    )
