"""Approximate nearest neighbours by inner product: multi-probe p-stable hashing.

Vectors are hashed by ranges of norms, and a query looks into each range. In a range vectors
get one more component so that all have the norm of its longest; then the nearest by
distance to a query of that norm is the largest inner product. A table hashes a vector to the
cells of `hashes` Gaussian projections cut at a width. A query looks into its own bucket and
into perturbed ones, in the order of their estimated success: the sum of squared distances
from the query to the cell borders that are crossed. Candidates of all tables are merged and
ranked by exact inner products in double precision.

A query that finds fewer neighbours than there are is compared with all vectors, part by part.

Equal vectors are one class, searched once, of which the smallest ids can appear in results.
A bucket with many vectors or many queries is split into parts of both, and every part of
its vectors meets every part of its queries in some task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airsift.llm.common import column, mix64, stored


@dataclass(frozen=True)
class Tables:
    """`width`: of a cell, in norms of the longest vector of a range. `spread`: longest by
    shortest norm of a range. `probes`: buckets per table and
    query. `part`: vectors of a bucket that one task compares. `asked`: queries of a bucket
    that it compares them with."""

    tables: int = 12
    hashes: int = 8
    width: float = 2.0
    spread: float = 1.25
    probes: int = 80
    part: int = 4000
    asked: int = 16_000
    seed: int = 5

    def projections(self, dims: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([self.seed, dims])
        n = self.tables * self.hashes
        return rng.standard_normal((dims + 1, n)), rng.random(n)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """Place of each vector on each projection, in cells: vectors x tables x hashes.
        Vectors are those of a range, divided by the norm of its longest."""
        a, b = self.projections(vectors.shape[1])
        squares = (vectors * vectors).sum(1)
        rest = np.sqrt(np.maximum(1.0 - squares, 0.0))
        places = np.c_[vectors, rest] @ a / self.width + b
        return places.reshape(len(vectors), self.tables, self.hashes)


def bucket_keys(cells: np.ndarray, dims: int) -> np.ndarray:
    """64-bit names of buckets, from cell numbers (... x tables x hashes)."""
    tables = np.arange(cells.shape[-2], dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(dims)
    key = np.broadcast_to(mix64(tables), cells.shape[:-1])
    with np.errstate(over="ignore"):
        for i in range(cells.shape[-1]):
            cell = np.floor(cells[..., i]).astype(np.int64).view(np.uint64)
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + cell)
    return key


def perturbations(place: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """Sets of (projection, -1 or 1) in ascending order of their squared distances."""
    inside = place - np.floor(place)
    cost = np.concatenate([inside**2, (1 - inside) ** 2])
    order = np.argsort(cost)
    steps = [(int(i) % len(place), -1 if i < len(place) else 1) for i in order]
    cost = cost[order].tolist()
    found: list[list[tuple[int, int]]] = [[]]
    heap = [(cost[0], (0,))]
    while heap and len(found) < probes:
        total, chosen = heapq.heappop(heap)
        moves = [steps[i] for i in chosen]
        if len({p for p, _ in moves}) == len(moves):
            found.append(moves)
        last = chosen[-1]
        if last + 1 < len(cost):
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return found


def _matrix(values: pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros, which add nothing to a product."""
    sizes = pc.list_value_length(values).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values.flatten().to_numpy(zero_copy_only=False)
    return out


def _by_dims(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = pc.list_value_length(column(batch, "vector")).to_numpy(zero_copy_only=False)
    for d in np.unique(dims).tolist():
        yield d, batch.take(pa.array(np.flatnonzero(dims == d)))


def _ranged(keys: np.ndarray, r: int) -> np.ndarray:
    """Names of the same buckets in a range of norms."""
    return mix64(keys + mix64(np.array([r], np.int64).view(np.uint64))[0])


def _unit(vectors: np.ndarray, log_norms: np.ndarray | float) -> np.ndarray:
    """Vectors divided by norms given as logarithms. Components are scaled by the largest one
    first, so that no square leaves the range of a double."""
    most = np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / most * np.exp(np.log(most) - log_norms)


def _log_norms(vectors: np.ndarray) -> np.ndarray:
    most = np.abs(vectors).max(axis=1, keepdims=True)
    return np.log(most) + np.log(((vectors / most) ** 2).sum(axis=1, keepdims=True)) / 2


def _members(classes: DataFrame, tables: Tables, longest: dict[int, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dims, batch in _by_dims(whole):
                vectors = _matrix(column(batch, "vector"))
                ranges = column(batch, "norms").to_numpy()
                keys = np.empty((len(vectors), tables.tables), np.uint64)
                for r in np.unique(ranges).tolist():
                    at = ranges == r
                    places = tables.cells(_unit(vectors[at], longest[r]))
                    keys[at] = _ranged(bucket_keys(places, dims), r)
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "class"), pa.array(keys.view(np.int64).tolist())],
                    names=["class", "buckets"],
                )

    hashed = classes.select("class", "vector", "norms").mapInArrow(run, "class bigint, buckets array<bigint>")
    return hashed.select("class", F.explode("buckets").alias("bucket"))


def _probes(queries: DataFrame, tables: Tables, longest: dict[int, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dims, batch in _by_dims(whole):
                vectors = _matrix(column(batch, "vector"))
                # A query has the norm of the longest vector, and nothing in the last place.
                places = tables.cells(_unit(vectors, _log_norms(vectors)))  # the same in every range
                found = []
                for place in places:
                    keys = []
                    for t in range(tables.tables):
                        moves = perturbations(place[t], tables.probes)
                        cells = np.repeat(np.floor(place[t])[None], len(moves), 0)
                        for i, move in enumerate(moves):
                            for p, step in move:
                                cells[i, p] += step
                        every = np.zeros((len(moves), tables.tables, tables.hashes))
                        every[:, t] = cells
                        keys.append(bucket_keys(every, dims)[:, t])
                    plain = np.concatenate(keys)
                    keys = [_ranged(plain, r) for r in longest]
                    found.append(np.unique(np.concatenate(keys)).view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "class"), pa.array(found, pa.list_(pa.int64()))],
                    names=["class", "buckets"],
                )

    hashed = queries.select("class", "vector").mapInArrow(run, "class bigint, buckets array<bigint>")
    return hashed.select("class", F.explode("buckets").alias("bucket"))


def _defined(products: np.ndarray) -> np.ndarray:
    """Sums of infinities of both signs count as the least product."""
    return np.where(np.isnan(products), -np.inf, products)


def _nearest(grouped, k: int) -> DataFrame:
    """Per task and query class its nearest k classes, as arrays."""

    def run(key, members: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema(
            [
                ("query", pa.int64()),
                ("classes", pa.list_(pa.int64())),
                ("scores", pa.list_(pa.float64())),
            ]
        )
        if not members.num_rows or not queries.num_rows:
            return schema.empty_table()
        # A class can be here in several buckets, a query too.
        ids, first = np.unique(members.column("class").to_numpy(), return_index=True)
        least = members.column("least").to_numpy()[first]
        vectors = _matrix(members.column("vector").combine_chunks().take(pa.array(first)))
        at = np.searchsorted(ids, members.column("class").to_numpy())
        buckets = members.column("bucket").to_numpy()
        order = np.argsort(buckets, kind="stable")
        buckets, at = buckets[order], at[order]
        asked = queries.column("class").to_numpy()
        order = np.argsort(asked, kind="stable")
        names, begin = np.unique(asked[order], return_index=True)
        ends = np.r_[begin[1:], len(asked)]
        wanted = queries.column("bucket").to_numpy()[order]
        low, high = np.searchsorted(buckets, wanted, "left"), np.searchsorted(buckets, wanted, "right")
        sources = _matrix(queries.column("vector").combine_chunks().take(pa.array(order[begin])))
        width = max(vectors.shape[1], sources.shape[1])
        vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
        sources = np.pad(sources, ((0, 0), (0, width - sources.shape[1])))
        out_names, out_classes, out_scores = [], [], []
        for i, name in enumerate(names.tolist()):
            seen = np.zeros(len(ids), bool)
            for j in range(begin[i], ends[i]):
                seen[at[low[j] : high[j]]] = True
            near = np.flatnonzero(seen)
            if not len(near):
                continue
            # The same sum in the same order for equal vectors wherever they are compared.
            with np.errstate(over="ignore", invalid="ignore"):
                rough = _defined(vectors[near] @ sources[i])
                if len(near) > k:
                    floor = np.partition(rough, -k)[-k]
                    margin = 1e-9 * (1 + abs(floor)) if np.isfinite(floor) else 0.0
                    near = near[rough >= floor - margin]
                score = _defined((vectors[near] * sources[i]).sum(1))
            # Of classes that tie with the last those of the least ids, as in the result.
            best = np.lexsort((least[near], -score))[:k]
            out_names.append(name)
            out_classes.append(ids[near[best]].tolist())
            out_scores.append(score[best].tolist())
        return pa.Table.from_arrays(
            [
                pa.array(out_names, pa.int64()),
                pa.array(out_classes, pa.list_(pa.int64())),
                pa.array(out_scores, pa.list_(pa.float64())),
            ],
            schema=schema,
        )

    return grouped.applyInArrow(run, "query bigint, classes array<bigint>, scores array<double>")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best k classes of every query over all tasks, and those that tie with the last."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        classes = np.concatenate([np.array(x, np.int64) for x in table.column("classes").to_pylist()])
        scores = np.concatenate([np.array(x, float) for x in table.column("scores").to_pylist()])
        order = np.lexsort((-scores, classes))
        first = np.r_[True, classes[order][1:] != classes[order][:-1]]
        classes, scores = classes[order][first], scores[order][first]
        if len(scores) > k:
            best = scores >= np.partition(scores, -k)[-k]
            classes, scores = classes[best], scores[best]
        query = np.full(len(classes), key[0].as_py())
        return pa.Table.from_arrays(
            [pa.array(query), pa.array(classes), pa.array(scores)], names=["query", "class", "score"]
        )

    return found.groupBy("query").applyInArrow(run, "query bigint, class bigint, score double")


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not empty, finite throughout, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    tables: Tables = Tables(),
) -> DataFrame:
    """The k nearest rows found for every query row: query_id, rank, vec_id, score.

    Null, empty, zero and non-finite vectors, and rows with a null id, take no part. Vectors
    are compared with those of equal length. A row is never its own neighbour; other rows of
    equal vectors are. Ties go to the smaller id. Repeated rows are one row; an id with
    several vectors counts with the nearest. A product beyond the range of a double is
    infinite, and one of infinite parts of both signs counts as the least. With fewer candidates all found are returned,
    and an empty table gives an empty table. Other columns are not read.
    """
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("vector"),
        is_query.alias("asks"),
    )
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # Classes are named by 64 bits of hash and checked by the vector itself.
    rows = stored(rows.withColumn("hash", F.xxhash64("vector")), "near-rows")
    first = rows.groupBy("hash", "vector").agg(
        F.min("vec_id").alias("least"), F.max("asks").alias("asks")
    )
    # An id with several vectors could name two classes; the hash then tells them apart.
    named = first.withColumn("class", F.xxhash64("least", "hash"))
    # Logarithms of norms: squares of very small or large components leave a double's range.
    most = F.array_max(F.transform("vector", F.abs))
    square = F.aggregate(
        "vector", F.lit(0.0), lambda s, x: s + (x / F.col("most")) * (x / F.col("most"))
    )
    named = named.withColumn("most", most).withColumn("norm", F.log("most") + F.log(square) / 2)
    named = stored(named.drop("most"), "near-normed")
    top = named.agg(F.max("norm")).first()[0] or 0.0
    span = F.floor((F.lit(top) - F.col("norm")) / math.log(tables.spread) + F.lit(1e-9))
    placed = stored(named.withColumn("norms", span.cast("bigint")), "near-classes")
    classes = placed.drop("norm")
    size = F.size("vector")
    keep = k + 1
    smallest = W.partitionBy("hash", "vector").orderBy("vec_id")
    few = (
        rows.select("hash", "vector", "vec_id")
        .withColumn("_nth", F.rank().over(smallest))
        .where(F.col("_nth") <= keep)
        .distinct()
        .groupBy("hash", "vector")
        .agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, keep).alias("ids"))
    )
    few = few.join(classes.select("hash", "vector", "class"), ["hash", "vector"])
    few = stored(few.select("class", "ids"), "near-ids")

    ranges = placed.groupBy("norms").agg(F.max("norm").alias("n")).collect()
    longest = {r["norms"]: r["n"] for r in ranges}
    members = stored(_members(classes, tables, longest), "near-members")
    asking = classes.where("asks")
    probes = stored(_probes(asking, tables, longest), "near-probes")
    found = _compared(members, probes, classes, asking, k, tables)
    pairs = stored(_merged(found, keep), "near-pairs")

    listed = pairs.join(few, "class").select("query", "score", F.explode("ids").alias("vec_id"))
    counts = listed.groupBy("query").agg(F.count_distinct("vec_id").alias("found"))
    there = rows.groupBy(size.alias("dims")).agg(F.count_distinct("vec_id").alias("there"))
    short = (
        asking.select("class", size.alias("dims"))
        .join(counts.withColumnRenamed("query", "class"), "class", "left")
        .join(there, "dims")
        .where(F.coalesce("found", F.lit(0)) < F.least("there", F.lit(keep)))
        .select("class", F.col("dims").cast("bigint").alias("bucket"))
    )
    short = stored(short, "near-short")
    if not short.isEmpty():
        every = classes.select("class", size.cast("bigint").alias("bucket"))
        more = _merged(_compared(every, short, classes, asking, k, tables), keep)
        names = short.select(F.col("class").alias("query"))
        pairs = pairs.join(names, "query", "left_anti").unionByName(more)
        listed = pairs.join(few, "class").select("query", "score", F.explode("ids").alias("vec_id"))
    return _ranked(rows, classes, listed, k)


def _compared(
    members: DataFrame,
    probes: DataFrame,
    classes: DataFrame,
    asking: DataFrame,
    k: int,
    tables: Tables,
) -> DataFrame:
    """Per task and query class the nearest of the classes it shares a bucket with."""
    # Buckets that no query visits end here.
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).join(
        probes.groupBy("bucket").agg(F.count("*").alias("asked")), "bucket"
    )
    sizes = sizes.withColumns(
        {
            "parts": F.ceil(F.col("n") / tables.part).cast("int"),
            "rounds": F.ceil(F.col("asked") / tables.asked).cast("int"),
        }
    )
    sizes = stored(sizes, "near-buckets")
    load = sizes.agg(
        F.sum(F.col("n") * F.col("rounds")).alias("n"),
        F.sum(F.col("asked") * F.col("parts")).alias("asked"),
    ).first()
    # A task takes four full parts of either side.
    tasks = max(
        8, -(-(load["n"] or 0) // (4 * tables.part)), -(-(load["asked"] or 0) // (4 * tables.asked))
    )
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    turn = F.pmod(F.xxhash64("class"), F.col("rounds")).cast("int")
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    every_turn = F.explode(F.sequence(F.lit(0), F.col("rounds") - 1))
    probes = probes.join(sizes, "bucket").withColumn("turn", turn).withColumn("part", every_part)
    placed = members.join(sizes, "bucket").withColumn("part", part).withColumn("turn", every_turn)
    task = F.pmod(F.xxhash64("bucket", "part", "turn"), F.lit(tasks)).cast("int").alias("task")
    side = ["class", "bucket"]
    placed = placed.select(task, *side).join(classes.select("class", "least", "vector"), "class")
    # A column of its own, as both sides read the same table.
    sources = asking.select("class", F.col("vector").alias("vector"))
    probes = probes.select(task, *side).join(sources, "class")
    return _nearest(placed.groupBy("task").cogroup(probes.groupBy("task")), k + 1)


def _ranked(rows: DataFrame, classes: DataFrame, listed: DataFrame, k: int) -> DataFrame:
    keep = k + 1
    listed = listed.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= keep)
    ranked = listed.groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("near")
    )
    askers = rows.where("asks").select("hash", "vector", F.col("vec_id").alias("query_id")).distinct()
    askers = askers.join(classes.select("hash", "vector", F.col("class").alias("query")), ["hash", "vector"])
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    result = askers.join(ranked, "query").select(
        "query_id", F.posexplode(others).alias("rank", "x")
    )
    return result.select(
        "query_id",
        (F.col("rank") + 1).cast("int").alias("rank"),
        F.col("x.vec_id").alias("vec_id"),
        F.col("x.score").alias("score"),
    )
