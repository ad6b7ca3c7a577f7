"""Centroid clustering of integer vectors with an incrementally kept matrix of dot products.

Vectors are packed in blocks. Beside every block stands its exact dot product with every
centroid. After a round only the components in which a centroid changed are multiplied and
added to its column; distances and their argmin follow from dot products and squared norms.
All sums are of integers, so results do not depend on partitions or order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsift.llm.common import column, pack, shipped, sliced, stored, unpack

# Components from here on could give squared distances beyond 64 bits.
LARGEST = 1 << 27
_BLOCK = "ids binary, known binary, vectors binary, dots binary"
RESULT = (
    "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, "
    "centroid_sha256 string"
)


@dataclass(frozen=True)
class Settings:
    """`clusters`: centroids, each of `dims` components. `rounds`: updates of the centroids.
    `scale`: whole units per 1.0 of a component. `seed`: names the order in which the first
    centroids are drawn. `block`: vectors per row of the working table."""

    dims: int = 64
    clusters: int = 40
    rounds: int = 5
    scale: int = 256
    seed: int = 2
    block: int = 4096


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest signed type that holds them."""
    top = int(np.abs(values).max(initial=0))
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(k).max)
    return values.astype(kind)


def whole_vectors(
    vectors: DataFrame, settings: Settings, vec_id: str, vector: str
) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as arrays of whole numbers."""
    values = F.col("v")
    usable = (F.size(values) == settings.dims) & F.forall(
        values, lambda x: x.isNotNull() & (F.abs(x) < LARGEST / settings.scale)
    )
    read = vectors.select(
        F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"),
        F.col(f"`{vector}`").cast("array<double>").alias("v"),
    )
    # NaN is greater than every number, so the comparison leaves it out as well.
    return read.where(F.col("v").isNotNull() & usable).select(
        "vec_id", F.transform("v", lambda x: F.floor(x * settings.scale)).alias("v")
    )


def first_centroids(whole: DataFrame, settings: Settings) -> np.ndarray:
    """The vectors of smallest hash; a null id counts as empty text, equal ids are told apart
    by their components."""
    name = F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = whole.orderBy(F.sha2(name, 256), "v").limit(settings.clusters).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), settings.dims)


def exact_dots(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Dot products in 64-bit integers, through floats where those are exact."""
    top = int(np.abs(vectors).max(initial=0)) * int(np.abs(centroids).max(initial=0))
    if top * max(centroids.shape[1], 1) < 1 << 53:
        return (vectors.astype(float) @ centroids.astype(float).T).astype(np.int64)
    return vectors.astype(np.int64) @ centroids.astype(np.int64).T


@dataclass(frozen=True)
class Change:
    """What became of the centroids: for each that moved, the components and by how much."""

    moved: list[tuple[int, np.ndarray, np.ndarray]]

    @staticmethod
    def between(old: np.ndarray, new: np.ndarray) -> Change:
        moved = []
        for j in np.flatnonzero((old != new).any(axis=1)):
            at = np.flatnonzero(old[j] != new[j])
            moved.append((int(j), at, new[j, at] - old[j, at]))
        return Change(moved)

    def apply(self, vectors: np.ndarray, dots: np.ndarray) -> np.ndarray:
        for j, at, by in self.moved:
            dots[:, j] += exact_dots(vectors[:, at], by[None, :])[:, 0]
        return dots


def assigned(
    vectors: np.ndarray, dots: np.ndarray, centroids: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of every vector, ties to the smaller number, and the squared distance."""
    wide = vectors.astype(np.int64)
    distance = (centroids**2).sum(axis=1)[None, :] - 2 * dots
    nearest = distance.argmin(axis=1)
    return nearest, distance[np.arange(len(wide)), nearest] + (wide**2).sum(axis=1)


def _blocks(whole: DataFrame, centroids: np.ndarray, settings: Settings) -> DataFrame:
    """Blocks of vectors with their dot products; a block has rows of one task."""
    shared = shipped(whole.sparkSession, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, settings.block):
            if not batch.num_rows:
                continue
            ids = column(batch, "vec_id")
            flat = column(batch, "v").flatten().to_numpy(zero_copy_only=False)
            vectors = flat.reshape(batch.num_rows, settings.dims)
            block = (
                ids.fill_null(0).to_numpy(zero_copy_only=False),
                np.asarray(ids.is_valid()).astype(np.int8),
                _narrow(vectors).reshape(-1),
                _narrow(exact_dots(vectors, shared())).reshape(-1),
            )
            yield pa.RecordBatch.from_arrays([pa.array([pack(x)]) for x in block], names=_names())

    return whole.mapInArrow(run, _BLOCK)


def _names() -> list[str]:
    return [field.split()[0] for field in _BLOCK.split(", ")]


def _opened(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, known, vectors and dots of every block of a batch, dots as 64-bit integers."""
    for row in zip(*[column(batch, n).to_pylist() for n in _names()], strict=True):
        ids, known, vectors, dots = map(unpack, row)
        vectors = vectors.reshape(len(ids), dims)
        yield ids, known, vectors, dots.reshape(len(ids), -1).astype(np.int64)


def _updated(blocks: DataFrame, change: Change, settings: Settings) -> DataFrame:
    shared = shipped(blocks.sparkSession, change)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                pack(_narrow(shared().apply(vectors, dots)).reshape(-1))
                for _, _, vectors, dots in _opened(batch, settings.dims)
            ]
            kept = [column(batch, n) for n in _names()[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.binary())], names=_names())

    return blocks.mapInArrow(run, _BLOCK)


def _sums(
    blocks: DataFrame, centroids: np.ndarray, settings: Settings
) -> dict[int, tuple[int, int, list[int]]]:
    """Per cluster the number of vectors, the sum of distances and the sum per component.

    A task sends one row per cluster and fact, in decimals that hold any sum.
    """
    shared = shipped(blocks.sparkSession, centroids)
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, spread = [0] * k, [0] * k
        total = np.zeros((k, dims), object)
        for batch in batches:
            for _, _, vectors, dots in _opened(batch, dims):
                nearest, distance = assigned(vectors, dots, shared())
                for j in np.unique(nearest):
                    own = nearest == j
                    number[j] += int(own.sum())
                    spread[j] += sum(distance[own].tolist())
                    total[j] += vectors[own].sum(axis=0, dtype=np.int64)
        met = [j for j in range(k) if number[j]]
        facts = [str(f) for j in met for f in (number[j], spread[j], *total[j])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(met, dims + 2), pa.int32()),
                pa.array(list(range(dims + 2)) * len(met), pa.int32()),
                pa.array(facts, pa.string()),
            ],
            names=["cluster", "place", "n"],
        )

    found = blocks.mapInArrow(run, "cluster int, place int, n string")
    total = found.groupBy("cluster", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    facts: dict[int, list[int]] = {}
    for row in total.collect():  # clusters * (dims + 2) rows at most
        facts.setdefault(row.cluster, [0] * (dims + 2))[row.place] = int(row.n)
    return {j: (f[0], f[1], f[2:]) for j, f in facts.items()}


def moved_centroids(centroids: np.ndarray, sums: dict) -> np.ndarray:
    """Every non-empty centroid at the floor of the exact mean of its vectors."""
    new = centroids.copy()
    for j, (n, _, total) in sums.items():
        new[j] = [t // n for t in total]
    return new


def cluster_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    settings: Settings = Settings(),
) -> DataFrame:
    """Cluster, squared distance, inertia of the cluster and of all, and a hash of the final
    centroid, one row per vector that takes part.

    Vectors that are null, of another length, or hold a null or non-finite component take no
    part, nor do those with a component whose whole number is 2^27 or more, as distances may
    not fit a BIGINT. With fewer vectors than centroids every vector is a first centroid.
    Repeated rows count one by one; a null id takes part and stays null; other input columns
    are not read; an empty table gives an empty table. An inertia beyond a BIGINT is null.

    Each round writes the blocks anew with their dot products; the driver holds the centroids
    and their sums only.
    """
    whole = whole_vectors(vectors, settings, vec_id, vector)
    centroids = first_centroids(whole, settings)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], RESULT)
    blocks = stored(_blocks(whole, centroids, settings), "centroids-0")
    sums = _sums(blocks, centroids, settings)
    for number in range(1, settings.rounds + 1):
        new = moved_centroids(centroids, sums)
        change = Change.between(centroids, new)
        if change.moved:
            blocks = stored(_updated(blocks, change, settings), f"centroids-{number}")
            centroids = new
            sums = _sums(blocks, centroids, settings)
    return _rows(blocks, centroids, sums, settings)


def _rows(
    blocks: DataFrame, centroids: np.ndarray, sums: dict, settings: Settings
) -> DataFrame:
    def fits(n: int) -> int | None:
        return n if n < 1 << 63 else None

    inertia = fits(sum(s[1] for s in sums.values()))
    per = [fits(sums[j][1]) if j in sums else 0 for j in range(len(centroids))]
    names = [
        hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids
    ]
    shared = shipped(blocks.sparkSession, (centroids, per, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, per, names = shared()
        for batch in batches:
            for ids, known, vectors, dots in _opened(batch, settings.dims):
                nearest, distance = assigned(vectors, dots, centroids)
                at = pa.array(nearest)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64(), mask=known == 0),
                        at.cast(pa.int32()),
                        pa.array(distance, pa.int64()),
                        pa.array(per, pa.int64()).take(at),
                        pa.repeat(pa.scalar(inertia, pa.int64()), len(ids)),
                        pa.array(names).take(at),
                    ],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return blocks.mapInArrow(run, RESULT)
