"""Token ids in binary shards with a minimal perfect hash index.

A shard file is Parquet without compression, one row per segment of a few million ids. A row
holds the raw payload (little-endian ids of all its documents, in ascending key order), where
each document begins, and an index from keys to documents: a minimal perfect hash that gives
every key of the segment a slot of its own, and per slot a fingerprint of the key and the
number of its first document. A key is found in constant time: hash, rank, fingerprint,
offset; a key that is not there fails the fingerprint but once in 2**32.

The hash is built in levels of bit arrays: a key alone at its bit stays there, keys that
collide go on to the next level. The slot is the number of set bits before the key's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airsift.llm.common import arrow_type, column, mix64, texts, u32_crc
from airsift.llm.tokens import default_tokenizer, worker_encoder

_NULL = -(1 << 63)
_GAMMA = 2
MAX_SEGMENTS = 10_000_000


def _positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level * 0x9E3779B97F4A7C15 + 0x51ED270B) & (1 << 64) - 1)
    return mix64(keys ^ mix64(np.array([seed]))[0]) % np.uint64(size)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype(np.uint32)


@dataclass
class PerfectHash:
    """Slots 0..n-1 for n distinct keys."""

    sizes: np.ndarray  # bits per level
    words: np.ndarray  # the bits of all levels, 64 to a word
    ranks: np.ndarray  # set bits before each word

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        left = keys.astype(np.uint64)
        sizes, levels = [], []
        while len(left):
            size = -(-max(64, _GAMMA * len(left)) // 64) * 64
            at = _positions(left, len(sizes), size).astype(np.int64)
            taken = np.bincount(at, minlength=size)
            levels.append(np.packbits(taken == 1, bitorder="little").view(np.uint64))
            left = left[taken[at] > 1]
            sizes.append(size)
        words = np.concatenate(levels) if levels else np.empty(0, np.uint64)
        ones = np.bitwise_count(words).astype(np.uint32)
        ranks = (np.cumsum(ones, dtype=np.uint64) - ones).astype(np.uint32)
        return PerfectHash(np.array(sizes, np.uint64), words, ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some keys that are not in the set."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        base = 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _positions(keys[open_], level, size) + np.uint64(base)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            rank = self.ranks[word] + np.bitwise_count(below)
            out[open_[hit]] = rank[hit]
            open_ = open_[~hit]
            base += int(size)
            if not len(open_):
                break
        return out


@dataclass
class Segment:
    """One row of a shard file."""

    keys: np.ndarray  # of every document, in order; nulls first
    nulls: int
    offsets: np.ndarray  # n + 1 begins, in ids
    payload: bytes
    id_bytes: int
    index: PerfectHash
    slot_prints: np.ndarray
    slot_rows: np.ndarray

    @staticmethod
    def build(keys: list[int | None], blobs: list[bytes], id_bytes: int) -> Segment:
        nulls = sum(k is None for k in keys)
        values = np.array([_NULL if k is None else k for k in keys], np.int64)
        sizes = np.array([len(b) // id_bytes for b in blobs], np.uint64)
        offsets = np.r_[np.uint64(0), np.cumsum(sizes, dtype=np.uint64)]
        # A key that repeats is indexed by its first document.
        distinct, first = np.unique(values[nulls:], return_index=True)
        distinct = distinct.view(np.uint64)
        index = PerfectHash.build(distinct)
        slots = index.slots(distinct)
        prints = np.empty(len(distinct), np.uint32)
        rows = np.empty(len(distinct), np.uint32)
        prints[slots] = fingerprints(distinct)
        rows[slots] = first + nulls
        return Segment(values, nulls, offsets, b"".join(blobs), id_bytes, index, prints, rows)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the first document of each key; -1 where there is none."""
        wanted = keys.view(np.uint64)
        slots = self.index.slots(wanted)
        out = np.full(len(keys), -1, np.int64)
        some = np.flatnonzero(slots >= 0)
        some = some[self.slot_prints[slots[some]] == fingerprints(wanted[some])]
        out[some] = self.slot_rows[slots[some]]
        return out

    def ids(self, row: int) -> np.ndarray:
        a, b = int(self.offsets[row]), int(self.offsets[row + 1])
        size = self.id_bytes
        return np.frombuffer(self.payload, f"<u{size}", b - a, a * size)

    def values(self) -> list:
        raw = [self.keys, self.offsets, self.index.sizes, self.index.words, self.index.ranks]
        raw += [self.slot_prints, self.slot_rows]
        return [self.id_bytes, self.nulls, self.payload, *[x.tobytes() for x in raw]]

    @staticmethod
    def read(row: dict) -> Segment:
        def array(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(row[name], kind)

        index = PerfectHash(array("sizes", "<u8"), array("words", "<u8"), array("ranks", "<u4"))
        return Segment(
            array("keys", "<i8"),
            row["nulls"],
            array("offsets", "<u8"),
            row["payload"],
            row["id_bytes"],
            index,
            array("prints", "<u4"),
            array("rows", "<u4"),
        )


_PLACE = "shard int, segment int, first_key bigint, last_key bigint, n_docs bigint, n_ids bigint"
_BODY = (
    "id_bytes int, nulls int, payload binary, keys binary, offsets binary, sizes binary, "
    "words binary, ranks binary, prints binary, rows binary"
)
SEGMENT = f"{_PLACE}, {_BODY}"


def write_shards(
    docs: DataFrame,
    folder: str,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    shard_bytes: int = 32 << 20,
    segment_ids: int = 1 << 20,
    added_tokens: bool = False,
) -> None:
    """Encode whole texts and write them to shard files in ascending order of integer ids.

    Shards are ranges of keys of about `shard_bytes` of text each; a segment ends with the
    document that brings it to `segment_ids`. Null keys come first; they are stored but not
    indexed. Rows that repeat a key are kept each, ordered by text; the index leads to the
    first in a segment. A null or empty text is its end id. An empty table writes no
    segments. Texts are shuffled once, ids never. `added_tokens` is that of `Encoder`.
    """
    path = tokenizer or default_tokenizer()
    small = docs.select(F.col(doc_id).cast("bigint").alias("key"), F.col(text).alias("text"))
    volume = small.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-volume // shard_bytes))

    schema = pa.schema([(f.name, arrow_type(f.dataType)) for f in T.StructType.fromDDL(SEGMENT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = worker_encoder(path, added_tokens)
        limit = segment_ids * encoder.id_bytes
        keys: list[int | None] = []
        blobs: list[bytes] = []
        size = number = 0

        def segment() -> pa.RecordBatch:
            made = Segment.build(keys, blobs, encoder.id_bytes)
            place = [shard, number, int(made.keys[0]), int(made.keys[-1]), len(keys)]
            row = [*place, int(made.offsets[-1]), *made.values()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema
            )

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                for key, blob in zip(
                    column(part, "key").to_pylist(), encoder.encode(texts(part)), strict=True
                ):
                    keys.append(key)
                    blobs.append(blob)
                    size += len(blob)
                    if size >= limit:
                        yield segment()
                        keys, blobs = [], []
                        size, number = 0, number + 1
        if keys:
            yield segment()

    ordered = small.repartitionByRange(shards, F.col("key").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    ordered.mapInArrow(run, SEGMENT).write.option("compression", "uncompressed").parquet(
        f"{folder}/segments"
    )


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SEGMENT).parquet(f"{folder}/segments")


def directory(spark: SparkSession, folder: str) -> DataFrame:
    """One row per segment with `base`, the ids of all segments before it.

    Sums per shard are added up first, so no task holds more than the shards, or the
    segments of one shard.
    """
    places = _segments(spark, folder).select(
        "shard", "segment", "first_key", "last_key", "n_docs", "n_ids"
    )
    shards = places.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = W.partitionBy("shard").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    base = F.col("begin") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    return places.join(shards, "shard").withColumn("base", base).drop("begin")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files, found through the index: doc_id, start, n_tokens,
    ids_crc32. A key that repeats is found once and its further documents follow it."""
    schema = (
        "doc_id bigint, shard int, segment int, local bigint, n_tokens bigint, ids_crc32 bigint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: column(batch, c)[at].as_py() for c in batch.schema.names}
                segment = Segment.read(row)
                n, nulls = len(segment.keys), segment.nulls
                rows = np.r_[np.arange(nulls), segment.find(segment.keys[nulls:])]
                again = np.r_[False, segment.keys[1:] == segment.keys[:-1]]
                again[:nulls] = False
                if nulls < n:
                    again[nulls] = False
                # A further document of a key stands behind the one before it.
                rows = np.where(again, np.arange(n), rows)
                if (rows < 0).any():
                    raise RuntimeError(f"index of segment {row['shard']}/{row['segment']} is damaged")
                starts = segment.offsets.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(segment.keys, mask=np.arange(n) < nulls),
                        pa.array([row["shard"]] * n, pa.int32()),
                        pa.array([row["segment"]] * n, pa.int32()),
                        pa.array(starts[rows]),
                        pa.array(starts[rows + 1] - starts[rows]),
                        pa.array([u32_crc(segment.ids(int(r))) for r in rows], pa.int64()),
                    ],
                    names=["doc_id", "shard", "segment", "local", "n_tokens", "ids_crc32"],
                )

    found = _segments(spark, folder).mapInArrow(run, schema)
    bases = directory(spark, folder).select("shard", "segment", "base")
    return found.join(bases, ["shard", "segment"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )


def lookup(spark: SparkSession, folder: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ids of the given keys: (key, ids), no row for a key that is not there.

    The segments a key can be in follow from the directory, 16 bytes per segment, of which
    more than MAX_SEGMENTS are refused. Repeated keys are sought once; null is never found.
    """
    listed = (
        directory(spark, folder)
        .select("first_key", "last_key", "shard", "segment")
        .orderBy("shard", "segment")
        .limit(MAX_SEGMENTS + 1)
        .toPandas()
    )
    if len(listed) > MAX_SEGMENTS:
        raise ValueError("too many segments for a directory in memory: write larger ones")
    first, last = listed["first_key"].to_numpy(), listed["last_key"].to_numpy()
    shard, number = listed["shard"].to_numpy(), listed["segment"].to_numpy()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = column(batch, "key").to_numpy()
            a, b = np.searchsorted(last, wanted, "left"), np.searchsorted(first, wanted, "right")
            many = np.maximum(b - a, 0)
            of = np.repeat(np.arange(len(wanted)), many)
            at = a[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays(
                [pa.array(wanted[of]), pa.array(shard[at]), pa.array(number[at])],
                names=["key", "shard", "segment"],
            )

    wanted = keys.select(F.col(key).cast("bigint").alias("key")).where("key IS NOT NULL").distinct()
    routed = wanted.mapInArrow(route, "key bigint, shard int, segment int")
    asked = routed.groupBy("shard", "segment").agg(F.collect_list("key").alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: column(batch, c)[at].as_py() for c in batch.schema.names}
                segment = Segment.read(row)
                want = np.array(row["wanted"], np.int64)
                rows = segment.find(want)
                got = [(k, segment.ids(r).tolist()) for k, r in zip(want.tolist(), rows.tolist(), strict=True) if r >= 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _ in got], pa.int64()),
                        pa.array([v for _, v in got], pa.list_(pa.int64())),
                    ],
                    names=["key", "ids"],
                )

    return _segments(spark, folder).join(asked, ["shard", "segment"]).mapInArrow(
        run, "key bigint, ids array<bigint>"
    )
