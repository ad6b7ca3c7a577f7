"""The frame store: normalised frames in a fixed number of folders, whatever the captures.

    store/part=<id>/buckets=<n>/bucket=<b>/   frames, sorted by capture and packet
    store/_captures/part=<id>/                one row per capture of the part

A capture has a short key, a 64-bit hash of its id, and its key a bucket. Buckets are folders,
not tasks: a capture that fills one is many files, written and read by as many tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsift.schema import CAPTURES_FOLDER

BUCKETS = 64


def with_key(frames: DataFrame, buckets: int) -> DataFrame:
    key = F.xxhash64("capture_id")
    return frames.withColumn("capture_key", key).withColumn(
        "bucket", F.pmod(key, F.lit(buckets)).cast("int")
    )


def write_part(normalized: DataFrame, store: str, part: str, buckets: int = BUCKETS) -> None:
    """One part of the store; writing the same part again replaces it.

    Frames are dealt by bucket in one shuffle, which splits full buckets and joins small ones,
    and sorted in their file, so that row groups hold few captures each.
    """
    folder = f"{store.rstrip('/')}/part={part}/buckets={buckets}"
    dealt = with_key(normalized, buckets).hint("rebalance", "bucket")
    ordered = dealt.sortWithinPartitions("bucket", "capture_key", "seq")
    ordered.write.mode("overwrite").partitionBy("bucket").parquet(folder)
    stored = normalized.sparkSession.read.parquet(folder)
    captures = stored.select("capture_key", "capture_id").distinct()
    captures.write.mode("overwrite").parquet(f"{store.rstrip('/')}/{CAPTURES_FOLDER}/part={part}")


def write_frame_store(normalized: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Normalised frames as Parquet, a new part of the store per call."""
    write_part(normalized, path, uuid.uuid4().hex, buckets)
