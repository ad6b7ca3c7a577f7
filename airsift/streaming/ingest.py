"""Incremental ingest of frame exports into a frame store."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from airsift.operators.normalize import normalize
from airsift.plans.rollup_store import write_batch
from airsift.plans.workspace import shared_folder
from airsift.sinks.frame_store import write_part
from airsift.sources.frames import (
    EXPORT_GLOB,
    CaptureReadError,
    capture_id,
    read_frame_store,
    select_frames,
)


def ingest_exports(
    spark: SparkSession,
    source: str,
    store: str,
    fields: Sequence[str],
    header: bool = False,
    glob: str = EXPORT_GLOB,
    checkpoint: str | None = None,
    rollups: str | None = None,
) -> StreamingQuery:
    """Append exports that are new since the last run to the store, then stop.

    Every file is taken once, also across restarts: the checkpoint folder, by default one
    under spark.checkpoint.dir, remembers them. Every batch is a folder of the store, as
    those of `write_frame_store` are, so both can fill one store. `fields` names the
    export's columns in order. With `rollups` every batch also adds its part to a rollup store
    (see `read_rollups`), from its own frames alone.
    """
    if "frame.number" not in fields:
        raise CaptureReadError("a stream has no scan order: the export needs frame.number")
    # The store's URI as a name that every file system takes.
    name = hashlib.md5(store.rstrip("/").encode()).hexdigest()
    checkpoint = checkpoint or f"{shared_folder(spark)}/ingest/{name}"
    schema = T.StructType([T.StructField(name, T.StringType()) for name in fields])
    raw = (
        spark.readStream.schema(schema)
        .option("sep", "\t")
        .option("quote", '"')
        .option("escape", '"')
        .option("header", header)
        .option("enforceSchema", not header)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .csv(source)
    )
    frames = normalize(select_frames(raw, capture_id().alias("capture_id")))

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is tried again overwrites what its first try left.
        part = batch_part(checkpoint, number)
        write_part(batch, store, part)
        if rollups is not None:
            write_batch(read_frame_store(spark, store, parts=[part]), rollups, part)

    return (
        frames.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def batch_part(checkpoint: str, number: int) -> str:
    """The part of the store that one batch is, named by its stream and number."""
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    return f"ingest-{stream}-{number}"
