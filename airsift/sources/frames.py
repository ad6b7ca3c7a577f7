"""Reading frame tables: tab-separated exports and stored Parquet frames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airsift.schema import CAPTURES_FOLDER, FIELD_CANDIDATES, NORMALIZED_SCHEMA, STORED_SCHEMA
from airsift.sources.exports import (
    CaptureReadError,
    as_path,
    export_files,
    header_census,
    inspect_files,
)

EXPORT_GLOB = "*.{tsv,txt,tsv.gz,txt.gz}"


def resolve_fields(available: Iterable[str]) -> dict[str, str | None]:
    """Logical column to the first of its candidate fields that is available."""
    present = set(available)
    return {
        logical: next((name for name in candidates if name in present), None)
        for logical, candidates in FIELD_CANDIDATES.items()
    }


def field_status(spark: SparkSession, available: Iterable[str]) -> DataFrame:
    """One row per logical column: where it comes from, if anywhere."""
    rows = [
        (position, logical, physical, physical is not None)
        for position, (logical, physical) in enumerate(resolve_fields(available).items(), 1)
    ]
    return spark.createDataFrame(
        rows, "pos int, logical_name string, physical_name string, available boolean"
    )


def capture_fields(
    spark: SparkSession, path: str | Sequence[str], glob: str = EXPORT_GLOB
) -> DataFrame:
    """The rows of `field_status` for every capture, from the first line of its export."""
    known = [
        F.struct(
            F.lit(pos).alias("pos"),
            F.lit(name).alias("logical_name"),
            F.array(*map(F.lit, fields)).alias("candidates"),
        )
        for pos, (name, fields) in enumerate(FIELD_CANDIDATES.items(), 1)
    ]
    census = header_census(spark, export_files(spark, path, glob))
    unfolded = census.select("capture_id", "fields", F.inline(F.array(*known)))
    return unfolded.selectExpr(
        "capture_id",
        "pos",
        "logical_name",
        "get(array_intersect(candidates, fields), 0) AS physical_name",
        "arrays_overlap(candidates, fields) AS available",
    )


def select_frames(raw: DataFrame, *extra: Column) -> DataFrame:
    """Project a table of export fields onto the logical frame columns.

    Only resolved fields are read; a column without a field is ''. Fails if the
    table has none of the known fields.
    """
    resolved = resolve_fields(raw.columns)
    if not any(resolved.values()):
        raise CaptureReadError("none of the known frame fields is in the input")
    columns = [
        (F.coalesce(F.col(f"`{physical}`").cast("string"), F.lit("")) if physical else F.lit(""))
        .alias(logical)
        for logical, physical in resolved.items()
    ]
    return raw.select(*extra, *columns)


def capture_id() -> Column:
    """The path of the file: names repeat in the folders of an archive."""
    return F.col("_metadata.file_path")


def _unique(fields: Sequence[str]) -> list[str]:
    """Field names as column names: of fields that differ in case only or not at all, the
    first keeps its name."""
    seen: set[str] = set()
    names = []
    for place, name in enumerate(fields):
        names.append(f"{name}#{place}" if name.lower() in seen else name)
        seen.add(name.lower())
    return names


def _scan(
    spark: SparkSession, uris: Sequence[str], fields: Sequence[str], header: bool, tolerant: bool
) -> DataFrame:
    """Frames of exports that share their columns."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in _unique(fields)])
    raw = (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("header", header)
        .option("ignoreCorruptFiles", tolerant)
        .csv([as_path(uri) for uri in uris])
    )
    frames = select_frames(raw, capture_id().alias("capture_id"))
    if "frame.number" in raw.columns:
        return frames
    return frames.withColumn("scan_order", F.monotonically_increasing_id())


def _shown(names: Sequence[str], most: int = 10) -> str:
    more = f" and {len(names) - most} more" if len(names) > most else ""
    return ", ".join(names[:most]) + more


def read_frames(
    spark: SparkSession,
    path: str | Sequence[str],
    fields: Sequence[str] | None = None,
    glob: str = EXPORT_GLOB,
    tolerate_truncated: bool = False,
) -> DataFrame:
    """Tab-separated, double-quoted frame exports as the text table `FRAMES_SCHEMA`.

    Every export names its columns in its first line, in any order and with any candidate of
    a logical column: the first lines are read in parallel, exports of equal columns are one
    scan, and the scans are united. `fields` names the columns of exports without a header
    line. Short rows are filled with '', long rows are cut. A capture without any row, or
    without any known field, fails by name. A damaged file fails the job; with
    `tolerate_truncated` its readable part is kept, and `scan_summary` tells which captures
    that concerns.

    Captures without packet numbers have '' for them, and the order of the scan in an extra
    column `scan_order`: rows of one file get increasing ids, as its splits are read by
    increasing partitions.
    """
    uris = export_files(spark, path, glob)
    layouts: dict[tuple[str, ...], list[str]] = {}
    failed, empty = [], []
    for row in header_census(spark, uris, header=fields is None).collect():  # one per file
        if row.error:
            failed.append(f"{row.capture_id} ({row.error})")
        elif not row.has_rows:
            empty.append(row.capture_id)
        names = tuple(row.fields if fields is None else fields)
        layouts.setdefault(names, []).append(row.capture_id)
    if failed:
        raise CaptureReadError(f"cannot be read: {_shown(sorted(failed))}")
    if empty:
        raise CaptureReadError(f"no frame in {_shown(sorted(empty))}")
    for names, members in layouts.items():
        if not any(resolve_fields(names).values()):
            raise CaptureReadError(
                f"none of the known frame fields is in {_shown(sorted(members))}"
            )
    frames = None
    for names, members in sorted(layouts.items()):
        scan = _scan(spark, sorted(members), names, fields is None, tolerate_truncated)
        frames = scan if frames is None else frames.unionByName(scan, allowMissingColumns=True)
    return frames


def list_captures(
    spark: SparkSession, path: str | Sequence[str], glob: str = EXPORT_GLOB
) -> DataFrame:
    """One row per export file, from the file listing alone (no file is opened)."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load([path] if isinstance(path, str) else list(path))
    )
    return files.select(
        capture_id().alias("capture_id"),
        F.col("_metadata.file_name").alias("capture_name"),
        capture_id().alias("capture_file"),
        F.col("length").alias("bytes"),
    )


def scan_summary(
    spark: SparkSession,
    path: str | Sequence[str],
    fields: Sequence[str] | None = None,
    glob: str = EXPORT_GLOB,
) -> DataFrame:
    """Per capture: files, rows, rows with too few or too many fields, a status, and where
    and why it breaks off.

    `failed` means no row could be read; `truncated` that the file broke off: its last row is
    short or has an open quote, or it does not decompress to its end; `check` that some other
    rows were short or long. `broken_at` is the place in the bytes of the file. Every file is
    read piece by piece by one task, so its size does not matter.
    """
    files = inspect_files(spark, export_files(spark, path, glob), fields)
    status = (
        F.when(F.col("rows") == 0, "failed")
        .when(F.col("reason").isNotNull(), "truncated")
        .when(F.col("odd_rows") > 0, "check")
        .otherwise("ok")
    )
    return files.select(
        "capture_id", F.lit(1).cast("bigint").alias("files"), "rows", "odd_rows",
        status.alias("status"), "broken_at", "reason",
    )


def require_rows(frames: DataFrame) -> DataFrame:
    """Fail if there is no frame at all."""
    if frames.isEmpty():
        raise CaptureReadError("no frame could be read")
    return frames


_SHORT = "lower(lpad(hex(capture_key), 16, '0'))"


def read_frame_store(
    spark: SparkSession,
    path: str,
    captures: Sequence[str] | None = None,
    short: bool = False,
    parts: Sequence[str] | None = None,
) -> DataFrame:
    """Normalised frames written by `write_frame_store` or the streaming ingest.

    `captures` names the captures wanted: only their buckets are opened, and in these only the
    row groups that hold them. With `short` the capture id is the short key of the store, 16
    hex digits, so that no shuffle carries long paths; `store_captures` has what they stand for.
    `parts` names the parts of the store wanted, such as one batch of an ingest.
    """
    folders = {"part": T.StringType(), "buckets": T.IntegerType(), "bucket": T.IntegerType()}
    kinds = T.StructType([*STORED_SCHEMA, *[T.StructField(n, t) for n, t in folders.items()]])
    stored = spark.read.schema(kinds).parquet(path)
    if parts is not None:
        stored = stored.where(F.col("part").isin(*parts))
    if captures is not None:
        keys = [F.xxhash64(F.lit(name)) for name in captures]
        in_bucket = F.lit(False)
        for key in keys:
            in_bucket = in_bucket | (F.col("bucket") == F.pmod(key, F.col("buckets")))
        stored = stored.where(in_bucket & F.col("capture_key").isin(*keys))
        stored = stored.where(F.col("capture_id").isin(*captures))
    capture = F.expr(_SHORT).alias("capture_id") if short else F.col("capture_id")
    return stored.select(capture, *NORMALIZED_SCHEMA.names[1:])


def store_captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per capture of a frame store, with the columns of `list_captures` but the size:
    its short key as `capture_id`, its name and its path."""
    kind = T.StructType().add("capture_key", T.LongType()).add("capture_id", T.StringType())
    listed = spark.read.schema(kind).parquet(f"{path.rstrip('/')}/{CAPTURES_FOLDER}")
    return listed.select("capture_key", "capture_id").distinct().selectExpr(
        f"{_SHORT} AS capture_id",
        "url_decode(replace(substring_index(capture_id, '/', -1), '+', '%2B')) AS capture_name",
        "capture_id AS capture_file",
    )
