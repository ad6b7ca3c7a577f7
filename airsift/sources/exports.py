"""Export files as they are: which there are, their header lines, and where they break off.

Files are opened by the tasks and read piece by piece, so a task holds a piece and a line,
whatever the size of a file.
"""

from __future__ import annotations

import csv
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

PIECE = 1 << 20
# A longer line is no frame: it counts as one odd row, and its text is not kept.
LONGEST_LINE = 1 << 24


class CaptureReadError(RuntimeError):
    """An export cannot be read as frames."""


def export_files(spark: SparkSession, path: str | Sequence[str], glob: str) -> list[str]:
    """URIs of the exports under the given paths, empty files included, in order."""
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    try:
        found = sorted(set(reader.text(paths).inputFiles()))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = []
    if not found:
        raise CaptureReadError(f"no exports matching {glob} in {paths}")
    return found


def as_path(uri: str) -> str:
    """The URI of a file as a path that Spark takes literally."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(uri))


def _pieces(uri: str, piece: int) -> Iterator[bytes]:
    """The bytes of a file, through any file system that pyarrow knows."""
    from pyarrow import fs

    parts = urlsplit(uri)
    path = unquote(parts.path)
    if parts.scheme in ("", "file"):
        system = fs.LocalFileSystem()
    else:
        system, base = fs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}/")
        path = base.rstrip("/") + path
    with system.open_input_stream(path, compression=None) as stream:
        while data := stream.read(piece):
            yield data


class Broken(Exception):
    """A file breaks off: why, and after how many of its bytes."""

    def __init__(self, reason: str, at: int):
        super().__init__(reason)
        self.reason, self.at = reason, at


def _unpacked(pieces: Iterator[bytes], most: int) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, at most `most` bytes at a time, up
    to the very byte at which it is damaged."""
    unpacker, at, begun = zlib.decompressobj(31), 0, False
    for data in pieces:
        step = len(data)
        while data:
            begun, before = True, unpacker.copy()
            try:
                out = unpacker.decompress(data[:step], most)
            except zlib.error as error:
                if step == 1:
                    raise Broken("damaged compression", at) from error
                unpacker, step = before, step // 2
                continue
            unread = len(unpacker.unused_data or unpacker.unconsumed_tail)
            taken = min(step, len(data)) - unread
            at, data = at + taken, data[taken:]
            if out:
                yield out
            if unpacker.eof:
                unpacker, begun = zlib.decompressobj(31), False
    if begun or not at:
        raise Broken("compression breaks off", at)


def _lines(pieces: Iterator[bytes], longest: int) -> Iterator[tuple[bytes | None, int, bool]]:
    """Lines without their end, the place of their first byte, and whether they end. A line
    that is too long is None."""
    held, begin, at, dropped = b"", 0, 0, False
    for data in pieces:
        at += len(data)
        *ended, last = (held + data).split(b"\n")
        for line in ended:
            yield (None if dropped else line.removesuffix(b"\r")), begin, True
            begin += len(line) + 1
            dropped = False
        held = last
        if len(held) > longest:
            held, dropped = b"", True
        if dropped:
            begin = at
    if held or dropped:
        yield (None if dropped else held), begin, False


def export_lines(
    uri: str, piece: int = PIECE, longest: int = LONGEST_LINE
) -> Iterator[tuple[bytes | None, int, bool]]:
    """Lines of an export that are not blank, plain or compressed. Raises `Broken` where it
    breaks off, after the lines before that."""
    pieces = _pieces(uri, piece)
    if uri.endswith(".gz"):
        pieces = _unpacked(pieces, piece)
    for line, at, ended in _lines(pieces, longest):
        if line is None or line.strip():
            yield line, at, ended


def fields_of(line: bytes) -> list[str] | None:
    """The fields of one line; None if a quote stays open in it."""
    text = line.decode("utf-8", "replace")
    if text.count('"') % 2:
        return None
    return next(csv.reader([text], delimiter="\t"), [])


def _per_file(
    spark: SparkSession, uris: Sequence[str], schema: str, look: Callable[[str], tuple]
) -> DataFrame:
    """One row per file, `look` at it by a task. Files are dealt over many tasks."""
    cores = spark.sparkContext.defaultParallelism
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [field.split()[0] for field in schema.split(", ")]
    files = spark.createDataFrame([(u,) for u in uris], "uri string")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = [dict(zip(names, look(uri), strict=True))]
                yield pa.RecordBatch.from_pylist(rows, target)

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target: pa.Schema = to_arrow_schema(StructType.fromDDL(schema))
    return files.repartition(min(len(uris), max(tasks, 4 * cores))).mapInArrow(run, schema)


def header_census(spark: SparkSession, uris: Sequence[str], header: bool = True) -> DataFrame:
    """Per file: the fields its first line names (none without `header`), whether a row
    follows, and why it cannot be read, if so. Reads the beginning of every file only."""

    def look(uri: str) -> tuple:
        names: list[str] | None = None
        try:
            for line, _, _ in export_lines(uri, 1 << 16):
                if not header or names is not None:
                    return uri, names or [], True, None
                names = fields_of((line or b"").removeprefix(b"\xef\xbb\xbf"))
                if names is None:
                    return uri, [], False, "the header line has an open quote"
        except (Broken, OSError) as error:
            return uri, names or [], False, str(error)
        return uri, names or [], False, None

    schema = "capture_id string, fields array<string>, has_rows boolean, error string"
    return _per_file(spark, uris, schema, look)


def inspect_files(
    spark: SparkSession,
    uris: Sequence[str],
    fields: Sequence[str] | None,
    piece: int = PIECE,
    longest: int = LONGEST_LINE,
) -> DataFrame:
    """Per file: rows, rows of too few or too many fields, the bytes after which it breaks off
    and why (both null if it does not). A row that breaks off counts as a row, and as odd."""

    def look(uri: str) -> tuple:
        width = len(fields) if fields is not None else None
        rows = odd = 0
        last: tuple[str, int] | None = None
        try:
            for line, at, _ in export_lines(uri, piece, longest):
                found = fields_of(line) if line is not None else []
                if width is None:
                    width = len(found or [])
                    continue
                rows += 1
                last = None
                if found is None or len(found) != width:
                    odd += 1
                    if found is None:
                        last = ("open quote in the last row", at)
                    elif len(found) < width:
                        last = ("short last row", at)
        except (Broken, OSError) as error:
            return uri, rows, odd, getattr(error, "at", 0), str(error)
        return uri, rows, odd, last[1] if last else None, last[0] if last else None

    schema = "capture_id string, rows bigint, odd_rows bigint, broken_at bigint, reason string"
    return _per_file(spark, uris, schema, look)
