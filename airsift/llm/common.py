"""Helpers the operators share: shared folders, Arrow maps, packed arrays, row checks."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest as hash64  # noqa: F401  operators import it from here

# A word is a run of bytes outside this class; `bytes.split()` splits on just these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which every executor reaches."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Write a table and return a scan of it: a lost executor costs a re-read."""
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    return written(df, work_folder(df.sparkSession, name))


def shipped(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast a value once; tasks call the result to get it, unpickled once per task."""
    from pyspark import cloudpickle

    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    found: list[object] = []

    def get() -> object:
        if not found:
            found.append(cloudpickle.loads(data.value))
        return found[0]

    return get


def crc32_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of an id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop input columns whose names the result needs for itself."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_rows(
    df: DataFrame,
    added: str,
    fn: Callable[[pa.RecordBatch], list[Iterable]],
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """Append columns that `fn` computes from each Arrow batch.

    `keep` names the input columns that stay (all by default); an input column with the
    name of an added one is replaced.
    """
    new = T.StructType.fromDDL(added)
    kept = [c for c in (df.columns if keep is None else keep)]
    taken = {f.name.lower() for f in new}
    kept = [c for c in kept if c.lower() not in taken]
    schema = T.StructType([df.schema[c] for c in kept] + list(new))
    types = [arrow_type(f.dataType) for f in new]
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            values = [
                v if isinstance(v, pa.Array) else pa.array(v, t)
                for v, t in zip(fn(batch), types, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(columns + values, names=names)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    at = batch.column(batch.schema.get_field_index(column))
    return [t if t is not None else "" for t in at.to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def pack(values: np.ndarray) -> bytes:
    """An integer or float array as compressed bytes: its byte planes, one after another."""
    a = np.ascontiguousarray(values)
    if a.dtype.kind in "iu" and a.size:
        top = int(a.max())
        if int(a.min()) >= 0:
            size = next(s for s in (1, 2, 4, 8) if top < 1 << (8 * s))
            a = a.astype(f"<u{size}")
    planes = a.view(np.uint8).reshape(a.size, a.dtype.itemsize).T.tobytes() if a.size else b""
    body = zstandard.ZstdCompressor(level=1).compress(planes)
    return a.dtype.str.encode().ljust(4) + a.size.to_bytes(8, "little") + body


def unpack(data: bytes) -> np.ndarray:
    kind, n = np.dtype(data[:4].strip().decode()), int.from_bytes(data[4:12], "little")
    planes = zstandard.ZstdDecompressor().decompress(data[12:], max_output_size=n * kind.itemsize)
    raw = np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T
    return np.ascontiguousarray(raw).view(kind).reshape(n)


def u32_crc(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def sorted_groups(
    batches: Iterator[pa.RecordBatch], key: list[str]
) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows of equal key, from batches sorted by key."""
    waiting: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [column(batch, k).to_pylist() for k in key]
        rows = list(zip(*columns, strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                if waiting and rows[start] != current:
                    yield current, pa.Table.from_batches(waiting)
                    waiting = []
                current = rows[start]
                waiting.append(batch.slice(start, i - start))
                start = i
    if waiting:
        yield current, pa.Table.from_batches(waiting)


_RADIX = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _powers(radix: int, n: int) -> np.ndarray:
    """1, radix, radix**2, ... modulo 2**64."""
    out = np.full(n, np.uint64(radix))
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def hashed_words(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z in lower case, and words per text.

    Works on the bytes of the whole column: running sums of byte values times powers of a
    radix give the polynomial hash of every word as a difference. Null texts have no words.
    """
    values = column(batch, name).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(values.buffers()[1], np.int64)
    offsets = offsets[values.offset : values.offset + len(values) + 1]
    n = int(offsets[-1] - offsets[0])
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(values), np.int64)
    raw = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    apart = np.zeros(256, bool)
    apart[[9, 10, 11, 12, 13, 32]] = True
    gap = apart[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first[n] = True
    start = np.flatnonzero(~gap & (np.r_[True, gap[:-1]] | first[:n]))
    last = np.flatnonzero(~gap & (np.r_[gap[1:], True] | first[1:]))
    hashed = np.zeros(len(start), np.uint64)
    rng = np.random.default_rng(3)
    with np.errstate(over="ignore"):
        for radix in _RADIX:
            symbols = rng.integers(1, 1 << 63, 256, np.uint64)
            symbols[65:91] = symbols[97:123]
            sums = symbols[raw]
            sums *= _powers(radix, n)
            np.cumsum(sums, out=sums)
            begun = np.where(start > 0, sums[start - 1], np.uint64(0))
            inverse = _powers(pow(radix, -1, 1 << 64), n)[start]
            hashed = mix64(hashed * np.uint64(0x9E3779B97F4A7C15) + (sums[last] - begun) * inverse)
    return hashed, np.diff(np.searchsorted(start, offsets))
