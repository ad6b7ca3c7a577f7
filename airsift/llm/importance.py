"""Importance resampling towards a target distribution over hashed word n-grams.

Two passes over the texts. The first counts the buckets of all n-grams, of the documents and
of the target; the second adds up a document's gains from one array of log ratios and adds
seeded Gumbel noise, so that the highest scores are a sample without replacement. The cutoff
is found without sorting all scores: a quantile sketch gives a bracket of scores, exact counts
of the rows outside prove that it holds the cutoff or widen it, and only the bracket is sorted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airsift.llm.common import column, map_rows, shipped, sliced, stored, without, work_folder
from airsift.operators.positions import positions, ranged

# A-Z in lower case; every other ASCII byte but 0-9 and a-z parts words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
FEATURES = "n_features bigint, n_words bigint, weight bigint, score bigint"
RESULT = ["n_features", "weight", "score", "rank"]


@dataclass(frozen=True)
class Settings:
    """`grams`: longest run of words. `buckets`: length of the weight array. `least_words`: a
    shorter document is never drawn. `draw`, `of`: share of the others that is. `scale`: units
    of one nat. `accuracy`: of the quantile sketch, whose rows are at most its multiple."""

    grams: int = 3
    buckets: int = 10_000
    least_words: int = 20
    draw: int = 5
    of: int = 100
    seed: int = 42
    scale: int = 1000
    accuracy: int = 10_000


def features(text: bytes, settings: Settings) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to `grams` words, repeats included.

    The crc32 of a run goes on from that of the run without its last word.
    """
    words = text.translate(_WORD_BYTES).split()
    following = [b" " + w for w in words]
    sums = list(map(crc32, words))
    found = list(sums)
    for n in range(1, min(settings.grams, len(words))):
        sums = list(map(crc32, following[n:], sums))
        found += sums
    return len(words), np.array(found, np.int64) % settings.buckets


def _raw(batch: pa.RecordBatch, text: str) -> Iterator[bytes]:
    values = column(batch, text).cast(pa.large_binary())
    return (v.as_py() or b"" for v in values)


def bucket_counts(table: DataFrame, text: str, settings: Settings) -> np.ndarray:
    """Features per bucket over all texts. A task sends one row per bucket it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, np.int64)
        for batch in sliced(batches):
            for value in _raw(batch, text):
                found = features(value, settings)[1]
                total += np.bincount(found, minlength=settings.buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    met = table.select(F.col(f"`{text}`").cast("string").alias(text)).mapInArrow(
        count, "bucket bigint, n bigint"
    )
    counts = np.zeros(settings.buckets, np.int64)
    for row in met.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets`
        counts[row.bucket] = row.n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray, settings: Settings) -> np.ndarray:
    """Log ratio of a bucket's share of the target and of the corpus, each with one more
    feature per bucket, in whole units."""
    s_all, t_all = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    ratios = ((t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(corpus, target, strict=True))
    return np.array([math.floor(settings.scale * math.log(r)) for r in ratios], np.int64)


def noise(doc_id: object, settings: Settings) -> int:
    """Gumbel noise of a document, in whole units; a null id counts as empty text."""
    name = f"{settings.seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-settings.scale * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(
    docs: DataFrame, gain: np.ndarray, settings: Settings, doc_id: str, text: str, keep: list[str]
) -> DataFrame:
    shared = shipped(docs.sparkSession, gain)

    def judge(batch: pa.RecordBatch) -> list:
        gain, rows = shared(), []
        for value, key in zip(_raw(batch, text), column(batch, doc_id).to_pylist(), strict=True):
            n_words, found = features(value, settings)
            weight = int(gain[found].sum())
            rows.append((len(found), n_words, weight, weight + noise(key, settings)))
        return list(zip(*rows, strict=True)) if rows else [[]] * 4

    return map_rows(docs, FEATURES, judge, keep)


def cutoff_bracket(rows: DataFrame, wanted: int, settings: Settings) -> tuple[int, int, int]:
    """Least and greatest score of a bracket that holds the `wanted`-th highest, and the exact
    number of rows above it. `wanted` lies between 1 and the number of rows."""
    n = rows.count()
    margin = 2.0 / settings.accuracy
    while True:
        low, high = 1 - wanted / n - margin, 1 - wanted / n + margin
        ends = [max(low, 0.0), min(high, 1.0)]
        sketch = rows.agg(
            F.percentile_approx("score", ends, settings.accuracy).alias("ends"),
            F.min("score").alias("least"),
            F.max("score").alias("most"),
        ).first()
        least = sketch.ends[0] if low > 0 else sketch.least
        most = sketch.ends[1] if high < 1 else sketch.most
        counts = rows.agg(
            F.count_if(F.col("score") > most).alias("above"),
            F.count_if(F.col("score").between(least, most)).alias("inside"),
        ).first()
        if counts.above < wanted <= counts.above + counts.inside:
            return least, most, counts.above
        margin *= 4


def _order() -> list[Column]:
    """Highest score first, ties to the smaller id, then to fewer features; rows that are
    equal in all of these are told apart by their place in the written table."""
    return [F.desc("score"), F.asc_nulls_last("_id"), F.asc("n_features"), F.asc("_nth")]


def _drawn(cut) -> Column:
    """Rows up to the cutoff row in `_order`."""
    same = F.col("score") == cut.score
    tied = F.struct(F.col("_id").isNull(), F.coalesce("_id", F.lit(0)), "n_features", "_nth")
    last = F.struct(
        F.lit(cut["_id"] is None), F.lit(cut["_id"] or 0).cast("bigint"),
        F.lit(cut.n_features).cast("bigint"), F.lit(cut["_nth"]).cast("bigint"),
    )
    return (F.col("score") > cut.score) | (same & (tied <= last))


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    keep: list[str] | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """All documents with n_features, weight, score and, if drawn, their rank (else null).

    Null and empty texts have no features and weight 0, and with fewer than `least_words`
    words a document is not drawn. A null id counts as empty text in the noise and comes last
    among ties. Repeated rows are scored and drawn one by one. An empty target draws by the
    rarity of buckets alone; an empty table gives an empty table. Input columns named as a
    result column are replaced. Ids are whole numbers.

    The driver holds two arrays of `buckets` counts and one row of the cutoff. Every row is
    written once with its score; the rows drawn are dealt into ranges for their ranks.
    """
    spark = docs.sparkSession
    gain = gains(
        bucket_counts(docs, text, settings), bucket_counts(target, target_text, settings), settings
    )
    kept = without(docs.select(*[f"`{c}`" for c in keep or docs.columns]), RESULT).columns
    carried = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(True).alias("_")).alias("_kept"),
        F.col(f"`{doc_id}`").cast("bigint").alias("_id"),
        F.col(f"`{text}`").cast("string").alias("_text"),
    )
    rows = scored(carried, gain, settings, "_id", "_text", ["_kept", "_id"])
    rows = stored(rows.withColumn("_nth", F.monotonically_increasing_id()), "importance-scores")
    long_enough = F.col("n_words") >= settings.least_words
    eligible = rows.where(long_enough)
    wanted = settings.draw * eligible.count() // settings.of
    out = [*[F.col(f"_kept.`{c}`") for c in kept], *RESULT]
    if not wanted:
        return rows.withColumn("rank", F.lit(None).cast("bigint")).select(*out)
    least, most, above = cutoff_bracket(eligible.select("score"), wanted, settings)
    bracket = eligible.where(F.col("score").between(least, most))
    bracket = bracket.select("score", "_id", "n_features", "_nth")
    placed = positions(ranged(bracket, _order(), work_folder(spark, "importance-bracket")))
    cut = placed.where(F.col("position") == wanted - above).first()
    drawn = long_enough & _drawn(cut)
    ranks = ranged(rows.where(drawn), _order(), work_folder(spark, "importance-drawn"))
    rest = rows.where(~drawn).withColumn("rank", F.lit(None).cast("bigint"))
    return positions(ranks, "rank").select(*out).unionByName(rest.select(*out))
