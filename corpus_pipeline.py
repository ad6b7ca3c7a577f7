"""A corpus from raw documents to packed sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Stages
before the last return the columns of `docs`; extra columns travel with their row, also under
names that an operator uses itself. Null and empty texts, repeated rows and empty tables are
handled as the operators say: null and empty texts are not toxic, fail the quality rules and
so end there; an empty table passes through all stages.

Stages share executors, so each leaves little in them. A stage called by itself sets the
session's Arrow batches to at most `BATCH_ROWS` rows and leaves them so, as its result is
computed later; `run` sets them back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsift.llm.common import stored
from airsift.llm.jaccard import deduplicated
from airsift.llm.mixing import mix_sources, mixed_rows
from airsift.llm.packing import pack
from airsift.llm.quality import quality_rules
from airsift.llm.toxicity import fit, score_toxicity

_READ = ["doc_id", "text", "source"]
# Every task holds a batch of whole texts several times: as Arrow vectors, as bytes to send,
# and in its Python worker.
BATCH_ROWS = 256
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Pieces of texts whose token ids a Python worker keeps, per generation.
CACHED_PIECES = 200_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
            spark.conf.set(_BATCH, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c.lower() not in _READ]


def _carried(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and beside them the other columns as one: no text
    goes through an operator twice."""
    row = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in _others(docs)])
    return docs.select(*_READ, row.alias("_row"))


def _rows(carried: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs`, in its order."""
    others = {c: F.col(f"_row.`{c}`") for c in _others(docs)}
    return carried.select(*[others.get(c, F.col(c)).alias(c) for c in docs.columns])


@_small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(_carried(docs), model, keep=[*_READ, "_row"])
    return _rows(scored.where("predicted = 0"), docs)


@_small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _rows(quality_rules(_carried(docs), keep=[*_READ, "_row"]).where("kept"), docs)


@_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one of least doc_id."""
    return deduplicated(docs)


@_small_batches
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return _rows(mixed_rows(mix_sources(_carried(docs))), docs)


@_small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return pack(docs, added_tokens=True, cached_pieces=CACHED_PIECES)


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mixing", mixing),
    ("packing", packing),
]

# Toxicity, compression and token ids cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    batch = spark.conf.get(_BATCH)
    try:
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        spark.conf.set(_BATCH, batch)
    return docs
