"""Where intermediate tables go."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; every executor must reach it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder


def new_work_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/airsift-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Write a table and return a scan of it. Cuts the lineage: a lost executor costs
    a re-read, not a re-run, and later scans read only the columns they need."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def all_written(
    tables: dict[str, DataFrame],
    folder: str,
    path: Callable[[str], str] | None = None,
    mode: str = "error",
) -> dict[str, DataFrame]:
    """Write independent tables at the same time, so that one's last tasks do not leave
    the cluster idle. `path` gives the place of a table, by default one under `folder`."""
    place = path or (lambda name: f"{folder}/{name}")
    with ThreadPoolExecutor(len(tables)) as pool:
        scans = pool.map(lambda item: written(item[1], place(item[0]), mode), tables.items())
        return dict(zip(tables, scans, strict=True))
