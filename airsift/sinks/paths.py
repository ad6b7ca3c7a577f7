"""Output folders: named by capture, never replacing earlier results, complete or not there."""

from __future__ import annotations

import json
from itertools import count

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLAIM = "_claim"
MANIFEST = "manifest.json"


class IncompleteReport(RuntimeError):
    """A report folder that its writer has not finished."""


def capture_folder(c: str = "capture_id") -> str:
    """SQL for the folder name of a capture. An id of up to 64 bytes is the name; of a longer
    one, such as the path of a file, its md5 and its end: names are limited by file systems."""
    end = f"right(regexp_replace({c}, '[^A-Za-z0-9._-]', '_'), 40)"
    return f"CASE WHEN octet_length({c}) <= 64 THEN {c} ELSE concat(md5({c}), '-', {end}) END"


def by_capture(df: DataFrame) -> DataFrame:
    """`df` with the folder name in place of the capture id, to be partitioned by it."""
    return df.withColumn("capture_id", F.expr(capture_folder()))


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def create_new(spark: SparkSession, path: str, content: str) -> bool:
    """Write a small new file; False if it is there already.

    Of several writers one succeeds. Hadoop's local file system looks before it writes, so
    there the file is created by the operating system.
    """
    jvm = spark.sparkContext._jvm
    system, target = _file_system(spark, path)
    exists = ("FileAlreadyExistsException", "AlreadyBeingCreatedException")
    try:
        system.mkdirs(target.getParent())
        if system.getUri().getScheme() == "file":
            if not jvm.java.io.File(target.toUri().getPath()).createNewFile():
                return False
            stream = system.create(target, True)
        else:
            stream = system.create(target, False)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() in exists:
            return False
        raise
    stream.write(bytearray(content.encode()))
    stream.close()
    return True


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file, such as a manifest."""
    system, target = _file_system(spark, path)
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder; none if there is no such folder."""
    system, target = _file_system(spark, folder)
    if not system.exists(target):
        return []
    return [status.getPath().getName() for status in system.listStatus(target)]


def next_free_path(spark: SparkSession, path: str) -> str:
    """`path`, or `path_1`, `path_2`, ... if it exists already."""
    base = path.rstrip("/")
    for number in count():
        candidate = base if number == 0 else f"{base}_{number}"
        system, target = _file_system(spark, candidate)
        if not system.exists(target):
            return candidate
    raise AssertionError("unreachable")


def claim_folder(spark: SparkSession, path: str) -> str:
    """The next free path, claimed: writers at the same time get folders of their own."""
    while True:
        folder = next_free_path(spark, path)
        if create_new(spark, f"{folder}/{CLAIM}", "{}"):
            return folder


def finish(spark: SparkSession, folder: str, sections: dict[str, str]) -> None:
    """Write the manifest: section to format. Its presence says that the folder is complete."""
    if not create_new(spark, f"{folder}/{MANIFEST}", json.dumps(sections, indent=1)):
        raise FileExistsError(f"{folder} is finished already")


def manifest(spark: SparkSession, folder: str) -> dict[str, str]:
    """The sections of a finished folder; fails if it is not finished."""
    system, target = _file_system(spark, f"{folder}/{MANIFEST}")
    if not system.exists(target):
        raise IncompleteReport(f"{folder} has no manifest: its writer did not finish")
    return json.loads(read_small(spark, f"{folder}/{MANIFEST}"))
