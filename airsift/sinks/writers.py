"""Writers: CSV, JSON, Parquet. All write one folder per capture, from many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airsift import labels as L
from airsift.operators import networks as N
from airsift.plans import report as R
from airsift.plans.analysis import Analysis
from airsift.sinks.html import write_html_report
from airsift.sinks.frame_store import write_frame_store  # noqa: F401  one of the writers
from airsift.sinks.paths import by_capture, capture_folder, claim_folder, finish, manifest


def _named(columns: list[str], names: list[str]) -> list[str]:
    return [f"{column} AS {name}" for column, name in zip(columns, names, strict=True)]


def networks_csv(networks: DataFrame, ssids: DataFrame) -> DataFrame:
    """Networks with the columns of the CSV file, one row per name. Order by BSSID, SSID."""
    named = N.with_names(networks, ssids)
    columns = ["coalesce(ssid, '')", "bssid", "channel", "average_signal_dbm", "client_count"]
    return named.selectExpr("capture_id", *_named(columns, L.NETWORKS_CSV_COLUMNS))


def clients_csv(clients: DataFrame, ssids: DataFrame) -> DataFrame:
    """Clients with the columns of the CSV file, one row per client and name of its network
    ('' without any), and, last, the column that orders clients of equal packet count."""
    named = N.with_names(clients, ssids)
    columns = ["bssid", "coalesce(ssid, '')", "mac", "packet_count"]
    return named.selectExpr("capture_id", *_named(columns, L.CLIENTS_CSV_COLUMNS), "first_order")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files that hold their texts as they are, blanks at the ends included."""
    (
        by_capture(df).write.partitionBy("capture_id")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_networks_csv(networks: DataFrame, ssids: DataFrame, path: str) -> None:
    write_csv(networks_csv(networks, ssids).orderBy("capture_id", "BSSID", "SSID"), path)


def write_clients_csv(clients: DataFrame, ssids: DataFrame, path: str) -> None:
    order = ["capture_id", "BSSID", F.desc("Paket_Sayisi"), "first_order", "Istemci_MAC", "SSID"]
    write_csv(clients_csv(clients, ssids).orderBy(*order).drop("first_order"), path)


def write_json(df: DataFrame, path: str) -> None:
    by_capture(df).write.partitionBy("capture_id").option("ignoreNullFields", False).json(path)


def write_captures(analysis: Analysis, path: str, captures: DataFrame | None = None) -> None:
    """Which capture is in which folder, as JSON lines; `captures` adds file names."""
    folders = analysis.packet_totals.select("capture_id").withColumn(
        "folder", F.expr(capture_folder())
    )
    if captures is not None:
        names = captures.select("capture_id", "capture_file", "capture_name")
        folders = folders.join(names.dropDuplicates(["capture_id"]), "capture_id", "left")
    folders.write.json(path)


def write_json_report(
    analysis: Analysis, path: str, captures: DataFrame | None = None
) -> None:
    """JSON lines: `envelope/` with one line per capture, and per section of the report a
    folder with one line per element. Built over the rollups, as it needs all tables."""
    analysis = analysis.materialize()
    write_captures(analysis, f"{path}/captures", captures)
    write_json(R.envelope(analysis, captures), f"{path}/envelope")
    for name, table in R.report_sections(analysis).items():
        write_json(table, f"{path}/{name}")


def write_tables(analysis: Analysis, path: str) -> None:
    """Every result table as Parquet."""
    analysis = analysis.materialize()
    for name, table in analysis.tables().items():
        table.write.parquet(f"{path}/{name}")


def write_all(
    analysis: Analysis, path: str, name: str = "report", captures: DataFrame | None = None
) -> str:
    """All report formats under one new folder, which is returned.

    The folder is claimed first and gets its manifest last: two writers at once have two
    folders, and one that was killed leaves a folder that `read_section` refuses. The rollups
    are materialised first, so the frames are read once for all formats.
    """
    spark = analysis.links.sparkSession
    folder = claim_folder(spark, f"{path}/{name}")
    analysis = analysis.materialize(f"{folder}/_rollups")
    write_json_report(analysis, f"{folder}/json", captures)
    write_networks_csv(analysis.networks, analysis.network_ssids, f"{folder}/networks_csv")
    write_clients_csv(analysis.clients, analysis.network_ssids, f"{folder}/clients_csv")
    write_html_report(analysis, f"{folder}/html", captures)
    sections = {f"json/{section}": "json" for section in R.report_sections(analysis)}
    sections |= {"json/captures": "json", "json/envelope": "json", "html": "text"}
    finish(spark, folder, sections | {"networks_csv": "csv", "clients_csv": "csv"})
    return folder


def read_section(
    spark: SparkSession, folder: str, section: str, schema: T.StructType | None = None
) -> DataFrame:
    """One section of a finished report; fails if its writer did not finish."""
    sections = manifest(spark, folder)
    if section not in sections:
        raise KeyError(f"{folder} has no section {section}, but {', '.join(sorted(sections))}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    options = {"header": True, "escape": '"', "emptyValue": "", "nullValue": "\\N"}
    reader = reader.options(**options) if sections[section] == "csv" else reader
    return reader.format(sections[section]).load(f"{folder}/{section}")
