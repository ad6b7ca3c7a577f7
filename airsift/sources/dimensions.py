"""Small fixed dimensions. Each has a known handful of rows, so joins may broadcast them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsift import labels as L
from airsift.functions.text import normalize_oui


def _constant_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """Rows of short texts and numbers as a local relation of the plan."""

    def literal(value: str | int) -> str:
        return str(value) if isinstance(value, int) else "'" + value.replace("'", "\\'") + "'"

    values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def oui_vendors(spark: SparkSession) -> DataFrame:
    return _constant_table(spark, L.OUI_VENDORS, ["oui", "vendor"])


def subtype_names(spark: SparkSession) -> DataFrame:
    return _constant_table(spark, L.SUBTYPE_NAMES, ["code", "name"])


def severity_labels(spark: SparkSession) -> DataFrame:
    rows = [(i, code, label) for i, (code, label) in enumerate(L.SEVERITY_LABELS, 1)]
    return _constant_table(spark, rows, ["position", "severity", "severity_label"])


def with_oui_vendor(df: DataFrame, mac: str, oui: DataFrame | None = None) -> DataFrame:
    """Left join `mac` to its vendor as `oui_vendor` (null if not listed).

    Only the built-in table is broadcast by hint. A table given by the caller, such
    as the full public registry, is left to the optimizer's own size check.
    """
    if oui is None:
        vendors = F.broadcast(oui_vendors(df.sparkSession))
    else:
        vendors = oui.selectExpr("upper(oui) AS oui", "vendor").dropDuplicates(["oui"])
    vendors = vendors.selectExpr("oui AS _oui", "vendor AS oui_vendor")
    keyed = df.selectExpr("*", f"{normalize_oui(mac)} AS _oui")
    return keyed.join(vendors, "_oui", "left").drop("_oui")
