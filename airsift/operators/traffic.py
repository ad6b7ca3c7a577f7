"""Packet totals, subtype distribution and top talkers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airsift import labels as L
from airsift.functions import measures, text
from airsift.operators.ranking import top_k
from airsift.operators.rollups import aggregates
from airsift.sources.dimensions import subtype_names


def packet_totals(radio: DataFrame) -> DataFrame:
    """Packets and EAPOL packets per capture."""
    sums = aggregates("sum(n) AS total_packets", "sum(eapol_n) AS eapol_packet_count")
    return radio.groupBy("capture_id").agg(*sums)


def frame_subtypes(radio: DataFrame, decimal_codes: bool = False) -> DataFrame:
    """Packets per subtype label. Order by packet_count desc, first_seq.

    Codes are matched as text. `decimal_codes` first turns hexadecimal codes into
    decimal ones, for exports that write them so.
    """
    code = text.decimal_subtype("sub") if decimal_codes else "sub"
    counts = (
        radio.where("sub <> ''")
        .groupBy("capture_id", F.expr(f"{code} AS code"))
        .agg(*aggregates("sum(n) AS packet_count", "min(first_seq) AS first_seq"))
    )
    names = F.broadcast(subtype_names(radio.sparkSession))
    return counts.join(names, "code", "left").selectExpr(
        "capture_id",
        f"{text.subtype_label('code', 'name')} AS subtype",
        "packet_count",
        "first_seq",
    )


def subtype_chart(subtypes: DataFrame, n: int = L.CHART_ROWS) -> DataFrame:
    top = top_k(subtypes, ["capture_id"], [F.desc("packet_count"), F.asc("first_seq")], n)
    largest = F.max("packet_count").over(Window.partitionBy("capture_id"))
    return top.withColumn("largest", largest).selectExpr(
        "capture_id",
        "rank",
        "subtype",
        "packet_count",
        f"{measures.grouped_number('packet_count')} AS value_text",
        f"{measures.share_of_max('packet_count', 'largest')} AS progress",
    )


def talkers(links: DataFrame, side: str) -> DataFrame:
    """Packets per valid MAC on one side (`src` or `dst`), broadcast and BSSIDs included."""
    counts = aggregates("sum(n) AS packet_count", "min(first_seq) AS first_seq")
    valid = links.where(f"{side} <> ''")
    return valid.groupBy("capture_id", F.col(side).alias("mac")).agg(*counts)


def top_talkers(links: DataFrame, side: str, n: int = L.TOP_TALKERS) -> DataFrame:
    """The n busiest MACs of one side per capture, ties to the one seen first."""
    order = [F.desc("packet_count"), F.asc("first_seq"), F.asc("mac")]
    top = top_k(talkers(links, side), ["capture_id"], order, n)
    return top.select("capture_id", "rank", "mac", "packet_count")
