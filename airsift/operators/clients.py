"""Client devices: who talked on which network, how much and when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airsift import labels as L
from airsift.functions import measures, text
from airsift.operators.ranking import exact_rank, top_k
from airsift.operators.rollups import TIME_BOUNDS, aggregates
from airsift.sources.dimensions import with_oui_vendor

CLIENT_KEYS = ["capture_id", "bssid", "mac"]


def client_order() -> list:
    """Clients of a network: most packets first, then by first appearance."""
    return [F.desc("packet_count"), F.asc("first_order"), F.asc("mac")]


def endpoints(links: DataFrame) -> DataFrame:
    """Source and destination of each link on a valid network, as candidate clients.

    A link whose ends are equal gives two rows, each both sender and receiver.
    `first_order` orders endpoints by packet, the source before the destination.
    """
    sides = "inline(array(struct(src AS mac, 0 AS side), struct(dst AS mac, 1 AS side)))"
    return (
        links.where("bssid <> ''")
        .selectExpr("*", sides)
        .where(f"mac <> bssid AND NOT {text.is_ignored_mac('mac')}")
        .selectExpr(
            "capture_id",
            "bssid",
            "mac",
            "n",
            "CASE WHEN mac = src THEN n ELSE 0L END AS sent",
            "CASE WHEN mac = dst THEN n ELSE 0L END AS received",
            "first_seq * 2 + side AS first_order",
            "first_ts_seq",
            "first_ts",
            "last_ts_seq",
            "last_ts",
        )
    )


def client_counts(links: DataFrame) -> DataFrame:
    """Packets per (capture, bssid, mac), without times."""
    counts = aggregates("sum(n) AS packet_count", "min(first_order) AS first_order")
    return endpoints(links).groupBy(*CLIENT_KEYS).agg(*counts)


def clients(links: DataFrame, oui: DataFrame | None = None) -> DataFrame:
    """One row per (capture, bssid, mac). Order by packet_count desc, first_order.

    The vendor is looked up after the aggregation, once per client.
    """
    sums = aggregates(
        "sum(n) AS packet_count",
        "sum(sent) AS sent_packets",
        "sum(received) AS received_packets",
        "min(first_order) AS first_order",
        *TIME_BOUNDS,
    )
    counted = endpoints(links).groupBy(*CLIENT_KEYS).agg(*sums)
    return with_oui_vendor(counted, "mac", oui).selectExpr(
        *CLIENT_KEYS,
        f"{text.vendor_label('mac', 'oui_vendor')} AS vendor",
        "packet_count",
        "sent_packets",
        "received_packets",
        f"{measures.seen_time('first_ts')} AS first_seen",
        f"{measures.seen_time('last_ts')} AS last_seen",
        f"{measures.activity_level('packet_count')} AS activity_level",
        "first_order",
    )


def ranked_clients(clients: DataFrame) -> DataFrame:
    """Every client with its exact rank in its network, however large the network."""
    return exact_rank(clients, ["capture_id", "bssid"], "packet_count", "first_order", "mac")


def top_clients(clients: DataFrame, n: int) -> DataFrame:
    """The first n clients of every network, with their rank."""
    return top_k(clients, ["capture_id", "bssid"], client_order(), n)


def client_totals(counts: DataFrame) -> DataFrame:
    """Packets per (capture, mac) over all networks, and where the client comes first:
    the lowest bssid and, there, its place among the clients."""
    totals = aggregates(
        "sum(packet_count) AS packet_count",
        "min(struct(bssid, -packet_count AS fewer, first_order)) AS place",
    )
    return counts.groupBy("capture_id", "mac").agg(*totals)


def distinct_client_count(counts: DataFrame) -> DataFrame:
    """Exact number of client MACs per capture: deduplicated by a shuffle, then counted."""
    macs = counts.select("capture_id", "mac").distinct()
    return macs.groupBy("capture_id").agg(F.count("*").alias("client_count"))


def active_client_chart(counts: DataFrame, n: int = L.CHART_ROWS) -> DataFrame:
    order = [F.desc("packet_count"), F.asc("place")]
    top = top_k(client_totals(counts), ["capture_id"], order, n)
    largest = F.max("packet_count").over(Window.partitionBy("capture_id"))
    return top.withColumn("largest", largest).selectExpr(
        "capture_id",
        "rank",
        "mac",
        "packet_count",
        f"{measures.grouped_number('packet_count')} AS value_text",
        f"{measures.share_of_max('packet_count', 'largest')} AS progress",
    )


def search_clients(clients: DataFrame, query: str) -> DataFrame:
    """Clients whose MAC or vendor contains the text, in any case."""
    wanted = query.strip().lower()
    if not wanted:
        return clients
    return clients.where(F.lower("mac").contains(wanted) | F.lower("vendor").contains(wanted))
