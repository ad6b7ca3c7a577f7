"""EAPOL packets and handshake candidates.

Addresses are not checked here: broadcast or damaged addresses count as clients, and
a bssid need not be a network.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsift import labels as L
from airsift.functions import measures
from airsift.functions.text import literal
from airsift.operators.normalize import eapol_frames
from airsift.operators.ranking import top_k
from airsift.operators.rollups import aggregates


def eapol_packets(frames: DataFrame) -> DataFrame:
    """One row per EAPOL packet; `seq` is the packet order in a capture."""
    return eapol_frames(frames).selectExpr(
        "capture_id",
        "seq",
        "frame_number",
        "ts_raw AS timestamp",
        "src AS source",
        "dst AS destination",
        "bssid",
        "eapol AS eapol_type",
    )


def first_eapol_packets(eapol: DataFrame, n: int = L.CLI_EAPOL) -> DataFrame:
    """The first n EAPOL packets of every capture, and how many there are beyond them."""
    totals = eapol.groupBy("capture_id").agg(F.expr("count(*) AS _total"))
    first = top_k(eapol, ["capture_id"], [F.asc("seq")], n)
    return first.join(totals, "capture_id").selectExpr(
        *first.columns, f"{measures.remaining('_total', n)} AS remaining"
    )


def handshake_candidates(eapol: DataFrame) -> DataFrame:
    """EAPOL packets per (capture, bssid, client). Order by first_seq.

    The client is the source, or the destination where the source is empty or the
    access point itself; packets with neither are left out.
    """
    client = (
        "CASE WHEN source <> '' AND source <> bssid THEN source "
        "WHEN destination <> '' AND destination <> bssid THEN destination END AS client"
    )
    groups = aggregates(
        "count(*) AS eapol_packet_count",
        "min_by(timestamp, seq) AS first_seen",
        "max_by(timestamp, seq) AS last_seen",
        "min(seq) AS first_seq",
        f"{measures.handshake_status('count(*)')} AS status",
    )
    paired = eapol.where("bssid <> ''").selectExpr("*", client).where("client IS NOT NULL")
    return paired.groupBy("capture_id", "bssid", "client").agg(*groups)


def with_status(candidates: DataFrame, status: str) -> DataFrame:
    return candidates.where(F.col("status") == status)


def status_counts(candidates: DataFrame, *keys: str) -> DataFrame:
    counts = aggregates(
        f"count_if(status = {literal(L.HANDSHAKE_STRONG)}) AS strong",
        f"count_if(status = {literal(L.HANDSHAKE_PARTIAL)}) AS partial",
    )
    return candidates.groupBy(*keys).agg(*counts)


def network_verdicts(networks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Handshake verdict of every network; strong candidates win over partial ones."""
    counts = status_counts(candidates, "capture_id", "bssid")
    return (
        networks.join(counts, ["capture_id", "bssid"], "left")
        .fillna(0, ["strong", "partial"])
        .selectExpr("*", f"{measures.handshake_verdict('strong', 'partial')} AS verdict")
    )


def network_handshakes(
    candidates: DataFrame, bssid: str | None = None, capture_id: str | None = None
) -> DataFrame:
    """Handshake detail rows, optionally of one network (in any case) or capture."""
    if capture_id is not None:
        candidates = candidates.where(F.col("capture_id") == capture_id)
    if bssid is not None:
        candidates = candidates.where(F.lower("bssid") == bssid.lower())
    return candidates.selectExpr(
        "capture_id",
        "bssid",
        "client",
        "eapol_packet_count",
        f"{measures.handshake_status_text('status')} AS status_text",
        "first_seen",
        "last_seen",
    )
