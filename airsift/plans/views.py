"""Tables as they are shown: network lists, details, report sections, text summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsift import labels as L
from airsift.functions import measures
from airsift.functions.text import literal
from airsift.operators import clients as C
from airsift.operators import findings as D
from airsift.operators import handshakes as H
from airsift.operators import networks as N
from airsift.operators import traffic as T
from airsift.plans.analysis import Analysis

CLIENT_DETAIL = [
    "mac",
    "vendor",
    "packet_count",
    "sent_packets",
    "received_packets",
    "first_seen",
    "last_seen",
    "activity_level",
]


def network_table(
    networks: DataFrame, ssids: DataFrame, surface: str = "table"
) -> DataFrame:
    """Networks with display texts, one row per name. `surface` is `table`, `report` or
    `cli`, which differ in the text for a missing SSID, channel or signal."""
    return N.with_names(networks, ssids).selectExpr(
        "capture_id",
        "bssid",
        f"{measures.ssid_text('ssid', surface)} AS ssid_text",
        *_display(surface),
        "client_count",
    )


def _display(surface: str) -> list[str]:
    return [
        f"{measures.channel_text('channel', surface)} AS channel_text",
        f"{measures.signal_text('average_signal_dbm', surface)} AS signal_text",
    ]


def networks_with_clients(
    networks: DataFrame, clients: DataFrame, n: int, surface: str
) -> DataFrame:
    """Every network with its first n clients, one row per client; a network without
    clients keeps one row. `remaining` counts the clients not listed. Names of networks
    are in `network_table`."""
    n = max(n, 0)
    listed = C.top_clients(clients, n).select("capture_id", "bssid", "rank", *CLIENT_DETAIL)
    shown = networks.selectExpr(
        "capture_id", "bssid", "ssid_count", *_display(surface), "client_count"
    )
    return shown.join(listed, ["capture_id", "bssid"], "left").selectExpr(
        "*", f"{measures.remaining('client_count', n)} AS remaining"
    )


def report_networks(networks: DataFrame, clients: DataFrame) -> DataFrame:
    """Network section of a report: the first 25 clients and the note under them."""
    n = L.REPORT_CLIENTS
    note = (
        f"CASE WHEN client_count = 0 THEN {literal(L.NO_CLIENTS_NOTE)} WHEN client_count > {n} "
        f"THEN format_string({literal(L.MORE_CLIENTS_NOTE)}, client_count) ELSE '' END AS note"
    )
    return networks_with_clients(networks, clients, n, "report").selectExpr("*", note)


def report_findings(analysis: Analysis) -> DataFrame:
    return D.shown_findings(analysis.packet_totals, analysis.findings)


def report_subtypes(subtypes: DataFrame) -> DataFrame:
    """Subtype section, most packets first in every capture."""
    return subtypes.orderBy("capture_id", F.desc("packet_count"), "first_seq").select(
        "capture_id", "subtype", "packet_count"
    )


def summary_cards(summary: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """Capture summary for display; `captures` (see `list_captures`) adds file names."""
    if captures is not None:
        names = captures.select("capture_id", "capture_name", "capture_file")
        summary = summary.join(names.dropDuplicates(["capture_id"]), "capture_id", "left")
    return summary.selectExpr(
        "*", f"{measures.grouped_number('total_packets')} AS total_packets_text"
    )


def network_details(
    analysis: Analysis, bssid: str | None = None, capture_id: str | None = None
) -> DataFrame:
    """Detail rows of all networks, or of the selected one, one per name. The EAPOL number is that of
    the whole capture."""
    networks, candidates = analysis.networks, analysis.handshake_candidates
    ssids = analysis.network_ssids
    totals = analysis.packet_totals.select("capture_id", "eapol_packet_count")
    if capture_id is not None:
        networks = networks.where(F.col("capture_id") == capture_id)
    if bssid is not None:
        networks = networks.where(F.col("bssid") == bssid)
    verdicts = H.network_verdicts(networks, candidates)
    return N.with_names(verdicts, ssids).join(totals, "capture_id").selectExpr(
        "capture_id",
        "bssid",
        f"{measures.ssid_text('ssid')} AS ssid_text",
        *_display("table"),
        "client_count",
        "eapol_packet_count",
        "verdict",
    )


def client_details(
    clients: DataFrame,
    bssid: str | None = None,
    mac: str | None = None,
    capture_id: str | None = None,
) -> DataFrame:
    """The eight client fields of all clients, or of the selected one."""
    selected = {"capture_id": capture_id, "bssid": bssid, "mac": mac}
    for column, value in selected.items():
        if value is not None:
            clients = clients.where(F.col(column) == value)
    return clients.select("capture_id", "bssid", *CLIENT_DETAIL)


def text_summary(analysis: Analysis, show_clients: int = L.CLI_CLIENTS) -> dict[str, DataFrame]:
    """The tables of the terminal summary."""
    clients = networks_with_clients(
        analysis.networks, analysis.clients, show_clients, "cli"
    ).drop(*[c for c in CLIENT_DETAIL if c not in ("mac", "packet_count")])
    return {
        "totals": analysis.summary,
        "networks": clients,
        "network_names": network_table(analysis.networks, analysis.network_ssids, "cli"),
        "subtypes": report_subtypes(analysis.frame_subtypes),
        "top_sources": T.top_talkers(analysis.links, "src", L.CLI_TOP_SOURCES),
        "eapol_packets": H.first_eapol_packets(analysis.eapol_packets),
    }
