"""A plain HTML report, written as ordered lines.

Every table row becomes one line with its place in the document; the lines are sorted
across the cluster and written into one folder per capture. A small capture is one
file; the files of a larger one, in name order, are the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from airsift.functions.text import literal
from airsift.plans import views as V
from airsift.plans.analysis import Analysis
from airsift.sinks.paths import by_capture

_HEAD = '<!DOCTYPE html><html lang="tr"><head><meta charset="utf-8"></head><body>'
_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]


def escape(c: str) -> str:
    escaped = f"coalesce(CAST({c} AS STRING), '')"
    for plain, entity in _ESCAPES:
        escaped = f"replace({escaped}, {literal(plain)}, {literal(entity)})"
    return escaped


def _tag(tag: str, *content: str) -> str:
    return f"concat('<{tag}>', {', '.join(content)}, '</{tag}>')"


def _cells(*columns: str) -> str:
    return _tag("tr", *[_tag("td", escape(c)) for c in columns])


def html_lines(analysis: Analysis, captures: DataFrame | None = None) -> DataFrame:
    """Lines of all documents: (capture_id, section, part, place, line)."""
    summary = V.summary_cards(analysis.summary, captures)
    title = escape("capture_name" if captures is not None else "capture_id")
    totals = _tag("table", _cells("total_packets_text", "network_count", "eapol_packet_count"))

    def lines(df: DataFrame, section: int, line: str, part="''", place="0L") -> DataFrame:
        return df.selectExpr(
            "capture_id",
            f"{section} AS section",
            f"{part} AS part",
            f"CAST({place} AS BIGINT) AS place",
            f"{line} AS line",
        )

    names = V.network_table(analysis.networks, analysis.network_ssids, "report")
    networks = analysis.networks.selectExpr("*", *V._display("report"))
    listed = V.report_networks(analysis.networks, analysis.clients)
    finding = _tag("b", escape("concat_ws(' ', severity_label, category_label, title)"))
    network = _cells("bssid", "channel_text", "signal_text", "client_count")
    parts = [
        lines(summary, 0, literal(_HEAD)),
        lines(summary, 1, f"concat({_tag('h1', title)}, {totals})"),
        lines(
            V.report_findings(analysis),
            2,
            _tag("p", finding, "' '", escape("description")),
            place="coalesce(rule_no, 0)",
        ),
        lines(names, 3, _tag("h2", escape("ssid_text")), part="bssid", place="-2L"),
        lines(networks, 3, f"concat('<table>', {network})", part="bssid", place="-1L"),
        lines(
            listed.where("mac IS NOT NULL"),
            3,
            _cells(*V.CLIENT_DETAIL),
            part="bssid",
            place="rank",
        ),
        lines(
            listed.where("coalesce(rank, 1) = 1"),
            3,
            f"concat('</table>', {_tag('p', escape('note'))})",
            part="bssid",
            place=f"{2**31}L",
        ),
        lines(summary, 4, "'<table>'"),
        lines(
            analysis.frame_subtypes,
            5,
            _cells("subtype", "packet_count"),
            part=f"format_string('%020d', {2**62}L - packet_count)",
            place="first_seq",
        ),
        lines(summary, 6, "'</table></body></html>'"),
    ]
    document = parts[0]
    for part in parts[1:]:
        document = document.unionByName(part)
    return document


def write_html_report(
    analysis: Analysis, path: str, captures: DataFrame | None = None
) -> None:
    """One folder of lines per capture, built over the rollups."""
    ordered = html_lines(analysis.materialize(), captures).orderBy(
        "capture_id", "section", "part", "place", "line"
    )
    by_capture(ordered.select("capture_id", "line")).write.partitionBy("capture_id").text(path)
