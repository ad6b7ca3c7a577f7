"""Rule-based findings per capture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsift import labels as L
from airsift.functions import measures, text
from airsift.functions.text import literal
from airsift.operators.handshakes import status_counts
from airsift.operators.rollups import aggregates
from airsift.sources.dimensions import severity_labels, with_oui_vendor

_FACTS = [
    "strong",
    "partial",
    "randomized",
    "hidden",
    "weak",
    "busy_clients",
    "busiest_mac",
    "busiest_packets",
    "unknown_vendor",
]


def client_class_counts(
    client_counts: DataFrame, oui: DataFrame | None = None, busy_from: int = L.BUSY_CLIENT_FROM
) -> DataFrame:
    """Per capture: distinct randomised and unknown-vendor MACs, client rows of at least
    `busy_from` packets, and the first of the busiest of these (by bssid, then by place
    in the network).

    Clients are first reduced to one row per MAC, across the cluster, so counting
    distinct ones needs no set of MACs in any task.
    """
    place = "struct(-packet_count AS fewer, bssid, first_order)"
    per_mac = aggregates(
        f"count_if(packet_count >= {busy_from}) AS busy",
        f"min(CASE WHEN packet_count >= {busy_from} THEN {place} END) AS place",
    )
    label = f"{text.vendor_label('mac', 'oui_vendor')} AS vendor"
    macs = with_oui_vendor(client_counts.groupBy("capture_id", "mac").agg(*per_mac), "mac", oui)
    classes = aggregates(
        f"count_if(vendor = {literal(L.VENDOR_RANDOMIZED)}) AS randomized",
        f"count_if(vendor = {literal(L.VENDOR_UNKNOWN)}) AS unknown_vendor",
        "sum(busy) AS busy_clients",
        "min_by(mac, place) AS busiest_mac",
        "-min(place).fewer AS busiest_packets",
    )
    return macs.selectExpr("*", label).groupBy("capture_id").agg(*classes)


def network_class_counts(network_measures: DataFrame) -> DataFrame:
    """Networks without any SSID and networks with a weak average signal, per capture."""
    classes = aggregates(
        "count_if(ssid_count = 0) AS hidden",
        f"count_if(average_signal_dbm <= {L.WEAK_SIGNAL_DBM}) AS weak",
    )
    return network_measures.groupBy("capture_id").agg(*classes)


def _finding(rule: int, when: str, finding: tuple, n: str, *more: str) -> str:
    """SQL of one rule: a finding where it fires, else null."""
    severity, category, title, description = finding
    args = [n, *more][: description.count("%")]
    shown = literal(description)
    if args:
        shown = f"format_string({shown}, {', '.join(args)})"
    return (
        f"CASE WHEN {when} THEN struct({rule} AS rule_no, {literal(severity)} AS severity, "
        f"{literal(category)} AS category, {literal(title)} AS title, "
        f"{shown} AS description, {n} AS n) END"
    )


def _rules(busy_from: int) -> list[str]:
    severity, category, title, description = L.FINDING_BUSY
    shown = description.replace("{busy_from}", f"{busy_from:,}".replace(",", "."))
    return [*_FIXED_RULES, _finding(*_BUSY_RULE, (severity, category, title, shown), *_BUSIEST)]


_BUSY_RULE = (5, "busy_clients > 0")
_BUSIEST = ("busy_clients", "busiest_mac", "busiest_packets")
_FIXED_RULES = [
    _finding(1, "strong > 0", L.FINDING_STRONG, "strong"),
    _finding(1, "strong = 0 AND partial > 0", L.FINDING_PARTIAL, "partial"),
    _finding(1, "strong = 0 AND partial = 0", L.FINDING_NO_HANDSHAKE, "0L"),
    _finding(2, "randomized > 0", L.FINDING_RANDOMIZED, "randomized"),
    _finding(3, "hidden > 0", L.FINDING_NO_SSID, "hidden"),
    _finding(4, "weak > 0", L.FINDING_WEAK, "weak"),
    _finding(6, "unknown_vendor > 0", L.FINDING_UNKNOWN_VENDOR, "unknown_vendor"),
]


def findings(
    captures: DataFrame,
    candidates: DataFrame,
    network_measures: DataFrame,
    client_counts: DataFrame,
    oui: DataFrame | None = None,
    busy_from: int = L.BUSY_CLIENT_FROM,
) -> DataFrame:
    """One row per rule that fires, numbered in rule order.

    Every input is reduced to one row of counts per capture; the rows are united and
    grouped once, so that a capture without handshakes or clients needs no outer join.
    """
    parts = [
        captures.select("capture_id"),
        status_counts(candidates, "capture_id"),
        network_class_counts(network_measures),
        client_class_counts(client_counts, oui, busy_from),
    ]
    facts = parts[0]
    for part in parts[1:]:
        facts = facts.unionByName(part, allowMissingColumns=True)
    # At most one part has a value for a fact, so max picks it.
    facts = facts.groupBy("capture_id").agg(*aggregates(*[f"max({c}) AS {c}" for c in _FACTS]))
    fired = f"inline(array_compact(array({', '.join(_rules(busy_from))})))"
    return facts.fillna(0).selectExpr("capture_id", fired)


def with_labels(findings: DataFrame) -> DataFrame:
    """Findings with their displayed severity and category."""
    labels = F.broadcast(severity_labels(findings.sparkSession)).drop("position")
    return findings.join(labels, "severity", "left").selectExpr(
        *findings.columns,
        f"{measures.severity_label('severity_label')} AS severity_label",
        f"{measures.category_label('category')} AS category_label",
    )


def severity_counts(captures: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings per severity, zeros kept, and their total, per capture."""
    parts = captures.select("capture_id").unionByName(
        findings.select("capture_id", "severity"), allowMissingColumns=True
    )
    codes = [code for code, _ in L.SEVERITY_LABELS]
    counts = parts.groupBy("capture_id").agg(
        *aggregates(*[f"count_if(severity = '{code}') AS {code}" for code in codes]),
        F.expr("count(severity) AS total"),
    )
    rows = ", ".join(
        f"struct({i} AS position, '{code}' AS severity, '{label}' AS severity_label, "
        f"{code} AS finding_count)"
        for i, (code, label) in enumerate(L.SEVERITY_LABELS, 1)
    )
    return counts.selectExpr("capture_id", "total", f"inline(array({rows}))")


def shown_findings(captures: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings for display; a capture without any shows the placeholder text."""
    shown = captures.select("capture_id").join(with_labels(findings), "capture_id", "left")
    return shown.selectExpr(
        "capture_id",
        "rule_no",
        f"coalesce(severity_label, {literal(L.SEVERITY_DEFAULT_LABEL)}) AS severity_label",
        f"{measures.category_label('category')} AS category_label",
        f"coalesce(title, {literal(L.NO_FINDINGS_TEXT)}) AS title",
        "coalesce(description, '') AS description",
    )
