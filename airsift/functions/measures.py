"""Numeric and display expressions over aggregated rows, as SQL text."""

from __future__ import annotations

from airsift import labels as L
from airsift.functions.text import literal


def mean_2dp(total: str, n: str) -> str:
    """`total / n` rounded to two decimals; null if there is nothing to average.

    The exact binary quotient is rounded, half to even, as IEEE tools do.
    `format_number` does so; `round` and `bround` go through the shortest decimal text
    and miss some three-decimal ties.
    """
    mean = f"CAST({total} AS DOUBLE) / nullif({n}, 0)"
    return f"CAST(translate(format_number({mean}, 2), ',', '') AS DOUBLE)"


def activity_level(packets: str) -> str:
    return (
        f"CASE WHEN {packets} >= {L.ACTIVITY_HIGH_FROM} THEN {literal(L.ACTIVITY_HIGH)} "
        f"WHEN {packets} >= {L.ACTIVITY_MEDIUM_FROM} THEN {literal(L.ACTIVITY_MEDIUM)} "
        f"ELSE {literal(L.ACTIVITY_LOW)} END"
    )


def seen_time(ts: str) -> str:
    """Epoch seconds as HH:MM:SS in the session time zone, a dash if there are none."""
    instant = f"timestamp_micros(try_cast(rint({ts} * 1e6D) AS BIGINT))"
    return f"coalesce(date_format({instant}, 'HH:mm:ss'), {literal(L.NO_VALUE)})"


def handshake_status(packets: str) -> str:
    return (
        f"CASE WHEN {packets} >= {L.HANDSHAKE_STRONG_FROM} "
        f"THEN {literal(L.HANDSHAKE_STRONG)} ELSE {literal(L.HANDSHAKE_PARTIAL)} END"
    )


def handshake_status_text(status: str) -> str:
    strong, partial = (
        literal(L.HANDSHAKE_STATUS_TEXT[s]) for s in (L.HANDSHAKE_STRONG, L.HANDSHAKE_PARTIAL)
    )
    return f"CASE WHEN {status} = {literal(L.HANDSHAKE_STRONG)} THEN {strong} ELSE {partial} END"


def handshake_verdict(strong: str, partial: str) -> str:
    return (
        f"CASE WHEN {strong} > 0 THEN format_string({literal(L.VERDICT_STRONG)}, {strong}) "
        f"WHEN {partial} > 0 THEN format_string({literal(L.VERDICT_PARTIAL)}, {partial}) "
        f"ELSE {literal(L.VERDICT_NONE)} END"
    )


def ssid_text(ssid: str, surface: str = "table") -> str:
    """A name for display; `surface` picks the text for a network without any."""
    return f"coalesce({ssid}, {literal(L.SSID_FALLBACK[surface])})"


def channel_text(channel: str, surface: str = "table") -> str:
    return f"coalesce({channel}, {literal(L.VALUE_FALLBACK[surface])})"


def signal_text(signal: str, surface: str = "table") -> str:
    shown = f"concat(CAST({signal} AS STRING), ' dBm')"
    return f"coalesce({shown}, {literal(L.VALUE_FALLBACK[surface])})"


def grouped_number(n: str) -> str:
    """Whole number with thousands separators."""
    return f"format_number({n}, 0)"


def dbm_text(signal: str) -> str:
    return f"concat(translate(format_number({signal}, 1), ',', ''), ' dBm')"


def share_of_max(n: str, largest: str) -> str:
    """Whole percent of the largest value, 0 to 100."""
    percent = f"least(greatest(CAST({n} / {largest} * 100 AS INT), 0), 100)"
    return f"CASE WHEN {largest} > 0 THEN {percent} ELSE 0 END"


def signal_scale(signal: str) -> str:
    """-100 dBm to -30 dBm as 0 to 100."""
    return f"CAST(least(greatest(({signal} + 100) / 70 * 100, 0D), 100D) AS INT)"


def severity_label(label: str) -> str:
    return f"coalesce({label}, {literal(L.SEVERITY_DEFAULT_LABEL)})"


def category_label(category: str) -> str:
    return f"upper(coalesce({category}, {literal(L.CATEGORY_DEFAULT)}))"


def remaining(n: str, shown: int) -> str:
    return f"greatest({n} - {shown}, 0L)"
