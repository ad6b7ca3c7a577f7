"""Additive facts about frames: the common input of all aggregate tables.

Two shapes carry everything the tables need:

* `links`  per (capture, bssid, src, dst): frames, first frame, first/last timestamp;
* `radio`  per (capture, bssid, channel, ssid, sub): frames, first frame, signal sum
  and count, EAPOL frames.

An address that is no valid MAC is '' in both.

The `frame_*` functions give one such row per frame, a projection without a shuffle,
for a single query. The `rollup_*` functions aggregate them: one column-pruned scan
and one shuffle of partial aggregates each, after which nothing reads the frames
again. Both give the same results downstream, as every consumer sums, or takes the
first or last by sequence number. All buffers are numeric, so both are hash
aggregates, and a hot address costs one row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINK_KEYS = ["capture_id", "bssid", "src", "dst"]
RADIO_KEYS = ["capture_id", "bssid", "channel", "ssid", "sub"]


def _valid(address: str) -> str:
    return f"CASE WHEN {address}_ok THEN {address} ELSE '' END AS {address}"


def frame_links(frames: DataFrame) -> DataFrame:
    timed_seq = "CASE WHEN ts IS NOT NULL THEN seq END"
    return frames.selectExpr(
        "capture_id",
        _valid("bssid"),
        _valid("src"),
        _valid("dst"),
        "1L AS n",
        "seq AS first_seq",
        f"{timed_seq} AS first_ts_seq",
        "ts AS first_ts",
        f"{timed_seq} AS last_ts_seq",
        "ts AS last_ts",
    )


def frame_radio(frames: DataFrame) -> DataFrame:
    return frames.selectExpr(
        "capture_id",
        _valid("bssid"),
        "channel",
        "ssid",
        "sub",
        "1L AS n",
        "seq AS first_seq",
        "CAST(coalesce(sig, 0) AS BIGINT) AS sig_sum",
        "CAST(sig IS NOT NULL AS BIGINT) AS sig_n",
        "CAST(eapol <> '' AS BIGINT) AS eapol_n",
    )


def aggregates(*sql: str) -> list[Column]:
    return [F.expr(s) for s in sql]


# First and last timestamp in packet order; rows without one do not count.
TIME_BOUNDS = [
    "min(first_ts_seq) AS first_ts_seq",
    "min_by(first_ts, first_ts_seq) AS first_ts",
    "max(last_ts_seq) AS last_ts_seq",
    "max_by(last_ts, last_ts_seq) AS last_ts",
]


def summed_links(links: DataFrame) -> DataFrame:
    sums = aggregates("sum(n) AS n", "min(first_seq) AS first_seq", *TIME_BOUNDS)
    return links.groupBy(*LINK_KEYS).agg(*sums)


def summed_radio(radio: DataFrame) -> DataFrame:
    sums = aggregates(
        "sum(n) AS n",
        "min(first_seq) AS first_seq",
        "sum(sig_sum) AS sig_sum",
        "sum(sig_n) AS sig_n",
        "sum(eapol_n) AS eapol_n",
    )
    return radio.groupBy(*RADIO_KEYS).agg(*sums)


def rollup_links(frames: DataFrame) -> DataFrame:
    return summed_links(frame_links(frames))


def rollup_radio(frames: DataFrame) -> DataFrame:
    return summed_radio(frame_radio(frames))
