"""Raw text frames to typed frames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from airsift.functions import text
from airsift.schema import SEQ_MISSING


def sequence_number(frame_number: str) -> str:
    """Packet order inside a capture; frames without a usable number come last."""
    digits = f"CASE WHEN {text.matches(frame_number, r'^[0-9]+\z')} THEN {frame_number} END"
    return f"coalesce(nullif(least(try_cast({digits} AS BIGINT), {SEQ_MISSING}L), {SEQ_MISSING}L), {SEQ_MISSING}L)"


def _projection() -> list[str]:
    frame_number = text.first_value("frame_number")
    ts_raw = text.first_value("timestamp")
    columns = {
        "capture_id": "capture_id",
        "seq": sequence_number(frame_number),
        "frame_number": frame_number,
        "ts_raw": ts_raw,
        "ts": text.parse_double(ts_raw),
        "sub": text.first_value("frame_subtype"),
    }
    for name, field in (("src", "source"), ("dst", "destination"), ("bssid", "bssid")):
        address = text.normalize_mac(field)
        columns[name] = address
        columns[f"{name}_ok"] = text.is_valid_mac(address)
    columns |= {
        "ssid": text.first_value("ssid"),
        "channel": text.first_value("channel"),
        "sig": text.parse_signal("signal"),
        "eapol": text.first_value("eapol_type"),
    }
    return [f"{sql} AS {name}" for name, sql in columns.items()]


def normalize(frames: DataFrame) -> DataFrame:
    """Trim, lower, check and parse every field once. A narrow projection: nothing
    shuffles, and over stored frames no pattern is matched again.

    Codes stay text, SSIDs stay encoded: both are translated after aggregation, when
    there are few of them.
    """
    columns = _projection()
    if "scan_order" in frames.columns:
        # In captures without packet numbers the order of the scan counts.
        columns = [
            f"coalesce(scan_order, {c.removesuffix(' AS seq')}) AS seq" if c.endswith(" AS seq") else c
            for c in columns
        ]
    return frames.selectExpr(*columns)


def eapol_frames(frames: DataFrame) -> DataFrame:
    """Frames with an EAPOL type, from raw or from normalised frames.

    On raw frames the plain `<> ''` test, which reaches the scan, comes before the
    exact one.
    """
    if "eapol_type" in frames.columns:
        frames = normalize(frames.where("eapol_type <> ''"))
    return frames.where("eapol <> ''")
