"""Column names and types of the tables the library reads and keeps."""

from __future__ import annotations

from pyspark.sql import types as T

# Logical columns of one 802.11 frame, in output order, and the export field
# names that can supply each one. The first name present in the data wins.
# Fixed values.
FIELD_CANDIDATES: dict[str, list[str]] = {
    "frame_number": ["frame.number"],
    "timestamp": ["frame.time_epoch"],
    "frame_type": ["wlan.fc.type"],
    "frame_subtype": ["wlan.fc.type_subtype"],
    "source": ["wlan.sa", "wlan.ta"],
    "destination": ["wlan.da", "wlan.ra"],
    "bssid": ["wlan.bssid"],
    "ssid": ["wlan.ssid", "wlan_mgt.ssid"],
    "channel": ["wlan_radio.channel", "radiotap.channel.freq"],
    "signal": ["radiotap.dbm_antsignal", "wlan_radio.signal_dbm"],
    "eapol_type": ["eapol.type"],
}

FRAME_COLUMNS: list[str] = list(FIELD_CANDIDATES)

# Frames as read: text only, '' where a field is missing.
FRAMES_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ["capture_id", *FRAME_COLUMNS]]
)

# Frames after `normalize`. `seq` is the packet order inside a capture; an `_ok` column
# tells whether the address before it is a valid MAC.
NORMALIZED_SCHEMA = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("frame_number", T.StringType()),
        T.StructField("ts_raw", T.StringType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("sub", T.StringType()),
        T.StructField("src", T.StringType()),
        T.StructField("src_ok", T.BooleanType()),
        T.StructField("dst", T.StringType()),
        T.StructField("dst_ok", T.BooleanType()),
        T.StructField("bssid", T.StringType()),
        T.StructField("bssid_ok", T.BooleanType()),
        T.StructField("ssid", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("sig", T.IntegerType()),
        T.StructField("eapol", T.StringType()),
    ]
)

# Order of frames without a usable frame number: after all others. Small enough
# that 2 * seq + 1, the order of a frame's endpoints, still fits a BIGINT.
SEQ_MISSING = 2**62 - 1

# Frame store: the frames and the short key of their capture; the folder of its captures,
# which a scan of the store passes over.
STORED_SCHEMA = T.StructType(
    [*NORMALIZED_SCHEMA, T.StructField("capture_key", T.LongType())]
)
CAPTURES_FOLDER = "_captures"
