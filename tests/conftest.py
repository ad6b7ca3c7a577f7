from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

FRAME_FIELDS = (
    "capture_id frame_number timestamp frame_type frame_subtype source destination bssid "
    "ssid channel signal eapol_type"
).split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_frames(spark):
    """Raw frames from dicts; absent fields are ''."""

    def build(rows):
        data = [tuple(row.get(field, "") for field in FRAME_FIELDS) for row in rows]
        return spark.createDataFrame(data, ", ".join(f"{f} string" for f in FRAME_FIELDS))

    return build


A = "3c:a7:ae:00:00:0a"
B = "3c:a7:ae:00:00:0b"
C1 = "00:1b:63:00:00:01"
C2 = "02:00:00:00:00:02"
FF = "ff:ff:ff:ff:ff:ff"

_EDGE_FIELDS = "timestamp frame_subtype source destination bssid ssid channel signal eapol_type"
_EDGE_ROWS = [
    ("100.0", "8", A, FF, A, "4142", "6", "-80", ""),
    ("101", "32", C1.upper(), A, A, "", "1", "-80.9,-3", ""),
    ("99", "32", A, C1, A, "", "1", "", ""),
    ("", "32", C1, C1, A, "", "6", "n/a", ""),
    ("", "32", C1, A, A, "", "", "", "3"),
    ("102", "32", A, C1, A, "", "", "", "3"),
    ("103", "32", C1, A, A, "", "", "", "3"),
    ("", "32", A, C1, A, "", "", "", "3"),
    ("104", "32", "junk", A, A, "", "", "", "0"),
    ("105", "0x0008", B, FF, B, "", "", "", ""),
    ("106", "4", C2, FF, FF, "", "", "", ""),
]


def edge_rows(capture="edge"):
    return [
        dict(zip(_EDGE_FIELDS.split(), row), frame_number=str(i), capture_id=capture)
        for i, row in enumerate(_EDGE_ROWS, 1)
    ]


@pytest.fixture(scope="session")
def edge(make_frames):
    from airsift import Analysis, normalize

    # Reversed on purpose: results must follow the frame number, not the row order.
    return Analysis(normalize(make_frames(edge_rows()[::-1])))
