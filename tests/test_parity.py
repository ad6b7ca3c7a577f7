"""Every query against DuckDB, on the given tables and on frames full of damage."""

from __future__ import annotations

import glob
import os
import random

import duckdb
import pandas as pd
import pytest
from conftest import FRAME_FIELDS, SF_DIR

import __spark_entry__ as entry
from parity import oracle
from parity import queries as Q


def compare(df, connection, sql):
    rows = df.collect()
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    columns = sorted(df.columns)
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    ours = sorted((tuple(r[c] for c in columns) for r in rows), key=str)
    theirs = sorted((tuple(r[i] for i in order) for r in expected), key=str)
    assert ours == theirs


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_its_sql():
    assert set(Q.queries()) == set(oracle.oracle_sql()) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_given_tables(spark, duck, name):
    compare(entry.queries()[name](spark, SF_DIR), duck, entry.oracle_sql()[name])


def messy_frames(n=3000, seed=7):
    """Two thirds of all frames in one capture, a third on one BSSID, one hot client."""
    rng = random.Random(seed)
    macs = [f"{p}:00:00:{i:02x}" for p in ("00:1b:63", "02:00:00", "00:50:56") for i in range(40)]
    aps = [f"3c:a7:ae:00:00:{i:02x}" for i in range(6)]
    odd = ["", "junk", "33:33:00:00:00:01", "01:00:5e:00:00:01", "ff:ff:ff:ff:ff:ff", "00:1b:63"]

    def address(hot, pool):
        x = rng.random()
        pick = hot if x < 0.33 else rng.choice(odd) if x < 0.45 else rng.choice(pool)
        pick = pick.upper() if rng.random() < 0.1 else pick
        return f" {pick} ,x" if rng.random() < 0.05 else pick

    rows = []
    numbers = {}
    for _ in range(n):
        capture = "hot" if rng.random() < 0.67 else f"c{rng.randint(0, 3)}"
        numbers[capture] = numbers.get(capture, 0) + 1
        rows.append(
            {
                "capture_id": capture,
                "frame_number": str(numbers[capture]),
                "timestamp": rng.choice(["", "x", f"{rng.randint(0, 10**9)}.{rng.randint(0, 999)}"]),
                "frame_type": "0",
                "frame_subtype": rng.choice(["8", "4", "12", "32", "", "0x08", "99"]),
                "source": address(macs[0], macs + aps),
                "destination": address(aps[0], macs + aps),
                "bssid": address(aps[0], aps),
                "ssid": rng.choice(["", "", "Net", "4142", "AB", "c3a9", "zz,y", "6162 "]),
                "channel": rng.choice(["", "1", "6", "11", "6,11"]),
                "signal": rng.choice(["", "n/a", "1d", f"-{rng.randint(30, 95)}", "-70.5,-1"]),
                "eapol_type": rng.choice(["", "", "", "", "3", "0"]),
            }
        )
    rng.shuffle(rows)
    return rows


# Frames whose numbers are not their own key cannot be cut by number.
NOT_FUZZED = ("tsv_scan", "subtype_decimal", "damaged_exports")
FUZZED = [n for n in sorted(Q.queries()) if n not in NOT_FUZZED]


@pytest.fixture(scope="module")
def messy(make_frames):
    rows = messy_frames()
    connection = duckdb.connect()
    connection.register("raw", pd.DataFrame(rows, columns=FRAME_FIELDS))
    connection.execute("CREATE TABLE raw_frames AS SELECT * FROM raw")
    return make_frames(rows), connection


@pytest.mark.parametrize("name", FUZZED)
def test_messy_frames(spark, messy, monkeypatch, name):
    frames, connection = messy
    monkeypatch.setattr(Q, "frames_from_events", lambda spark, sf_dir: frames)
    compare(Q.queries()[name](spark, ""), connection, oracle.oracle_sql("SELECT * FROM raw_frames")[name])


SPLIT = ["admitted_files", "captures_by_path", "mixed_captures", "tsv_scan"]


@pytest.mark.parametrize("name", SPLIT)
def test_exports_of_splits_without_rows(spark, tmp_path, name):
    """Of the splits of one row group only that of its middle has rows: the first has none."""
    n = 3000
    events = pd.DataFrame(
        {
            "event_id": range(n),
            "ts": pd.date_range("2024-01-01", periods=n, freq="s").astype("datetime64[us]"),
            "user_id": [i * 7 % 50 for i in range(n)],
            "event_type": [["view", "click", "signup", "error", "purchase"][i % 5] for i in range(n)],
        }
    )
    path = f"{tmp_path}/events.parquet"
    events.to_parquet(path, row_group_size=n)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    kept = {f"spark.sql.files.{k}": spark.conf.get(f"spark.sql.files.{k}") for k in ("maxPartitionBytes", "openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", os.path.getsize(path) // 5)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        compare(entry.queries()[name](spark, str(tmp_path)), connection, entry.oracle_sql()[name])
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
