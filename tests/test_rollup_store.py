"""Rollups batch by batch, sets of MACs, and search over the names as shown."""

from __future__ import annotations

import os

import pytest
from conftest import A, C1, FF, edge_rows
from pyspark.sql import functions as F

from airsift import Analysis, normalize
from airsift.operators import macsets as M
from airsift.operators import networks as N
from airsift.plans import rollup_store as S
from airsift.sinks import writers as W
from airsift.streaming.ingest import ingest_exports


def tables(analysis):
    return {name: sorted(map(str, t.collect())) for name, t in analysis.tables().items()}


@pytest.fixture(scope="module")
def three(make_frames):
    rows = [dict(r, capture_id=c) for c in ("x", "y", "z") for r in edge_rows()]
    rows += [dict(r, capture_id="x", frame_number=str(100 + i)) for i, r in enumerate(edge_rows())]
    return normalize(make_frames(rows))


def test_batches_equal_one_analysis_of_all(spark, three, tmp_path):
    root = str(tmp_path / "rollups")
    with pytest.raises(FileNotFoundError):
        S.read_rollups(spark, root)
    wanted = tables(Analysis(three))
    parts = [three.where(f"hash(frame_number) % 3 IN ({i}, -{i})") for i in range(3)]
    assert S.write_batch(parts[0], root, "b0")
    assert tables(S.read_rollups(spark, root)) != wanted
    assert S.write_batch(parts[1], root, "b1") and not S.write_batch(parts[1], root, "b1")
    # A batch that was lost before its commit: its files are passed over, then replaced.
    parts[0].write.parquet(f"{root}/links/part=b2")
    assert S.committed(spark, root) == ["b0", "b1"]
    assert S.write_batch(parts[2], root, "b2")
    assert tables(S.read_rollups(spark, root)) == wanted
    S.merge_parts(spark, root, "1")
    assert S.committed(spark, root) == ["merged-1"]
    merged = S.read_rollups(spark, root)
    assert tables(merged) == wanted
    S.write_batch(three.where("capture_id = 'x'").withColumn("capture_id", F.lit("w")), root, "b3")
    S.merge_parts(spark, root, "2")
    assert S.committed(spark, root) == ["merged-2"]
    counts = {r.capture_id: r.total_packets for r in S.read_rollups(spark, root).summary.collect()}
    assert counts == {"x": 22, "y": 11, "z": 11, "w": 22}


def test_reading_scans_rollups_only(spark, three, tmp_path):
    root, frames = str(tmp_path / "rollups"), str(tmp_path / "frames")
    W.write_frame_store(three, frames)
    S.write_batch(three, root, "b0")
    found = S.read_rollups(spark, root)
    for name, table in found.tables().items():
        read = table.inputFiles()
        assert read and all(f"{root}/" in f for f in read), name
    folder = W.write_all(found, str(tmp_path), "r")
    assert W.read_section(spark, folder, "json/clients").count() == found.clients.count()


def test_a_stream_keeps_its_rollups(spark, tmp_path):
    source, fields = tmp_path / "in", ["frame.number", "wlan.sa", "wlan.bssid"]
    source.mkdir()
    for name in "ab":
        (source / f"{name}.tsv").write_text(f'"1"\t"{C1}"\t"{A}"\n"2"\t"{C1}"\t"{A}"\n')
        query = ingest_exports(spark, str(source), str(tmp_path / "s"), fields, rollups=str(tmp_path / "r"))
        query.awaitTermination(120)
        assert query.exception() is None
    found = S.read_rollups(spark, str(tmp_path / "r"))
    assert [(r.mac, r.packet_count) for r in found.clients.collect()] == [(C1, 2)] * 2
    sets = S.read_mac_sets(spark, str(tmp_path / "r"))
    assert [r.client_count for r in M.distinct_counts(sets).collect()] == [1]


def test_mac_sets_at_the_ends_of_buckets(spark, make_frames):
    macs = ["00:00:00:00:00:00", "00:00:00:00:00:01", "00:00:00:00:7f:ff", "00:00:00:00:80:00"]
    macs += ["00:1b:63:ff:ff:ff", "00:1b:64:00:00:00", "ff:ff:ff:ff:ff:fe", "fe:ff:ff:ff:ff:ff", "00:1b:63:00:00:00"]
    rows = [
        {"capture_id": c, "frame_number": str(i), "bssid": A, "source": m}
        for c in "ab" for i, m in enumerate(macs[: 9 if c == "a" else 5], 1)
    ]
    analysis = Analysis(normalize(make_frames(rows)))
    sets = M.mac_sets(analysis.links)
    per = {r.capture_id: r.client_count for r in M.distinct_counts(sets, "capture_id").collect()}
    assert per == {"a": 9, "b": 5}
    (both,) = M.distinct_counts(sets).collect()
    known = {r.vendor for r in analysis.clients.collect()}
    assert len(known) == 3  # randomised, unknown, and one vendor
    vendors = {r.mac: r.vendor for r in analysis.clients.collect()}
    count = lambda v: sum(x == v for x in vendors.values())
    assert tuple(both) == (9, count("Private / Randomized MAC"), count("Bilinmiyor"))


def test_sparse_mac_sets_stay_small(spark, tmp_path):
    macs = spark.range(20_000).selectExpr("lower(lpad(hex(abs(xxhash64(id)) % 281474976710656), 12, '0')) AS h")
    links = macs.selectExpr(
        "'c' AS capture_id", f"'{A}' AS bssid", "'' AS dst", "1L AS n", "1L AS first_seq",
        "concat_ws(':', substr(h,1,2), substr(h,3,2), substr(h,5,2), substr(h,7,2), substr(h,9,2), substr(h,11,2)) AS src",
        "1L AS first_ts_seq", "1D AS first_ts", "1L AS last_ts_seq", "1D AS last_ts",
    )
    M.mac_sets(links).write.option("compression", "zstd").parquet(str(tmp_path / "m"))
    size = sum(f.stat().st_size for f in os.scandir(tmp_path / "m") if f.name.endswith(".parquet"))
    assert size < 60 * 20_000  # bytes for a MAC alone in its bucket of 4 KB


def test_search_over_names_as_shown(make_frames):
    names = {A: ["Net0", "Net1", "Net2", "a, b", "zz"], FF: [f"n{i:04d}" for i in range(2500)]}
    rows = [
        {"capture_id": "c", "frame_number": str(i), "bssid": b, "ssid": n.encode().hex()}
        for i, (b, n) in enumerate((b, n) for b, some in names.items() for n in some)
    ]
    analysis = Analysis(normalize(make_frames(rows)))
    shown = {b: ", ".join(sorted(some)).lower() for b, some in names.items()}
    for query in (
        "Net0, Net1, Net2", "1, N", "net2, a, b", "t2, a, b, z", "a, b", ", b, zz", "net0, net2", ", ", "zz, ",
        "n0999, n1000, n1001, n1002", "N2499", ", n0000", " net0 ",
    ):
        found = {r.bssid for r in N.search_networks(analysis.networks, analysis.network_ssids, query).collect()}
        assert found == {b for b, text in shown.items() if query.strip().lower() in text}, query
