from __future__ import annotations

import csv
import glob
import json
import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import A, C1, C2, FF, edge_rows

from airsift import Analysis, normalize, read_frame_store
from airsift.operators import networks as N
from airsift.plans import report as R
from airsift.sinks import writers as W
from airsift.schema import NORMALIZED_SCHEMA
from airsift.sinks.paths import IncompleteReport, claim_folder, finish, next_free_path
from airsift.sources.frames import store_captures


def parts(pattern):
    return sorted(glob.glob(pattern))


def lines(folder):
    return [
        line for path in parts(f"{folder}/part-*") for line in open(path, encoding="utf-8").read().splitlines()
    ]


def test_json_report_is_lines_at_every_size(edge, tmp_path):
    W.write_json_report(edge, str(tmp_path))
    (line,) = lines(f"{tmp_path}/envelope/capture_id=edge")
    assert json.loads(line)["total_packets"] == 11
    for name, table in edge.tables().items():
        assert len(lines(f"{tmp_path}/{name}/capture_id=edge")) == table.count(), name
    found = [json.loads(x) for x in lines(f"{tmp_path}/networks/capture_id=edge")]
    assert sorted((n["bssid"], n["channel"], n["average_signal_dbm"]) for n in found) == [
        (A, "6", -80.0),
        (FF, None, None),
    ]


def test_envelope_with_names(spark, edge):
    captures = spark.createDataFrame(
        [("edge", "edge.tsv", "file:/x/edge.tsv")],
        "capture_id string, capture_name string, capture_file string",
    )
    (row,) = R.envelope(edge, captures).collect()
    assert row.module == "Wi-Fi Forensics"
    assert len(row.generated_at) == len("2024-01-01T00:00:00")
    assert row.capture_name == "edge.tsv"


def test_csv_files(edge, tmp_path):
    W.write_networks_csv(edge.networks, edge.network_ssids, f"{tmp_path}/n")
    (path,) = parts(f"{tmp_path}/n/capture_id=edge/*.csv")
    rows = list(csv.reader(open(path, encoding="utf-8")))
    assert rows == [
        ["SSID", "BSSID", "Kanal", "Ortalama_Sinyal_dBm", "Istemci_Sayisi"],
        ["AB", A, "6", "-80.0", "1"],
        ["", FF, "", "", "1"],
    ]
    W.write_clients_csv(edge.clients, edge.network_ssids, f"{tmp_path}/c")
    found = [
        row for path in parts(f"{tmp_path}/c/capture_id=edge/*.csv") for row in csv.reader(open(path, encoding="utf-8"))
    ]
    assert found[0] == ["BSSID", "SSID", "Istemci_MAC", "Paket_Sayisi"]
    assert [r for r in found if r[0] != "BSSID"] == [[A, "AB", C1, "8"], [FF, "", C2, "1"]]


def test_html_report(make_frames, tmp_path):
    rows = edge_rows("edge") + [
        {"capture_id": "edge", "frame_number": "12", "bssid": A, "ssid": "<b>&'x'"},
    ]
    W.write_html_report(Analysis(normalize(make_frames(rows))), str(tmp_path / "h"))
    document = "".join(lines(tmp_path / "h" / "capture_id=edge"))
    assert document.startswith("<!DOCTYPE html>") and document.endswith("</html>")
    assert document.count("<table>") == document.count("</table>") == 4
    assert "&lt;b&gt;&amp;&#x27;x&#x27;</h2>" in document and "<h2>AB</h2>" in document
    assert document.index(A) < document.index(C1) < document.index("Subtype 32")


def test_write_all_never_overwrites(edge, tmp_path):
    first = W.write_all(edge, str(tmp_path), "edge")
    assert first == f"{tmp_path}/edge"
    assert next_free_path(edge.frames.sparkSession, first) == f"{first}_1"
    for kind in ("json/envelope", "networks_csv", "clients_csv", "html"):
        assert parts(f"{first}/{kind}/capture_id=edge/part-*"), kind


def test_a_report_is_complete_or_refused(spark, edge, tmp_path):
    folder = W.write_all(edge, str(tmp_path), "r")
    found = W.read_section(spark, folder, "json/networks").collect()
    assert {r.bssid for r in found} == {A, FF}
    assert W.read_section(spark, folder, "clients_csv").count() == 2
    with pytest.raises(KeyError):
        W.read_section(spark, folder, "pdf")
    killed = claim_folder(spark, f"{tmp_path}/r")
    assert killed == f"{folder}_1"
    W.write_networks_csv(edge.networks, edge.network_ssids, f"{killed}/networks_csv")
    with pytest.raises(IncompleteReport):
        W.read_section(spark, killed, "networks_csv")
    with pytest.raises(FileExistsError):
        finish(spark, folder, {})
    with ThreadPoolExecutor(6) as pool:
        claimed = list(pool.map(lambda _: claim_folder(spark, f"{tmp_path}/q"), range(9)))
    assert len(set(claimed)) == 9


def long_id(name):
    return "hdfs://nn:8020/" + "ç:/" * 330 + name


def test_captures_of_long_paths(spark, make_frames, tmp_path):
    rows = [dict(r, capture_id=long_id(c)) for c in ("a.tsv", "b+c%20d.tsv") for r in edge_rows()]
    frames = normalize(make_frames(rows))
    W.write_frame_store(frames, str(tmp_path / "s"))
    stored = read_frame_store(spark, str(tmp_path / "s"))
    assert sorted(map(str, stored.collect())) == sorted(map(str, frames.collect()))
    short = read_frame_store(spark, str(tmp_path / "s"), short=True)
    names = {r.capture_id: (r.capture_name, r.capture_file) for r in store_captures(spark, str(tmp_path / "s")).collect()}
    assert {r.capture_id for r in short.collect()} == set(names) and all(len(c) == 16 for c in names)
    assert set(names.values()) == {("a.tsv", long_id("a.tsv")), ("b+c d.tsv", long_id("b+c%20d.tsv"))}
    folder = W.write_all(Analysis(stored), str(tmp_path), "long")
    listed = {r.capture_id: r.folder for r in W.read_section(spark, folder, "json/captures").collect()}
    assert set(listed) == {long_id("a.tsv"), long_id("b+c%20d.tsv")}
    for name in listed.values():
        assert parts(f"{folder}/html/capture_id={name}/part-*"), name


def test_many_captures_fill_a_fixed_number_of_folders(spark, tmp_path):
    rows = spark.range(20_000).selectExpr(
        "concat('c', id % 10000) AS capture_id", "id AS seq",
        *[f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in NORMALIZED_SCHEMA.fields[2:]],
    )
    W.write_frame_store(rows, str(tmp_path / "s"), buckets=16)
    assert len(parts(f"{tmp_path}/s/part=*/buckets=16/bucket=*")) == 16
    assert len(parts(f"{tmp_path}/s/part=*/buckets=16/bucket=*/*.parquet")) < 40
    W.write_frame_store(rows.limit(5), str(tmp_path / "s"), buckets=3)
    found = read_frame_store(spark, str(tmp_path / "s"), captures=["c7", "c9999", "none"])
    counts = {r.capture_id: r["count"] for r in found.groupBy("capture_id").count().collect()}
    few = {r.capture_id for r in rows.limit(5).collect()}
    assert counts == {c: 2 + (c in few) for c in ("c7", "c9999")}
    assert store_captures(spark, str(tmp_path / "s")).count() == 10_000


def test_frame_store_prunes_captures_and_pushes_filters(spark, make_frames, tmp_path):
    frames = normalize(make_frames(edge_rows("a") + edge_rows("b")))
    W.write_frame_store(frames, str(tmp_path / "s"))
    stored = read_frame_store(spark, str(tmp_path / "s"))
    assert stored.schema == frames.schema or stored.columns == frames.columns
    assert sorted(map(str, stored.collect())) == sorted(map(str, frames.collect()))
    only = read_frame_store(spark, str(tmp_path / "s"), captures=["a"], short=True)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = Analysis(only).eapol_packets._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ as bigint\) = pmod\(-?\d+, cast\(buckets", plan)
    assert re.search(r"PushedFilters: \[.*EqualTo\(capture_key,.*Not\(EqualTo\(eapol,\)\)", plan)
    assert Analysis(only).packet_totals.first().total_packets == 11


def test_thousands_of_names_on_one_network(make_frames):
    rows = [
        {"capture_id": "c", "frame_number": str(i), "bssid": A if i < 3000 else FF, "ssid": f"n{i}"}
        for i in range(1, 3003)
    ]
    analysis = Analysis(normalize(make_frames(rows)))
    found = {r.bssid: r.ssid_count for r in analysis.networks.collect()}
    assert found == {A: 2999, FF: 3}
    assert analysis.network_ssids.count() == 3002
    ours = lambda q: {r.bssid for r in N.search_networks(analysis.networks, analysis.network_ssids, q).collect()}
    assert (ours("N2999"), ours("n3001"), ours("gizli"), ours("n1")) == ({A}, {FF}, set(), {A})
    assert W.networks_csv(analysis.networks, analysis.network_ssids).count() == 3002


def test_csv_keeps_blanks(spark, tmp_path):
    table = spark.createDataFrame([("c", " AB ", "x"), ("c", "", " ")], "capture_id string, name string, more string")
    W.write_csv(table, f"{tmp_path}/b")
    found = [
        r for p in parts(f"{tmp_path}/b/capture_id=c/*.csv") for r in csv.reader(open(p, encoding="utf-8"))
    ]
    assert sorted(r for r in found if r[0] != "name") == [["", " "], [" AB ", "x"]]


@pytest.mark.parametrize("bad", ["", "x"])
def test_rollups_survive_damaged_addresses(make_frames, bad):
    rows = [{"capture_id": "c", "frame_number": "1", "bssid": bad, "source": A, "ssid": "s"}]
    analysis = Analysis(normalize(make_frames(rows))).materialize()
    assert analysis.networks.count() == 0
    assert [r.mac for r in analysis.top_sources.collect()] == [A]


def test_write_tables(spark, edge, tmp_path):
    W.write_tables(edge, str(tmp_path))
    for name, table in edge.tables().items():
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == table.count(), name
