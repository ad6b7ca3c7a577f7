from __future__ import annotations

import gzip
import os

import pytest

from airsift import normalize, read_frames
from airsift.schema import FRAME_COLUMNS, SEQ_MISSING
from airsift.sources.frames import (
    CaptureReadError,
    field_status,
    list_captures,
    require_rows,
    resolve_fields,
    scan_summary,
    select_frames,
)

HEADER = "frame.number\tframe.time_epoch\twlan.ssid\n"
ROWS = [
    '"1"\t"1700000000.5"\t"a""b"\n',
    '"2"\t"1700000001"\n',
    '"3"\t""\t"x"\t"extra"\n',
    '"4"\t\t"Ağ, 1"\n',
]


def write(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        file.write(content)


def test_resolution_prefers_the_first_candidate():
    resolved = resolve_fields({"wlan.ta", "wlan.da", "wlan.ra", "frame.number"})
    assert resolved["source"] == "wlan.ta"
    assert resolved["destination"] == "wlan.da"
    assert resolved["eapol_type"] is None
    assert list(resolved) == FRAME_COLUMNS


def stem(path):
    return os.path.basename(path).removesuffix(".gz").removesuffix(".tsv")


def test_captures_of_equal_names_stay_apart(spark, tmp_path):
    for folder in "abc":
        write(tmp_path, f"{folder}/cap-01.tsv", '"1"\t"aa"\n')
    frames = read_frames(spark, str(tmp_path), fields=["frame.number", "wlan.ta"])
    assert sorted(r["count"] for r in frames.groupBy("capture_id").count().collect()) == [1, 1, 1]
    listed = {r.capture_id for r in list_captures(spark, str(tmp_path)).collect()}
    assert listed == {r.capture_id for r in frames.collect()}


def test_field_status(spark):
    rows = field_status(spark, ["wlan.ta"]).orderBy("pos").collect()
    assert [r.logical_name for r in rows] == FRAME_COLUMNS
    assert [(r.physical_name, r.available) for r in rows if r.available] == [("wlan.ta", True)]


def test_scan_reads_quotes_short_and_long_rows(spark, tmp_path):
    write(tmp_path, "one.tsv", HEADER + "".join(ROWS))
    rows = read_frames(spark, str(tmp_path)).orderBy("frame_number").collect()
    shown = [(stem(r.capture_id), r.frame_number, r.timestamp, r.ssid, r.eapol_type) for r in rows]
    assert shown == [
        ("one", "1", "1700000000.5", 'a"b', ""),
        ("one", "2", "1700000001", "", ""),
        ("one", "3", "", "x", ""),
        ("one", "4", "", "Ağ, 1", ""),
    ]


def test_scan_without_header_and_captures_in_subfolders(spark, tmp_path):
    write(tmp_path, "a/x.1.tsv", '"1"\t"aa"\n')
    write(tmp_path, "b/y.tsv", '"1"\t"bb"\n')
    write(tmp_path, "b/notes.md", "no export\n")
    frames = read_frames(spark, str(tmp_path), fields=["frame.number", "wlan.ta"])
    assert sorted((stem(r.capture_id), r.source) for r in frames.collect()) == [("x.1", "aa"), ("y", "bb")]
    names = sorted((stem(r.capture_id), r.capture_name) for r in list_captures(spark, str(tmp_path)).collect())
    assert names == [("x.1", "x.1.tsv"), ("y", "y.tsv")]


def test_every_capture_names_its_own_columns(spark, tmp_path):
    write(tmp_path, "a.tsv", "frame.number\twlan.sa\twlan_radio.channel\n1\taa\t6\n2\tab\t7\n")
    write(tmp_path, "b/c d[1].tsv", "wlan_mgt.ssid\twlan.ta\twlan.sa\tframe.number\n\"x\ty\"\tno\tbb\t1\n")
    write(tmp_path, "100%25.tsv", '\ufeff"wlan.ta"\twlan.ta\tframe.number\r\n"cc"\t"dd"\t"9"\r\n')
    write(tmp_path, "n.tsv", "other\twlan.ta\nq\tee\nq\tff\n")
    frames = read_frames(spark, str(tmp_path))
    assert frames.count() == 6
    rows = {(r.source, r.frame_number, r.ssid, r.channel) for r in frames.collect()}
    assert rows == {
        ("aa", "1", "", "6"), ("ab", "2", "", "7"), ("bb", "1", "x\ty", ""), ("cc", "9", "", ""),
        ("ee", "", "", ""), ("ff", "", "", ""),
    }
    order = {r.src: r.seq for r in normalize(frames).collect()}
    assert (order["aa"], order["ab"], order["bb"], order["cc"]) == (1, 2, 1, 9)
    assert order["ee"] < order["ff"] < SEQ_MISSING
    # Counting, and reading a column that few exports have, take the same rows.
    assert frames.select("bssid").count() == frames.select("ssid", "signal").count() == 6
    write(tmp_path, "z.tsv", "ip.src\tip.dst\n1\t2\n")
    with pytest.raises(CaptureReadError, match="known frame fields.*z.tsv"):
        read_frames(spark, str(tmp_path))


def test_captures_without_a_row_fail_by_name(spark, tmp_path):
    write(tmp_path, "good.tsv", HEADER + ROWS[0])
    write(tmp_path, "bare.tsv", HEADER + "\n\n")
    with pytest.raises(CaptureReadError, match="no frame in .*bare.tsv"):
        read_frames(spark, str(tmp_path))
    (tmp_path / "bare.tsv").write_text("")
    with pytest.raises(CaptureReadError, match="no frame in .*bare.tsv"):
        read_frames(spark, str(tmp_path), fields=["frame.number"])
    status = {stem(r.capture_id): (r.rows, r.status) for r in scan_summary(spark, str(tmp_path)).collect()}
    assert status == {"good": (1, "ok"), "bare": (0, "failed")}


def test_broken_exports_say_where(spark, tmp_path):
    body = HEADER + ROWS[0] + '"2"\t"1"\t"b"\n'
    for name, end in (("whole", '"3"\t""\t""'), ("short", '"3"\t"17"'), ("quote", '"3"\t"17"\t"ab')):
        write(tmp_path, f"{name}.tsv", body + end)
    write(tmp_path, "inside.tsv", HEADER + '"1"\t"a\n' + ROWS[0])
    content = (HEADER + "".join(f'"{i}"\t"{i}"\t"{os.urandom(8).hex()}"\n' for i in range(9_000))).encode()
    packed = gzip.compress(content)
    (tmp_path / "cut.tsv.gz").write_bytes(packed[:-9_000])
    (tmp_path / "damaged.tsv.gz").write_bytes(packed[:60_000] + b"\xff" * 40 + packed[60_040:])
    (tmp_path / "members.tsv.gz").write_bytes(gzip.compress((HEADER + ROWS[0]).encode()) + gzip.compress(ROWS[0].encode()))
    found = {stem(r.capture_id): r for r in scan_summary(spark, str(tmp_path)).collect()}
    at = len(body.encode())
    shown = {n: (r.rows, r.odd_rows, r.status, r.broken_at, r.reason) for n, r in found.items()}
    assert shown["whole"] == (3, 0, "ok", None, None)
    assert shown["short"] == (3, 1, "truncated", at, "short last row")
    assert shown["quote"] == (3, 1, "truncated", at, "open quote in the last row")
    assert shown["inside"] == (2, 1, "check", None, None)
    assert shown["members"] == (2, 0, "ok", None, None)
    assert shown["cut"][2:] == ("truncated", len(packed) - 9_000, "compression breaks off")
    assert 0 < shown["cut"][0] < 9_000
    assert shown["damaged"][2::2] == ("truncated", "damaged compression")
    assert shown["damaged"][0] > 2_000 and shown["damaged"][3] >= 60_000


def test_files_are_read_in_pieces(tmp_path):
    import tracemalloc

    from airsift.sources import exports

    line = b'"1"\t"1700000000.5"\t"' + b"a" * 100 + b'"\n'
    (tmp_path / "big.tsv.gz").write_bytes(gzip.compress(HEADER.encode() + line * 400_000))
    tracemalloc.start()
    n = sum(1 for _ in exports.export_lines(f"file://{tmp_path}/big.tsv.gz"))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400_001 and most < 12 << 20
    (tmp_path / "long.tsv").write_bytes(b"a\n" + b"x" * 5000 + b"\nb\n" + b"y" * 5000)
    found = [(x, e) for x, _, e in exports.export_lines(f"file://{tmp_path}/long.tsv", 700, 1000)]
    assert found == [(b"a", True), (None, True), (b"b", True), (None, False)]


def test_errors(spark, tmp_path):
    with pytest.raises(CaptureReadError):
        read_frames(spark, str(tmp_path / "missing"))
    with pytest.raises(CaptureReadError):
        read_frames(spark, str(tmp_path), glob="*.tsv")
    write(tmp_path, "a.tsv", "ip.src\n1.2.3.4\n")
    with pytest.raises(CaptureReadError):
        read_frames(spark, str(tmp_path))
    with pytest.raises(CaptureReadError):
        require_rows(spark.createDataFrame([], "a string"))


def test_without_frame_numbers_the_scan_order_counts(spark, tmp_path):
    write(tmp_path, "a.tsv", "wlan.sa\n" + "".join(f"{i}\n" for i in range(50)))
    rows = normalize(read_frames(spark, str(tmp_path))).orderBy("seq").collect()
    assert [r.src for r in rows] == [str(i) for i in range(50)]
    assert {r.frame_number for r in rows} == {""}


def test_unusable_frame_numbers_come_last(spark, make_frames):
    rows = [{"frame_number": n} for n in ("x", "", "7", "12345678901234567890")]
    seqs = sorted(r.seq for r in normalize(make_frames(rows)).collect())
    assert seqs == [7, SEQ_MISSING, SEQ_MISSING, SEQ_MISSING]


def test_truncated_file_keeps_its_readable_rows(spark, tmp_path):
    content = (HEADER + "".join(f'"{i}"\t"{i}"\t"{os.urandom(8).hex()}"\n' for i in range(50_000))).encode()
    (tmp_path / "cut.tsv.gz").write_bytes(gzip.compress(content)[:-300_000])
    (tmp_path / "whole.tsv.gz").write_bytes(gzip.compress((HEADER + ROWS[0]).encode()))
    (tmp_path / "broken.tsv.gz").write_bytes(b"no gzip at all")
    both = [str(tmp_path / "whole.tsv.gz"), str(tmp_path / "cut.tsv.gz")]
    with pytest.raises(Exception, match="(?i)end of|corrupt|zlib|failed"):
        read_frames(spark, both).collect()
    with pytest.raises(CaptureReadError):
        read_frames(spark, str(tmp_path / "broken.tsv.gz"), fields=["wlan.sa"], tolerate_truncated=True)
    frames = read_frames(spark, both, tolerate_truncated=True)
    counts = {stem(r.capture_id): r["count"] for r in frames.groupBy("capture_id").count().collect()}
    assert counts["whole"] == 1
    assert 0 < counts["cut"] < 50_000
    summary = scan_summary(spark, str(tmp_path), fields=["frame.number", "frame.time_epoch", "wlan.ssid"])
    status = {stem(r.capture_id): r.status for r in summary.collect()}
    assert status == {"broken": "failed", "cut": "truncated", "whole": "ok"}


def test_scan_summary_counts_odd_rows(spark, tmp_path):
    write(tmp_path, "odd.tsv", HEADER + "".join(ROWS))
    write(tmp_path, "fine.tsv", HEADER + ROWS[0])
    rows = {stem(r.capture_id): (r.files, r.rows, r.odd_rows, r.status) for r in scan_summary(spark, str(tmp_path)).collect()}
    assert rows == {"odd": (1, 4, 2, "check"), "fine": (1, 1, 0, "ok")}


def test_projection_reads_only_resolved_fields(spark, tmp_path):
    spark.createDataFrame([("1", "aa", "zz")], "`frame.number` string, `wlan.ta` string, other string").write.parquet(
        str(tmp_path / "p")
    )
    frames = select_frames(spark.read.parquet(str(tmp_path / "p")))
    plan = frames._jdf.queryExecution().executedPlan().toString()
    assert "other" not in plan
    assert frames.first().source == "aa"
