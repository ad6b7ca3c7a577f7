"""The hand-made capture: ties, equal ends, missing fields."""

from __future__ import annotations

import pytest
from conftest import A, C1, C2, FF, edge_rows

from airsift import Analysis, normalize


def records(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module", params=["frames", "rollups"])
def analysis(edge, request):
    return edge if request.param == "frames" else edge.materialize()


def test_summary(analysis):
    (row,) = analysis.summary.collect()
    assert tuple(row) == ("edge", 11, 2, 2, 5)


def test_networks(analysis):
    rows = {r.bssid: r for r in analysis.networks.collect()}
    assert set(rows) == {A, FF}
    assert [tuple(r)[1:] for r in analysis.network_ssids.collect()] == [(A, "AB")]
    assert tuple(rows[A])[2:] == ("6", -80.0, 1, 1)
    assert tuple(rows[FF])[2:] == (None, None, 1, 0)


def test_clients(analysis):
    assert records(
        analysis.clients,
        "bssid",
        "mac",
        "packet_count",
        "sent_packets",
        "received_packets",
        "first_seen",
        "last_seen",
        "vendor",
        "activity_level",
    ) == [
        (A, C1, 8, 5, 5, "00:01:41", "00:01:43", "Apple", "Düşük"),
        (FF, C2, 1, 1, 0, "00:01:46", "00:01:46", "Private / Randomized MAC", "Düşük"),
    ]


def test_handshakes(analysis):
    assert records(
        analysis.handshake_candidates,
        "bssid",
        "client",
        "eapol_packet_count",
        "status",
        "first_seen",
        "last_seen",
    ) == [
        (A, C1, 4, "strong_candidate", "", ""),
        (A, "junk", 1, "partial", "104", "104"),
    ]


def test_subtypes_and_talkers(analysis):
    subtypes = analysis.frame_subtypes.orderBy("packet_count", ascending=False).collect()
    ordered = sorted(subtypes, key=lambda r: (-r.packet_count, r.first_seq))
    assert [(r.subtype, r.packet_count) for r in ordered] == [
        ("Subtype 32", 8),
        ("Beacon", 1),
        ("Subtype 0x0008", 1),
        ("Probe Request", 1),
    ]
    sources = analysis.top_sources.orderBy("rank").collect()
    assert [(r.mac, r.packet_count) for r in sources][:2] == [(A, 4), (C1, 4)]
    assert len(sources) == 4
    targets = analysis.top_destinations.orderBy("rank").collect()
    assert [(r.mac, r.packet_count) for r in targets] == [(A, 4), (C1, 4), (FF, 3)]


def test_findings(analysis):
    assert records(analysis.findings, "severity", "category", "n") == [
        ("info", "privacy", 1),
        ("info", "wireless", 1),
        ("success", "handshake", 1),
        ("warning", "signal", 1),
    ]


def test_capture_without_anything_still_has_a_finding(make_frames):
    quiet = Analysis(normalize(make_frames([{"capture_id": "quiet", "frame_number": "1"}])))
    (row,) = quiet.findings.collect()
    assert (row.severity, row.category, row.n) == ("info", "handshake", 0)
    assert tuple(quiet.summary.first()) == ("quiet", 1, 0, 0, 0)


def test_busy_clients_name_the_first_of_the_busiest(edge):
    busy = Analysis(edge.frames, busy_from=1)
    (row,) = busy.findings.where("rule_no = 5").collect()
    assert row.n == 2
    assert f"{C1} (8 paket)" in row.description


def test_union_of_captures_is_union_of_results(make_frames, edge):
    both = make_frames(edge_rows("edge") + edge_rows("other"))
    together = Analysis(normalize(both)).tables()
    for name, table in edge.tables().items():
        part = together[name].where("capture_id = 'edge'").drop("capture_id")
        assert sorted(map(str, part.collect())) == sorted(
            map(str, table.drop("capture_id").collect())
        ), name


def test_selections(edge):
    from airsift.operators import handshakes as H
    from airsift.plans import views as V

    (row,) = V.network_details(edge, bssid=A, capture_id="edge").collect()
    assert tuple(row)[2:] == ("AB", "6", "-80.0 dBm", 1, 5, "● Güçlü Aday (1)")
    assert V.network_details(edge, capture_id="none").count() == 0
    (row,) = V.client_details(edge.clients, bssid=FF, mac=C2).collect()
    assert row.packet_count == 1
    rows = H.network_handshakes(edge.handshake_candidates, A.upper(), "edge").collect()
    assert sorted(r.status_text for r in rows) == ["Güçlü Aday", "Kısmi"]
    assert H.network_handshakes(edge.handshake_candidates, FF).count() == 0


def test_text_summary(edge):
    from airsift.plans import views as V

    tables = V.text_summary(edge, show_clients=0)
    shown = sorted((r.bssid, r.channel_text, r.mac, r.remaining) for r in tables["networks"].collect())
    assert shown == [(A, "6", None, 1), (FF, "bilinmiyor", None, 1)]
    names = sorted((r.bssid, r.ssid_text) for r in tables["network_names"].collect())
    assert names == [(A, "AB"), (FF, "<SSID belirlenemedi veya gizli>")]
    assert tables["eapol_packets"].count() == 5
    assert tables["top_sources"].count() == 4
