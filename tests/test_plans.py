"""The physical plans are the ones meant: what is read, shuffled and limited."""

from __future__ import annotations

import re

import pytest
from conftest import edge_rows

from airsift import Analysis, normalize, read_frame_store
from airsift.operators import clients as C
from airsift.operators import networks as N
from airsift.operators import traffic as T
from airsift.sinks.writers import write_frame_store


def plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.sub(r"#\d+L?", "", text)


@pytest.fixture(scope="module")
def stored(spark, make_frames, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("plans") / "store")
    write_frame_store(normalize(make_frames(edge_rows())), folder)
    return Analysis(read_frame_store(spark, folder))


def columns_read(df):
    return [sorted(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*?)>", plan(df))]


def test_scans_read_only_what_they_need(stored):
    capture = "capture_id"  # a column of the store, as its folders are buckets of captures
    assert columns_read(stored.top_sources) == [[capture, "seq", "src", "src_ok"]]
    assert columns_read(stored.frame_subtypes) == [[capture, "seq", "sub"]]
    assert columns_read(stored.packet_totals) == [[capture, "eapol"]]
    assert columns_read(N.signal_average(stored.radio)) == [["bssid", "bssid_ok", capture, "sig"]]


@pytest.mark.parametrize("name", ["top_sources", "clients", "frame_subtypes", "packet_totals"])
def test_frames_meet_hash_aggregates_only(stored, name):
    assert "SortAggregate" not in plan(getattr(stored, name))


@pytest.mark.parametrize("name", ["links", "radio"])
def test_rollups_are_one_shuffle_of_partial_hash_aggregates(stored, name):
    from airsift.operators import rollups as R

    text = plan(getattr(R, f"rollup_{name}")(stored.frames))
    assert text.count("Exchange ") == 1
    assert "partial_sum" in text and "SortAggregate" not in text


def test_top_lists_are_limited_before_the_shuffle(stored):
    for df in (
        stored.top_sources,
        C.top_clients(stored.clients, 25),
        T.subtype_chart(stored.frame_subtypes),
        N.signal_chart(stored.networks, stored.network_ssids),
        C.active_client_chart(stored.client_counts),
    ):
        assert re.search(r"WindowGroupLimit .*Partial", plan(df)), plan(df)


def test_clients_need_one_shuffle_and_no_other_join(stored):
    text = plan(stored.clients)
    assert text.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_networks_use_no_outer_join_of_facts(stored):
    text = plan(stored.network_measures)
    assert "Join" not in text
    assert text.count("Exchange hashpartitioning") == 3  # radio rows, facts, networks


def test_no_python_and_no_cross_join(stored):
    for df in stored.tables().values():
        text = plan(df)
        assert "Python" not in text and "Pandas" not in text
        assert "CartesianProduct" not in text and "NestedLoop" not in text
