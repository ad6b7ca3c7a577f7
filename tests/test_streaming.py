from __future__ import annotations

import pytest

from airsift import normalize, read_frame_store
from airsift.sinks.writers import write_frame_store
from airsift.sources.frames import CaptureReadError
from airsift.streaming.ingest import ingest_exports

FIELDS = ["frame.number", "wlan.sa", "wlan.bssid"]


def run(spark, source, store, **options):
    query = ingest_exports(spark, str(source), str(store), FIELDS, **options)
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def test_every_export_is_taken_once(spark, tmp_path):
    source, store = tmp_path / "in", tmp_path / "store"
    source.mkdir()
    (source / "a.tsv").write_text('"1"\t"00:1B:63:00:00:01"\t""\n')
    run(spark, source, store)
    (source / "b.tsv").write_text('"1"\t"x"\t""\n"2"\t"y"\t""\n')
    run(spark, source, store)
    run(spark, source, store)
    rows = read_frame_store(spark, str(store)).collect()
    name = lambda r: r.capture_id.rsplit("/", 1)[-1].removesuffix(".tsv")
    assert sorted((name(r), r.seq, r.src, r.src_ok) for r in rows) == [
        ("a", 1, "00:1b:63:00:00:01", True),
        ("b", 1, "x", False),
        ("b", 2, "y", False),
    ]


def test_exports_need_a_frame_number(spark, tmp_path):
    with pytest.raises(CaptureReadError):
        ingest_exports(spark, str(tmp_path), str(tmp_path / "s"), ["wlan.sa"])


def test_batch_store_and_ingest_share_a_store(spark, make_frames, tmp_path):
    source, store = tmp_path / "in", tmp_path / "store"
    write_frame_store(normalize(make_frames([{"capture_id": "x", "frame_number": "1"}])), str(store))
    for folder in ("a", "b"):
        (source / folder).mkdir(parents=True)
        (source / folder / "cap-01.tsv").write_text('"1"\t"00:1B:63:00:00:01"\t""\n')
        run(spark, source, store)
    rows = read_frame_store(spark, str(store)).collect()
    assert len(rows) == 3 and len({r.capture_id for r in rows}) == 3
