from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from airsift.operators import positions, ranking
from airsift.operators.clients import ranked_clients, top_clients
from airsift.schema import SEQ_MISSING


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_exact_rank_equals_one_window(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rng = random.Random(parts)
    rows = [
        ("hot" if i % 3 else f"g{i % 5}", rng.choice([1, 1, 1, 2, 5, rng.randint(1, 50)]), order)
        for i, order in enumerate(rng.sample(range(10_000), 2_000))
    ]
    df = spark.createDataFrame(rows, "g string, c bigint, o bigint").withColumn("t", F.col("o"))
    ranked = ranking.exact_rank(df, ["g"], "c", "o", "t").collect()
    expected = {}
    for g in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        expected |= {(g, r[2]): place for place, r in enumerate(members, 1)}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {(r.g, r.o): r["rank"] for r in ranked} == expected


def test_long_lists_have_the_same_plan_and_rank(spark):
    rows = [("c", "b", f"m{i:05d}", i % 7, i) for i in range(1500)]
    columns = "capture_id string, bssid string, mac string, packet_count bigint, first_order bigint"
    clients = spark.createDataFrame(rows, columns)
    full = {r.mac: r["rank"] for r in ranked_clients(clients).collect()}
    for n in (20, 1200):
        top = top_clients(clients, n)
        assert top.schema["rank"].dataType.simpleString() == "int"
        assert {r.mac: r["rank"] for r in top.collect()} == {m: r for m, r in full.items() if r <= n}
    limited = top_clients(clients, 20)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in limited
    assert top_clients(clients, 5000).count() == 1500
    assert top_clients(clients, -3).count() == 0
    assert spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold") == "1000"


def test_a_hot_group_without_frame_numbers_fills_many_tasks(spark, tmp_path):
    rows = spark.range(100_000).selectExpr(
        "'c' AS capture_id", "CAST(NULL AS STRING) AS bssid", "lpad(hex(id * 7919), 12, '0') AS mac"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    dealt = positions.ranged(rows, [F.col("capture_id"), F.col("bssid"), F.col("mac")], str(tmp_path / "r"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in dealt.groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 40_000
    ranked = positions.group_ranks(dealt, ["capture_id", "bssid"]).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 100_001))
    assert [r.mac for r in ranked] == sorted(r.mac for r in ranked)
    placed = positions.positions(dealt).orderBy("position").collect()
    assert [(r.position, r.mac) for r in placed] == [(r["rank"], r.mac) for r in ranked]


def test_ranks_scan_and_shuffle_once(spark):
    rows = [("c", f"b{i % 3}", f"m{i}", i % 7, i) for i in range(300)]
    columns = "capture_id string, bssid string, mac string, packet_count bigint, first_order bigint"
    clients = spark.createDataFrame(rows, columns)
    plan = ranked_clients(clients)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan  # the ranges are read, not dealt again
    assert plan.count("Exchange hashpartitioning") == 2 and "SinglePartition" not in plan


def test_clients_without_frame_numbers_are_sliced(spark):
    macs = spark.range(20_000).selectExpr("lower(hex(id * 7919 * 1048576 / 64)) AS h", "id")
    rows = macs.selectExpr(
        "'c' AS capture_id", "'b' AS bssid", "lpad(h, 12, '0') AS mac", "1L AS packet_count",
        f"{2 * SEQ_MISSING + 1}L AS first_order",
    )
    ranked = ranked_clients(rows)
    expected = sorted(r.mac for r in rows.collect())
    assert [r.mac for r in ranked.orderBy("rank").collect()] == expected
