"""Sets of client MACs as bitmaps: exact distinct counts that add up.

A MAC is a number of 48 bits. A bucket is a range of 32,768 of them, a bitmap of 4 KB that is
mostly zeros and compresses to little more than its MACs. The first 33 bits, and so the vendor
part and the local bit, are the same in a bucket: its class is looked up once, not per MAC.
The bitmaps of any captures are united by `or`, whatever batches they came from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsift import labels as L
from airsift.functions import text
from airsift.functions.text import literal
from airsift.operators.clients import endpoints
from airsift.operators.rollups import aggregates
from airsift.sources.dimensions import with_oui_vendor

_NUMBER = "CAST(conv(translate(mac, ':', ''), 16, 10) AS BIGINT)"
# Spark counts positions from 1, so that a bucket is a range of the MACs themselves.
_PLACE = f"{_NUMBER} + 1"


def mac_sets(links: DataFrame) -> DataFrame:
    """Per capture and bucket the bitmap of its client MACs."""
    macs = endpoints(links).select("capture_id", "mac").distinct()
    placed = macs.selectExpr(
        "capture_id",
        f"bitmap_bucket_number({_PLACE}) AS bucket",
        f"bitmap_bit_position({_PLACE}) AS place",
    )
    return placed.groupBy("capture_id", "bucket").agg(
        F.expr("bitmap_construct_agg(place)").alias("macs")
    )


def united(sets: DataFrame, *keys: str) -> DataFrame:
    """One bitmap per key and bucket."""
    return sets.groupBy(*keys, "bucket").agg(F.expr("bitmap_or_agg(macs)").alias("macs"))


def distinct_counts(sets: DataFrame, *keys: str, oui: DataFrame | None = None) -> DataFrame:
    """Distinct clients, randomised ones and ones of unknown vendor per key, or over all
    captures without a key, from the bitmaps alone."""
    counted = united(sets, *keys).selectExpr(
        *keys,
        "CAST(bitmap_count(macs) AS BIGINT) AS n",
        # The vendor part of the bucket, as an address.
        "regexp_replace(lpad(lower(hex(shiftright(bucket - 1, 9))), 6, '0'), '(..)', '$1:') AS mac",
    )
    named = with_oui_vendor(counted, "mac", oui)
    named = named.selectExpr("*", f"{text.vendor_label('mac', 'oui_vendor')} AS vendor")
    sums = aggregates(
        "sum(n) AS client_count",
        f"coalesce(sum(n) FILTER (WHERE vendor = {literal(L.VENDOR_RANDOMIZED)}), 0L) AS randomized",
        f"coalesce(sum(n) FILTER (WHERE vendor = {literal(L.VENDOR_UNKNOWN)}), 0L) AS unknown_vendor",
    )
    return named.groupBy(*keys).agg(*sums)
