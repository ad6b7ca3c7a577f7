"""Networks: one row per BSSID that shows an SSID, a channel, a signal or a client."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsift import labels as L
from airsift.functions import measures, text
from airsift.operators.clients import endpoints
from airsift.operators.ranking import ranks, top_k
from airsift.operators.rollups import aggregates

NETWORK_KEYS = ["capture_id", "bssid"]
_FACT_KEYS = [*NETWORK_KEYS, "kind", "value"]
_DECODED_SSID = f"CASE WHEN ssid = '' THEN '' ELSE {text.decode_ssid('ssid')} END"


def radio_facts(radio: DataFrame) -> DataFrame:
    """Channel, decoded SSID and signal of every radio row on a valid network, one row
    each."""
    facts = f"""inline(array(
        struct('channel' AS kind, channel AS value),
        struct('ssid' AS kind, {_DECODED_SSID} AS value),
        struct('signal' AS kind, CASE WHEN sig_n > 0 THEN 'dbm' ELSE '' END AS value)))"""
    kept = [*NETWORK_KEYS, "n", "first_seq", "sig_sum", "sig_n"]
    return radio.where("bssid <> ''").selectExpr(*kept, facts).where("value <> ''")


def client_facts(links: DataFrame) -> DataFrame:
    return endpoints(links).selectExpr(
        *NETWORK_KEYS,
        "'client' AS kind",
        "mac AS value",
        "n",
        "first_order AS first_seq",
        "0L AS sig_sum",
        "0L AS sig_n",
    )


def network_facts(radio: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct facts per network. The union of the four kinds is the network set, so
    grouping it replaces a chain of full outer joins."""
    sums = aggregates(
        "sum(n) AS n",
        "min(first_seq) AS first_seq",
        "sum(sig_sum) AS sig_sum",
        "sum(sig_n) AS sig_n",
    )
    # Texts are decoded and facts unfolded once per distinct radio row, not per frame.
    grouped = radio.groupBy(*NETWORK_KEYS, "channel", "ssid").agg(*sums)
    facts = radio_facts(grouped).unionByName(client_facts(links))
    return facts.groupBy(*_FACT_KEYS).agg(*sums)


def network_measures(facts: DataFrame) -> DataFrame:
    """Networks with their single values, aggregates of fixed size whatever the network.

    The primary channel is the one of most frames, ties to the one seen first.
    """
    most = "CASE WHEN kind = 'channel' THEN struct(n, -first_seq AS earlier) END"
    signal = measures.mean_2dp(
        "sum(CASE WHEN kind = 'signal' THEN sig_sum END)",
        "sum(CASE WHEN kind = 'signal' THEN sig_n END)",
    )
    values = aggregates(
        f"max_by(value, {most}) AS channel",
        f"{signal} AS average_signal_dbm",
        "count_if(kind = 'client') AS client_count",
        "count_if(kind = 'ssid') AS ssid_count",
    )
    return facts.groupBy(*NETWORK_KEYS).agg(*values)


def with_names(networks: DataFrame, ssids: DataFrame) -> DataFrame:
    """Networks with `ssid`, one row per network and name; null for one without any."""
    return networks.join(ssids, NETWORK_KEYS, "left")


def network_ssids(radio: DataFrame) -> DataFrame:
    """Distinct decoded SSIDs per network, one per row."""
    named = radio.where("bssid <> '' AND ssid <> ''")
    raw = named.select(*NETWORK_KEYS, "ssid").distinct()
    return raw.selectExpr(*NETWORK_KEYS, f"{_DECODED_SSID} AS ssid").distinct()


def channel_counts(radio: DataFrame) -> DataFrame:
    counts = aggregates("sum(n) AS packet_count", "min(first_seq) AS first_seq")
    used = radio.where("bssid <> '' AND channel <> ''")
    return used.groupBy(*NETWORK_KEYS, "channel").agg(*counts)


def channel_mode(radio: DataFrame) -> DataFrame:
    """Primary channel per network with its packet count."""
    mode = aggregates(
        "max_by(channel, struct(packet_count, -first_seq AS earlier)) AS channel",
        "max(packet_count) AS packet_count",
    )
    return channel_counts(radio).groupBy(*NETWORK_KEYS).agg(*mode)


def signal_average(radio: DataFrame) -> DataFrame:
    """Average signal per network that shows one, with its sample count."""
    average = aggregates(
        f"{measures.mean_2dp('sum(sig_sum)', 'sum(sig_n)')} AS average_signal_dbm",
        "sum(sig_n) AS samples",
    )
    measured = radio.where("bssid <> '' AND sig_n > 0")
    return measured.groupBy(*NETWORK_KEYS).agg(*average)


def client_counts(facts: DataFrame) -> DataFrame:
    """Packets per (capture, bssid, mac): the client facts."""
    return facts.where("kind = 'client'").selectExpr(
        *NETWORK_KEYS, "value AS mac", "n AS packet_count", "first_seq AS first_order"
    )


def signal_chart(networks: DataFrame, ssids: DataFrame, n: int = L.CHART_ROWS) -> DataFrame:
    """The n strongest networks of every capture, ties by bssid, one row per name. Names
    are looked up for the networks on the chart only."""
    order = [F.desc("average_signal_dbm"), F.asc("bssid")]
    top = top_k(networks.where("average_signal_dbm IS NOT NULL"), ["capture_id"], order, n)
    return with_names(top, ssids).selectExpr(
        "capture_id",
        "rank",
        "bssid",
        "coalesce(ssid, bssid) AS label",
        "average_signal_dbm",
        f"{measures.dbm_text('average_signal_dbm')} AS value_text",
        f"{measures.signal_scale('average_signal_dbm')} AS progress",
    )


# What stands between the names of a network where they are shown.
_BETWEEN = ", "


def _names_in_a_row(ssids: DataFrame, length: int) -> DataFrame:
    """`ssid`: every name with the `length` - 1 that follow it in its network, as shown.

    Names are numbered by `ranks`, and a name is sent to each of the rows it is in: a network
    of any number of names fills many tasks.
    """
    ranked = ranks(ssids.select(*NETWORK_KEYS, "ssid"), NETWORK_KEYS, [F.asc("ssid")])
    begins = F.sequence(F.col("rank") - length + 1, F.col("rank"))
    return (
        ranked.withColumn("begin", F.explode(begins))
        .groupBy(*NETWORK_KEYS, "begin")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "ssid"))).alias("names"))
        .select(*NETWORK_KEYS, F.array_join("names.ssid", _BETWEEN).alias("ssid"))
    )


def search_networks(networks: DataFrame, ssids: DataFrame, query: str) -> DataFrame:
    """Networks of which the BSSID or the text of all names, as shown, contains the query, in
    any case.

    Names are shown in order with ", " between them. A query with n commas spans n + 1 names
    at most, so names are searched n + 1 at a time, and the whole text is never built.
    """
    wanted = query.strip().lower()
    if not wanted:
        return networks
    shown = ssids
    if "," in wanted:
        shown = _names_in_a_row(ssids, wanted.count(",") + 1)
    names = shown.where(F.lower("ssid").contains(wanted)).select(*NETWORK_KEYS).distinct()
    named = names.withColumn("_named", F.lit(True))
    found = F.col("_named") | F.lower("bssid").contains(wanted)
    if wanted in L.SSID_FALLBACK["table"].lower():
        found = found | (F.col("ssid_count") == 0)
    return networks.join(named, NETWORK_KEYS, "left").where(found).drop("_named")
