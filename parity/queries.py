"""Every operator as a query over the given tables, with flat, comparable columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from airsift.functions import text
from airsift.operators import clients as C
from airsift.operators import findings as D
from airsift.operators import handshakes as H
from airsift.operators import macsets as M
from airsift.operators import networks as N
from airsift.operators import rollups as R
from airsift.operators import traffic as T
from airsift.operators.normalize import normalize
from airsift.plans import report as J
from airsift.plans import views as V
from airsift.plans.analysis import Analysis
from airsift.plans.rollup_store import merge_parts, read_mac_sets, read_rollups, write_batch
from airsift.plans.workspace import new_work_folder
from airsift.schema import FIELD_CANDIDATES
from airsift.sinks import writers as W
from airsift.sinks.paths import manifest
from airsift.sources.dimensions import with_oui_vendor
from airsift.sources.events import frames_from_events
from airsift.sources.frames import (
    capture_fields,
    list_captures,
    read_frame_store,
    read_frames,
    scan_summary,
    store_captures,
)

# Low enough for the test tables to have busy clients.
BUSY_FROM = 8

RANKED = ["capture_id", "bssid", "mac", "packet_count", "first_order"]
CLIENT = ["capture_id", "bssid", *V.CLIENT_DETAIL]


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return normalize(frames_from_events(spark, sf_dir))


def analysis(spark: SparkSession, sf_dir: str, **options) -> Analysis:
    return Analysis(normalized(spark, sf_dir), **options)


def over(fn: Callable[[Analysis], DataFrame], **options):
    """A query straight over the frames."""
    return lambda spark, sf_dir: fn(analysis(spark, sf_dir, **options))


def stored(fn: Callable[[Analysis], DataFrame], **options):
    """A query of many parts, over rollups written once."""
    return lambda spark, sf_dir: fn(analysis(spark, sf_dir, **options).materialize())


def frame_checks(a: Analysis) -> DataFrame:
    checks = ["capture_id", "seq"]
    for c in ("src", "dst", "bssid"):
        checks.append(f"CAST({text.is_valid_mac(c)} AS INT) AS {c}_valid")
        checks.append(f"CAST({text.is_ignored_mac(c)} AS INT) AS {c}_ignored")
    return a.frames.selectExpr(*checks)


def ssid_decode(a: Analysis) -> DataFrame:
    raw = a.frames.groupBy("ssid").agg(F.count("*").alias("packet_count"))
    return raw.selectExpr("*", f"{text.decode_ssid('ssid')} AS decoded")


def vendor_lookup(a: Analysis) -> DataFrame:
    macs = a.frames.selectExpr("explode(array(src, dst)) AS mac").distinct()
    return with_oui_vendor(macs, "mac").selectExpr(
        "mac",
        f"{text.normalize_oui('mac')} AS oui",
        f"CAST({text.is_locally_administered('mac')} AS INT) AS local",
        f"{text.vendor_label('mac', 'oui_vendor')} AS vendor",
    )


def client_endpoints(a: Analysis) -> DataFrame:
    return C.endpoints(a.links).select(
        "capture_id", "bssid", "mac", "first_order", "sent", "received"
    )


def search(a: Analysis, query: str) -> DataFrame:
    return N.search_networks(a.networks, a.network_ssids, query)


def link_rollup(a: Analysis) -> DataFrame:
    return R.rollup_links(a.frames)


def radio_rollup(a: Analysis) -> DataFrame:
    return R.rollup_radio(a.frames)


_OPTIONS = {"sep": "\t", "quoteAll": True, "escape": '"', "header": True}


def _export(rows: DataFrame, folder: str, number: int, kind: str, **options) -> None:
    """Write the exports of one site. Every file has rows: of a table with partition columns a
    task without rows writes none, of others Spark leaves the first task's file bare."""
    sited = rows.withColumn("site", F.lit(number))
    sited.write.mode("append").partitionBy("site").options(**options).format(kind).save(folder)


def tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames exported as tab-separated text and read back."""
    folder = new_work_folder(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    frames = frames_from_events(spark, sf_dir)
    exported = frames.select(
        *[F.col(name).alias(fields[0]) for name, fields in FIELD_CANDIDATES.items()]
    )
    _export(exported, folder, 0, "csv", **_OPTIONS)
    return normalize(read_frames(spark, folder, glob="*.csv")).drop("capture_id")


def frame_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised frames written to a frame store and read back."""
    folder = new_work_folder(spark)
    W.write_frame_store(normalized(spark, sf_dir), folder)
    return read_frame_store(spark, folder)


def written(write: Callable[[DataFrame, str], None], read: str):
    """A table written by a sink and read back with its own schema."""

    def run(spark: SparkSession, df: DataFrame) -> DataFrame:
        folder = new_work_folder(spark)
        write(df, folder)
        schema = T_.StructType([f for f in df.schema if f.name != "capture_id"])
        options = {"header": True, "escape": '"', "emptyValue": "", "nullValue": "\\N"}
        reader = spark.read.schema(schema.add("capture_id", "string"))
        reader = reader.options(**options) if read == "csv" else reader
        return reader.format(read).load(folder).select(*df.columns)

    return run


def as_json(fn: Callable[[Analysis], DataFrame]):
    """A section of the JSON report, written and read back."""
    return lambda spark, sf_dir: written(W.write_json, "json")(spark, fn(analysis(spark, sf_dir)))


def report_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope lines of the JSON report, written and read back."""
    wrapped = J.envelope(
        analysis(spark, sf_dir).materialize(), generated_at=F.lit("2024-01-01T00:00:00")
    )
    return written(W.write_json, "json")(spark, wrapped)


def networks_csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir).materialize()
    write = lambda df, folder: W.write_networks_csv(a.networks, a.network_ssids, folder)
    read = written(write, "csv")(spark, W.networks_csv(a.networks, a.network_ssids))
    # An empty field is a missing channel, and a name that is none.
    return read.withColumns({"Kanal": F.expr("nullif(Kanal, '')"), "SSID": F.expr("coalesce(SSID, '')")})


def clients_csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir).materialize()
    write = lambda df, folder: W.write_clients_csv(a.clients, a.network_ssids, folder)
    table = W.clients_csv(a.clients, a.network_ssids).drop("first_order")
    read = written(write, "csv")(spark, table)
    return read.withColumn("SSID", F.expr("coalesce(SSID, '')"))


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every section of a whole report, of its second writer, read by its manifest."""
    folder = new_work_folder(spark)
    a = analysis(spark, sf_dir).materialize()
    first, second = (W.write_all(a, folder, "report") for _ in range(2))
    counts = None
    for section, kind in sorted(manifest(spark, second).items()):
        if kind == "text":
            continue
        read = W.read_section(spark, second, section)
        read = read.groupBy().agg(F.count("*").alias("rows")).select(
            F.lit(second.removeprefix(first)).alias("writer"), F.lit(section).alias("section"), "rows"
        )
        counts = read if counts is None else counts.unionByName(read)
    return counts


def store_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of two captures with ids of a thousand characters, by the short key of the store
    and named by its captures."""
    folder = new_work_folder(spark)
    name = lambda c: f"file:/{'x' * 1000}/{c}.tsv"
    frames = normalized(spark, sf_dir)
    long = F.concat(F.lit(name("")[:-4]), "capture_id", F.lit(".tsv"))
    W.write_frame_store(frames.withColumn("capture_id", long), folder, buckets=8)
    stored = read_frame_store(spark, folder, captures=[name("cap0"), name("cap2")], short=True)
    a = Analysis(stored).materialize()
    captures = store_captures(spark, folder)
    found = a.clients.join(captures, "capture_id").drop("capture_id", "capture_file")
    return found.withColumn("capture_name", F.regexp_replace("capture_name", r"\.tsv$", ""))


def csv_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that begin and end with blanks, through CSV files."""
    named = analysis(spark, sf_dir).network_ssids
    padded = named.selectExpr("capture_id", "bssid", "concat(' ', ssid, ' ') AS ssid")
    return written(W.write_csv, "csv")(spark, padded)


def captures_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three captures with files of one name, exported and read back."""
    folder = new_work_folder(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    frames = frames_from_events(spark, sf_dir)
    for i in range(3):
        some = frames.where(F.col("frame_number").cast("bigint") % 3 == i)
        columns = [F.col(name).alias(fields[0]) for name, fields in FIELD_CANDIDATES.items()]
        _export(some.select(*columns), folder, i, "csv", **_OPTIONS)
    read = read_frames(spark, folder, glob="*.csv")
    site = F.regexp_extract("capture_id", "site(?:=|%3D)([0-9]+)", 1).cast("int")
    return read.groupBy(site.alias("site")).agg(F.count("*").alias("packet_count"))


# Columns of three kinds of exports: the usual ones; others of the candidates, turned round;
# two candidates of one column, a column nobody knows, and none that is never read.
_LAYOUTS = [
    {fields[0]: name for name, fields in FIELD_CANDIDATES.items()},
    {fields[-1]: name for name, fields in reversed(FIELD_CANDIDATES.items())},
    {"wlan.ta": "bssid", "ip.src": "channel"}
    | {fields[0]: name for name, fields in FIELD_CANDIDATES.items() if name != "frame_type"},
]


def mixed_exports(spark: SparkSession, sf_dir: str) -> str:
    """Frames exported by three kinds of exporters into one folder; returns the folder."""
    folder = new_work_folder(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    frames = frames_from_events(spark, sf_dir)
    for i, layout in enumerate(_LAYOUTS):
        some = frames.where(F.col("frame_number").cast("bigint") % len(_LAYOUTS) == i)
        columns = [F.col(name).alias(field) for field, name in layout.items()]
        _export(some.select(*columns), folder, i, "csv", **_OPTIONS)
    return folder


def mixed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports with other columns in other orders, read in one call."""
    frames = read_frames(spark, mixed_exports(spark, sf_dir), glob="*.csv")
    return normalize(frames).drop("capture_id")


def site(c: str = "capture_id"):
    return F.regexp_extract(c, "site(?:=|%3D)([0-9]+)", 1).cast("int").alias("site")


def mixed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which export field supplies each logical column, capture by capture."""
    status = capture_fields(spark, mixed_exports(spark, sf_dir), glob="*.csv")
    return status.select(site(), "pos", "logical_name", "physical_name", "available").distinct()


def _line_exports(spark: SparkSession, sf_dir: str, line) -> str:
    """Four exports of lines of text, `line` made of the quoted fields and the number of the
    frame, and one of a header line only; returns the folder."""
    folder = new_work_folder(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    fields = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in FIELD_CANDIDATES]
    number = F.col("frame_number").cast("bigint")
    rows = frames_from_events(spark, sf_dir).select(
        (number % 4).alias("site"), number.alias("at"), line(F.array(*fields), number).alias("value")
    )
    head = "\t".join(names[0] for names in FIELD_CANDIDATES.values())
    heads = spark.range(5).selectExpr("id AS site", "0L AS at", f"'{head}' AS value")
    ordered = rows.unionByName(heads).repartition("site").sortWithinPartitions("site", "at")
    ordered.select("site", "value").write.partitionBy("site").text(folder)
    return folder


def ragged_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lack their last fields, and rows with too many."""

    def line(fields, number):
        short = F.when(number % 5 == 0, F.slice(fields, 1, 6)).otherwise(fields)
        longer = (number % 7 == 0) & (number % 5 != 0)
        more = F.when(longer, F.concat(short, F.array(*[F.lit('"x"')] * 6))).otherwise(short)
        return F.array_join(more, "\t")

    folder = _line_exports(spark, sf_dir, line)
    read = read_frames(spark, [f"{folder}/site={i}" for i in range(4)])
    return normalize(read).drop("capture_id")


def damaged_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `scan_summary` tells of exports with short rows, cut in their last row, and bare."""
    total = frames_from_events(spark, sf_dir).count()

    def line(fields, number):
        whole = F.array_join(fields, "\t")
        last = number > total - 4
        odd = F.when((number % 4 == 3) & (number % 10 == 1), F.array_join(F.slice(fields, 1, 3), "\t"))
        quoted = F.regexp_replace(whole, ".$", "")
        short = F.array_join(F.slice(fields, 1, 2), "\t")
        return (
            F.when(last & (number % 4 == 1), quoted)
            .when(last & (number % 4 == 2), short)
            .otherwise(F.coalesce(odd, whole))
        )

    found = scan_summary(spark, _line_exports(spark, sf_dir, line))
    return found.select(site(), "rows", "odd_rows", "status", "reason")


def admitted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of exports with several suffixes those that are exports by their name, also packed."""
    folder = new_work_folder(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    frames = frames_from_events(spark, sf_dir)
    number = F.col("frame_number").cast("bigint")
    lines = frames.select(F.concat(F.lit('"'), "frame_number", F.lit('"')).alias("value"), (number % 3).alias("i"))
    _export(lines.where("i = 0").select("value"), folder, 0, "text")
    _export(lines.where("i = 1").select("value"), folder, 1, "csv")
    _export(lines.where("i = 2").select("value"), folder, 2, "text", compression="gzip")
    read = read_frames(spark, folder, fields=["frame.number"])
    listed = list_captures(spark, folder).select(site()).distinct()
    return read.groupBy(site()).agg(F.count("*").alias("packet_count")).join(listed, "site")


def in_batches(spark: SparkSession, sf_dir: str, merge: bool = False) -> str:
    """A rollup store filled in three batches, one of them tried twice and one left undone;
    with `merge` the first two are merged before the third."""
    root = new_work_folder(spark)
    frames = normalized(spark, sf_dir)
    for i in range(3):
        write_batch(frames.where(f"seq % 3 = {i}"), root, f"b{i}")
        if merge and i == 1:
            merge_parts(spark, root, "b0-b1")
    assert not write_batch(frames, root, "b1")
    R.rollup_links(frames).write.parquet(f"{root}/links/part=undone")
    return root


def batches(fn: Callable[[Analysis], DataFrame], merge: bool = False):
    """A query over rollups of three batches."""
    return lambda spark, sf_dir: fn(read_rollups(spark, in_batches(spark, sf_dir, merge)))


def mac_set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct clients over several sets of captures, from the bitmaps of three batches."""
    sets = read_mac_sets(spark, in_batches(spark, sf_dir))
    of = F.expr("explode(array(capture_id, 'all', if(capture_id < 'cap2', 'first', 'last')))")
    return M.distinct_counts(sets.select(of.alias("captures"), "bucket", "macs"), "captures")


def busy_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of which every tenth is told a thousand times, for the classes of busy clients."""
    frames = normalized(spark, sf_dir)
    times = F.when(F.col("seq") % 10 == 0, 1000).otherwise(1)
    return frames.withColumn("_n", F.explode(F.sequence(F.lit(1), times))).drop("_n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # scans and scalar projections
        "frames_normalized": lambda spark, sf_dir: normalized(spark, sf_dir),
        "tsv_scan": tsv_scan,
        "frame_store": frame_store,
        "frame_checks": over(frame_checks),
        "ssid_decode": over(ssid_decode),
        "vendor_lookup": over(vendor_lookup),
        # rollups
        "link_rollup": over(link_rollup),
        "radio_rollup": over(radio_rollup),
        "networks_from_rollups": stored(lambda a: a.networks),
        "clients_from_rollups": stored(lambda a: a.clients),
        "findings_from_rollups": stored(lambda a: a.findings),
        "summary_from_rollups": stored(lambda a: a.summary),
        "clients_in_batches": batches(lambda a: a.clients),
        "networks_in_batches": batches(lambda a: a.networks, merge=True),
        "findings_in_batches": batches(lambda a: a.findings),
        "summary_in_batches": batches(lambda a: a.summary, merge=True),
        "mac_set_counts": mac_set_counts,
        # totals and distributions
        "packet_totals": over(lambda a: a.packet_totals),
        "source_counts": over(lambda a: T.talkers(a.links, "src")),
        "destination_counts": over(lambda a: T.talkers(a.links, "dst")),
        "subtype_distribution": over(lambda a: a.frame_subtypes),
        "subtype_decimal": over(lambda a: T.frame_subtypes(a.radio, decimal_codes=True)),
        "top_sources": over(lambda a: a.top_sources),
        "top_destinations": over(lambda a: a.top_destinations),
        "top_sources_cli": over(lambda a: T.top_talkers(a.links, "src", 10)),
        # networks
        "networks": over(lambda a: a.networks),
        "network_ssids": over(lambda a: a.network_ssids),
        "network_channel_counts": over(lambda a: N.channel_counts(a.radio)),
        "network_channel_mode": over(lambda a: N.channel_mode(a.radio)),
        "network_signal": over(lambda a: N.signal_average(a.radio)),
        "network_measures": over(lambda a: a.network_measures),
        "network_search": over(lambda a: search(a, " aP-1 ")),
        "network_search_comma": over(lambda a: search(a, " net0, NET1, net2")),
        "network_search_part": over(lambda a: search(a, "1, N")),
        "network_search_hidden": over(lambda a: search(a, "gizli")),
        "network_search_blank": over(lambda a: search(a, "  ")),
        # clients
        "client_endpoints": over(client_endpoints),
        "clients": over(lambda a: a.clients),
        "client_ranks": over(
            lambda a: C.ranked_clients(a.clients.select(*RANKED)).drop("first_order")
        ),
        "clients_top25": over(lambda a: C.top_clients(a.clients, 25)),
        "client_activity_total": over(lambda a: C.client_totals(a.client_counts).drop("place")),
        "distinct_clients": over(lambda a: C.distinct_client_count(a.client_counts)),
        "client_class_counts": over(
            lambda a: D.client_class_counts(a.client_counts, busy_from=BUSY_FROM)
        ),
        "client_search": over(lambda a: C.search_clients(a.clients, "APPLE").select(*CLIENT)),
        "client_search_mac": over(
            lambda a: C.search_clients(a.clients, "02:11:22").select(*CLIENT)
        ),
        "client_activity_busy": lambda spark, sf_dir: Analysis(busy_frames(spark, sf_dir)).clients,
        "client_details": over(lambda a: V.client_details(a.clients)),
        # EAPOL and handshakes
        "eapol_packets": over(lambda a: a.eapol_packets),
        "first_eapol_packets": over(lambda a: H.first_eapol_packets(a.eapol_packets)),
        "handshake_candidates": over(lambda a: a.handshake_candidates),
        "strong_handshakes": over(
            lambda a: H.with_status(a.handshake_candidates, "strong_candidate")
        ),
        "partial_handshakes": over(lambda a: H.with_status(a.handshake_candidates, "partial")),
        "handshake_details_selected": over(
            lambda a: H.network_handshakes(
                a.handshake_candidates, bssid="3C:A7:AE:00:00:01", capture_id="cap1"
            )
        ),
        "client_details_selected": over(
            lambda a: V.client_details(a.clients, bssid="3c:a7:ae:00:00:01", capture_id="cap1")
        ),
        "handshake_details": over(lambda a: H.network_handshakes(a.handshake_candidates)),
        "network_handshake_verdict": stored(
            lambda a: H.network_verdicts(a.networks, a.handshake_candidates).select(
                "capture_id", "bssid", "strong", "partial", "verdict"
            )
        ),
        # findings
        "findings": stored(lambda a: a.findings),
        "findings_default_busy": lambda spark, sf_dir: (
            Analysis(busy_frames(spark, sf_dir)).materialize().findings
        ),
        "findings_busy": stored(lambda a: a.findings, busy_from=BUSY_FROM),
        "finding_severity_counts": stored(
            lambda a: D.severity_counts(a.packet_totals, a.findings)
        ),
        "report_findings": stored(V.report_findings),
        # summaries, charts, views
        "capture_summary": stored(lambda a: V.summary_cards(a.summary)),
        "signal_chart": over(lambda a: N.signal_chart(a.networks, a.network_ssids)),
        "subtype_chart": over(lambda a: T.subtype_chart(a.frame_subtypes)),
        "active_client_chart": over(lambda a: C.active_client_chart(a.client_counts)),
        "network_table": stored(lambda a: V.network_table(a.networks, a.network_ssids)),
        "network_details": stored(lambda a: V.network_details(a)),
        "report_networks": stored(lambda a: V.report_networks(a.networks, a.clients)),
        "report_subtypes": over(lambda a: V.report_subtypes(a.frame_subtypes)),
        "summary_networks": stored(lambda a: V.text_summary(a)["networks"]),
        # files
        "networks_csv": stored(lambda a: W.networks_csv(a.networks, a.network_ssids)),
        "clients_csv": over(lambda a: W.clients_csv(a.clients, a.network_ssids)),
        "networks_csv_files": networks_csv_files,
        "clients_csv_files": clients_csv_files,
        "report_files": report_files,
        "store_by_key": store_by_key,
        "csv_blanks": csv_blanks,
        "captures_by_path": captures_by_path,
        "mixed_captures": mixed_captures,
        "mixed_fields": mixed_fields,
        "ragged_exports": ragged_exports,
        "damaged_exports": damaged_exports,
        "admitted_files": admitted_files,
        "json_networks": as_json(lambda a: a.networks),
        "json_clients": as_json(lambda a: a.clients),
        "json_subtypes": as_json(lambda a: a.frame_subtypes),
        "json_handshakes": as_json(lambda a: a.handshake_candidates),
        "json_ssids": as_json(lambda a: a.network_ssids),
        "json_sources": as_json(lambda a: a.top_sources),
        "json_destinations": as_json(lambda a: a.top_destinations),
        "json_eapol": as_json(lambda a: a.eapol_packets),
        "json_findings": as_json(lambda a: a.materialize().findings),
        "json_summary": as_json(lambda a: a.materialize().summary),
        "report_envelope": report_envelope,
        "network_details_selected": stored(
            lambda a: V.network_details(a, bssid="3c:a7:ae:00:00:01")
        ),
        "summary_network_names": stored(lambda a: V.text_summary(a)["network_names"]),
    }
