"""Rollups kept batch by batch: a batch reads its own frames only, and readers sum the parts.

    root/<table>/part=<id>/     links, radio, eapol and mac sets of one batch
    root/_commits/<id>          the batch counts; a line per part that it replaces

Links and radio rows are sums, EAPOL rows are a list, MAC sets unite: all tables of an
`Analysis` follow from the union of the parts. A part counts once its commit is there; the
commit of a batch that is tried again is found, and the batch left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsift.operators import handshakes as H
from airsift.operators import macsets as M
from airsift.operators import networks as N
from airsift.operators import rollups as R
from airsift.plans.analysis import Analysis
from airsift.plans.workspace import all_written
from airsift.sinks.paths import create_new, names_in, read_small

_COMMITS = "_commits"


def _write(root: str, part: str, tables: dict[str, DataFrame], replaces: list[str]) -> None:
    spark = next(iter(tables.values())).sparkSession
    # What a try before left behind, without a commit, is overwritten.
    all_written(tables, root, lambda name: f"{root}/{name}/part={part}", mode="overwrite")
    create_new(spark, f"{root}/{_COMMITS}/{part}", "\n".join(replaces))


def write_batch(frames: DataFrame, root: str, part: str) -> bool:
    """Add the rollups of one batch of normalised frames; False if `part` counts already."""
    root = root.rstrip("/")
    if part in names_in(frames.sparkSession, f"{root}/{_COMMITS}"):
        return False
    links = R.rollup_links(frames)
    tables = {
        "links": links,
        "radio": R.rollup_radio(frames),
        "eapol": H.eapol_packets(frames),
        "macs": M.mac_sets(links),
    }
    _write(root, part, tables, [])
    return True


def committed(spark: SparkSession, root: str) -> list[str]:
    """The parts that count: committed, and not replaced by another."""
    folder = f"{root.rstrip('/')}/{_COMMITS}"
    names = set(names_in(spark, folder))
    merged = [n for n in names if n.startswith("merged-")]
    replaced = {old for n in merged for old in read_small(spark, f"{folder}/{n}").split("\n")}
    return sorted(names - replaced)


def read_parts(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of one table in all parts that count; other parts are pruned."""
    parts = committed(spark, root)
    if not parts:
        raise FileNotFoundError(f"no batch is committed in {root}")
    rows = spark.read.parquet(f"{root.rstrip('/')}/{table}")
    return rows.where(F.col("part").isin(parts)).drop("part")


def read_rollups(spark: SparkSession, root: str, oui: DataFrame | None = None) -> Analysis:
    """All tables over the batches so far. No frame is read."""
    links, radio = (read_parts(spark, root, t) for t in ("links", "radio"))
    return Analysis(
        None,
        oui,
        links=links,
        radio=radio,
        eapol=read_parts(spark, root, "eapol"),
        facts=N.network_facts(radio, links),
    )


def read_mac_sets(spark: SparkSession, root: str) -> DataFrame:
    return read_parts(spark, root, "macs")


def merge_parts(spark: SparkSession, root: str, part: str) -> None:
    """One part in place of all so far, for a store of many small batches. Readers see the old
    parts until the commit, and the new one from then on."""
    root, old = root.rstrip("/"), committed(spark, root)
    tables = {t: read_parts(spark, root, t) for t in ("links", "radio", "eapol", "macs")}
    summed = {
        "links": R.summed_links(tables["links"]),
        "radio": R.summed_radio(tables["radio"]),
        "eapol": tables["eapol"],
        "macs": M.united(tables["macs"], "capture_id"),
    }
    _write(root, f"merged-{part}", summed, old)
