"""All tables of an analysis over one set of normalised frames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsift import labels as L
from airsift.operators import clients as C
from airsift.operators import findings as D
from airsift.operators import handshakes as H
from airsift.operators import networks as N
from airsift.operators import rollups as R
from airsift.operators import traffic as T
from airsift.plans.workspace import all_written, new_work_folder, written


class Analysis:
    """Lazy tables over normalised frames of any number of captures.

    A new `Analysis` works on the frames directly, the best plan for one table. One over
    rollups that are given needs no frames.
    `materialize` aggregates the frames once into the rollups and returns an
    `Analysis` over those, the best plan for many tables.
    """

    def __init__(
        self,
        frames: DataFrame | None,
        oui: DataFrame | None = None,
        busy_from: int = L.BUSY_CLIENT_FROM,
        links: DataFrame | None = None,
        radio: DataFrame | None = None,
        eapol: DataFrame | None = None,
        facts: DataFrame | None = None,
    ):
        self.frames = frames
        self.oui = oui
        self.busy_from = busy_from
        self.materialized = facts is not None
        given = {"links": links, "radio": radio, "eapol_packets": eapol, "network_facts": facts}
        # A table that is given takes the place of the lazy property of its name.
        self.__dict__.update({k: v for k, v in given.items() if v is not None})

    def materialize(self, folder: str | None = None) -> Analysis:
        """Write the two rollups, the EAPOL packets and the network facts: three scans
        of the frames that each read only their columns. Nothing after this reads the
        frames again. An `Analysis` that is materialised already is returned as it is."""
        if self.materialized:
            return self
        folder = folder or new_work_folder(self.frames.sparkSession)
        tables = all_written(
            {
                "links": R.rollup_links(self.frames),
                "radio": R.rollup_radio(self.frames),
                "eapol": self.eapol_packets,
            },
            folder,
        )
        facts = N.network_facts(tables["radio"], tables["links"])
        return Analysis(
            self.frames,
            self.oui,
            self.busy_from,
            **tables,
            facts=written(facts, f"{folder}/facts"),
        )

    @cached_property
    def links(self) -> DataFrame:
        return R.frame_links(self.frames)

    @cached_property
    def radio(self) -> DataFrame:
        return R.frame_radio(self.frames)

    @cached_property
    def eapol_packets(self) -> DataFrame:
        return H.eapol_packets(self.frames)

    @cached_property
    def packet_totals(self) -> DataFrame:
        return T.packet_totals(self.radio)

    @cached_property
    def frame_subtypes(self) -> DataFrame:
        return T.frame_subtypes(self.radio)

    @cached_property
    def top_sources(self) -> DataFrame:
        return T.top_talkers(self.links, "src")

    @cached_property
    def top_destinations(self) -> DataFrame:
        return T.top_talkers(self.links, "dst")

    @cached_property
    def client_counts(self) -> DataFrame:
        if self.materialized:
            return N.client_counts(self.network_facts)
        return C.client_counts(self.links)

    @cached_property
    def clients(self) -> DataFrame:
        return C.clients(self.links, self.oui)

    @cached_property
    def network_facts(self) -> DataFrame:
        return N.network_facts(self.radio, self.links)

    @cached_property
    def network_measures(self) -> DataFrame:
        return N.network_measures(self.network_facts)

    @cached_property
    def network_ssids(self) -> DataFrame:
        return N.network_ssids(self.radio)

    @cached_property
    def networks(self) -> DataFrame:
        """Networks with their single values; `network_ssids` has the names."""
        return self.network_measures

    @cached_property
    def handshake_candidates(self) -> DataFrame:
        return H.handshake_candidates(self.eapol_packets)

    @cached_property
    def findings(self) -> DataFrame:
        return D.findings(
            self.packet_totals,
            self.handshake_candidates,
            self.network_measures,
            self.client_counts,
            self.oui,
            self.busy_from,
        )

    @cached_property
    def summary(self) -> DataFrame:
        """Packets, networks, distinct clients and EAPOL packets per capture."""
        networks = self.network_measures.groupBy("capture_id").agg(
            F.count("*").alias("network_count")
        )
        counts = ["total_packets", "network_count", "client_count", "eapol_packet_count"]
        return (
            self.packet_totals.unionByName(networks, allowMissingColumns=True)
            .unionByName(C.distinct_client_count(self.client_counts), allowMissingColumns=True)
            .groupBy("capture_id")
            .agg(*R.aggregates(*[f"coalesce(max({c}), 0L) AS {c}" for c in counts]))
        )

    def tables(self) -> dict[str, DataFrame]:
        return {
            "capture_summary": self.summary,
            "networks": self.networks,
            "network_ssids": self.network_ssids,
            "clients": self.clients,
            "frame_subtypes": self.frame_subtypes,
            "top_sources": self.top_sources,
            "top_destinations": self.top_destinations,
            "eapol_packets": self.eapol_packets,
            "handshake_candidates": self.handshake_candidates,
            "findings": self.findings,
        }


def analyze(
    frames: DataFrame, oui: DataFrame | None = None, folder: str | None = None
) -> dict[str, DataFrame]:
    """Every result table of normalised frames, from one pass that fills the rollups."""
    return Analysis(frames, oui).materialize(folder).tables()
