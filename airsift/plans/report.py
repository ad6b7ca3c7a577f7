"""The report of a capture: one flat table per section, the same at every size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airsift import labels as L
from airsift.plans.analysis import Analysis


def report_sections(analysis: Analysis) -> dict[str, DataFrame]:
    """One row per element of every list of the report, with the columns it is ordered by."""
    return analysis.tables()


def envelope(
    analysis: Analysis,
    captures: DataFrame | None = None,
    product: str = "airsift",
    generated_at: Column | None = None,
) -> DataFrame:
    """One row per capture: product, module, time of creation and the totals; `captures`
    (see `list_captures`) adds file names."""
    if generated_at is None:
        generated_at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    summary = analysis.summary
    if captures is not None:
        names = captures.select("capture_id", "capture_file", "capture_name")
        summary = summary.join(names.dropDuplicates(["capture_id"]), "capture_id", "left")
    return summary.select(
        "capture_id",
        F.lit(product).alias("product"),
        F.lit(L.ENVELOPE_MODULE).alias("module"),
        generated_at.alias("generated_at"),
        *[F.col(c) for c in summary.columns if c != "capture_id"],
    )
