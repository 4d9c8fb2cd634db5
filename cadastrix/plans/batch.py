"""Batch mode: documents of a packet vote together, the packet is looked up once, and the result goes back to its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract, layout, register, review, visual, vote
from ..session import checkpoint
from .config import Config, ScanSettings, named_run


def run_settings(docs: DataFrame, known: DataFrame, settings: ScanSettings, config: Config, model=None) -> DataFrame:  # type: ignore[no-untyped-def]
    """A run by its settings: batch or mass mode, county, project code and section as entered or as the folder tells (R-4, R-5)."""
    from ..streaming import mass

    s = named_run(settings)
    rules = config.with_rules(default_county=s.county)
    if s.scan_mode == "mass":
        out = mass.process(docs, known, rules, s.project_code, key="scan_id")
        return out.withColumn("section", F.lit(s.section)) if s.section else out
    return run(docs, known, rules, s.project_code, s.section, model=model)


def run(docs: DataFrame, known: DataFrame, config: Config, project_code: str = "Project", section: str = "", fuzzy: bool = True, lines: str | None = None, model=None) -> DataFrame:  # type: ignore[no-untyped-def]
    """R-3, R-4: extract, repair duplicates, vote, enrich, merge, derive. ``docs`` has packet_id, ordinal, scan_id, source_name, ocr_text; where
    it has ``ocr_pages`` (or ``lines`` names a column of layout lines), addresses are sought there first; where it has ``features``, or
    ``visual_label`` and ``confidence``, M-10 applies. ``known`` comes from ``register.with_address``. Every plan of a packet gets the folder of the packet's first one. Extraction, vote and lookup are written once each (checkpoints), so none runs again."""
    rows = docs if lines else layout.with_address_lines(docs, config, "_lines")
    found = extract.extract_metadata(rows, config, project_code, fuzzy=fuzzy, lines=lines or "_lines").drop("_lines")
    found = checkpoint(visual.repair(found, config, model=model))
    shared = checkpoint(vote.shared_record(found, F.struct("ordinal", "scan_id")))
    if config.get("sdat_lookup", True):
        shared = checkpoint(register.enrich_batch(shared, checkpoint(known), config.county))
    merged = register.merge_batch(found, shared, project_code)
    if section:
        merged = merged.withColumn("section", F.lit(section))
    named = review.sync(merged)
    first = named.where(~F.col("is_lookup")).groupBy("packet_id").agg(F.min_by("folder_name", F.struct("ordinal", "scan_id")).alias("_folder"))
    return named.join(first, "packet_id", "left").withColumn("folder_name", F.when(F.col("is_lookup"), F.col("folder_name")).otherwise(F.coalesce("_folder", "folder_name"))).drop("_folder")
