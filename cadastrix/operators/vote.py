"""Plurality votes per packet: two-level aggregation, partial on the map side, so a packet with a third of all rows is no hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_known, vote_key

SHARED = ["lot", "address", "tax_map", "parcel", "tax_id", "section"]
FALLBACK = {"lot": "Unknown Lot", "address": "Unknown Address", "tax_map": "", "parcel": "", "tax_id": "", "section": ""}


def vote(rows: DataFrame, keys: list[str], value: str, order: Column, out: str = "voted") -> DataFrame:
    """A-1: most frequent folded value per group, in its first-seen spelling; ties go to the value seen first. Unknown values and
    values without letters or digits don't vote; a group without votes is left out. ``order`` must tell rows of a group apart."""
    ballots = rows.where(is_known(F.col(value))).withColumn("_key", vote_key(F.col(value))).where("_key <> ''").withColumn("_at", order)
    counted = ballots.groupBy(*keys, "_key").agg(F.count("*").alias("_n"), F.min(F.struct("_at", F.col(value).alias("v"))).alias("_first"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_first._at").alias("at"), F.col("_first.v").alias("v")))
    return counted.groupBy(*keys).agg(best["v"].alias(out))


def shared_record(docs: DataFrame, order: Column, keys: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """A-2: one row per packet with the voted fields of its permanent documents; the first known tax id of a register print-out
    outranks the vote. Needs ``is_lookup``; packets without permanent documents get the fallbacks."""
    keys, fields = keys or ["packet_id"], fields or SHARED
    rows = docs.withColumn("_order", order)
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields)))
    long = rows.where(~F.col("is_lookup")).select(*keys, "_order", pairs.alias("_p")).select(*keys, "_order", "_p.*")
    wide = vote(long, [*keys, "field"], "value", F.col("_order")).groupBy(*keys).pivot("field", fields).agg(F.first("voted"))
    printed = rows.where(F.col("is_lookup") & is_known(F.col("tax_id"))).groupBy(*keys).agg(F.min_by("tax_id", "_order").alias("_printed"))
    out = rows.select(*keys).distinct().join(wide, keys, "left").join(printed, keys, "left")
    values = {f: F.coalesce(*([F.col("_printed")] if f == "tax_id" else []), F.col(f), F.lit(FALLBACK.get(f, ""))) for f in fields}
    return out.withColumns(values).drop("_printed")
