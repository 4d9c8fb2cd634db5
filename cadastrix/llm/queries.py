"""Queries and SQL of the operators for training data; each runs over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, no_own_broadcasts, short_plan_texts
from ..session import read_table as table
from . import addresses, bpe, doctype, linkage, mixing, moderation, pii, survivors


def _written(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """A result of many steps, written once with short plan texts, so that what reads it has a short plan."""
    with short_plan_texts(spark), no_own_broadcasts(spark):
        return checkpoint(make())


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, lambda: linkage.found(table(spark, d, "property_register"), table(spark, d, "extracted_metadata")))


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    make = lambda: linkage.match_records(table(spark, d, "property_register"), table(spark, d, "extracted_metadata")).select("register_id", "record_id", "confidence", "cosine")
    return _written(spark, make)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, lambda: addresses.same_place_pairs(table(spark, d, "property_register"), table(spark, d, "extracted_metadata")))


def p2_places(spark: SparkSession, d: str) -> DataFrame:
    return addresses.place_classes(table(spark, d, "property_register"), table(spark, d, "extracted_metadata"))


def _pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.with_spans(table(spark, d, "scanned_documents").select("scan_id", "ocr_text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    items = _pii(spark, d).select("scan_id", F.explode("pii").alias("item"))
    return items.select("scan_id", "item.kind", "item.pii_text").distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _pii(spark, d).select("scan_id", "redacted")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "extracted_metadata").select("record_id", "document_type")
    return doctype.map_document_types(records, table(spark, d, "document_type_list")).select("record_id", "type_id")


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "extracted_metadata").select("record_id", "document_type")
    found = doctype.map_document_types(records, table(spark, d, "document_type_list")).where(F.col("type_id") == 0)
    return found.groupBy("document_type").agg(F.count("*").alias("records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, lambda: survivors.best_captures(table(spark, d, "extracted_metadata"), table(spark, d, "property_register"), table(spark, d, "capture_sources")))


def p5_consistent(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, lambda: survivors.consistent_captures(table(spark, d, "extracted_metadata"), table(spark, d, "property_register"), table(spark, d, "capture_sources")))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.with_token_ids(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = bpe.decode_ids(bpe.with_token_ids(table(spark, d, "documents").select("doc_id", "text")))
    return rows.select("doc_id", F.size("ids").alias("tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(table(spark, d, "documents"), table(spark, d, "source_targets"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return moderation.score_documents(table(spark, d, "documents").select("doc_id", "source", "text"), table(spark, d, "moderation_examples"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("flagged").select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "source", "score")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return moderation.rates_per_source(_scored(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_matches, p2_found, p2_places, p3_found, p3_redacted, p4_found, p4_unmatched, p5_found, p5_consistent, p6_ids, p6_roundtrip, p7_mix, p7_shares, p8_found, p8_scores, p8_rates)}


def oracle_sql() -> dict[str, str]:
    return {}
