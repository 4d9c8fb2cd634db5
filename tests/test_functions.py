"""Literal cases of normalisation, identifiers and names."""

import pytest
from pyspark.sql import functions as F

from cadastrix.functions import identifiers as ids
from cadastrix.functions import text as tx
from cadastrix.operators import extract
from cadastrix.plans.config import Config, ScanSettings, keyword_groups, load_config, overlay, resolve_device


def value(spark, make, *cells):
    row = spark.createDataFrame([tuple(cells)], ", ".join(f"c{i} string" for i in range(len(cells))))
    return row.select(make(*(F.col(f"c{i}") for i in range(len(cells)))).alias("v")).first().v


@pytest.mark.parametrize(
    ("make", "cell", "want"),
    [
        (tx.normalize_value, " a\x1fb c .;", "a b c"),
        (tx.normalize_value, None, ""),
        (tx.normalize_for_fuzzy, "@", "a"),
        (tx.normalize_ocr_numbers, "TAX ID", "TAX 1D"),
        (lambda c: tx.safe_path_part(c, "x"), "Plat/Replat - Lot 1", "PlatReplat - Lot 1"),
        (lambda c: tx.safe_path_part(c, "x"), "", "x"),
        (lambda c: tx.safe_path_part(c, "x"), "a" * 300, "a" * 140),
        (ids.normalize_identifier, "0012", "12"),
        (ids.normalize_identifier, "000", "000"),
        (ids.normalize_identifier, "0", "0"),
        (ids.normalize_tax_id, "1-253148", "01-253148"),
        (ids.normalize_tax_id, "01253148", "01-253148"),
        (ids.normalize_tax_id, "12345", ""),
        (ids.normalize_tax_id, "O1—25B148", "01-258148"),
        (tx.vote_key, "123 M@in", "lzemain"),
        (lambda c: ids.suggested_filename(F.lit(""), F.lit(""), c), "scan.pdf", "Lot.pdf"),
        (ids.register_value, '{"b":1,"a":2}', '{"a":2,"b":1}'),
        (ids.address_number, "12 Main St", "12"),
        (ids.address_number, "12A Main St", ""),
    ],
)
def test_literals(spark, make, cell, want):
    assert value(spark, make, cell) == want


def test_identifier_options_never_cut(spark):
    assert value(spark, lambda c: ids.identifier_options(c, (6,)), "123456789") == ["123456789"]
    assert value(spark, ids.identifier_options, "") == []
    assert value(spark, lambda c: ids.identifier_options(c, (2, 4)), "7") == ["0007", "07", "7"]


def test_address_words(spark):
    assert value(spark, ids.address_words, "12 North Main Street 5 Oak Hill Farm") == ["NORTH", "MAIN", "OAK"]
    assert value(spark, ids.address_words, None) == []


@pytest.mark.parametrize(("v", "known", "unknown"), [("", False, True), (" ", False, False), ("Unknown Lot", False, True), ("project", True, False), ("Project", False, True), ("7", True, False)])
def test_missing_predicates(spark, v, known, unknown):
    assert value(spark, tx.is_known, v) is known
    assert value(spark, tx.is_unknown, v) is unknown


def test_first_match_cases(spark):
    lot = load_config().get("lot_pattern")
    assert value(spark, lambda c: extract.first_match(c, lot), "PLOT 12 LOTS 3 LOT NO 4 LOT 5r") == "5r"
    parcel = load_config().get("parcel_patterns")
    assert value(spark, lambda c: extract.first_match(c, parcel, True), "PARCEL 34B") == "348"
    assert value(spark, lambda c: extract.first_match(c, parcel, True), "Parcel 34B") == ""


def test_ignored_address_parity(spark):
    assert value(spark, lambda c: extract.is_ignored_address(c, Config()), "123 MAIN RD")
    assert not value(spark, lambda c: extract.is_ignored_address(c, Config()), "2432 COMPTROLLERS CT")
    assert not value(spark, lambda c: extract.is_ignored_address(c, Config(parity=False)), "123 MAIN RD")


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"default_county": "X", "lot_pattern": [], "new_key": 1, "sdat_lookup": false}')
    c = load_config(str(tmp_path / "c.json"))
    assert c.county == "X" and c.get("new_key") == 1 and c.get("sdat_lookup") is False and c.get("lot_pattern")
    assert overlay({"a": 1}, {"a": None, "b": 0, "c": {}}) == {"a": 1, "b": 0, "c": {}}
    assert keyword_groups({"A": ["x"]}) == [("A", ["x"])] and keyword_groups(["B"]) == [("B", ["B"])] and keyword_groups(3) == []
    assert ScanSettings.of({"scan_mode": "MASS", "county": ""}).county == "Calvert"
    assert resolve_device("auto", True) == "gpu:0" and resolve_device("auto", False) == "cpu"


def test_plans_stay_native(spark):
    df = spark.createDataFrame([("a",)], "ocr_text string")
    plan = df.select(tx.safe_path_part(F.col("ocr_text"), "x"), ids.normalize_tax_id(F.col("ocr_text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_checkpoints_leave_settings_as_they_were(spark):
    from cadastrix import session

    keys = ["spark.sql.maxPlanStringLength", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.codegen.wholeStage"]
    before = [spark.conf.get(k, None) for k in keys]
    rows = spark.range(50).join(spark.range(5), "id")
    assert session.checkpoint(rows).count() == session.merged_checkpoint(rows).count() == session.brief_checkpoint(rows).count() == 5
    assert [spark.conf.get(k, None) for k in keys] == before
    spark.conf.set(keys[0], "500")
    try:
        with session.short_plan_texts(spark):
            assert spark.conf.get(keys[0]) == "500"  # a length of the user's own stays
    finally:
        spark.conf.unset(keys[0])


def test_small_inputs_are_spread(spark, tmp_path):
    from cadastrix import session

    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert session.spread(rows).rdd.getNumPartitions() == 4 and session.spread(rows, 0) is rows
    assert session.spread(rows.limit(0)).count() == 0
