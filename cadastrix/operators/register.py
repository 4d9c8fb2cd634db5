"""Lookups in the property register: left joins with priorities, all on equality keys (renderings of an identifier are exploded)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identifiers import address_number, address_words, display_address, identifier_options, identifiers_match, normalize_identifier, record_tax_id, register_value, tax_id_account, tax_id_district
from ..functions.text import is_known, normalize_value, normalized_address, or_else, prefer_known, safe_path_part, text, zfill

# The columns of the register by their short names.
FIELDS = {
    "county": "county_name_mdp_field_cntyname", "account_id": "account_id_mdp_field_acctid", "district": "record_key_district_ward_sdat_field_2",
    "account_number": "record_key_account_number_sdat_field_3", "lot": "lot_mdp_field_lot_sdat_field_41", "map": "map_mdp_field_map_sdat_field_42",
    "parcel": "parcel_mdp_field_parcel_sdat_field_44", "section": "section_mdp_field_section_sdat_field_39", "premise_number": "premise_address_number_mdp_field_premsnum_sdat_field_20",
    "premise_name": "premise_address_name_mdp_field_premsnam_sdat_field_23", "premise_type": "premise_address_type_mdp_field_premstyp_sdat_field_24",
    "premise_city": "premise_address_city_mdp_field_premcity_sdat_field_25", "premise_zip": "premise_address_zip_code_mdp_field_premzip_sdat_field_26",
    "mdp_address": "mdp_street_address_mdp_field_address", "mdp_city": "mdp_street_address_city_mdp_field_city", "mdp_zip": "mdp_street_address_zip_code_mdp_field_zipcode",
}
# Register columns kept with a document but not shown for review.
HIDDEN = [
    "legal_description_line_1_mdp_field_legal1_sdat_field_17", "legal_description_line_2_mdp_field_legal2_sdat_field_18", "deed_reference_1_liber_mdp_field_dr1liber_sdat_field_30",
    "deed_reference_1_folio_mdp_field_dr1folio_sdat_field_31", "grid_mdp_field_grid_sdat_field_43", "zoning_code_mdp_field_zoning_sdat_field_45",
    "land_use_code_mdp_field_lu_desclu_sdat_field_50", "property_factors_utilities_water_mdp_field_pfuw_sdat_field_63", "property_factors_utilities_sewer_mdp_field_pfus_sdat_field_64",
    "plat_reference_liber_mdp_field_pltliber_sdat_field_267", "plat_reference_folio_mdp_field_pltfolio_sdat_field_268",
]
ORDER = ["account_id", "district", "account_number", "register_id"]
VISIBLE = ["lot", "address", "tax_map", "parcel", "tax_id", "section"]


def with_address(register: DataFrame) -> DataFrame:
    """S-16: the register's columns under their short names, null as '', with the display address; hidden columns keep their names."""
    named = register.select("register_id", *(text(F.col(c)).alias(k) for k, c in FIELDS.items()), *(text(F.col(c)).alias(c) for c in HIDDEN))
    parts = ("premise_number", "premise_name", "premise_type", "premise_city", "premise_zip", "mdp_address", "mdp_city", "mdp_zip")
    return named.withColumn("full_address", display_address(*(F.col(p) for p in parts)))


def _source_order() -> list[Column]:
    return [F.col(c) for c in ORDER]


def _capped(pairs: DataFrame, probe: list[str], limit: int, *first: Column) -> DataFrame:
    order = Window.partitionBy(*probe).orderBy(*first, *_source_order())
    return pairs.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= limit).drop("_at")


def _county(county: str) -> Column:
    return F.upper("county").contains(county.upper()) if county else F.lit(True)


def _account_pairs(probes: DataFrame, register: DataFrame) -> DataFrame:
    """Probes (columns probe, terms) joined with the rows of their district and account, in any rendering of both."""
    keyed = probes.where("terms.district <> '' AND terms.account_number <> ''")
    keyed = keyed.withColumn("account_number", F.explode(identifier_options(F.col("terms.account_number"), (6, 8)))).withColumn("district", F.explode(identifier_options(F.col("terms.district"), (2,))))
    return keyed.join(register, ["account_number", "district"])


def lookup(probes: DataFrame, register: DataFrame, county: str = "", limit: int = 200) -> DataFrame:
    """J-2: register rows per probe by the first strategy that finds any: account in the county, account, map in the county, parcel in
    the county; the last two are narrowed to rows that agree with all terms, where any does (P-5).

    ``probes`` has a unique ``probe`` and a struct ``terms`` (lot, tax_map, parcel, district, account_number); ``register`` comes from
    ``with_address``. Adds ``strategy`` and ``rank`` (register order); at most ``limit`` rows per probe, as in a capped query.
    """
    by_account = _account_pairs(probes, register).withColumn("strategy", F.when(_county(county), 1).otherwise(2)) if county else _account_pairs(probes, register).withColumn("strategy", F.lit(2))
    # rows outside the county belong to strategy 2 only, rows inside to both: 1 wins where there is one
    tagged = [by_account]
    if county:
        inside = register.where(_county(county))
        for strategy, term, column in ((3, "tax_map", "map"), (4, "parcel", "parcel")):
            # of a number that many rows share only the first ``limit`` can be among the first of a probe
            first = _capped(inside.where(F.col(column) != ""), [column], limit)
            keyed = probes.where(F.col(f"terms.{term}") != "").withColumn(column, F.explode(identifier_options(F.col(f"terms.{term}"), (3, 4))))
            tagged.append(keyed.join(first, column).withColumn("strategy", F.lit(strategy)))
    pairs = reduce(lambda a, b: a.unionByName(b), tagged)
    first = pairs.withColumn("_least", F.min("strategy").over(Window.partitionBy("probe"))).where("strategy = _least")
    capped = _capped(first, ["probe"], limit)
    agree = reduce(lambda a, b: a & b, (identifiers_match(F.col(c), F.col(f"terms.{t}")) for t, c in (("tax_map", "map"), ("parcel", "parcel"), ("lot", "lot"), ("district", "district"), ("account_number", "account_number"))))
    judged = capped.withColumn("_ok", agree).withColumn("_any", F.max("_ok").over(Window.partitionBy("probe")))
    kept = judged.where((F.col("strategy") <= 2) | F.col("_ok") | ~F.col("_any")).drop("_ok", "_any", "_least")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("probe").orderBy(*_source_order())))


#: The terms of a probe with the register column that each is held against.
TERMS = {"tax_map": "map", "parcel": "parcel", "lot": "lot", "district": "district", "account_number": "account_number"}


def first_records(probes: DataFrame, register: DataFrame, county: str = "", limit: int = 200) -> DataFrame:
    """The row of rank 1 that ``lookup`` finds for each probe, as ``probe`` and ``record`` (its values), without listing the others.

    The first ``limit`` rows of every map and parcel number asked for are numbered once. For each set of terms that probes of a number
    leave open, the least number of every combination of the others is kept, so a probe finds its row by equality and carries a number, not rows.
    """
    tagged = _account_pairs(probes, register).select("probe", F.when(_county(county), 1).otherwise(2).alias("strategy") if county else F.lit(2).alias("strategy"), *_source_order(), register_values().alias("record"))
    best = F.min(F.struct("strategy", *_source_order(), "record")).alias("_best")
    by_account = tagged.groupBy("probe").agg(best).select("probe", "_best.record")
    if not county:
        return by_account
    numbers = lambda a, b: F.array(*(F.struct(F.lit(s).alias("by"), F.col(c).alias("text")) for s, c in ((3, a), (4, b)))).alias("_n")
    is_open = [text(F.col(f"terms.{t}")) == "" for t in TERMS]
    key = F.concat_ws("|", *(F.when(o, "*").otherwise(normalize_identifier(F.col(f"terms.{t}"))) for o, t in zip(is_open, TERMS, strict=True)))
    mask = F.concat(*(F.when(o, "*").otherwise("=") for o in is_open))
    asked = probes.select("probe", mask.alias("mask"), key.alias("key"), numbers("terms.tax_map", "terms.parcel")).select("probe", "mask", "key", F.inline("_n")).where("text <> ''")
    masks = asked.select("by", "text", "mask").distinct()
    own = F.array(*(normalize_identifier(F.col(c)) for c in TERMS.values())).alias("own")
    held = register.where(_county(county)).select(*_source_order(), own, register_values().alias("record"), numbers("map", "parcel")).select(*ORDER, "own", "record", F.inline("_n").alias("by", "value"))
    first = _capped(held.where("value <> ''"), ["by", "value"], limit)
    options = masks.select("by", "text").distinct().withColumn("value", F.explode(identifier_options(F.col("text"), (3, 4))))
    order = Window.partitionBy("by", "text").orderBy(*_source_order())
    numbered = options.join(first, ["by", "value"]).withColumn("at", F.row_number().over(order)).where(F.col("at") <= limit)
    own_key = F.concat_ws("|", *(F.when(F.substring("mask", i + 1, 1) == "*", "*").otherwise(F.col("own")[i]) for i in range(len(TERMS))))
    agreeing = numbered.select("by", "text", "at", "own").join(masks, ["by", "text"]).groupBy("by", "text", own_key.alias("key")).agg(F.min("at").alias("at"))
    # a number that the register holds gives its first row where no row agrees with all terms
    there = asked.join(numbered.where("at = 1").select("by", "text"), ["by", "text"], "left_semi").join(agreeing, ["by", "text", "key"], "left")
    least = there.groupBy("probe").agg(F.min(F.struct("by", "text", F.coalesce("at", F.lit(1)).alias("at"))).alias("_least")).select("probe", "_least.*")
    by_number = least.join(numbered.select("by", "text", "at", "record"), ["by", "text", "at"]).select("probe", "record")
    return by_account.unionByName(by_number.join(by_account.select("probe"), "probe", "left_anti"))


def terms_of(tax_id: Column | None = None, lot: Column | None = None, tax_map: Column | None = None, parcel: Column | None = None) -> Column:
    empty = F.lit("")
    lot = empty if lot is None else F.when(F.lower(text(lot)).startswith("unknown"), "").otherwise(text(lot))
    district, account = (empty, empty) if tax_id is None else (tax_id_district(tax_id), tax_id_account(tax_id))
    return F.struct(lot.alias("lot"), (empty if tax_map is None else text(tax_map)).alias("tax_map"), (empty if parcel is None else text(parcel)).alias("parcel"), district.alias("district"), account.alias("account_number"))


def lookup_by_tax_id(probes: DataFrame, register: DataFrame, county: str = "", limit: int = 200) -> DataFrame:
    """J-1: probes have ``probe`` and ``tax_id``; invalid ids find nothing."""
    return lookup(probes.select("probe", terms_of(F.col("tax_id")).alias("terms")), register, county, limit)


def lookup_by_address(probes: DataFrame, register: DataFrame, county: str = "", limit: int = 25) -> DataFrame:
    """J-3, J-4: probes have ``probe`` and ``address``. Rows of the five-digit house number whose combined address contains the first
    word, capped in register order, then ranked by the number of address words in the display address (+5 for the whole address)."""
    words, number = address_words(F.col("address")), address_number(F.col("address"))
    keyed = probes.select("probe", "address", number.alias("_number"), words.alias("_words")).where("_number <> '' AND size(_words) > 0")
    keyed = keyed.withColumn("premise_number", zfill(F.col("_number"), 5))
    here = F.upper("mdp_address").contains(F.col("_words")[0])
    pairs = keyed.join(register.where(_county(county)), "premise_number").where(here)
    capped = _capped(pairs, ["probe"], limit)
    candidate = normalized_address(F.col("full_address"))
    hits = F.aggregate(F.concat(F.array("_number"), F.col("_words")), F.lit(0), lambda a, w: a + F.when((w != "") & candidate.contains(w), 1).otherwise(0))
    scored = capped.withColumn("score", hits + F.when(candidate == normalized_address(F.col("address")), 5).otherwise(0))
    order = Window.partitionBy("probe").orderBy(F.desc("score"), *_source_order())
    return scored.withColumn("rank", F.row_number().over(order)).drop("_number", "_words")


def unique_address(found: DataFrame) -> DataFrame:
    """J-5: the row of each probe whose address equals the probe's or contains it or is contained, where it is the only one (P-6)."""
    a, b = normalized_address(F.col("address")), normalized_address(F.col("full_address"))
    alike = found.where((a != "") & (b != "") & ((a == b) | a.contains(b) | b.contains(a)))
    return alike.withColumn("_n", F.count("*").over(Window.partitionBy("probe"))).where("_n = 1").drop("_n")


def register_values() -> Column:
    """The metadata fields that one register row provides, '' where it is silent (input of J-9 and J-10)."""
    visible = {
        "lot": normalize_value(F.col("lot")), "address": F.col("full_address"), "tax_map": normalize_value(F.col("map")), "parcel": normalize_value(F.col("parcel")),
        "tax_id": record_tax_id(F.col("district"), F.col("account_number")), "section": normalize_value(F.col("section")),
    }
    return F.struct(*(safe_path_part(v, "").alias(k) for k, v in visible.items()), *(register_value(F.col(h)).alias(h) for h in HIDDEN))


def apply_record(rows: DataFrame, record: str = "record") -> DataFrame:
    """J-9: register value where there is one, else the field as it was; hidden fields are added where the rows lack them."""
    have = set(rows.columns)
    keep = {f: text(F.col(f)) if f in have else F.lit("") for f in [*VISIBLE, *HIDDEN]}
    return rows.withColumns({f: F.when(text(F.col(f"{record}.{f}")) != "", F.col(f"{record}.{f}")).otherwise(old) for f, old in keep.items()})


def _first(found: DataFrame, stage: int) -> DataFrame:
    return found.where("rank = 1").select("probe", register_values().alias("record"), F.lit(stage).alias("stage"))


def enrich_batch(shared: DataFrame, register: DataFrame, county: str = "", key: str = "packet_id") -> DataFrame:
    """J-6: the packet row enriched by tax id, else address (first row), else map and parcel; a tax id that finds nothing is cleared.

    Adds ``stage`` (1 tax id, 2 address, 3 map or parcel, null none) and the hidden columns.
    """
    probes = shared.withColumn("probe", F.col(key))
    by_tax = _first(lookup_by_tax_id(probes.where(is_known(F.col("tax_id"))), register, county), 1)
    by_address = _first(lookup_by_address(probes.where(is_known(F.col("address"))), register, county), 2)
    terms = probes.where("tax_map <> '' OR parcel <> ''").select("probe", terms_of(None, F.col("lot"), F.col("tax_map"), F.col("parcel")).alias("terms"))
    by_map = first_records(terms, register, county).withColumn("stage", F.lit(3))
    best = reduce(lambda a, b: a.unionByName(b), (by_tax, by_address, by_map)).groupBy("probe").agg(F.min_by("record", "stage").alias("record"), F.min("stage").alias("stage"))
    joined = probes.join(best, "probe", "left")
    cleared = joined.withColumn("tax_id", F.when(F.coalesce("stage", F.lit(9)) == 1, F.col("tax_id")).otherwise(F.lit("")))
    # only known register values are copied to the packet row (J-10)
    shown = {f: F.when(is_known(F.col(f"record.{f}")), F.col(f"record.{f}")).otherwise(text(F.col(f))) for f in VISIBLE}
    hidden = {f: F.when(is_known(F.col(f"record.{f}")), F.col(f"record.{f}")).otherwise(F.lit("")) for f in HIDDEN}
    return cleared.withColumns(shown | hidden).drop("record", "probe")


def enrich_mass(docs: DataFrame, register: DataFrame, county: str = "", project_code: str = "Project", key: str = "doc_id") -> DataFrame:
    """J-7: every document on its own: tax id, else a unique address, never map or parcel; print-outs stay as they are."""
    code = safe_path_part(F.lit(project_code), "Project")
    rows = docs.withColumn("probe", F.col(key))
    plans = rows.where(~F.col("is_lookup"))
    by_tax = first_records(plans.where(is_known(F.col("tax_id"))).select("probe", terms_of(F.col("tax_id")).alias("terms")), register, county).withColumn("stage", F.lit(1))
    unique = unique_address(lookup_by_address(plans.where(is_known(F.col("address"))), register, county))
    by_address = unique.select("probe", register_values().alias("record"), F.lit(2).alias("stage"))
    best = by_tax.unionByName(by_address).groupBy("probe").agg(F.min_by("record", "stage").alias("record"), F.min("stage").alias("stage"))
    joined = apply_record(rows.join(best, "probe", "left")).drop("record", "probe")
    return joined.withColumn("project_code", F.when(F.col("is_lookup"), F.col("project_code")).otherwise(code))


def merge_batch(docs: DataFrame, shared: DataFrame, project_code: str = "Project", keys: list[str] | None = None) -> DataFrame:
    """J-11: packet values where known, else the document's own; the type stays the document's, the project code is the run's."""
    keys = keys or ["packet_id"]
    named = shared.select(*keys, F.struct(*VISIBLE, *HIDDEN).alias("_shared"))
    own = {f: text(F.col(f)) if f in docs.columns else F.lit("") for f in [*VISIBLE, *HIDDEN]}
    merged = docs.join(named, keys, "left").withColumns({f: prefer_known(F.col(f"_shared.{f}"), o) for f, o in own.items()})
    return merged.withColumn("project_code", safe_path_part(F.lit(project_code), "Project")).drop("_shared")


def enrich_with_terms(rows: DataFrame, register: DataFrame, county: str = "", key: str = "doc_id") -> DataFrame:
    """J-8: rows with ``terms`` take over the first row that the strategies find; rows that find none stay as they are."""
    probes = rows.select(F.col(key).alias("probe"), "terms")
    best = first_records(probes, register, county).withColumnRenamed("probe", key)
    return apply_record(rows.join(best, key, "left")).drop("record")


#: Edits of these fields ask for a new lookup; each field with the way it is looked up.
ASKING = {"tax_id": 1, "address": 2, "tax_map": 3, "parcel": 3}


def refreshed(seeds: DataFrame, register: DataFrame, county: str = "", key: str = "probe") -> DataFrame:
    """J-12: ``key`` and a struct ``values`` (visible and hidden fields) of the seeds for which the lookup of their ``changed_field``
    finds a row: by tax id, by address (first of the ranked rows), else by map, parcel and lot. The row's values count, else the
    seed's; a seed looked up by map gives up its own tax id and address, as these told of the old property."""
    return _taken(_asked(seeds, register, county, key, "inner"), key).select(key, "values")


def _asked(seeds: DataFrame, register: DataFrame, county: str, key: str, how: str) -> DataFrame:
    """The seeds with the ``record`` that the lookup of their ``changed_field`` finds first."""
    probes = seeds.withColumn("probe", F.col(key)) if key != "probe" else seeds
    by = F.col("changed_field")
    tax = first_records(probes.where(by == "tax_id").select("probe", terms_of(F.col("tax_id")).alias("terms")), register, county)
    address = lookup_by_address(probes.where(by == "address").select("probe", "address"), register, county).where("rank = 1").select("probe", register_values().alias("record"))
    terms = probes.where(by.isin("tax_map", "parcel")).select("probe", terms_of(None, F.col("lot"), F.col("tax_map"), F.col("parcel")).alias("terms"))
    found = reduce(lambda a, b: a.unionByName(b), (tax, address, first_records(terms, register, county)))
    joined = probes.join(found, "probe", how)
    return joined.drop("probe") if key != "probe" else joined


def _taken(asked: DataFrame, key: str) -> DataFrame:
    """``values`` of the rows with a ``record``: the record's where it has one, else the row's own."""
    by_map = F.col("changed_field").isin("tax_map", "parcel")
    own = {f: text(F.col(f)) if f in asked.columns else F.lit("") for f in [*VISIBLE, *HIDDEN]}
    own["tax_id"] = F.when(by_map, F.lit("")).otherwise(own["tax_id"])
    own["address"] = F.when(by_map, F.lit("Unknown Address")).otherwise(own["address"])
    values = F.struct(*(or_else(F.col(f"record.{f}"), o).alias(f) for f, o in own.items()))
    return asked.withColumn("values", F.when(F.col("record").isNotNull(), values))


def refresh(docs: DataFrame, register: DataFrame, changed_field: str, county: str = "", key: str = "doc_id") -> DataFrame:
    """J-12, mass mode: each permanent document looked up again by itself after an edit of ``changed_field``; print-outs stay."""
    plans, rest = docs.where(~F.col("is_lookup")), docs.where(F.col("is_lookup"))
    # each document is its own seed, so what is found joins it once
    taken = _taken(_asked(plans.withColumn("changed_field", F.lit(changed_field)), register, county, key, "left"), key).drop("record", *({"changed_field"} - set(docs.columns)))
    return _with_values(taken).unionByName(rest, allowMissingColumns=True)


def refresh_packets(docs: DataFrame, register: DataFrame, changed_field: str, county: str = "", packet: str = "packet_id", order: tuple[str, ...] = ("ordinal", "scan_id")) -> DataFrame:
    """J-13, batch mode: the first permanent document of a packet is looked up and its values go to all permanent ones."""
    plans, rest = docs.where(~F.col("is_lookup")), docs.where(F.col("is_lookup"))
    seeds = packet_seeds(plans, packet, order).withColumn("changed_field", F.lit(changed_field))
    return _written(plans, refreshed(seeds, register, county, packet), [packet]).unionByName(rest, allowMissingColumns=True)


def packet_seeds(plans: DataFrame, packet: str, order: tuple[str, ...]) -> DataFrame:
    """The fields of each packet's first document, by an aggregate (no packet is gathered in one place)."""
    have = [f for f in [*VISIBLE, *HIDDEN] if f in plans.columns]
    first = F.min_by(F.struct(*have), F.struct(*order)).alias("_seed")
    return plans.groupBy(packet).agg(first).select(packet, "_seed.*")


def _written(plans: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    return _with_values(plans.join(values, keys, "left"))


def _with_values(joined: DataFrame) -> DataFrame:
    old = {f: F.col(f) if f in joined.columns else F.lit("") for f in [*VISIBLE, *HIDDEN]}
    return joined.withColumns({f: F.when(F.col("values").isNotNull(), F.col(f"values.{f}")).otherwise(o) for f, o in old.items()}).drop("values")
