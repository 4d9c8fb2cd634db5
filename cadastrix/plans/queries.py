"""Every query of the engine's own operators with its SQL; each runs over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import identifiers as ids
from ..functions import text as tx
from ..operators import extract, layout, register, review, visual, vote
from ..session import checkpoint, shared_folder
from ..session import read_table as table
from ..streaming import mass
from . import batch
from . import sqltext as s
from .config import DEFAULTS, LOOKUP_ONLY, Config, load_config

COUNTY = "Velden"
CONFIG: Config = load_config(county=COUNTY)
CLOCK = "2026-01-01T00:00:00"
FIELDS = ["lot", "address", "project_code", "document_type", "tax_map", "parcel", "tax_id", "section"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def scans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scanned_documents").select("scan_id", "packet_id", "ordinal", "source_path", "source_name", "ocr_text")


def laid(spark: SparkSession, d: str) -> DataFrame:
    """Scanned documents with their layout lines; the pages are dropped once read."""
    docs = table(spark, d, "scanned_documents").select(*scans(spark, d).columns, "ocr_pages")
    return layout.with_address_lines(docs, CONFIG, "lines").drop("ocr_pages")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Extracted records with '' for null and the lookup flag."""
    r = table(spark, d, "extracted_metadata")
    return r.withColumns({f: tx.text(F.col(f)) for f in FIELDS}).withColumn("is_lookup", F.col("document_type") == LOOKUP_ONLY)


def known(spark: SparkSession, d: str) -> DataFrame:
    return register.with_address(table(spark, d, "property_register"))


def probes(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).withColumn("probe", F.col("record_id"))


RECORDS = "SELECT * REPLACE (" + ", ".join(f"{s.c(f)} AS {f}" for f in FIELDS) + "), coalesce(document_type, '') = 'Lookup Only' AS is_lookup FROM extracted_metadata"
REG = f"reg AS MATERIALIZED ({s.register()})"
X = "ocr_text"


@query(f"SELECT scan_id, {s.t1(X)} AS value FROM scanned_documents")
def q01_normalize_value(spark: SparkSession, d: str) -> DataFrame:
    return scans(spark, d).select("scan_id", tx.normalize_value(F.col(X)).alias("value"))


@query(f"SELECT scan_id, {s.t2(X)} AS value FROM scanned_documents")
def q02_fuzzy_norm(spark: SparkSession, d: str) -> DataFrame:
    return scans(spark, d).select("scan_id", tx.normalize_for_fuzzy(F.col(X)).alias("value"))


@query(f"SELECT scan_id, {s.t3(X)} AS value FROM scanned_documents")
def q03_digit_repair(spark: SparkSession, d: str) -> DataFrame:
    return scans(spark, d).select("scan_id", tx.normalize_ocr_numbers(F.col(X)).alias("value"))


@query(f"SELECT record_id, {s.t4('address')} AS key, {s.t5('address')} AS compact FROM extracted_metadata")
def q04_vote_key(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("record_id", tx.vote_key(F.col("address")).alias("key"), tx.normalized_address(F.col("address")).alias("compact"))


@query(f"SELECT scan_id, {s.t6(X, s.q('Document'))} AS part FROM scanned_documents")
def q05_safe_path(spark: SparkSession, d: str) -> DataFrame:
    return scans(spark, d).select("scan_id", tx.safe_path_part(F.col(X), "Document").alias("part"))


@query(f"SELECT record_id, id, regexp_matches(id, '^[0-9]{{1,2}}-[0-9]{{4,8}}$') AS valid, {s.tax_part('id', 1)} AS district, {s.tax_part('id', 2)} AS account FROM (SELECT record_id, {s.t11('tax_id')} AS id FROM extracted_metadata)")
def q06_tax_id_canonical(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("tax_id")
    return records(spark, d).select("record_id", ids.normalize_tax_id(t).alias("id"), ids.is_valid_tax_id(t).alias("valid"), ids.tax_id_district(t).alias("district"), ids.tax_id_account(t).alias("account"))


@query(f"SELECT record_id, {s.t9('parcel')} AS identifier, array_to_string({s.t10('parcel', (2, 3, 4, 6, 8))}, ',') AS options FROM extracted_metadata")
def q07_identifier_options(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("parcel")
    return records(spark, d).select("record_id", ids.normalize_identifier(p).alias("identifier"), F.array_join(ids.identifier_options(p), ",").alias("options"))


@query(f"SELECT u.update_id, count(*) AS n, bool_or({s.c('u.parcel')} = '' OR {s.t9('r.parcel')} = {s.t9('u.parcel')}) AS parcel_matches, bool_or({s.t11('r.tax_id')} = {s.t11('u.tax_id')} AND {s.t11('u.tax_id')} <> '') AS tax_id_matches FROM review_updates u JOIN extracted_metadata r USING (record_id) GROUP BY u.update_id")
def q08_identifier_match(spark: SparkSession, d: str) -> DataFrame:
    u, r = table(spark, d, "review_updates").alias("u"), table(spark, d, "extracted_metadata").alias("r")
    rows = u.join(r, "record_id")
    same = ids.identifiers_match(F.col("r.parcel"), F.col("u.parcel"))
    return rows.groupBy("update_id").agg(F.count("*").alias("n"), F.max(same).alias("parcel_matches"), F.max(ids.tax_id_matches(F.col("r.tax_id"), F.col("u.tax_id"))).alias("tax_id_matches"))


_FIRST = {"lot": ("lot_pattern", False), "tax_map": ("map_patterns", False), "parcel": ("parcel_patterns", True), "tax_id": ("tax_id_patterns", True), "project_code": ("project_code_patterns", False)}


@query("SELECT scan_id, " + ", ".join(f"{s.first_match(X, DEFAULTS[p], n)} AS {k}" for k, (p, n) in _FIRST.items()) + " FROM scanned_documents")
def q09_first_match_fields(spark: SparkSession, d: str) -> DataFrame:
    return scans(spark, d).select("scan_id", *(extract.first_match(F.col(X), DEFAULTS[p], n).alias(k) for k, (p, n) in _FIRST.items()))


@query(f"SELECT scan_id, array_to_string({s.all_matches(X, DEFAULTS['lot_pattern'] + DEFAULTS['map_patterns'])}, '|') AS found FROM scanned_documents")
def q10_all_matches(spark: SparkSession, d: str) -> DataFrame:
    return scans(spark, d).select("scan_id", F.array_join(extract.all_matches(F.col(X), DEFAULTS["lot_pattern"] + DEFAULTS["map_patterns"]), "|").alias("found"))


@query(f"SELECT scan_id, {s.hits(X)} AS hits, {s.is_lookup(X)} AS is_lookup FROM scanned_documents")
def q11_lookup_detect(spark: SparkSession, d: str) -> DataFrame:
    return scans(spark, d).select("scan_id", extract.anchor_hits(F.col(X)).alias("hits"), extract.is_lookup_document(F.col(X)).alias("is_lookup"))


@query(f"SELECT scan_id, {s.lookup_tax(X)} AS tax_id FROM scanned_documents")
def q12_lookup_tax_id(spark: SparkSession, d: str) -> DataFrame:
    return scans(spark, d).select("scan_id", extract.lookup_tax_id(F.col(X)).alias("tax_id"))


@query(f"SELECT scan_id, {s.rule_label(X)} AS label, CAST({s.rule_start(X)} AS INT) AS start FROM scanned_documents")
def q13_doc_type_rules(spark: SparkSession, d: str) -> DataFrame:
    m = extract.regex_document_type(F.col(X), CONFIG)
    return scans(spark, d).select("scan_id", m["label"].alias("label"), m["start"].alias("start"))


@query(f"SELECT scan_id, {s.exact(X, 'label')} AS label, {s.exact(X, 'keyword')} AS keyword, CAST({s.exact(X, 'start')} AS INT) AS start FROM scanned_documents")
def q14_doc_type_exact(spark: SparkSession, d: str) -> DataFrame:
    m = extract.exact_document_type(F.col(X), CONFIG)
    return scans(spark, d).select("scan_id", m["label"].alias("label"), m["keyword"].alias("keyword"), m["start"].alias("start"))


@query()
def q15_doc_type_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return extract.with_document_type(scans(spark, d), CONFIG).select("scan_id", "type_match.*")


@query(f"SELECT scan_id, array_to_string(list_filter({s.all_matches(X, DEFAULTS['address_patterns'])}, lambda a: a <> ''), '|') AS candidates FROM scanned_documents")
def q16_address_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = F.filter(extract.all_matches(F.col(X), DEFAULTS["address_patterns"]), lambda a: a != "")
    return scans(spark, d).select("scan_id", F.array_join(found, "|").alias("candidates"))


@query(f"SELECT record_id, {s.ignored('address')} AS ignored FROM extracted_metadata")
def q17_address_ignored(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("record_id", extract.is_ignored_address(F.col("address"), CONFIG).alias("ignored"))


@query(f"SELECT d.scan_id, array_to_string(coalesce(lines, []), chr(10)) AS lines FROM scanned_documents d LEFT JOIN ({s.layout_lines()}) l ON l.scan_id = d.scan_id")
def q18_layout_lines(spark: SparkSession, d: str) -> DataFrame:
    return laid(spark, d).select("scan_id", F.array_join("lines", "\n").alias("lines"))


@query(f"SELECT * EXCLUDE (source_name) FROM ({s.extracted()})")
def q19_extract_metadata(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_metadata(laid(spark, d), CONFIG, fuzzy=False, lines="lines").select("scan_id", "packet_id", "ordinal", "is_lookup", *FIELDS)


_ORDER = "(sheet_no, record_id)"


@query(f"SELECT packet_id, sheet_no, voted AS lot FROM ({s.voted('(' + RECORDS + ')', 'packet_id, sheet_no', 'record_id', ['lot'])})")
def q20_vote_fields(spark: SparkSession, d: str) -> DataFrame:
    return vote.vote(records(spark, d), ["packet_id", "sheet_no"], "lot", F.col("record_id"), "lot")


def _shared_sql(source: str, order: str) -> str:
    votes = s.voted(f"(SELECT * FROM {source} WHERE NOT is_lookup)", "packet_id", order, vote.SHARED)
    picks = ", ".join(f"coalesce({'printed.id, ' if f == 'tax_id' else ''}max(CASE WHEN field = {s.q(f)} THEN voted END), {s.q(vote.FALLBACK[f])}) AS {f}" for f in vote.SHARED)
    return f"""SELECT p.packet_id, {picks} FROM (SELECT DISTINCT packet_id FROM {source}) p LEFT JOIN ({votes}) v USING (packet_id)
 LEFT JOIN (SELECT packet_id, arg_min(tax_id, {order}) AS id FROM {source} WHERE is_lookup AND {s.known('tax_id')} GROUP BY packet_id) printed USING (packet_id) GROUP BY p.packet_id, printed.id"""


@query(f"WITH r AS MATERIALIZED ({RECORDS}) {_shared_sql('r', _ORDER)}")
def q21_shared_record(spark: SparkSession, d: str) -> DataFrame:
    return vote.shared_record(records(spark, d), F.struct("sheet_no", "record_id"))


_TERMS = f"SELECT record_id AS probe, '' AS lot, '' AS tax_map, '' AS parcel, {s.tax_part(s.t11('tax_id'), 1)} AS district, {s.tax_part(s.t11('tax_id'), 2)} AS account_number FROM r"
_MAPS = "SELECT record_id AS probe, CASE WHEN starts_with(lower(lot), 'unknown') THEN '' ELSE lot END AS lot, tax_map, parcel, '' AS district, '' AS account_number FROM r"
_ALL = _MAPS.replace("'' AS district, '' AS account_number", f"{s.tax_part(s.t11('tax_id'), 1)} AS district, {s.tax_part(s.t11('tax_id'), 2)} AS account_number")
_WITH = f"WITH r AS MATERIALIZED ({RECORDS}), {REG}, "


@query(f"{_WITH} p AS MATERIALIZED ({_TERMS}) SELECT probe, register_id, strategy, rank FROM ({s.lookup('p', COUNTY)})")
def q22_lookup_tax_id(spark: SparkSession, d: str) -> DataFrame:
    return register.lookup_by_tax_id(probes(spark, d), known(spark, d), COUNTY).select("probe", "register_id", "strategy", "rank")


def _terms(spark: SparkSession, d: str, tax: bool = True) -> DataFrame:
    t = F.col("tax_id") if tax else None
    return probes(spark, d).select("probe", register.terms_of(t, F.col("lot"), F.col("tax_map"), F.col("parcel")).alias("terms"))


@query(f"{_WITH} p AS MATERIALIZED ({_ALL}) SELECT probe, register_id, strategy, rank FROM ({s.lookup('p', COUNTY)})")
def q23_lookup_strategies(spark: SparkSession, d: str) -> DataFrame:
    return register.lookup(_terms(spark, d), known(spark, d), COUNTY).select("probe", "register_id", "strategy", "rank")


@query(f"{_WITH} p AS MATERIALIZED ({_MAPS}) SELECT probe, count(*) AS kept, min(strategy) AS strategy, min(register_id) AS first_id FROM ({s.lookup('p', COUNTY)}) GROUP BY probe")
def q24_filter_fallback(spark: SparkSession, d: str) -> DataFrame:
    found = register.lookup(_terms(spark, d, False), known(spark, d), COUNTY)
    return found.groupBy("probe").agg(F.count("*").alias("kept"), F.min("strategy").alias("strategy"), F.min("register_id").alias("first_id"))


_ADDRESSES = "SELECT record_id AS probe, address FROM r"


@query(f"{_WITH} p AS MATERIALIZED ({_ADDRESSES}) SELECT probe, register_id, score, rank FROM ({s.by_address('p', '')})")
def q25_lookup_address_ranked(spark: SparkSession, d: str) -> DataFrame:
    return register.lookup_by_address(probes(spark, d), known(spark, d)).select("probe", "register_id", "score", "rank")


@query(f"{_WITH} p AS MATERIALIZED ({_ADDRESSES}) SELECT probe, register_id FROM ({s.unique_address(s.by_address('p', ''))})")
def q26_unique_address(spark: SparkSession, d: str) -> DataFrame:
    return register.unique_address(register.lookup_by_address(probes(spark, d), known(spark, d))).select("probe", "register_id")


_OUT = ["lot", "address", "project_code", "document_type", "tax_map", "parcel", "tax_id", "section"]


def _batch_sql() -> str:
    v = register.VISIBLE
    value = {f: s.record_value(f) for f in v}

    def first(stage: int, found: str) -> str:
        return f"SELECT probe, {stage} AS stage, " + ", ".join(f"{value[f]} AS v_{f}" for f in v) + f" FROM ({found}) WHERE rank = 1"

    tax = f"(SELECT packet_id AS probe, '' AS lot, '' AS tax_map, '' AS parcel, {s.tax_part(s.t11('tax_id'), 1)} AS district, {s.tax_part(s.t11('tax_id'), 2)} AS account_number FROM shared WHERE {s.known('tax_id')})"
    adr = f"(SELECT packet_id AS probe, address FROM shared WHERE {s.known('address')})"
    maps = "(SELECT packet_id AS probe, CASE WHEN starts_with(lower(lot), 'unknown') THEN '' ELSE lot END AS lot, tax_map, parcel, '' AS district, '' AS account_number FROM shared WHERE tax_map <> '' OR parcel <> '')"
    best = " UNION ALL ".join([first(1, s.lookup(tax, COUNTY)), first(2, s.by_address(adr, COUNTY)), first(3, s.lookup(maps, COUNTY))])
    rich = ", ".join(f"CASE WHEN {s.known(f'b.v_{f}')} THEN b.v_{f} ELSE " + ("(CASE WHEN b.stage = 1 THEN x.tax_id ELSE '' END)" if f == "tax_id" else f"x.{f}") + f" END AS {f}" for f in v)
    merged = ", ".join(f"CASE WHEN {s.known(f'h.{f}')} THEN h.{f} ELSE e.{f} END AS {f}" for f in v)
    return f"""docs AS MATERIALIZED ({s.extracted()}), shared AS MATERIALIZED ({_shared_sql('docs', '(ordinal, scan_id)')}), {REG},
 found AS MATERIALIZED ({best}), best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY probe ORDER BY stage) = 1),
 rich AS MATERIALIZED (SELECT x.packet_id, b.stage, {rich} FROM shared x LEFT JOIN best b ON b.probe = x.packet_id),
 merged AS MATERIALIZED (SELECT e.scan_id, e.packet_id, e.ordinal, e.source_name, e.is_lookup, e.document_type, 'Project' AS project_code, {merged} FROM docs e LEFT JOIN rich h USING (packet_id))"""


_NAMES = f"{s.folder('lot', 'address')} AS folder_name, {s.filename('document_type', 'lot', 'source_name')} AS file_name, {s.status('is_lookup', 'lot', 'address', 'project_code', 'document_type')} AS status"


@query(f"""WITH {_batch_sql()}, named AS MATERIALIZED (SELECT *, {_NAMES} FROM merged),
 firsts AS (SELECT packet_id, arg_min(folder_name, (ordinal, scan_id)) AS f FROM named WHERE NOT is_lookup GROUP BY packet_id)
 SELECT scan_id, packet_id, {', '.join(_OUT)}, CASE WHEN is_lookup THEN folder_name ELSE coalesce(f, folder_name) END AS folder_name, file_name, status FROM named LEFT JOIN firsts USING (packet_id)""")
def q27_batch_enrich(spark: SparkSession, d: str) -> DataFrame:
    return batch.run(laid(spark, d), known(spark, d), CONFIG, fuzzy=False, lines="lines").select("scan_id", "packet_id", *_OUT, "folder_name", "file_name", "status")


def _mass_sql() -> str:
    v = register.VISIBLE
    values = ", ".join(f"{s.record_value(f)} AS v_{f}" for f in v)
    tax = f"(SELECT scan_id AS probe, '' AS lot, '' AS tax_map, '' AS parcel, {s.tax_part(s.t11('tax_id'), 1)} AS district, {s.tax_part(s.t11('tax_id'), 2)} AS account_number FROM docs WHERE NOT is_lookup AND {s.known('tax_id')})"
    adr = f"(SELECT scan_id AS probe, address FROM docs WHERE NOT is_lookup AND {s.known('address')})"
    best = f"SELECT probe, 1 AS stage, {values} FROM ({s.lookup(tax, COUNTY)}) WHERE rank = 1 UNION ALL SELECT probe, 2 AS stage, {values} FROM ({s.unique_address(s.by_address(adr, COUNTY))})"
    rich = ", ".join(f"coalesce(nullif(b.v_{f}, ''), e.{f}) AS {f}" for f in v)
    return f"""WITH docs AS MATERIALIZED ({s.extracted()}), {REG}, found AS MATERIALIZED ({best}), best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY probe ORDER BY stage) = 1),
 rich AS MATERIALIZED (SELECT e.scan_id, e.source_name, e.is_lookup, e.document_type, CASE WHEN e.is_lookup THEN e.project_code ELSE 'Project' END AS project_code, {rich} FROM docs e LEFT JOIN best b ON b.probe = e.scan_id)
 SELECT scan_id, {', '.join(_OUT)}, {_NAMES} FROM rich"""


@query(_mass_sql())
def q28_mass_enrich(spark: SparkSession, d: str) -> DataFrame:
    out = mass.process(laid(spark, d), known(spark, d), CONFIG, fuzzy=False, key="scan_id", lines="lines")
    return out.select("scan_id", *_OUT, "folder_name", "file_name", "status")


@query(f"WITH r AS MATERIALIZED ({RECORDS}), shared AS MATERIALIZED ({_shared_sql('r', _ORDER)}) SELECT r.record_id, r.packet_id, 'Project' AS project_code, r.document_type, " + ", ".join(f"CASE WHEN {s.known(f'h.{f}')} THEN h.{f} ELSE r.{f} END AS {f}" for f in register.VISIBLE) + " FROM r LEFT JOIN shared h ON h.packet_id = r.packet_id")
def q29_merge_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d)
    shared = vote.shared_record(rows, F.struct("sheet_no", "record_id")).withColumns({h: F.lit("") for h in register.HIDDEN})
    return register.merge_batch(rows, shared).select("record_id", "packet_id", "project_code", "document_type", *register.VISIBLE)


_FOLDER = "regexp_extract(regexp_replace(coalesce(source_path, ''), '/[^/]*$', ''), '([^/]*)$', 1)"


@query(f"SELECT scan_id, CASE WHEN contains(f, '.') THEN trim(split_part(f, '.', 1)) ELSE {s.strip('f')} END AS project, CASE WHEN contains(f, '.') THEN trim(split_part(regexp_replace(f, '^[^.]*\\.', ''), '-', 1)) ELSE '' END AS section FROM (SELECT scan_id, {_FOLDER} AS f FROM scanned_documents)")
def q30_folder_project_section(spark: SparkSession, d: str) -> DataFrame:
    project, section = review.folder_project_section(F.regexp_replace(tx.text(F.col("source_path")), "/[^/]*$", ""))
    return scans(spark, d).select("scan_id", project.alias("project"), section.alias("section"))


_SOURCE = "'sheet_' || sheet_no || '.pdf' AS source_name"


@query(f"SELECT record_id, {_NAMES} FROM (SELECT *, {_SOURCE} FROM ({RECORDS}))")
def q31_names_status(spark: SparkSession, d: str) -> DataFrame:
    return review.sync(_named(spark, d)).select("record_id", "folder_name", "file_name", "status")


def _named(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).drop("scan_id", "capture_source", "captured_at", "loaded_at")
    return rows.withColumns({"source_name": F.concat(F.lit("sheet_"), F.col("sheet_no").cast("string"), F.lit(".pdf")), "ordinal": F.col("sheet_no"), "scan_id": F.col("record_id")})


_DUP = f"""WITH r AS MATERIALIZED (SELECT *, {s.strip('document_type')} AS kind, {s.missing('document_type', 'document_type')} AS nokind FROM (SELECT *, {_SOURCE} FROM ({RECORDS}))),
 g AS (SELECT packet_id, lower(kind) AS key, arg_min(kind, (sheet_no, record_id)) AS duplicate_type FROM r WHERE NOT is_lookup AND NOT nokind GROUP BY packet_id, lower(kind) HAVING count(*) >= 2)"""


@query(f"{_DUP} SELECT record_id, duplicate_type FROM r LEFT JOIN g ON g.packet_id = r.packet_id AND g.key = lower(r.kind) AND NOT r.is_lookup AND NOT r.nokind")
def q32_duplicate_types(spark: SparkSession, d: str) -> DataFrame:
    return review.duplicate_types(_named(spark, d)).select("record_id", "duplicate_type")


_MISSING = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {s.missing(f, f)} THEN {s.q(label)} END" for f, label in review.REQUIRED.items()) + "], lambda m: m IS NOT NULL), ', ')"


@query(f"{_DUP}, v AS (SELECT r.*, duplicate_type, {_MISSING} AS missing FROM r LEFT JOIN g ON g.packet_id = r.packet_id AND g.key = lower(r.kind) AND NOT r.is_lookup AND NOT r.nokind) SELECT record_id, missing, CASE WHEN duplicate_type IS NOT NULL THEN 'error' WHEN missing <> '' THEN 'warning' ELSE 'none' END AS severity, array_to_string(list_filter([CASE WHEN duplicate_type IS NOT NULL THEN 'Duplicate document type “' || duplicate_type || '”' END, CASE WHEN missing <> '' THEN 'Missing ' || missing END], lambda m: m IS NOT NULL), '; ') AS issues FROM v")
def q33_validation_state(spark: SparkSession, d: str) -> DataFrame:
    v = review.validation(review.sync(review.duplicate_types(_named(spark, d))))
    return v.select("record_id", F.array_join("missing", ", ").alias("missing"), "severity", F.array_join(F.transform("issues", lambda i: i["message"]), "; ").alias("issues"))


_VIS = "list_transform(range(1, 25), lambda i: CASE WHEN i = 1 THEN CAST(floor(abs(embedding[1]) * 40) AS DOUBLE) ELSE CAST(abs(embedding[i]) AS DOUBLE) END)"


def visual_rows(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    feats = F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.when(i == 1, F.floor(F.abs(e[0]) * 40).cast("double")).otherwise(F.abs(F.element_at(e, i)).cast("double")))
    kind = F.element_at(F.array(*(F.lit(k) for k in review.PLAN_TYPES), F.lit("Pier Plan")), (F.col("vec_id") % 4 + 1).cast("int"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.floor(F.col("vec_id") / 16).alias("packet_id"), F.col("vec_id").alias("ordinal"), "label", kind.alias("document_type"), feats.alias("features"))


_P = "greatest(0.0, least(0.98, 0.0::DOUBLE + (CASE WHEN f[1] >= 2 THEN 0.55 ELSE 0 END)::DOUBLE + (CASE WHEN f[1] >= 4 THEN 0.15 ELSE 0 END)::DOUBLE + (CASE WHEN f[2] < 0.85 THEN 0.10 ELSE 0 END)::DOUBLE + (CASE WHEN f[6] < 0.08 THEN 0.08 ELSE 0 END)::DOUBLE + (CASE WHEN f[5] BETWEEN 0.015 AND 0.13 THEN 0.07 ELSE 0 END)::DOUBLE + (CASE WHEN f[3] BETWEEN 0.005 AND 0.20 THEN 0.05 ELSE 0 END)::DOUBLE))"
_VISUAL = f"SELECT doc_id, packet_id, document_type, round({_P}, 6) AS p FROM (SELECT vec_id AS doc_id, vec_id // 16 AS packet_id, ['Site Plan', 'House Location', 'Wall Check', 'Pier Plan'][vec_id % 4 + 1] AS document_type, {_VIS} AS f FROM embeddings)"


@query(f"SELECT doc_id, p AS probability FROM ({_VISUAL})")
def q34_visual_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return visual_rows(spark, d).select("doc_id", F.round(visual.heuristic(F.col("features")), 6).alias("probability"))


@query(f"WITH v AS ({_VISUAL}), c AS (SELECT *, document_type <> 'Pier Plan' AND p >= 0.75 AS can FROM v), w AS (SELECT *, row_number() OVER (PARTITION BY packet_id, document_type, can ORDER BY p DESC, doc_id DESC) AS r, count(*) OVER (PARTITION BY packet_id, document_type) AS n FROM c) SELECT doc_id, packet_id, can AND r <= n - 1 AS repaired, CASE WHEN can AND r <= n - 1 THEN 'Field Notes' ELSE document_type END AS document_type FROM w")
def q35_duplicate_repair(spark: SparkSession, d: str) -> DataFrame:
    rows = visual.classify(visual_rows(spark, d)).withColumn("confidence", F.round("confidence", 6))
    return visual.repair_duplicates(rows, visual.threshold(CONFIG)).select("doc_id", "packet_id", "repaired", "document_type")


@query()
def q36_visual_model(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a trained forest for the rows that took no part in its training."""
    rows = visual_rows(spark, d).withColumn("label", F.when(F.col("label") % 2 == 0, "field_notes").otherwise("not_field_notes"))
    model, _ = visual.train(rows)
    return visual.classify(rows.where(visual.held_out()), model=model).select("doc_id", "label", "visual_label", F.round("confidence", 6).alias("confidence"))


def _updates_sql(mode: str) -> str:
    scope = "packet_id" if mode == "batch" else "record_id"
    stamp = "(updated_at, update_id)"
    shared = ", ".join(f"arg_max({f}, {stamp}) FILTER ({f} IS NOT NULL) AS n_{f}" for f in review.PROPERTY_FIELDS)
    values = ", ".join(f"coalesce(n_{f}, r.{f}) AS {f}" for f in review.PROPERTY_FIELDS)
    return f"""WITH r AS MATERIALIZED (SELECT *, {_SOURCE} FROM ({RECORDS})), u AS MATERIALIZED (SELECT DISTINCT ON (update_id) * FROM review_updates),
 a AS (SELECT {scope} AS scope, {shared}, count(*) AS updates FROM u WHERE {scope} IS NOT NULL GROUP BY {scope}), b AS (SELECT record_id, arg_max(document_type, {stamp}) FILTER (document_type IS NOT NULL) AS n_type FROM u WHERE record_id IS NOT NULL GROUP BY record_id),
 m AS (SELECT r.record_id, r.source_name, coalesce(a.updates, 0) AS updates, coalesce(n_type, r.document_type) AS document_type, {values} FROM r LEFT JOIN a ON a.scope = r.{scope} LEFT JOIN b ON b.record_id = r.record_id)
 SELECT record_id, updates, {', '.join(_OUT)}, {_NAMES.replace('is_lookup', "document_type = 'Lookup Only'")} FROM m"""


@query(_updates_sql("batch"))
def q37_apply_updates_batch(spark: SparkSession, d: str) -> DataFrame:
    return _updated(spark, d, "batch")


@query(_updates_sql("mass"))
def q38_apply_updates_mass(spark: SparkSession, d: str) -> DataFrame:
    return _updated(spark, d, "mass")


def _updated(spark: SparkSession, d: str, mode: str) -> DataFrame:
    out = review.apply_updates(_named(spark, d), table(spark, d, "review_updates"), mode)
    return out.select("record_id", "updates", *_OUT, "folder_name", "file_name", "status")


_CLAIM = "row_number() OVER (PARTITION BY folder_name, file_name ORDER BY packet_id, sheet_no, record_id)"
_NAMED = f"SELECT *, {_NAMES} FROM (SELECT *, {_SOURCE} FROM ({RECORDS}))"
_DEST = "folder_name || '/' || CASE WHEN n = 1 THEN file_name ELSE regexp_replace(file_name, '\\.[^.]*$', '') || ' (' || n || ')' || regexp_extract(file_name, '(\\.[^.]*)$', 1) END"


@query(f"SELECT record_id, {_DEST} AS dest FROM (SELECT *, {_CLAIM} AS n FROM ({_NAMED}))")
def q39_unique_paths(spark: SparkSession, d: str) -> DataFrame:
    return review.unique_paths(review.sync(_named(spark, d))).select("record_id", "dest")


_KEYS = ["lot", "address", "project_code", "document_type", "tax_map", "parcel", "tax_id", "section", "source_name"]


@query(f"SELECT record_id, trim(document_type || ' - Lot ' || lot, ' -') AS title, address AS subject, array_to_string(list_filter([{', '.join(f'CASE WHEN {k} <> {s.q("")} THEN {s.q(k + "=")} || {k} END' for k in _KEYS)}, 'filed_at={CLOCK}'], lambda k: k IS NOT NULL), '; ') AS keywords, CAST(1 + {' + '.join(f'({s.c(x)} <> {s.q("")})::INT' for x in review.XMP.values())} AS INT) AS entries FROM (SELECT *, {_SOURCE} FROM ({RECORDS}))")
def q40_keywords_xmp(spark: SparkSession, d: str) -> DataFrame:
    return review.pdf_metadata(_named(spark, d), CLOCK).select("record_id", "title", "subject", "keywords", F.size("xmp").alias("entries"))


@query(f"WITH n AS MATERIALIZED ({_NAMED}), f AS (SELECT packet_id, arg_min((lot, address, folder_name, project_code, section), (sheet_no, record_id)) AS x, count(*) AS file_count, string_agg(file_name, '|' ORDER BY sheet_no, record_id) AS files_filed FROM n GROUP BY packet_id) SELECT packet_id, x[1] AS lot_number, x[2] AS address, x[3] AS location_filed, '{CLOCK}' AS time_filed, x[4] AS project_code, x[5] AS section, file_count, files_filed FROM f")
def q41_audit_rollup(spark: SparkSession, d: str) -> DataFrame:
    return review.audit_rows(review.sync(_named(spark, d)), CLOCK)


@query(_mass_sql())
def q42_mass_stream_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, False)


#: Bytes of stored input for each file of a micro-batch.
FILE_BYTES = 2 << 20


def arrival_files(spark: SparkSession, rows: DataFrame) -> int:
    """Files of a micro-batch: by the size of the input, at most one for each shuffle partition."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(size // FILE_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _streamed(spark: SparkSession, d: str, whole: bool) -> DataFrame:
    """Mass mode as a stream of several micro-batches, the first of which comes twice: with the similarity stage where ``whole``, else what
    SQL can express."""
    from ..sources.store import VersionedStore

    base = f"{shared_folder(spark)}/mass-{uuid.uuid4().hex}"
    schema = StructType([f for f in spark.read.parquet(f"{d}/scanned_documents.parquet").schema if f.name in ("scan_id", "source_name", "ocr_text", "ocr_pages")])
    rows = spark.read.schema(schema).parquet(f"{d}/scanned_documents.parquet").withColumn("_batch", F.pmod(F.xxhash64("scan_id"), F.lit(2)))
    # a micro-batch is as many files as can be worked on at once, one where the input is small
    files = arrival_files(spark, rows)
    rows.repartition(files, "scan_id").write.partitionBy("_batch").parquet(f"{base}/arrivals")
    again = spark.read.parquet(f"{base}/arrivals").where("_batch = 0").drop("_batch").withColumn("_batch", F.lit(2))
    again.coalesce(files).write.mode("append").partitionBy("_batch").parquet(f"{base}/arrivals")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"{base}/arrivals")
    store = VersionedStore(spark, f"{base}/documents", key="scan_id")
    register_once = checkpoint(known(spark, d))
    mass.start(source.withColumn("doc_id", F.col("scan_id").cast("string")), register_once, CONFIG, mass.publish_to(store), f"{base}/checkpoint", fuzzy=whole, store=store).awaitTermination()
    out = store.read()
    if out is None:
        return (q57_mass_whole if whole else q28_mass_enrich)(spark, d).limit(0)
    return out.select("scan_id", *_OUT, "folder_name", "file_name", "status")


@query("WITH t AS (SELECT user_id % 20 AS run_id, event_type AS stage, sum(value) AS seconds FROM events GROUP BY ALL) SELECT run_id, stage, round(seconds, 4) AS seconds, row_number() OVER (PARTITION BY run_id ORDER BY round(seconds, 4) DESC, stage) AS rank, round(CASE WHEN sum(seconds) OVER (PARTITION BY run_id) > 0 THEN seconds / sum(seconds) OVER (PARTITION BY run_id) * 100 ELSE 0 END, 3) AS pct FROM t")
def q43_stage_timing_rank(spark: SparkSession, d: str) -> DataFrame:
    timings = table(spark, d, "events").select((F.col("user_id") % 20).alias("run_id"), F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    ranked = review.stage_ranking(timings)
    return ranked.select("run_id", "stage", F.round("seconds", 4).alias("seconds"), "rank", F.round("pct", 3).alias("pct"))


_SCALE = "CASE WHEN greatest(page_width, page_height) * (greatest(dpi, 72.0) / 72.0) > 3999 THEN 3999.0 / greatest(page_width, page_height) ELSE greatest(dpi, 72.0) / 72.0 END"
_PAGES = "(SELECT scan_id, unnest(ocr_pages, recursive := false) AS p FROM scanned_documents)"


@query(f"SELECT scan_id, page_index, round({_SCALE}, 6) AS scale, round(({_SCALE}) * 72, 6) AS effective_dpi FROM (SELECT scan_id, p.page_index AS page_index, p.page_width::DOUBLE AS page_width, p.page_height::DOUBLE AS page_height, p.dpi::DOUBLE AS dpi FROM {_PAGES})")
def q44_page_scale(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "scanned_documents").select("scan_id", F.explode("ocr_pages").alias("p"))
    scaled = layout.page_scale(F.col("p.page_width"), F.col("p.page_height"), F.col("p.dpi"))
    return pages.select("scan_id", F.col("p.page_index").alias("page_index"), F.round(scaled["scale"], 6).alias("scale"), F.round(scaled["dpi"], 6).alias("effective_dpi"))


_GOOD = "list_filter(coalesce(i.polygon, []), lambda g: len(g) >= 2 AND g[1] IS NOT NULL AND g[2] IS NOT NULL)"
_EDGE = {"x0": ("min", 1), "y0": ("min", 2), "x1": ("max", 1), "y1": ("max", 2)}


@query("SELECT scan_id, page_index, i.text AS text, " + ", ".join(f"coalesce(list_{fn}(list_transform({_GOOD}, lambda g: g[{k}])), 0.0)::DOUBLE AS {name}" for name, (fn, k) in _EDGE.items()) + f" FROM (SELECT scan_id, p.page_index AS page_index, unnest(p.items, recursive := false) AS i FROM {_PAGES})")
def q45_bbox(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "scanned_documents").select("scan_id", F.explode("ocr_pages").alias("p")).select("scan_id", F.col("p.page_index").alias("page_index"), F.explode("p.items").alias("i"))
    box = layout.bbox(F.col("i.polygon"))
    return items.select("scan_id", "page_index", F.col("i.text").alias("text"), *(box[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))))


@query("SELECT scan_id, coalesce(array_to_string(list_filter(flatten(list_transform(ocr_pages, lambda p: list_transform(coalesce(p.items, []), lambda i: i.text))), lambda t: t IS NOT NULL AND t <> ''), chr(10)), '') AS document_text FROM scanned_documents")
def q46_document_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scanned_documents").select("scan_id", layout.document_text(F.col("ocr_pages")).alias("document_text"))


@query(f"SELECT record_id, {s.known('lot')} AS lot_known, {s.unknown('lot')} AS lot_unknown, {s.missing('document_type', 'document_type')} AS type_missing, {s.missing('project_code', 'project_code')} AS code_missing FROM extracted_metadata")
def q47_missing_predicates(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "extracted_metadata")
    return r.select("record_id", tx.is_known(F.col("lot")).alias("lot_known"), tx.is_unknown(F.col("lot")).alias("lot_unknown"), tx.is_missing("document_type", F.col("document_type")).alias("type_missing"), tx.is_missing("project_code", F.col("project_code")).alias("code_missing"))


@query(f"SELECT register_id, full_address, {', '.join(f'{s.record_value(f)} AS {f}' for f in register.VISIBLE)} FROM (SELECT * REPLACE (lot AS lot) FROM ({s.register()}))".replace("FROM (SELECT * REPLACE (lot AS lot) FROM", "FROM (SELECT * FROM"))
def q48_register_values(spark: SparkSession, d: str) -> DataFrame:
    v = register.register_values()
    return known(spark, d).select("register_id", "full_address", v.alias("v")).select("register_id", "full_address", *(f"v.{f}" for f in register.VISIBLE))


@query(f"WITH r AS ({RECORDS}) SELECT record_id, CASE WHEN starts_with(lower(lot), 'unknown') THEN '' ELSE {s.t6('lot', s.q(''))} END AS lot, {s.t6('tax_map', s.q(''))} AS tax_map, {s.t6('parcel', s.q(''))} AS parcel, {s.tax_part(s.t11('tax_id'), 1)} AS district, {s.tax_part(s.t11('tax_id'), 2)} AS account_number, '{COUNTY}' AS county FROM r")
def q49_search_terms(spark: SparkSession, d: str) -> DataFrame:
    t = extract.search_terms(records(spark, d), CONFIG)
    return t.select("record_id", *(F.col(f"terms.{k}").alias(k) for k in ("lot", "tax_map", "parcel", "district", "account_number", "county")))


def _refresh_sql(found: str, own: dict[str, str] | None = None) -> str:
    own = own or {}
    values = ", ".join(f"CASE WHEN b.probe IS NULL THEN r.{f} ELSE coalesce(nullif(b.v_{f}, ''), {own.get(f, f'r.{f}')}) END AS {f}" for f in register.VISIBLE)
    return f"{_WITH} b AS MATERIALIZED (SELECT probe, {', '.join(f'{s.record_value(f)} AS v_{f}' for f in register.VISIBLE)} FROM ({found}) WHERE rank = 1) SELECT r.record_id, {values} FROM r LEFT JOIN b ON b.probe = r.record_id"


# looked up by map, a document gives up its own tax id and address: they told of the old property
_GIVEN_UP = {"tax_id": "''", "address": "'Unknown Address'"}


@query(_refresh_sql(s.by_address("(SELECT record_id AS probe, address FROM r WHERE NOT is_lookup)", COUNTY)))
def q50_refresh_by_address(spark: SparkSession, d: str) -> DataFrame:
    return register.refresh(records(spark, d), known(spark, d), "address", COUNTY, "record_id").select("record_id", *register.VISIBLE)


@query(_refresh_sql(s.lookup(f"({_MAPS} WHERE NOT is_lookup)", COUNTY), _GIVEN_UP))
def q51_refresh_by_map(spark: SparkSession, d: str) -> DataFrame:
    return register.refresh(records(spark, d), known(spark, d), "tax_map", COUNTY, "record_id").select("record_id", *register.VISIBLE)


@query(f"WITH n AS MATERIALIZED (SELECT * REPLACE ({s.t6('folder_name', s.q('Unsorted'))} AS folder_name, {s.t6('file_name', s.q('Document.pdf'))} AS file_name) FROM ({_NAMED})), f AS (SELECT *, {_CLAIM} AS n FROM n WHERE NOT is_lookup) SELECT record_id, {_DEST} AS dest, 'copy' AS mode FROM f")
def q52_filing_plan(spark: SparkSession, d: str) -> DataFrame:
    return review.filing_plan(review.sync(_named(spark, d))).select("record_id", "dest", "mode")


@query(f"SELECT status, count(*) AS documents FROM ({_NAMED}) GROUP BY status")
def q53_queue_counts(spark: SparkSession, d: str) -> DataFrame:
    return review.sync(_named(spark, d)).groupBy("status").agg(F.count("*").alias("documents"))


@query(f"SELECT record_id, CASE WHEN {s.missing('document_type', 'document_type')} THEN 'Unknown Type' ELSE {s.strip('document_type')} END || ' - ' || CASE WHEN {s.missing('lot', 'lot')} THEN 'Unknown Lot' ELSE 'Lot ' || {s.strip('lot')} END AS label FROM extracted_metadata")
def q54_document_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_metadata").select("record_id", ids.document_label(F.col("document_type"), F.col("lot")).alias("label"))


def _edited_sql(mode: str) -> str:
    """R-2 with J-12 and J-13: edits, then one lookup by the last field that asks for it, then fields edited later than that."""
    batch_ = mode == "batch"
    scope, stamp, v = "packet_id" if batch_ else "record_id", "(updated_at, update_id)", register.VISIBLE
    asks = ", ".join(map(s.q, register.ASKING))
    shared = ", ".join(f"arg_max({f}, {stamp}) FILTER ({f} IS NOT NULL) AS n_{f}, max({stamp}) FILTER ({f} IS NOT NULL) AS at_{f}" for f in review.PROPERTY_FIELDS)
    values = ", ".join(f"coalesce(n_{f}, r.{f}) AS {f}" for f in review.PROPERTY_FIELDS)
    seed = ", ".join(f"arg_min({f}, (sheet_no, record_id)) AS {f}" for f in v) if batch_ else ", ".join(v)
    group = " GROUP BY packet_id, asked" if batch_ else ""
    tax = f"(SELECT probe, '' AS lot, '' AS tax_map, '' AS parcel, {s.tax_part(s.t11('tax_id'), 1)} AS district, {s.tax_part(s.t11('tax_id'), 2)} AS account_number FROM seeds WHERE asked = 'tax_id')"
    maps = "(SELECT probe, CASE WHEN starts_with(lower(lot), 'unknown') THEN '' ELSE lot END AS lot, tax_map, parcel, '' AS district, '' AS account_number FROM seeds WHERE asked IN ('tax_map', 'parcel'))"
    found = " UNION ALL ".join(f"SELECT probe, {', '.join(f'{s.record_value(f)} AS v_{f}' for f in v)} FROM ({x}) WHERE rank = 1" for x in (s.lookup(tax, COUNTY), s.by_address("(SELECT probe, address FROM seeds WHERE asked = 'address')", COUNTY), s.lookup(maps, COUNTY)))
    own = {f: f"s.{f}" for f in v} | {"tax_id": "CASE WHEN s.asked IN ('tax_map', 'parcel') THEN '' ELSE s.tax_id END", "address": "CASE WHEN s.asked IN ('tax_map', 'parcel') THEN 'Unknown Address' ELSE s.address END"}
    final = ", ".join(f"CASE WHEN w.probe IS NOT NULL AND NOT m.is_lookup AND NOT coalesce(m.at_{f} > m.asked_at, false) THEN w.w_{f} ELSE m.{f} END AS {f}" for f in v)
    return f"""WITH r AS MATERIALIZED (SELECT *, {_SOURCE} FROM ({RECORDS})), {REG}, u AS MATERIALIZED (SELECT DISTINCT ON (update_id) * FROM review_updates),
 a AS (SELECT {scope} AS scope, {shared}, count(*) AS updates, arg_max(changed_field, {stamp}) FILTER (changed_field IN ({asks})) AS asked, max({stamp}) FILTER (changed_field IN ({asks})) AS asked_at FROM u WHERE {scope} IS NOT NULL GROUP BY {scope}),
 b AS (SELECT record_id, arg_max(document_type, {stamp}) FILTER (document_type IS NOT NULL) AS n_type FROM u WHERE record_id IS NOT NULL GROUP BY record_id),
 m AS MATERIALIZED (SELECT r.record_id, r.packet_id, r.sheet_no, r.source_name, r.is_lookup, a.scope, a.asked, a.asked_at, {', '.join(f'a.at_{f}' for f in review.PROPERTY_FIELDS)}, coalesce(a.updates, 0) AS updates, coalesce(n_type, r.document_type) AS document_type, {values} FROM r LEFT JOIN a ON a.scope = r.{scope} LEFT JOIN b ON b.record_id = r.record_id),
 seeds AS MATERIALIZED (SELECT {scope} AS probe, asked, {seed} FROM m WHERE NOT is_lookup AND asked IS NOT NULL{group}),
 found AS MATERIALIZED ({found}), w AS MATERIALIZED (SELECT s.probe, {', '.join(f"coalesce(nullif(v_{f}, ''), {own[f]}) AS w_{f}" for f in v)} FROM seeds s JOIN found USING (probe)),
 z AS (SELECT m.record_id, m.source_name, m.updates, m.document_type, m.project_code, {final} FROM m LEFT JOIN w ON w.probe = m.scope)
 SELECT record_id, updates, {', '.join(_OUT)}, {_NAMES.replace('is_lookup', "document_type = 'Lookup Only'")} FROM z"""


def _edited(spark: SparkSession, d: str, mode: str) -> DataFrame:
    out = review.apply_updates(_named(spark, d), table(spark, d, "review_updates"), mode, known=known(spark, d), county=COUNTY)
    return out.select("record_id", "updates", *_OUT, "folder_name", "file_name", "status")


@query(_edited_sql("batch"))
def q59_edits_looked_up_batch(spark: SparkSession, d: str) -> DataFrame:
    return _edited(spark, d, "batch")


@query(_edited_sql("mass"))
def q60_edits_looked_up_mass(spark: SparkSession, d: str) -> DataFrame:
    return _edited(spark, d, "mass")


def _packets_sql(found: str, own: dict[str, str]) -> str:
    v = register.VISIBLE
    seeds = ", ".join(f"arg_min({f}, (sheet_no, record_id)) AS {f}" for f in v)
    values = ", ".join(f"coalesce(nullif({s.record_value(f)}, ''), {own.get(f, f's_{f}')}) AS w_{f}" for f in v)
    final = ", ".join(f"CASE WHEN w.probe IS NOT NULL AND NOT r.is_lookup THEN w_{f} ELSE r.{f} END AS {f}" for f in v)
    return f"""{_WITH} seeds AS MATERIALIZED (SELECT packet_id AS probe, {seeds} FROM r WHERE NOT is_lookup GROUP BY packet_id), hits AS MATERIALIZED (SELECT * FROM ({found}) WHERE rank = 1),
 w AS MATERIALIZED (SELECT h.probe, {values} FROM hits h JOIN (SELECT probe AS sp, {', '.join(f'{f} AS s_{f}' for f in v)} FROM seeds) ON sp = h.probe) SELECT r.record_id, {final} FROM r LEFT JOIN w ON w.probe = r.packet_id"""


_SEED_TAX = f"(SELECT probe, '' AS lot, '' AS tax_map, '' AS parcel, {s.tax_part(s.t11('tax_id'), 1)} AS district, {s.tax_part(s.t11('tax_id'), 2)} AS account_number FROM seeds)"


@query(_packets_sql(s.lookup(_SEED_TAX, COUNTY), {}))
def q61_refresh_packets_by_tax_id(spark: SparkSession, d: str) -> DataFrame:
    return register.refresh_packets(records(spark, d), known(spark, d), "tax_id", COUNTY, order=("sheet_no", "record_id")).select("record_id", *register.VISIBLE)


@query(_refresh_sql(s.lookup(f"({_TERMS} WHERE NOT is_lookup)", COUNTY)))
def q62_refresh_by_tax_id(spark: SparkSession, d: str) -> DataFrame:
    return register.refresh(records(spark, d), known(spark, d), "tax_id", COUNTY, "record_id").select("record_id", *register.VISIBLE)


def _text_terms_sql() -> str:
    x, p = "t.ocr_text", DEFAULTS
    county = f"trim(regexp_replace({s.or_else(s.first_match(x, p['county_patterns']), s.q(COUNTY))}, '(?i)\\bcounty\\b', '', 'g'))"
    tax = s.or_else(s.c("e.tax_id"), s.first_match(x, p["tax_id_patterns"], True))
    values = {
        "lot": "CASE WHEN starts_with(lower(e.lot), 'unknown') THEN '' ELSE e.lot END", "tax_map": s.or_else("e.tax_map", s.first_match(x, p["map_patterns"])), "parcel": s.or_else("e.parcel", s.first_match(x, p["parcel_patterns"])),
        "district": s.or_else(s.tax_part(s.t11("y.tax"), 1), s.first_match(x, p["district_patterns"], True)), "account_number": s.or_else(s.tax_part(s.t11("y.tax"), 2), s.first_match(x, p["account_patterns"], True)), "county": county,
    }
    inner = f"SELECT e.scan_id AS id, {tax} AS tax FROM docs e JOIN scanned_documents t USING (scan_id)"
    return f"docs AS MATERIALIZED ({s.extracted()}), y AS MATERIALIZED ({inner}), terms AS MATERIALIZED (SELECT e.scan_id, {', '.join(f'{s.t6(e, s.q(str()))} AS {k}' for k, e in values.items())} FROM docs e JOIN scanned_documents t USING (scan_id) JOIN y ON y.id = e.scan_id)"


_TERM_KEYS = ("lot", "tax_map", "parcel", "district", "account_number", "county")


@query(f"WITH {_text_terms_sql()} SELECT scan_id, {', '.join(_TERM_KEYS)} FROM terms")
def q63_search_terms_of_texts(spark: SparkSession, d: str) -> DataFrame:
    t = extract.search_terms(extract.extract_metadata(laid(spark, d), CONFIG, fuzzy=False, lines="lines"), CONFIG)
    return t.select("scan_id", *(F.col(f"terms.{k}").alias(k) for k in _TERM_KEYS))


@query(f"WITH {_text_terms_sql()}, {REG}, b AS MATERIALIZED (SELECT probe, {', '.join(f'{s.record_value(f)} AS v_{f}' for f in register.VISIBLE)} FROM ({s.lookup('(SELECT scan_id AS probe, lot, tax_map, parcel, district, account_number FROM terms)', COUNTY)}) WHERE rank = 1) SELECT e.scan_id, {', '.join(f"coalesce(nullif(b.v_{f}, ''), e.{f}) AS {f}" for f in register.VISIBLE)} FROM docs e LEFT JOIN b ON b.probe = e.scan_id")
def q64_enrich_with_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = extract.search_terms(extract.extract_metadata(laid(spark, d), CONFIG, fuzzy=False, lines="lines"), CONFIG)
    return register.enrich_with_terms(checkpoint(rows.select("scan_id", "terms", *register.VISIBLE)), known(spark, d), COUNTY, "scan_id").select("scan_id", *register.VISIBLE)


@query(f"WITH g AS MATERIALIZED ({_NAMED}), p AS (SELECT packet_id, arg_min(folder_name, (sheet_no, record_id)) AS f FROM g WHERE NOT is_lookup GROUP BY packet_id), n AS MATERIALIZED (SELECT g.* REPLACE ({s.t6('p.f', s.q('Unsorted'))} AS folder_name, {s.t6('file_name', s.q('Document.pdf'))} AS file_name) FROM g JOIN p USING (packet_id)), f AS (SELECT *, {_CLAIM} AS n FROM n WHERE NOT is_lookup) SELECT record_id, {_DEST} AS dest, 'move' AS mode FROM f")
def q65_packet_filing_plan(spark: SparkSession, d: str) -> DataFrame:
    return review.filing_plan(review.with_packet_folder(review.sync(_named(spark, d))), copy=False).select("record_id", "dest", "mode")


# The whole jobs, with the similarity stage, which SQL cannot express; without it SQL fixes the results of q19, q27, q28 and q42.


@query()
def q55_extract_whole(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_metadata(laid(spark, d), CONFIG, lines="lines").select("scan_id", "packet_id", "ordinal", "is_lookup", *FIELDS)


@query()
def q56_batch_whole(spark: SparkSession, d: str) -> DataFrame:
    return batch.run(laid(spark, d), known(spark, d), CONFIG, lines="lines").select("scan_id", "packet_id", *_OUT, "folder_name", "file_name", "status")


@query()
def q57_mass_whole(spark: SparkSession, d: str) -> DataFrame:
    out = mass.process(laid(spark, d), known(spark, d), CONFIG, key="scan_id", lines="lines")
    return out.select("scan_id", *_OUT, "folder_name", "file_name", "status")


@query()
def q58_mass_stream_whole(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
