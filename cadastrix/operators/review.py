"""The review table: derived names and status, validation, keyed updates, filing plans, audit and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identifiers import document_status, keyword_text, suggested_filename, suggested_folder
from ..functions.text import is_missing, safe_path_part, strip, text
from ..plans.config import LOOKUP_ONLY
from ..session import checkpoint
from . import register

# Required fields of the review form with their labels, and those that decide the status.
REQUIRED = {"lot": "Lot", "address": "Address", "project_code": "Project code", "document_type": "Document type", "tax_map": "Tax map", "parcel": "Parcel", "tax_id": "Tax ID"}
STATUS_FIELDS = ["lot", "address", "project_code", "document_type"]
PROPERTY_FIELDS = ["lot", "address", "tax_map", "parcel", "tax_id", "section", "project_code"]
#: Fixed value: the largest number of a name.
MOST_CLAIMS = 9999
PLAN_TYPES = ["Site Plan", "House Location", "Wall Check"]


def sync(docs: DataFrame, auto_folder: bool = True, auto_file_name: bool = True) -> DataFrame:
    """R-1: folder and file name (derived when asked, or where there is none) and status."""
    folder, name = suggested_folder(F.col("lot"), F.col("address")), suggested_filename(F.col("document_type"), F.col("lot"), F.col("source_name"))
    if not auto_folder and "folder_name" in docs.columns:
        folder = F.coalesce(F.nullif("folder_name", F.lit("")), folder)
    if not auto_file_name and "file_name" in docs.columns:
        name = F.coalesce(F.nullif("file_name", F.lit("")), name)
    status = F.when(F.col("is_lookup"), F.lit("lookup_only")).otherwise(document_status(*(F.col(c) for c in STATUS_FIELDS)))
    return docs.withColumns({"folder_name": folder, "file_name": name, "status": status})


def folder_project_section(path: Column) -> tuple[Column, Column]:
    """S-19: folder name without a dot is the project, else split once; the section ends at the first ``-``."""
    name = F.element_at(F.split(F.regexp_replace(text(path), "/+$", ""), "/"), -1)
    dotted = name.contains(".")
    project = F.when(dotted, F.trim(F.substring_index(name, ".", 1))).otherwise(strip(name))
    section = F.when(dotted, F.trim(F.substring_index(F.regexp_replace(name, r"^[^.]*\.", ""), "-", 1))).otherwise(F.lit(""))
    return project, section


def duplicate_types(docs: DataFrame, packet: str = "packet_id") -> DataFrame:
    """A-4: ``duplicate_type`` (the first spelling in the packet) for permanent documents whose type, in any case, occurs twice or more.

    Counted by a grouped aggregate joined back, so no window has to hold a whole packet.
    """
    kind = strip(F.col("document_type"))
    live = docs.where(~F.col("is_lookup") & ~is_missing("document_type", F.col("document_type"))).withColumn("_key", F.lower(kind))
    counted = live.groupBy(packet, "_key").agg(F.count("*").alias("_n"), F.min(F.struct("ordinal", "scan_id", kind.alias("kind"))).alias("_first")).where("_n >= 2")
    usable = ~F.col("is_lookup") & ~is_missing("document_type", F.col("document_type"))
    keyed = docs.withColumn("_key", F.when(usable, F.lower(kind)))
    return keyed.join(counted.select(packet, "_key", F.col("_first.kind").alias("duplicate_type")), [packet, "_key"], "left").drop("_key")


def messages(c: Column) -> Column:
    """R-7: a text as a list of its own, a null one as none, blanks dropped. A JSON list gives its members, a JSON object its
    ``message`` or ``error``, in lists too."""
    c = text(c)
    said = lambda m, *more: F.coalesce(*(F.nullif(F.get_json_object(m, f"$.{k}"), F.lit("")) for k in ("message", "error", *more)))
    members = F.transform(F.from_json(c, "array<string>"), lambda m: F.coalesce(said(m), m))
    found = F.when(c.rlike(r"^\s*\["), F.coalesce(members, F.array(c))).when(c.rlike(r"^\s*\{.*\}\s*$"), F.array(F.coalesce(said(c, "detail"), F.lit("")))).otherwise(F.array(c))
    return F.filter(F.transform(found, strip), lambda m: m != "")


def validation(docs: DataFrame) -> DataFrame:
    """R-6: missing (labels in form order), issues and severity; needs ``duplicate_type``; optional ``warnings``, ``errors`` arrays."""
    none = F.array().cast("array<string>")
    labels = F.filter(F.array(*(F.when(is_missing(f, F.col(f)), F.lit(label)) for f, label in REQUIRED.items())), lambda x: x.isNotNull())
    warnings = F.coalesce("warnings", none) if "warnings" in docs.columns else none
    failed = F.when(F.lower("status").isin("error", "failed", "failure"), F.array(F.concat(F.lit("Document status: "), F.lower("status")))).otherwise(none)
    errors = F.concat(F.coalesce("errors", none) if "errors" in docs.columns else none, failed)
    rows = docs.withColumns({"missing": labels, "warnings": warnings, "errors": errors})

    def issue(kind: str, message: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), message.alias("message"))

    parts = F.concat(
        F.when(F.col("duplicate_type").isNotNull(), F.array(issue("duplicate", F.concat(F.lit("Duplicate document type “"), F.col("duplicate_type"), F.lit("”"))))).otherwise(F.array().cast("array<struct<kind:string,message:string>>")),
        F.when(F.size("missing") > 0, F.array(issue("missing", F.concat(F.lit("Missing "), F.array_join("missing", ", "))))).otherwise(F.array().cast("array<struct<kind:string,message:string>>")),
        F.transform("warnings", lambda m: issue("warning", m)), F.transform("errors", lambda m: issue("error", m)),
    )
    severity = F.when((F.size("errors") > 0) | F.col("duplicate_type").isNotNull(), "error").when(F.size("issues") > 0, "warning").otherwise("none")
    return rows.withColumn("issues", parts).withColumn("severity", severity)


STAMP = ("updated_at", "update_id")


def latest_updates(updates: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Value of each field per key after all updates in order of ``updated_at``: the last update that carries the field, and when
    (``_at_<field>``). Updates delivered twice count once; order of arrival does not matter."""
    stamp = F.struct(*STAMP)
    last = [F.max(F.when(F.col(f).isNotNull(), F.struct(*STAMP, F.col(f).alias("value")))).alias(f"_last_{f}") for f in fields]
    found = updates.dropDuplicates(["update_id"]).groupBy(*keys).agg(*last, F.count("*").alias("updates"), F.max(F.when(F.col("changed_field").isin(*register.ASKING), F.struct(*STAMP, "changed_field"))).alias("_asked")) if "changed_field" in updates.columns else updates.dropDuplicates(["update_id"]).groupBy(*keys).agg(*last, F.count("*").alias("updates"), F.max(F.when(F.lit(False), F.struct(*STAMP, F.lit("").alias("changed_field")))).alias("_asked"))
    out = {f"_new_{f}": F.col(f"_last_{f}.value") for f in fields} | {f"_at_{f}": F.when(F.col(f"_last_{f}").isNotNull(), F.struct(*(F.col(f"_last_{f}.{c}").alias(c) for c in STAMP))) for f in fields}
    return found.withColumns(out).drop(*(f"_last_{f}" for f in fields))


def apply_updates(docs: DataFrame, updates: DataFrame, mode: str = "batch", key: str = "record_id", packet: str = "packet_id", known: DataFrame | None = None, county: str = "", order: tuple[str, ...] = ("ordinal", "scan_id")) -> DataFrame:
    """R-2, G-10: property fields go to every document of the packet (batch) or to the one document (mass), the type to its document
    only; lookup flag, names and status are derived again. Documents without an update keep their fields.

    With ``known`` (the register from ``with_address``) the last edit of tax id, address, map or parcel asks for a new lookup: in mass
    mode of the document, in batch mode of the packet's first permanent document, whose values then go to all permanent ones (J-12,
    J-13). A field edited later than that keeps its edit. Folder and file names typed in a document's last update (``folder_name``,
    ``file_name``) count unless that update asks for derived ones (``auto_folder``, ``auto_file_name``).
    """
    scope = packet if mode == "batch" else key
    shared = latest_updates(updates.where(F.col(scope).isNotNull()), [scope], PROPERTY_FIELDS)
    own = latest_updates(updates.where(F.col(key).isNotNull()), [key], ["document_type"]).drop("updates", "_asked", "_at_document_type")
    rows = docs.join(shared, scope, "left").join(own, key, "left")
    values = {f: F.coalesce(f"_new_{f}", text(F.col(f))) for f in [*PROPERTY_FIELDS, "document_type"]}
    was = rows.withColumns(values).withColumns({"updates": F.coalesce("updates", F.lit(0)), "_was_lookup": F.col("is_lookup") if "is_lookup" in docs.columns else F.lit(False)})
    if known is not None:
        was = _looked_up(was, known, county, scope, mode, order)
    rows = was.drop("_asked", "_was_lookup", *(f"_{k}_{f}" for k in ("new", "at") for f in [*PROPERTY_FIELDS, "document_type"]))
    return _typed_names(sync(rows.withColumn("is_lookup", F.col("document_type") == LOOKUP_ONLY)), updates, key)


def _looked_up(rows: DataFrame, known: DataFrame, county: str, scope: str, mode: str, order: tuple[str, ...]) -> DataFrame:
    plans = rows.where(~F.col("_was_lookup") & F.col("_asked").isNotNull())
    fields = [f for f in [*register.VISIBLE, *register.HIDDEN] if f in rows.columns]
    seed = F.struct(*fields, F.col("_asked.changed_field").alias("changed_field"))
    seeds = plans.groupBy(scope).agg(F.min_by(seed, F.struct(*order)).alias("_seed")).select(scope, "_seed.*") if mode == "batch" else plans.select(scope, seed.alias("_seed")).select(scope, "_seed.*")
    joined = rows.join(register.refreshed(seeds, known, county, scope), scope, "left")
    asked = F.struct(*(F.col(f"_asked.{c}").alias(c) for c in STAMP))
    takes = F.col("values").isNotNull() & ~F.col("_was_lookup")
    out = {}
    for f in [*register.VISIBLE, *register.HIDDEN]:
        old = F.col(f) if f in rows.columns else F.lit("")
        later = F.coalesce(F.col(f"_at_{f}") > asked, F.lit(False)) if f in register.VISIBLE else F.lit(False)
        out[f] = F.when(takes & ~later, F.col(f"values.{f}")).otherwise(old)
    return joined.withColumns(out).drop("values")


def _typed_names(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    typed = [(f, a) for f, a in (("folder_name", "auto_folder"), ("file_name", "auto_file_name")) if f in updates.columns]
    if not typed:
        return rows
    auto = lambda a: F.coalesce(F.col(a), F.lit(False)) if a in updates.columns else F.lit(False)
    last = F.max(F.struct(*STAMP, *(F.when(~auto(a), F.col(f)).alias(f) for f, a in typed))).alias("_typed")
    joined = rows.join(updates.where(F.col(key).isNotNull()).dropDuplicates(["update_id"]).groupBy(key).agg(last), key, "left")
    stem = lambda c: F.regexp_replace(text(c), r"(?<=.)\.[^.]*$", "")
    make = {"folder_name": lambda t: safe_path_part(t, F.col("folder_name")), "file_name": lambda t: F.concat(safe_path_part(stem(t), stem(F.col("source_name"))), F.lit(".pdf"))}
    return joined.withColumns({f: F.when(F.col(f"_typed.{f}").isNotNull(), make[f](F.col(f"_typed.{f}"))).otherwise(F.col(f)) for f, _ in typed}).drop("_typed")


def ranked(rows: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Row number of each row within its group, any of which may hold most rows: the rows are sorted by range over all tasks and written
    once, numbered within task and group, and the counts of the tasks before are added."""
    placed = checkpoint(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = [placed[k].eqNullSafe(counts[k]) for k in [*keys, "_part"]]
    joined = placed.join(counts, same, "left").drop(*(counts[k] for k in [*keys, "_part"]))
    return joined.withColumn(out, F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)) + F.col("_before")).drop("_part", "_before")


def unique_paths(plan: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """K-2: ``dest`` (folder/file) made unique: the n-th claim gets `` (n)`` before the suffix. Names already taken (``existing.dest``,
    with or without number) push the numbers up; a number beyond ``MOST_CLAIMS`` raises."""
    rows = ranked(plan, ["folder_name", "file_name"], ["packet_id", "ordinal", "scan_id"], "_n")
    if existing is not None:
        taken = existing.select(F.regexp_replace("dest", r" \((\d+)\)(\.[^./]*)$", "$2").alias("_base"), F.greatest(F.lit(1), F.coalesce(F.expr("try_cast(regexp_extract(dest, ' \\\\((\\\\d+)\\\\)\\\\.[^./]*$', 1) AS int)"), F.lit(1))).alias("_k"))
        most = taken.groupBy("_base").agg(F.max("_k").alias("_taken"))
        rows = rows.withColumn("_base", F.concat("folder_name", F.lit("/"), "file_name")).join(most, "_base", "left").withColumn("_n", F.col("_n") + F.coalesce("_taken", F.lit(0))).drop("_base", "_taken")
    stem, suffix = F.regexp_replace("file_name", r"(?<=.)\.[^.]*$", ""), F.regexp_extract("file_name", r"(?<=.)(\.[^.]*)$", 1)
    checked = F.when(F.col("_n") > MOST_CLAIMS, F.raise_error(F.concat(F.lit("no free name left for "), F.col("file_name")))).otherwise(F.col("_n"))
    rows = rows.withColumn("_n", checked.cast("long"))
    name = F.when(F.col("_n") == 1, F.col("file_name")).otherwise(F.concat(stem, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), suffix))
    return rows.withColumn("dest", F.concat("folder_name", F.lit("/"), name)).drop("_n")


def with_packet_folder(docs: DataFrame, packet: str = "packet_id", order: tuple[str, ...] = ("ordinal", "scan_id")) -> DataFrame:
    """K-9, filing of whole packets: every permanent document goes to the folder of its packet's first permanent one."""
    plans = docs.where(~F.col("is_lookup"))
    own = F.coalesce(F.nullif("folder_name", F.lit("")), suggested_folder(F.col("lot"), F.col("address")))
    first = plans.groupBy(packet).agg(F.min_by(own, F.struct(*order)).alias("_folder"))
    return docs.join(first, packet, "left").withColumn("folder_name", F.when(F.col("is_lookup"), F.col("folder_name")).otherwise(F.coalesce("_folder", "folder_name"))).drop("_folder")


def filing_plan(docs: DataFrame, copy: bool = True, in_place: bool = False, existing: DataFrame | None = None) -> DataFrame:
    """K-1, P-7: one row per file to write (source, dest, mode); filed and lookup documents are left out. ``existing`` (``dest``) are the
    names that the output folder holds."""
    live = docs.where(~F.col("is_lookup") & (F.col("status") != "filed"))
    if in_place:
        return live.withColumn("dest", F.col("source_path")).withColumn("mode", F.lit("in_place"))
    clean = live.withColumns({"folder_name": safe_path_part(F.col("folder_name"), "Unsorted"), "file_name": safe_path_part(F.col("file_name"), "Document.pdf")})
    return unique_paths(clean, existing).withColumn("mode", F.lit("copy" if copy else "move"))


XMP = {
    "Lot": "lot", "Address": "address", "ProjectCode": "project_code", "DocumentType": "document_type", "TaxMap": "tax_map", "Parcel": "parcel", "TaxID": "tax_id", "Section": "section",
    "County": "county", "AccountID": "account_id", "LegalDescriptionLine1": "legal_description_line_1_mdp_field_legal1_sdat_field_17",
    "LegalDescriptionLine2": "legal_description_line_2_mdp_field_legal2_sdat_field_18", "DeedReferenceLiber": "deed_reference_1_liber_mdp_field_dr1liber_sdat_field_30",
    "DeedReferenceFolio": "deed_reference_1_folio_mdp_field_dr1folio_sdat_field_31", "PlatReferenceLiber": "plat_reference_liber_mdp_field_pltliber_sdat_field_267",
    "PlatReferenceFolio": "plat_reference_folio_mdp_field_pltfolio_sdat_field_268", "Grid": "grid_mdp_field_grid_sdat_field_43", "ZoningCode": "zoning_code_mdp_field_zoning_sdat_field_45",
    "LandUseCode": "land_use_code_mdp_field_lu_desclu_sdat_field_50", "UtilitiesWater": "property_factors_utilities_water_mdp_field_pfuw_sdat_field_63",
    "UtilitiesSewer": "property_factors_utilities_sewer_mdp_field_pfus_sdat_field_64", "OriginalFileName": "source_name",
}


def pdf_metadata(docs: DataFrame, filed_at: str = "") -> DataFrame:
    """K-3, K-4, T-23: title, subject, keywords and the map of the non-empty custom fields; the clock is a parameter."""
    have = set(docs.columns)
    title = F.btrim(F.concat(text(F.col("document_type")), F.lit(" - Lot "), text(F.col("lot"))), F.lit(" -"))
    fields = {k: F.col(k) if k in have else F.lit("") for k in ("lot", "address", "project_code", "document_type", "tax_map", "parcel", "tax_id", "section", "source_name")}
    entries = [F.struct(F.lit(k).alias("key"), text(F.col(c)).alias("value")) for k, c in XMP.items() if c in have] + [F.struct(F.lit("FiledAt").alias("key"), F.lit(filed_at).alias("value"))]
    return docs.withColumns({"title": title, "subject": text(F.col("address")), "keywords": keyword_text(fields | {"filed_at": F.lit(filed_at)}), "xmp": F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"] != ""))})


def audit_rows(filed: DataFrame, filed_at: str = "", packet: str = "packet_id") -> DataFrame:
    """A-6, K-7: one audit row per packet: fields of its first document, number and names of its files in order."""
    first = F.min(F.struct("ordinal", "scan_id", "lot", "address", "folder_name", "project_code", "section"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "scan_id", "file_name"))), lambda x: x["file_name"]), "|")
    agg = filed.groupBy(packet).agg(first.alias("_first"), F.count("*").alias("file_count"), names.alias("files_filed"))
    return agg.select(packet, F.col("_first.lot").alias("lot_number"), F.col("_first.address").alias("address"), F.col("_first.folder_name").alias("location_filed"), F.lit(filed_at).alias("time_filed"), F.col("_first.project_code").alias("project_code"), F.col("_first.section").alias("section"), "file_count", "files_filed")


def stage_ranking(timings: DataFrame, run: str = "run_id") -> DataFrame:
    """A-7, A-8: seconds per stage summed, ranked slowest first within a run, with the share of the run's ``total`` row (or of all)."""
    sums = timings.groupBy(run, "stage").agg(F.sum("seconds").alias("seconds"))
    order = Window.partitionBy(run).orderBy(F.desc("seconds"), "stage")
    whole = F.coalesce(F.max(F.when(F.col("stage").endswith("total"), F.col("seconds"))).over(Window.partitionBy(run)), F.sum("seconds").over(Window.partitionBy(run)))
    return sums.withColumn("rank", F.row_number().over(order)).withColumn("pct", F.when(whole > 0, F.col("seconds") / whole * 100).otherwise(F.lit(0.0)))


def find_document(docs: DataFrame, doc_id: object, key: str = "doc_id") -> DataFrame:
    """T-27, S-21: the document of an id, or none."""
    return docs.where(F.col(key) == F.lit(doc_id)).limit(1)


