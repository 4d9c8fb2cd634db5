"""Identifiers and names derived from metadata, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_missing, is_unknown, joined, normalize_ocr_numbers, normalize_value, or_else, safe_path_part, strip, text, zfill

TAX_ID = r"^([0-9]{1,2})-([0-9]{4,8})$"
# Words of an address that do not tell streets apart.
ADDRESS_STOP = ["MD", "MARYLAND", "ST", "STREET", "RD", "ROAD", "DR", "DRIVE", "LN", "LANE", "CT", "COURT", "AVE", "AVENUE", "BLVD", "BOULEVARD", "WAY", "PL", "PLACE", "CIR", "CIRCLE"]


def normalize_identifier(c: Column) -> Column:
    """T-9: letters and digits, upper case, no leading zeros; a value of zeros only stays as it is."""
    compact = F.upper(F.regexp_replace(text(c), "[^0-9A-Za-z]", ""))
    return or_else(F.ltrim(compact, F.lit("0")), compact)


def identifier_options(c: Column, widths: tuple[int, ...] = (2, 3, 4, 6, 8)) -> Column:
    """T-10: sorted renderings of an identifier; none for an empty one."""
    compact = F.upper(F.regexp_replace(text(c), "[^0-9A-Za-z]", ""))
    padded = [F.when(compact.rlike("^[0-9]+$") & (F.length(compact) <= w), F.lpad(compact, w, "0")) for w in widths]
    options = F.array(compact, or_else(F.ltrim(compact, F.lit("0")), "0"), *padded)
    return F.when(compact == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.filter(options, lambda o: o.isNotNull()))))


def normalize_tax_id(c: Column) -> Column:
    """T-11: ``dd-account``, or '' where no id can be read."""
    value = F.regexp_replace(normalize_ocr_numbers(strip(c)), "[–—−]", "-")
    digits = F.regexp_replace(value, "[^0-9]", "")
    left = F.regexp_replace(F.substring_index(value, "-", 1), "[^0-9]", "")
    right = F.regexp_replace(F.regexp_replace(value, "^[^-]*-", ""), "[^0-9]", "")
    dashed = F.concat(zfill(left, 2), F.lit("-"), right)
    plain = F.concat(F.substring(digits, 1, 2), F.lit("-"), F.regexp_replace(digits, "^..", ""))
    return F.when(digits == "", F.lit("")).when(value.contains("-"), dashed).when(F.length(digits) >= 6, plain).otherwise(F.lit(""))


def is_valid_tax_id(c: Column) -> Column:
    """T-12."""
    return normalize_tax_id(c).rlike(TAX_ID)


def tax_id_district(c: Column) -> Column:
    """T-13, first part; '' for an invalid id."""
    return F.regexp_extract(normalize_tax_id(c), TAX_ID, 1)


def tax_id_account(c: Column) -> Column:
    """T-13, second part."""
    return F.regexp_extract(normalize_tax_id(c), TAX_ID, 2)


def format_tax_id(district: Column, account: Column) -> Column:
    """T-14."""
    return normalize_tax_id(F.concat(text(district), F.lit("-"), text(account)))


def tax_id_matches(a: Column, b: Column) -> Column:
    """T-15."""
    return (normalize_tax_id(a) == normalize_tax_id(b)) & (normalize_tax_id(a) != "")


def identifiers_match(a: Column, b: Column) -> Column:
    """P-4: equal identifiers, or no target."""
    return (text(b) == "") | (normalize_identifier(a) == normalize_identifier(b))


def address_number(c: Column) -> Column:
    """T-19: the leading house number, '' where the first word is none."""
    return F.regexp_extract(F.trim(F.upper(F.regexp_replace(text(c), "[^0-9A-Za-z ]", " "))), "^([0-9]+)(?: |$)", 1)


def address_words(c: Column) -> Column:
    """T-19: the first three telling words after the first."""
    words = F.filter(F.split(F.upper(F.regexp_replace(text(c), "[^0-9A-Za-z ]", " ")), " +"), lambda w: w != "")
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    stop = F.array(*(F.lit(w) for w in ADDRESS_STOP))
    return F.slice(F.filter(rest, lambda w: ~F.array_contains(stop, w) & ~w.rlike("^[0-9]+$")), 1, 3)


def suggested_folder(lot: Column, address: Column) -> Column:
    """T-20."""
    return safe_path_part(F.concat(F.lit("Lot "), text(lot), F.lit(" - "), text(address)), "Unknown Lot - Unknown Address")


def suggested_filename(document_type: Column, lot: Column, source_name: Column) -> Column:
    """T-21."""
    stem = F.regexp_replace(text(source_name), r"(?<=.)\.[^.]*$", "")
    return F.concat(safe_path_part(F.concat(text(document_type), F.lit(" - Lot "), text(lot)), stem), F.lit(".pdf"))


def document_status(*required: Column) -> Column:
    """T-22."""
    missing = is_unknown(required[0])
    for c in required[1:]:
        missing = missing | is_unknown(c)
    return F.when(missing, F.lit("needs_review")).otherwise(F.lit("ready"))


def document_label(document_type: Column, lot: Column) -> Column:
    """T-26."""
    kind = F.when(is_missing("document_type", document_type), F.lit("Unknown Type")).otherwise(strip(document_type))
    number = F.when(is_missing("lot", lot), F.lit("Unknown Lot")).otherwise(F.concat(F.lit("Lot "), strip(lot)))
    return F.concat(kind, F.lit(" - "), number)


def keyword_text(fields: dict[str, Column]) -> Column:
    """T-23: ``key=value`` of the non-empty fields, joined by ``; ``."""
    return F.array_join(F.filter(F.array(*(F.when(text(c) != "", F.concat(F.lit(f"{k}="), text(c))) for k, c in fields.items())), lambda x: x.isNotNull()), "; ")


def display_address(number: Column, name: Column, kind: Column, city: Column, zip_code: Column, mdp: Column, mdp_city: Column, mdp_zip: Column) -> Column:
    """T-16: premise address, else the combined one with its own city and ZIP; ``MD`` between; '' without a street."""
    n = [normalize_value(x) for x in (number, name, kind, city, zip_code, mdp, mdp_city, mdp_zip)]
    premise = joined(" ", *n[:3])
    other = premise == ""
    street = F.when(other, n[5]).otherwise(premise)
    town, code = F.when(other, or_else(n[3], n[6])).otherwise(n[3]), F.when(other, or_else(n[4], n[7])).otherwise(n[4])
    return F.when(street == "", F.lit("")).otherwise(joined(" ", street, town, F.lit("MD"), code))


def record_tax_id(district: Column, account: Column) -> Column:
    """T-17: both parts needed."""
    d, a = normalize_value(district), normalize_value(account)
    return F.when((d != "") & (a != ""), F.concat(zfill(d, 2), F.lit("-"), zfill(a, 6))).otherwise(F.lit(""))


def register_value(c: Column) -> Column:
    """T-18: structured values (JSON text) with sorted keys, everything else normalised."""
    s = text(c)
    return F.when(s.rlike(r"^\s*[{\[]"), F.coalesce(F.to_json(F.try_parse_json(s)), normalize_value(s))).otherwise(normalize_value(s))
