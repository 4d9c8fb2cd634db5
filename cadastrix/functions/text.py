"""Text normalisation as column expressions; nothing here needs a Python worker.

Null is read as an empty string throughout: missing values are ``''`` in this engine, never null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ``str.split`` sees it (no-break space, separators and next-line included).
WS = r"[\s\x1c-\x1f\x85\p{Z}]+"
INVALID_PATH = r'[<>:"/\\|?*\x00-\x1f]'
# One-to-one character maps, (from, to).
LETTER_MAP = ("01|!5$3@862+", "olllsseabgzt")
DIGIT_MAP = ("OoIil|SsB", "001111558")
MISSING = "''"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(text(c), rf"^{WS}|{WS}$", "")


def normalize_value(c: Column) -> Column:
    """T-1: white space collapsed, `` :-#.,;`` stripped from both ends."""
    return F.btrim(F.regexp_replace(text(c), WS, " "), F.lit(" :-#.,;"))


def normalize_for_fuzzy(c: Column) -> Column:
    """T-2: lower case, digits and signs that scanners confuse as letters."""
    return F.translate(F.lower(text(c)), *LETTER_MAP)


def normalize_ocr_numbers(c: Column) -> Column:
    """T-3: letters that scanners read for digits as digits."""
    return F.translate(text(c), *DIGIT_MAP)


def vote_key(c: Column) -> Column:
    """T-4."""
    return F.regexp_replace(normalize_for_fuzzy(c), "[^a-z0-9]", "")


def normalized_address(c: Column) -> Column:
    """T-5."""
    return F.regexp_replace(F.upper(text(c)), "[^A-Z0-9]", "")


def or_else(c: Column, fallback: Column | str) -> Column:
    """``c`` unless it is empty, then ``fallback``."""
    return F.when(c != "", c).otherwise(F.lit(fallback) if isinstance(fallback, str) else fallback)


def safe_path_part(c: Column, fallback: Column | str) -> Column:
    """T-6: a name fit for a path, at most 140 characters; the cut comes after the trimming, so it may end in a blank."""
    whole = or_else(normalize_value(c), fallback)
    return or_else(F.substring(F.btrim(F.regexp_replace(whole, INVALID_PATH, ""), F.lit(" .")), 1, 140), fallback)


def is_known(c: Column) -> Column:
    """T-7 for votes: stripped, not empty, no placeholder."""
    s = strip(c)
    return (s != "") & ~F.lower(s).startswith("unknown") & ~s.isin("Project", "Document")


def is_unknown(c: Column) -> Column:
    """T-7 for the status: the same placeholders, but white space alone counts as known."""
    s = text(c)
    return (s == "") | F.lower(s).startswith("unknown") | s.isin("Project", "Document")


def is_missing(field: str, c: Column) -> Column:
    """T-7 for review: ``project`` and ``document`` are placeholders of their own field only, in any case."""
    s = F.lower(strip(c))
    missing = (s == "") | s.startswith("unknown")
    if field == "project_code":
        missing = missing | (s == "project")
    if field == "document_type":
        missing = missing | (s == "document")
    return missing


def prefer_known(c: Column, fallback: Column) -> Column:
    """T-8."""
    return F.when(is_known(c), text(c)).otherwise(text(fallback))


def zfill(c: Column, width: int) -> Column:
    """Zeros on the left up to ``width``; longer values stay whole (``lpad`` would cut them)."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def first_nonempty(*columns: Column) -> Column:
    """T-25."""
    return reduce(lambda rest, c: F.when(text(c) != "", text(c)).otherwise(rest), reversed(columns), F.lit(""))


def joined(separator: str, *columns: Column) -> Column:
    """The non-empty values of the columns, joined."""
    return F.array_join(F.filter(F.array(*(text(c) for c in columns)), lambda x: x != ""), separator)
