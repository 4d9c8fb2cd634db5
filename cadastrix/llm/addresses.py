"""Addresses that denote the same place.

``parse`` takes an address apart (house number, direction, street name, type, town, ZIP) whatever the order of its parts. Street
names are weighted character n-grams; a prefix-filtered inverted index over them yields candidate names, cosine similarity (and an
edit distance as exact check) verifies them. A street written in several ways so becomes one street of the register; two addresses
denote the same place where street and folded house number agree. Work on names happens once per distinct spelling, not per row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.register import FIELDS as FIELDS_OF_REGISTER
from ..session import brief_checkpoint
from ..session import merged_checkpoint as checkpoint
from .doctype import distance

# Directions and other words before a street's name, and street types, with their usual short forms.
DIRECTIONS = {
    "NORTH": ["N", "NO", "NORTH", "NTH"], "SOUTH": ["S", "SO", "SOUTH"], "EAST": ["E", "EAST"], "WEST": ["W", "WEST"], "OLD": ["OLD"],
    "UPPER": ["UPR", "UPPER", "UP"], "LOWER": ["LWR", "LOWER"], "LITTLE": ["LIT", "LTL", "LITTLE"], "SAINT": ["ST", "SAINT"], "MOUNT": ["MT", "MOUNT"],
}
TYPES = {
    "AVENUE": ["AVENUE", "AVE", "AV"], "BOULEVARD": ["BOULEVARD", "BLVD"], "CIRCLE": ["CIRCLE", "CIR", "CIRC"], "COURT": ["COURT", "CT", "CRT"], "DRIVE": ["DRIVE", "DR", "DRV"],
    "LANE": ["LANE", "LN"], "PLACE": ["PLACE", "PL"], "ROAD": ["ROAD", "RD"], "STREET": ["STREET", "ST", "STR"], "TERRACE": ["TERRACE", "TER", "TERR"],
    "TRAIL": ["TRAIL", "TRL", "TR"], "WAY": ["WAY", "WY"], "PARKWAY": ["PARKWAY", "PKWY"], "HIGHWAY": ["HIGHWAY", "HWY"], "SQUARE": ["SQUARE", "SQ"],
}
DIRECTION_OF = {s: k for k, v in DIRECTIONS.items() for s in v}
TYPE_OF = {s: k for k, v in TYPES.items() for s in v}
# Characters misread for a letter or for a digit.
TO_LETTER = str.maketrans("0135$@48+|!6", "OLESSAABTLLG")
TO_DIGIT = str.maketrans("OIL|!SBZGQD", "01111582600")
_LABEL = re.compile(r"^\W*(?:PROPERTY [A@]DDRE[S5$]{2}|SITE [A@]DDRE[S5$]{2}|PREMISES [A@]DDRE[S5$]{2}|[A@]DDR[E3][S5$]{2}|PR[E3]M[I1L][S5$][E3][S5$]|PREMISE|[S5$][I1L][T+][E3]|PR[O0]P|LOCATION)(?:\b|(?=[:.\s]))\s*[.:\-]*\s*")
_UNIT = re.compile(r"[,\s]*(?:#\s*[A-Z0-9]+|\b(?:AP[T+]|UNI[T+]|STE|SUI[T+]E|BLDG)(?:\b|(?=[\s.]))\.?\s*#?\s*[A-Z0-9]+|\b(?:REAR|FRONT)(?: B[L1I]D[G6])?\b)(?=[\s,.]|$)")
_ZIP = re.compile(r"(?:^|(?<=[\s,]))(?:(?:MD|MARYLAND|M D)\b\.?[\s,]*)?(2[0-9OISBLZ]{4})(?:\s*-\s*[0-9OISBLZ]{4})?\s*(?=$|-\s)")
_STATE = re.compile(r"[\s,]+(?:MD|MARYLAND|M[A@]RYL[A@]ND)\.?(?=$|[\s,])")
_NUMBER = re.compile(r"^#?[0-9OISBLZGQ|!]{1,6}$")
_NO_PLACE = re.compile(r"\b(?:LOT|SEC|SECTION|BLOCK|PARCEL|OFF|NEAR)\b|\bUNKNOWN\b")
FIELDS = ["number", "direction", "name", "type", "town", "zip", "clean"]
KEPT = 300_000


def _letters(word: str) -> str:
    return re.sub(r"[^A-Z]", "", word.translate(TO_LETTER))


def _digits(word: str) -> str:
    return re.sub(r"[^0-9]", "", word.translate(TO_DIGIT)).lstrip("0")


def _fuzzy_type(word: str) -> str:
    """Type of a misspelt or cut-off type word, or ''."""
    if len(word) >= 4:
        for full in TYPES:
            if distance(word, full, 1) <= 1 or (full.startswith(word) and len(word) >= 3):
                return full
    if "L" in word and (other := word.replace("L", "I")) in TYPE_OF:
        return TYPE_OF[other]
    hits = {full for short, full in TYPE_OF.items() if short.startswith(word) or full.startswith(word)}
    return hits.pop() if len(hits) == 1 else ""


@lru_cache(maxsize=KEPT)
def parse(address: str | None) -> tuple[str, str, str, str, str, str, bool]:
    """(number, direction, name, type, town, zip, clean); '' for what is missing. ``clean`` says that no character had to be mended
    and that number, name and an exact type are there; whether the name is spelt right only the street index can tell."""
    nothing = ("", "", "", "", "", "", False)
    if not address or not address.strip():
        return nothing
    s = re.sub(r"\s+", " ", address.upper().replace("–", "-").replace("—", "-")).strip()
    odd = bool(re.search(r"[$@+|!]", s))
    s = _LABEL.sub("", s)
    if _NO_PLACE.search(s):
        return nothing
    zip_code = town = ""
    if m := _ZIP.search(s):
        raw = m[1]
        zip_code = _digits(raw)
        odd |= raw != zip_code
        s = f"{s[: m.start()]} {s[m.end() :]}"
    s = re.sub(r"\s+", " ", s).strip()
    if m := re.match(r"^([A-Z0-9@$+ ]+?)(?:[\s,]+(?:MD|MARYLAND))?\s+-\s+(.*[0-9].*)$", s):
        if not _NUMBER.match(m[1].split()[0]):
            town, s = m[1], m[2]
    s = _LABEL.sub("", s)
    s = _UNIT.sub("", s)
    s = _STATE.sub("", f" {s}").strip(" ,-")
    s = re.sub(r"^N[O0]\.?\s*(?=[0-9OISBL]{1,5}\b)", "", s)
    s = re.sub(r",?\s*\bN[O0]\.?\s+(?=[0-9OISBL]{1,5}\b)", ", ", s)
    parts = [p.strip(" .") for p in s.split(",") if p.strip(" .")]
    number, streets = "", []
    for p in parts:
        words = p.split()
        if not number:
            at = next((i for i in (0, len(words) - 1) if words and _NUMBER.match(words[i].strip(".")) and any(c.isdigit() for c in words[i])), None)
            if at is None and streets and words and _NUMBER.match(words[0]) and any(c.isdigit() for c in words[0]):
                at = 0
            if at is None:
                inner = [i for i, w in enumerate(words) if _NUMBER.match(w.strip(".")) and sum(c.isdigit() for c in w) >= 2]
                at = inner[0] if inner else None
            if at is not None:
                raw = words[at].strip(".#")
                number = _digits(raw)
                odd |= not raw.isdigit()
                before, after = words[:at], words[at + 1 :]
                if before and after:
                    streets += [" ".join(before), " ".join(after)]
                elif before or after:
                    streets.append(" ".join(before or after))
                continue
        streets.append(p)
    if not streets:
        return (number, "", "", "", "", zip_code, False)
    raw_words = [w.strip(".") for w in re.split(r"[\s]+", streets[0]) if w.strip(".")]
    odd |= any(re.search(r"[0-9]", w) for w in raw_words)
    words = [x for x in (_letters(w) for w in raw_words) if x]
    rest = " ".join(streets[1:])
    if not words:
        return (number, "", "", "", _letters(town or rest), zip_code, False)
    direction = ""
    if len(words) > 1:
        if words[0] in DIRECTION_OF or words[0].replace("L1T", "LIT").replace("LLT", "LIT") in DIRECTION_OF:
            direction = DIRECTION_OF[words[0] if words[0] in DIRECTION_OF else "LIT"]
            words = words[1:]
        elif len(words) > 2 and len(words[0]) >= 4:
            close = [d for d in DIRECTIONS if len(d) >= 4 and distance(words[0], d, 1) <= 1]
            if close:
                direction, odd = close[0], True
                words = words[1:]
    kind, at, exact = "", len(words), False
    for i in range(1, len(words)):
        if words[i] in TYPE_OF:
            kind, at, exact = TYPE_OF[words[i]], i, True
            break
    if not kind:
        for i in range(1, len(words)):
            if found := _fuzzy_type(words[i]):
                kind, at = found, i
                break
            if len(words[i]) == 1 and i == len(words) - 1:
                at = i
    name = "".join(words[:at])
    if at + 1 < len(words) and not town and not rest:
        town = "".join(words[at + 1 :])
    if len(words[:at]) > 1:
        odd = True
    town = _letters(re.sub(r"\b(?:MD|MARYLAND)\b", "", f"{town or rest}"))
    odd |= bool(re.search(r"[0-9]", rest))
    return (number, direction, name, kind, town, zip_code, bool(number and name and kind and exact and not odd))


PARSED = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS[:-1]] + [T.StructField("clean", T.BooleanType())])


@F.pandas_udf(PARSED)
def parsed(values: pd.Series) -> pd.DataFrame:
    codes, unique = pd.factorize(values.fillna(""))
    found = [parse(v) for v in unique]
    return pd.DataFrame([found[c] for c in codes], columns=FIELDS)


# ---------------------------------------------------------------- the index of street names

COSINE = 0.45
DOMINATES = 3
#: Share of the commonest spelling of a direction, type and town from which a spelling is searched in the first round.
COMMON = 0.1
PARTIAL = 10
SPELLING = ["direction", "name"]


def edits(length: int) -> int:
    """Edits that a name of this length may differ by."""
    return 0 if length <= 3 else 1 if length <= 6 else 2


def grams(name: str) -> list[str]:
    s = f"^{name}$"
    return [s[i : i + 2] for i in range(len(s) - 1)]


def weights(name: str, idf: dict[str, float]) -> dict[str, float]:
    """Unit vector of the weighted bigrams of a name."""
    w: dict[str, float] = {}
    for g in grams(name):
        w[g] = w.get(g, 0.0) + idf.get(g, 1.0)
    norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
    return {g: x / norm for g, x in w.items()}


def prefix_grams(name: str, idf: dict[str, float], least: float = COSINE) -> list[str]:
    """Rarest grams first, until those left out cannot reach ``least`` with any name: two similar names share one of these."""
    w = weights(name, idf)
    left, out = 1.0, []
    for g in sorted(w, key=lambda g: (-idf.get(g, 1.0), g)):
        if math.sqrt(max(left, 0.0)) < least - 1e-9:
            break
        out.append(g)
        left -= w[g] ** 2
    return out


def verify(idf: dict[str, float]) -> Callable[[Column | str, Column | str], Column]:
    """Edits between two names of like grams, -1 where they are too many."""

    @F.pandas_udf("int")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            if x == y:
                out.append(0)
                continue
            u, v = weights(x, idf), weights(y, idf)
            most = edits(min(len(x), len(y)))
            d = distance(x, y, most) if sum(w * v.get(g, 0.0) for g, w in u.items()) >= COSINE else most + 1
            out.append(d if d <= most else -1)
        return pd.Series(out)

    return verified


def gram_weights(names: DataFrame) -> dict[str, float]:
    """Weight of each bigram over all names; there are at most 29 x 29."""
    letters = F.filter(F.split(F.concat(F.lit("^"), "name", F.lit("$")), ""), lambda c: c != "")
    pieces = F.transform(F.sequence(F.lit(1), F.size("_c") - 1), lambda i: F.concat(F.element_at("_c", i), F.element_at("_c", i + 1)))
    counted = names.select(letters.alias("_c")).select(F.explode(F.array_distinct(pieces)).alias("gram")).groupBy("gram").count().collect()
    total = max((r["count"] for r in counted), default=1)
    return {r["gram"]: math.sqrt(math.log(1 + total / r["count"]) + 0.1) for r in counted}


def name_index(names: DataFrame, idf: dict[str, float] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Index of street names (direction, name): from spellings (direction, name) to the pairs (direction, name, other, d) of any name
    with one of them, ``other``, that may be one.

    The bigram statistics cover all names; there are at most 29 x 29 bigrams, so their weights may be broadcast.
    """
    idf = gram_weights(names) if idf is None else idf

    @F.pandas_udf("array<struct<gram:string,at:int>>")
    def first(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [{"gram": g, "at": i} for p in [set(prefix_grams(v, idf))] for i, g in enumerate(grams(v)) if g in p])

    verified = verify(idf)
    # two names within two edits hold a shared gram at most two places apart, so the place is part of the index key
    keyed = brief_checkpoint(names.select(*SPELLING, F.explode(first("name")).alias("_g")).select(*SPELLING, "_g.gram", "_g.at"))
    left = keyed.select("direction", "gram", "name", F.explode(F.sequence(F.col("at") - 2, F.col("at") + 2)).alias("at"))
    near = (F.abs(F.length("name") - F.length("other")) <= 2) & (F.levenshtein("name", "other", 4) >= 0)

    def pairs(spellings: DataFrame) -> DataFrame:
        right = keyed.join(spellings, SPELLING, "left_semi").select("direction", "gram", "at", F.col("name").alias("other"))
        found = left.join(right, ["direction", "gram", "at"]).where(near).select("direction", "name", "other").distinct()
        return found.withColumn("d", verified("name", "other")).where(F.col("d") >= 0)

    return pairs


FORM = ["direction", "name", "type", "town", "zip"]


def _same_town(a: Column, b: Column) -> Column:
    return (a == "") | (b == "") | (a == b) | (F.levenshtein(a, b) <= 2)


def _rivals(streets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Streets (direction, name, type, town, n) with each other spelling of theirs that is ``DOMINATES`` times as frequent: other, other_n."""
    mine = streets.select("direction", "name", "type", "town", F.col("n").alias("own"))
    theirs = streets.select("direction", F.col("name").alias("other"), "type", F.col("town").alias("other_town"), F.col("n").alias("other_n"))
    both = mine.join(pairs.where("d > 0"), SPELLING).join(theirs, ["direction", "other", "type"]).where(_same_town(F.col("town"), F.col("other_town")))
    return both.where(F.col("other_n") >= DOMINATES * F.col("own"))


KEY = ["direction", "name", "type", "town"]
Pairs = Callable[[DataFrame], DataFrame]


def forms_of(register_forms: DataFrame, other_forms: DataFrame | None = None) -> DataFrame:
    """Distinct written forms (FORM) with ``n``, how often the register has each (0: only the others)."""
    forms = register_forms.where("name <> ''").groupBy(*FORM).agg(F.count("*").alias("n"))
    if other_forms is not None:
        forms = forms.unionByName(other_forms.where("name <> ''").groupBy(*FORM).agg(F.lit(0).cast("long").alias("n"))).groupBy(*FORM).agg(F.sum("n").alias("n"))
    return checkpoint(forms)


def _with_right_names(streets: DataFrame, pairs: DataFrame) -> DataFrame:
    stands = _rivals(streets, pairs).groupBy(*KEY).agg(F.max_by("other", F.struct("other_n", "other")).alias("right_name"))
    return streets.join(stands, KEY, "left")


def _streets(forms: DataFrame) -> DataFrame:
    return forms.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max_by("zip", F.struct(F.col("zip") != "", "n", "zip")).alias("street_zip"))


def full_streets(forms: DataFrame, index: Pairs) -> tuple[DataFrame, DataFrame]:
    """Streets that the register writes with type and town, with the spelling that stands for each, and the pairs (name, other, d) of every
    form's name with the streets it may mean.

    The commonest spellings are searched first. A rarer one stands for a street too, unless a spelling that dominates it was found among
    them: pairs of two misspellings of one street are then never formed, and no street is left out.
    """
    streets = brief_checkpoint(_streets(forms.where("n > 0 AND type <> '' AND town <> ''")))
    most = streets.groupBy("direction", "type", "town").agg(F.max("n").alias("most"))
    common = brief_checkpoint(streets.join(most, ["direction", "type", "town"]).where(F.col("n") >= COMMON * F.col("most")).select(*SPELLING).distinct())
    pairs = brief_checkpoint(index(common))
    rest = streets.join(common, SPELLING, "left_anti").join(_rivals(streets, pairs), KEY, "left_anti").select(*SPELLING).distinct()
    itself = forms.where("n > 0").select(*SPELLING, F.col("name").alias("other"), F.lit(0).alias("d"))
    pairs = brief_checkpoint(pairs.unionByName(index(rest)).unionByName(itself).distinct())
    return brief_checkpoint(_with_right_names(streets, pairs)), pairs


def partial_streets(left: DataFrame, index: Pairs) -> tuple[DataFrame, DataFrame]:
    """Register forms that fit no full street are streets of their own, by what is known of them; one without type only where no typed one fits."""
    partial = brief_checkpoint(_streets(left.where("n > 0")))
    pairs = brief_checkpoint(index(partial.select(*SPELLING).distinct()).join(left.select(*SPELLING).distinct(), SPELLING, "left_semi"))
    typed = partial.where("type <> ''").select("direction", F.col("name").alias("other"), F.col("town").alias("other_town"))
    covered = partial.where("type = ''").join(pairs, SPELLING).join(typed, ["direction", "other"]).where(_same_town(F.col("town"), F.col("other_town"))).select(*KEY).distinct()
    return brief_checkpoint(_with_right_names(partial.join(covered, KEY, "left_anti"), pairs)), pairs


def fit_forms(forms: DataFrame, full: DataFrame, full_pairs: DataFrame, partial: DataFrame | None = None, partial_pairs: DataFrame | None = None) -> DataFrame:
    """The street index of the forms: full streets first, then partial ones (of the two addresses of a register row one on a full street
    counts, whatever its edits)."""
    each = brief_checkpoint(_fitting(forms, full_pairs, full))
    if partial is None or partial_pairs is None:
        return each
    left = brief_checkpoint(forms.join(each.select(*FORM).distinct(), FORM, "left_anti"))
    return each.unionByName(brief_checkpoint(_fitting(left, partial_pairs, partial).withColumn("d", F.col("d") + PARTIAL)))


def street_index(register_forms: DataFrame, other_forms: DataFrame) -> DataFrame:
    """Streets of every written form: FORM columns, ``street`` ('direction name type' of the register), ``d`` (edits of its name), ``exact``.

    Both inputs have the FORM columns, one row per address. A form of the others is left out where no street fits it; a form has several
    rows where several fit with equally few edits: its type and town (or ZIP), where given, must be the street's; a spelling gives way to
    one that is ``DOMINATES`` times as frequent.
    """
    forms = forms_of(register_forms, other_forms)
    index = name_index(brief_checkpoint(forms.select(*SPELLING).distinct()))
    full, pairs = full_streets(forms, index)
    each = fit_forms(forms, full, pairs)
    left = forms.join(each.select(*FORM).distinct(), FORM, "left_anti")
    left = brief_checkpoint(left.join(left.where("n > 0").select("direction").distinct(), "direction", "left_semi"))
    partial, pairs = partial_streets(left, index)
    return each.unionByName(_fitting(left, pairs, partial).withColumn("d", F.col("d") + PARTIAL))


def _fitting(forms: DataFrame, pairs: DataFrame, streets: DataFrame) -> DataFrame:
    """Forms with the streets that fit them by fewest edits: FORM columns, street, d, exact, street_n. ``streets`` has direction, name, type,
    town, n, street_zip and right_name (null where its own name is right); a form or a street without type fits any type."""
    known = streets.select("direction", F.col("name").alias("other"), F.col("type").alias("street_type"), F.col("town").alias("street_town"), "street_zip", F.col("n").alias("street_n"), F.coalesce("right_name", "name").alias("right_name"))
    fits = ((F.col("type") == "") | (F.col("street_type") == "") | (F.col("type") == F.col("street_type"))) & _same_town(F.col("town"), F.col("street_town"))
    fits = fits & ((F.col("town") != "") | (F.col("zip") == "") | (F.col("street_zip") == "") | (F.col("zip") == F.col("street_zip")))
    found = forms.select(*FORM).join(pairs, SPELLING).join(known, ["direction", "other"]).where(fits)
    street = F.concat_ws(" ", F.when(F.col("direction") != "", F.col("direction")), F.col("right_name"), F.when(F.col("street_type") != "", F.col("street_type"))).alias("street")
    each = found.groupBy(*FORM, street).agg(F.min("d").alias("d"), F.sum("street_n").alias("street_n"), F.max(((F.col("name") == F.col("right_name")) & ((F.col("town") == "") | (F.col("town") == F.col("street_town")))).cast("int")).alias("exact"))
    return each.withColumn("least", F.min("d").over(Window.partitionBy(*FORM))).where("d = least").select(*FORM, "street", "d", (F.col("exact") == 1).alias("exact"), "street_n")


# ---------------------------------------------------------------- the tables of the project

#: Names of the register's columns used here.
REGISTER = {k: FIELDS_OF_REGISTER[k] for k in ("premise_number", "premise_name", "premise_type", "premise_city", "premise_zip", "mdp_address", "mdp_city", "mdp_zip", "lot", "map", "parcel", "district")} | {"account": FIELDS_OF_REGISTER["account_number"]}


def register_addresses(register: DataFrame) -> DataFrame:
    """Two rows per register row at most: register_id and the parts of its premise and of its mdp address, where a number and a name are there."""

    def text(key: str) -> Column:
        return F.trim(F.coalesce(F.col(REGISTER[key]), F.lit("")))

    premise = F.concat_ws(" ", text("premise_number"), text("premise_name"), text("premise_type"))
    premise = F.when((text("premise_number") != "") & (text("premise_name") != ""), F.concat_ws(", ", premise, F.nullif(text("premise_city"), F.lit("")), F.nullif(text("premise_zip"), F.lit(""))))
    mdp = F.when(text("mdp_address") != "", F.concat_ws(", ", text("mdp_address"), F.nullif(text("mdp_city"), F.lit("")), F.nullif(text("mdp_zip"), F.lit(""))))
    each = F.explode(F.array(F.struct(F.lit(1).alias("field"), premise.alias("written")), F.struct(F.lit(2).alias("field"), mdp.alias("written"))))
    rows = register.where(F.col("register_id").isNotNull()).select("register_id", each.alias("_a")).where(F.col("_a.written").isNotNull())
    return rows.withColumn("_p", parsed(F.col("_a.written"))).select("register_id", "_a.field", "_p.*").where("name <> ''")


def record_addresses(records: DataFrame) -> DataFrame:
    """record_id and the parts of its address, where a street name is there."""
    rows = records.where(F.col("record_id").isNotNull() & (F.trim("address") != "")).select("record_id", parsed("address").alias("_p"))
    return rows.select("record_id", "_p.*").where("name <> ''")


def split_towns(forms: DataFrame, register_forms: DataFrame) -> DataFrame:
    """Forms without type and town whose name ends in a town of the register, with the town cut off; all other rows as they are."""
    towns = register_forms.where("length(town) >= 5").groupBy(F.col("town").alias("_town")).count().where("count >= 3").select("_town")
    open_ = (F.col("type") == "") & (F.col("town") == "") & (F.length("name") >= 9)
    ends = F.explode(F.transform(F.sequence(F.lit(5), F.least(F.lit(20), F.length("name") - 3)), lambda n: F.substring("name", F.length("name") - n + 1, n))).alias("_town")
    names = forms.where(open_).select("name").distinct().select("name", ends).join(towns, "_town").groupBy("name").agg(F.max_by("_town", F.length("_town")).alias("_town"))
    cut = F.expr("substring(name, 1, length(name) - length(_town))")
    ending = forms.where(open_).join(names, "name", "left").withColumn("town", F.coalesce("_town", "town")).withColumn("name", F.coalesce(cut, "name")).drop("_town")
    return forms.where(~open_).unionByName(ending)


def located(register: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parsed register addresses, parsed record addresses and their street index, each written once."""
    reg = checkpoint(register_addresses(register))
    rec = checkpoint(split_towns(checkpoint(record_addresses(records)), reg))
    return reg, rec, checkpoint(street_index(reg, rec))


def house() -> Column:
    """Name of a place: house number and street."""
    return F.concat_ws(" ", "number", "street").alias("place")


def register_places(reg: DataFrame, index: DataFrame) -> DataFrame:
    """(register_id, place) of the rows whose address names a house. Where premise and mdp address of a row are different places, the one
    with fewer edits counts, then the premise."""
    one = reg.where("number <> ''").join(index, FORM).select("register_id", house(), "d", "street_n", "field")
    return brief_checkpoint(one.groupBy("register_id").agg(F.min_by("place", F.struct("d", "field", -F.col("street_n"), "place")).alias("place")))


def places(register: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(register_id, place) and (record_id, place): the place of each row whose address names a house on a street of the register.

    A record is placed where the register has a house; an address that fits houses on several streets is no evidence for any.
    """
    reg, rec, index = located(register, records)
    one = register_places(reg, index)
    maybe = rec.where("number <> ''").join(index, FORM).select("record_id", house())
    there = maybe.join(one.select("place").distinct(), "place")
    two = there.groupBy("record_id").agg(F.min("place").alias("place"), F.max("place").alias("_other")).where("place = _other").select("record_id", "place")
    return one, checkpoint(two)


def place_classes(register: DataFrame, records: DataFrame) -> DataFrame:
    """One row per placed row: id, source ('register' or 'record'), its class ``place`` and ``links``, the number of rows it is paired with
    (register rows: all others of the place; records: the register rows). Counts only, so a place of any size costs one row per member."""
    reg, rec = places(register, records)
    rows = checkpoint(reg.select(F.col("register_id").alias("id"), F.lit("register").alias("source"), "place").unionByName(rec.select(F.col("record_id").alias("id"), F.lit("record").alias("source"), "place")))
    size = rows.groupBy("place").agg(F.count(F.when(F.col("source") == "register", 1)).alias("_reg"), F.count(F.when(F.col("source") == "record", 1)).alias("_rec"))
    links = F.when(F.col("source") == "register", F.col("_reg") - 1 + F.col("_rec")).otherwise(F.col("_reg"))
    return rows.join(size, "place").select("id", "source", "place", links.alias("links"))


def same_place_pairs(register: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b), smaller first, of rows of one place: two register rows, or a register row and a record; the links of
    ``place_classes`` written out.

    Rows without id, house number or street have no pair; repeated ids count once; empty tables give no pairs.
    """
    reg, rec = places(register, records)
    left = reg.select("place", F.col("register_id").alias("id_a"))
    both = left.join(reg.select("place", F.col("register_id").alias("id_b")), "place").where("id_a < id_b")
    cross = left.join(rec.select("place", F.col("record_id").alias("id_b")), "place")
    cross = cross.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return both.select("id_a", "id_b").unionByName(cross)
