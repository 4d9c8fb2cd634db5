"""Free-entered document types mapped to the reference list.

Every value is folded (case, separators, characters that scanners confuse) and run through one multi-pattern automaton
that holds all labels and phrases, once as they stand and once with customary short forms of words written out. Of the embedded mentions the longest non-overlapping ones win. A value
without a mention goes to token-set similarity, where the names compete with a list of entries known to be no type.

The operator is narrow: no shuffle, each worker keeps a bounded cache of the values it has seen.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that scanners confuse, folded to one letter.
FOLD = {"0": "o", "1": "l", "|": "l", "!": "l", "i": "l", "3": "e", "5": "s", "$": "s", "@": "a", "4": "a", "8": "b", "6": "g", "+": "t"}

# Customary short forms of words in the names of survey and permit documents.
SHORT = {
    "address": "addr", "amendment": "amend amdt", "approved": "appr apprd", "area": "ar", "boundary": "bndry bdry bound bdy", "boring": "brg bor", "building": "bldg", "certificate": "cert certif crt", "check": "chk ck", "condominium": "condo condomin",
    "conservation": "conserv cons consv", "construction": "constr const constrn", "contour": "contr", "control": "ctrl cntrl ctl contrl", "critical": "crit critl", "dedication": "dedic ded dedn", "deed": "dd", "demolition": "demo demol", "description": "descr desc descrip",
    "drawing": "dwg drwg drg draw", "driveway": "drvwy dwy drwy drvway", "easement": "easemt esmt easmt esmnt", "elevation": "elev elevn", "erosion": "eros", "exhibit": "exh exhib exhbt", "field": "fld", "forest": "for frst", "foundation": "fdn found fndn fnd",
    "grading": "grdg grad grd", "house": "hse hs", "landscape": "lscape landscp lndscp lscp", "layout": "lyt layt", "legal": "lgl", "location": "loc locn locat", "log": "lg", "management": "mgmt mgt mgm", "notes": "nts nt", "percolation": "perc perk", "permit": "prmt perm pmt",
    "pier": "pr", "plan": "pln pl", "plat": "plt", "plot": "plt", "point": "pt pnt", "profile": "prof prfl", "property": "prop", "register": "reg", "report": "rpt rep rept", "road": "rd", "sediment": "sed sedmt", "septic": "sept sptc", "sheet": "sht sh", "shoreline": "shorel shln",
    "site": "st", "sketch": "sk skt sktch", "soil": "sl soils", "stakeout": "stk stkout", "stormwater": "stormwtr stmwtr strmwtr stormw", "survey": "svy surv srvy sv", "test": "tst", "topographic": "topo topog topographical", "utility": "util utilities utl", "wall": "wl", "well": "wll",
}
# Other words of the trade for the same thing, words that are written apart or together, and initials.
SYNONYMS = {
    "plot plan": "site plan", "contour": "topographic", "perk": "perc", "percolation": "perc", "mhw": "mean high water", "e and s": "erosion and sediment", "e&s": "erosion and sediment", "replatting": "replat", "re plat": "replat", "replat": "plat replat", "metes & bounds": "metes and bounds",
    "storm water": "stormwater", "stake out": "stakeout", "look up": "lookup", "lay out": "layout", "shore line": "shoreline", "as blt": "as built", "asbuilt": "as built", "fieldnotes": "field notes", "drive way": "driveway", "land scape": "landscape",
}
# General words for papers that are no such document; they compete with the names so that a misspelt one is not forced.
NO_TYPE = ["x", "n/a", "photo", "photograph", "misc", "miscellaneous", "cover letter", "letter", "unknown", "business card", "invoice", "receipt", "document", "fax", "fax transmittal", "timesheet", "envelope", "none", "blank", "other", "form", "page", "note", "memo", "calendar", "picture", "mileage", "parking", "back side"]

# Words around a value that say nothing about its type.
DECOR = {"copy", "old", "the", "rev", "final", "dated", "lot", "sheet", "review", "for", "new", "draft", "of", "no", "nd", "rd", "st", "to", "page", "and", "from", "or"}
SIMILAR = 0.72
#: Names of fewer characters are found as whole values only, never inside other words.
SHORTEST = 3
CACHE = 200_000


def fold(value: str) -> str:
    """Lower case, one letter for every confusable character, ``rn`` as ``m``, separators as single blanks."""
    s = "".join(FOLD.get(c, c) for c in value.lower())
    return re.sub(r"[^a-z0-9]+", " ", s.replace("rn", "m")).strip()


def _plain(value: str) -> str:
    """Separators as single blanks but digits kept, for spotting trailing dates and numbers before folding."""
    return re.sub(r"[\s_.,:;]+", " ", value).strip()


_TAIL = re.compile(r"(?i)(?:\s*[-,]?\s*(?:rev\.? ?[a-z0-9]|dated [\d/ -]+|\(\d+\)|\(copy\)|lot \d+|sheet \d+ of \d+|for review|copy|old|final|\d{1,2}/\d{1,2}(?:/\d+)?)\s*[.:]*)+\s*$")
_HEAD = re.compile(r"(?i)^\s*(?:the|old|2nd|rev|copy of|new|final)[.\s]+")


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with adjacent transpositions; ``most + 1`` as soon as it must exceed ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def _closeness(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1 - distance(a, b, longest // 2 + 1) / longest if longest else 0.0


def _long_forms() -> dict[str, str]:
    """Full word by folded short form; a form that two words share stays as it is."""
    found: dict[str, set[str]] = {}
    for word, shorts in SHORT.items():
        for short in shorts.split():
            found.setdefault(fold(short), set()).add(fold(word))
    return {s: w.pop() for s, w in found.items() if len(w) == 1 and s not in {fold(x) for x in SHORT}}


class TypeMatcher:
    """Automaton plus token-set similarity over one reference list; deterministic, at most ``CACHE`` values remembered."""

    def __init__(self, entries: list[tuple[int, str, list[str]]], similar: float = SIMILAR):
        self.similar = similar
        self.long = _long_forms()
        self.synonyms = sorted(((fold(a), fold(b)) for a, b in SYNONYMS.items()), key=lambda x: -len(x[0]))
        self.names: list[tuple[str, int]] = []
        seen: dict[str, int] = {}
        for type_id, label, phrases in sorted(entries):
            for name in [label, *(phrases or [])]:
                for key in dict.fromkeys((fold(name), self.spelt(fold(name)))) if name else []:
                    if key and key not in seen:
                        seen[key] = int(type_id)
        for key, type_id in list(seen.items()):
            for other, usual in self.synonyms:
                if re.search(rf"(?<![a-z0-9]){re.escape(usual)}(?![a-z0-9])", key):
                    seen.setdefault(key.replace(usual, other), type_id)
        # initials stand for the one entry that has them
        initials: dict[str, set[int]] = {}
        for key, type_id in seen.items():
            if len(key.split()) >= 3:
                initials.setdefault("".join(w[0] for w in key.split()), set()).add(type_id)
        for key, ids in initials.items():
            if len(ids) == 1 and key not in seen:
                seen[key] = next(iter(ids))
        self.names = list(seen.items())
        self.names += [(key, 0) for name in NO_TYPE if (key := fold(name)) and key not in seen]
        self.automaton = ahocorasick.Automaton()
        for key, type_id in self.names:
            compact = key.replace(" ", "")
            if type_id and len(compact) >= SHORTEST:
                self.automaton.add_word(compact, (len(compact), type_id))
        self.automaton.make_automaton()
        self.whole = {key: type_id for key, type_id in self.names if type_id}
        self.token_sets = [frozenset(k.split()) - {"of", "the"} for k, _ in self.names]
        self.sizes = np.array([max(1, len(k.replace(" ", ""))) for k, _ in self.names])
        self.counts = np.stack([self._counts(k.replace(" ", "")) for k, _ in self.names])
        self.telling = np.stack([self._counts("".join(t - DECOR or t)) for t in self.token_sets])
        # two or more words that stand in the names of one entry only
        self.of_words: dict[str, set[int]] = {}
        for tokens, (_, type_id) in zip(self.token_sets, self.names, strict=True):
            for word in tokens:
                self.of_words.setdefault(word, set()).add(type_id)
        self.match = lru_cache(maxsize=CACHE)(self._match)

    def spelt(self, key: str) -> str:
        """A folded value with its short forms and synonyms written out."""
        words = " ".join(self.long.get(w, w) for w in key.split())
        for other, usual in self.synonyms:
            if other in words:
                words = re.sub(rf"(?<![a-z0-9]){re.escape(other)}(?![a-z0-9])", usual, words)
        return words

    def mentions(self, key: str) -> list[tuple[int, int, int]]:
        """Embedded names as (start, length, type_id) over the compact text; longest first, none overlapping, on word boundaries."""
        starts, ends, at = set(), set(), 0
        for word in key.split():
            starts.add(at)
            at += len(word)
            ends.add(at)
        found = [(end + 1 - n, n, t) for end, (n, t) in self.automaton.iter(key.replace(" ", "")) if end + 1 in ends and end + 1 - n in starts]
        taken: list[tuple[int, int, int]] = []
        for start, n, t in sorted(found, key=lambda m: (-m[1], m[0])):
            if all(start + n <= s or s + k <= start for s, k, _ in taken):
                taken.append((start, n, t))
        return taken

    def _match(self, value: str) -> tuple[int, float, str]:
        key = fold(value)
        if not key:
            return 0, 0.0, "empty"
        forms = list(dict.fromkeys((key, self.spelt(key))))
        for form in forms:
            if form in self.whole:
                return self.whole[form], 1.0, "mention"
            if found := self.mentions(form):
                return found[0][2], 1.0, "mention"
        core = fold(_HEAD.sub("", _TAIL.sub("", _plain(value)))) or key
        best = max((self._similar(k) for k in dict.fromkeys((core, self.spelt(core), *forms))), key=lambda x: x[1])
        if best[1] < self.similar:
            return 0, best[1], "none"
        return best[0], best[1], "similar" if best[0] else "no_type"

    @staticmethod
    def _counts(compact: str) -> np.ndarray:
        return np.bincount([ord(c) - 48 if c.isdigit() else ord(c) - 87 for c in compact], minlength=36)[:36]

    def _within(self, tokens: frozenset[str]) -> int:
        """The one entry that has a name with all these words (two at least) and others, 0 where none or several have."""
        plain = {w for w in tokens if w not in DECOR and not w.isdigit()}
        for own in (plain, plain | {w for w in tokens & DECOR if w == "sheet"}):
            if len(own) >= 2 and all(w in self.of_words for w in own):
                found = {t for names, (_, t) in zip(self.token_sets, self.names, strict=True) if own <= names}
                if len(found) == 1:
                    return found.pop()
        return 0

    def _similar(self, key: str) -> tuple[int, float]:
        """Best of all names that reaches ``similar``. Names are compared in order of an upper bound of their score, until it is no better
        than the best so far: edits keep only letters that both have, and of a word only letters that the other side has at all can agree."""
        tokens = frozenset(key.split())
        compact = key.replace(" ", "")
        for own, (_, type_id) in zip(self.token_sets, self.names, strict=True):
            if own and own == tokens - {"of", "the"}:
                return type_id, 1.0
        if within := self._within(tokens):
            return within, 0.95
        counts, telling = self._counts(compact), self._counts("".join(tokens - DECOR or tokens))
        whole = np.minimum(self.counts, counts).sum(axis=1) / np.maximum(self.sizes, len(compact))
        words = np.minimum((self.telling > 0) @ telling / max(1, telling.sum()), self.telling @ (telling > 0) / np.maximum(1, self.telling.sum(axis=1))) * 0.98
        bound = np.maximum(whole, words)
        best, best_row = (0, 0.0), len(self.names)
        for row in np.argsort(-bound, kind="stable"):
            if bound[row] < max(self.similar, best[1]) - 1e-9:
                break
            name, type_id = self.names[row]
            score = max(_closeness(compact, name.replace(" ", "")), self._token_set(tokens, self.token_sets[row]))
            if score > best[1] + 1e-9 or (abs(score - best[1]) <= 1e-9 and best[1] and row < best_row):
                best, best_row = (type_id, max(score, best[1])), row
        return best

    @staticmethod
    def _token_set(a: frozenset[str], b: frozenset[str]) -> float:
        """Soft token-set ratio: every word takes its closest partner, weighted by its length, both ways."""
        a = a - DECOR or a
        b = b - DECOR or b
        if not a or not b:
            return 0.0

        def one_way(x: frozenset[str], y: frozenset[str]) -> float:
            return sum(len(w) * max(_closeness(w, v) for v in y) for w in x) / sum(map(len, x))

        return min(one_way(a, b), one_way(b, a)) * 0.98


_matchers: dict[tuple, TypeMatcher] = {}


def _matcher(entries: tuple) -> TypeMatcher:
    if entries not in _matchers:
        _matchers.clear()
        _matchers[entries] = TypeMatcher([(i, label, list(p)) for i, label, p in entries])
    return _matchers[entries]


RESULT = T.StructType([T.StructField("type_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("how", T.StringType())])
MOST_ENTRIES = 20_000


def reference_entries(types: DataFrame) -> tuple:
    """The reference list as plain values. It is a fixed list; more than ``MOST_ENTRIES`` rows raise instead of growing the driver."""
    rows = types.select("type_id", "label", "phrases").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"the reference list has more than {MOST_ENTRIES} entries")
    return tuple(sorted((r.type_id, r.label or "", tuple(p for p in (r.phrases or []) if p)) for r in rows if r.type_id is not None))


def match_type(value: Column, entries: tuple) -> Column:
    """Struct (type_id, score, how) of a free-entered value; type_id 0 where nothing matches. Null and blank give (0, 0.0, 'empty')."""

    @F.pandas_udf(RESULT)
    def match(values: pd.Series) -> pd.DataFrame:
        matcher = _matcher(entries)
        codes, unique = pd.factorize(values.fillna(""))
        found = [matcher.match(v) for v in unique]
        return pd.DataFrame([found[c] for c in codes], columns=["type_id", "score", "how"])

    return match(value)


def map_document_types(records: DataFrame, types: DataFrame, column: str = "document_type") -> DataFrame:
    """Rows whose value is neither null, blank nor exactly a label, with ``type_id`` (0 = unmatched), ``type_score`` and ``type_how``.

    Null and blank values and exact labels are left out; repeated rows stay; an empty table gives an empty result; columns
    of the input keep their names, clashing result names are replaced.
    """
    entries = reference_entries(types)
    labels = [label for _, label, _ in entries]
    value = F.col(f"`{column}`")
    free = records.filter(value.isNotNull() & (F.trim(F.regexp_replace(value, r"\s+", " ")) != "") & ~value.isin(labels))
    found = free.withColumn("_type", match_type(value, entries))
    return found.withColumns({"type_id": F.col("_type.type_id"), "type_score": F.col("_type.score"), "type_how": F.col("_type.how")}).drop("_type")
