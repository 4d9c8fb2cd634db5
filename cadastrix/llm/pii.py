"""Personal information in free text: a character BiLSTM with CRF transitions finds spans, typed placeholders replace them.

Texts are cut into overlapping windows of ``WINDOW`` characters; both LSTMs run over batches of windows. Each character takes its
emission scores from the window in which it lies deepest, and one Viterbi path over the whole text reconciles all windows, so a
span is never cut at a window's edge. An exact check follows: it trims punctuation and cue words, and drops spans whose characters
cannot form an item of their kind. Weights are trained by ``pii_training`` and lie beside this module.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .addresses import TO_LETTER, TYPE_OF, TYPES

KINDS = ["email", "phone", "id_number", "street_address", "person_name"]
TAGS = ["O"] + [f"{b}-{k}" for k in KINDS for b in "BI"]
LETTERS, CLASSES = 100, 8
WINDOW, STRIDE = 256, 192
BATCH = 384
MODEL = os.path.join(os.path.dirname(__file__), "pii_model.npz")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[STREET_ADDRESS]", "person_name": "[PERSON_NAME]"}
TEXTS_KEPT = 20_000


@lru_cache(maxsize=4096)
def letter_id(c: str) -> int:
    """Id of a character without regard to case; ASCII by itself, accented letters as one id, everything else as another."""
    c = c.lower()
    if c == "\n":
        return 1
    if " " <= c <= "~":
        return ord(c[0]) - 32 + 2
    return 98 if c.isalpha() else 99


@lru_cache(maxsize=4096)
def char_class(c: str) -> int:
    if c.isupper():
        return 1
    if c.islower():
        return 2
    if c.isdigit():
        return 3
    if c == "\n" or c == "\r":
        return 4
    if c.isspace():
        return 5
    return 6 if c < "\x7f" else 7


class Tagger:
    """BiLSTM-CRF over characters; only numpy."""

    def __init__(self, path: str = MODEL):
        w = {k: v.astype(np.float32) for k, v in np.load(path).items()}
        self.hidden = w["rec_f"].shape[0]
        self.table = {d: (w[f"letter_{d}"][:, None, :] + w[f"class_{d}"][None, :, :] + w[f"bias_{d}"]).reshape(LETTERS * CLASSES, -1) for d in "fb"}
        self.rec = {d: np.ascontiguousarray(w[f"rec_{d}"]) for d in "fb"}
        self.out = {d: w[f"out_{d}"] for d in "fb"}
        self.out_bias, self.trans = w["out_bias"], w["trans"].copy()
        h = self.hidden
        for d in "fb":  # sigmoid(x) = (tanh(x / 2) + 1) / 2, so one tanh serves all gates
            self.table[d][:, : 3 * h] *= 0.5
            self.rec[d][:, : 3 * h] *= 0.5
        for i, a in enumerate(TAGS):
            for j, b in enumerate(TAGS):
                if b[0] == "I" and a[2:] != b[2:]:
                    self.trans[i, j] = -1e4

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(windows, width) of combined ids -> (windows, width, tags)."""
        n, width = ids.shape
        h = self.hidden
        total = np.tile(self.out_bias, (n, width, 1))
        for d in "fb":
            hid, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            hs = np.empty((width, n, h), np.float32)
            for t in range(width) if d == "f" else range(width - 1, -1, -1):
                z = self.table[d][ids[:, t]]
                z += hid @ self.rec[d]
                np.tanh(z, out=z)
                s = z[:, : 3 * h]
                s += 1
                s *= 0.5
                cell *= z[:, h : 2 * h]
                cell += z[:, :h] * z[:, 3 * h :]
                hid = z[:, 2 * h : 3 * h] * np.tanh(cell)
                hs[t] = hid
            total += (hs.reshape(-1, h) @ self.out[d]).reshape(width, n, -1).transpose(1, 0, 2)
        return total

    def paths(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi path of each text, texts of like length side by side."""
        result: list[np.ndarray] = [np.zeros(0, np.int8)] * len(emissions)
        order = sorted(range(len(emissions)), key=lambda i: len(emissions[i]))
        k = len(TAGS)
        start = np.array([-1e4 if t[0] == "I" else 0 for t in TAGS], np.float32)
        at = 0
        while at < len(order):
            longest = len(emissions[order[min(at + BATCH, len(order)) - 1]])
            size = BATCH if longest <= 4096 else 1
            group = order[at : at + size]
            at += len(group)
            width = max(len(emissions[i]) for i in group)
            if not width:
                continue
            e = np.zeros((width, len(group), k), np.float32)
            for c, i in enumerate(group):
                e[: len(emissions[i]), c] = emissions[i]
            back = np.zeros((width, len(group), k), np.int8)
            score = e[0] + start
            scores = np.empty((width, len(group), k), np.float32)
            scores[0] = score
            for t in range(1, width):
                all_ = score[:, :, None] + self.trans[None]
                best = all_.argmax(axis=1)
                back[t] = best
                score = np.take_along_axis(all_, best[:, None, :], 1)[:, 0] + e[t]
                scores[t] = score
            lengths = np.array([len(emissions[i]) for i in group])
            columns = np.arange(len(group))
            tags = scores[np.maximum(lengths - 1, 0), columns].argmax(axis=1)
            path = np.zeros((width, len(group)), np.int8)
            for t in range(width - 1, -1, -1):
                live = t < lengths
                path[t] = tags
                tags = np.where(live, back[t, columns, tags], tags)
            for c, i in enumerate(group):
                result[i] = path[: lengths[c], c]
        return result

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, kind) of each text, after the exact check."""
        combined = [np.fromiter((letter_id(c) * CLASSES + char_class(c) for c in t), np.int64, len(t)) for t in texts]
        cuts = [(i, at) for i, ids in enumerate(combined) for at in ([0] if len(ids) <= WINDOW else [*range(0, len(ids) - WINDOW, STRIDE), len(ids) - WINDOW]) if len(ids)]
        blank = letter_id("\n") * CLASSES + char_class("\n")
        emit = [np.zeros((len(ids), len(TAGS)), np.float32) for ids in combined]
        depth = [np.full(len(ids), -1, np.int32) for ids in combined]
        inside = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
        for at in range(0, len(cuts), BATCH):
            part = cuts[at : at + BATCH]
            rows = np.full((len(part), WINDOW), blank, np.int64)
            for r, (i, start) in enumerate(part):
                piece = combined[i][start : start + WINDOW]
                rows[r, : len(piece)] = piece
            scores = self.emissions(rows)
            for r, (i, start) in enumerate(part):
                n = min(WINDOW, len(combined[i]) - start)
                here = inside[:n].copy()
                if start == 0:
                    here[: WINDOW // 2] = WINDOW
                if start + n == len(combined[i]):
                    here[max(0, n - WINDOW // 2) :] = WINDOW
                better = here > depth[i][start : start + n]
                emit[i][start : start + n][better] = scores[r, :n][better]
                depth[i][start : start + n][better] = here[better]
        found = []
        for text, path in zip(texts, self.paths(emit), strict=True):
            spans, begin = [], -1
            for t in range(len(path) + 1):
                tag = TAGS[path[t]] if t < len(path) else "O"
                if begin >= 0 and tag[0] != "I":
                    kind = TAGS[path[begin]][2:]
                    spans += [(*b, settled(text[b[0] : b[1]], kind)) for b in checked(text, begin, t, kind) if not spans or b[0] >= spans[-1][1]]
                    begin = -1
                if tag[0] == "B":
                    begin = t
            found.append(spans)
        return found


_DIGITISH = re.compile(r"[0-9OoIlSsBbZGgq|]")
_CUE = re.compile(r"(?i)^(?:ssn|ss#|s\.s\.|soc(?:ial)?\.?(?:\s*sec(?:urity)?\.?)?|passport|pass\.|alien|reg\.|resident|id|card|oper\.|lic\.|driver'?s?|licen[cs]e|d\.?l\.?|no\.?|nr\.?|number|#|:)[\s:#.]+")
_TITLE = re.compile(r"(?i)^(?:mrs|mr|ms|miss|dr|drs|prof|hon|owner|tenant|attn|attention|seller|buyer|grantor|grantee|witness|heir of|applicant|client|contact|dear|spoke to|c/o|cc)\.?:?\s+")
_NOT_NAME = re.compile(r"(?i)\b(?:inc|llc|surveys|surveying|engineering|partners|geomatics|estates|department|assessments|exhibit|layout|permit|deed|description|notes|profile|sketch|certificate|drawing|parcel|county|tax|plat|premises|address|property|her|his|their|our|your|my|the|this|see|ask|phone|call|cell|fax|mail|after|before|with|and|or)\b")
#: Words in lower case that stand inside names.
_PARTICLES = {"de", "da", "di", "del", "della", "van", "von", "der", "den", "la", "le", "dos", "bin", "al", "el", "y", "jr", "sr"}
_PHONE = re.compile(r"[0-9OoIlSsB]{3}[-. ][0-9OoIlSsB]{3}[-. ][0-9OoIlSsB]{4}")
_SOCIAL = re.compile(r"[0-9OoIlSsB]{3}[- ][0-9OoIlSsB]{2}[- ][0-9OoIlSsB]{4}")
#: A name that ends like a street counts only after a person's cue, or with the surname first.
_PERSON_CUE = re.compile(r"(?i)(?:owner|tenant|mrs?|ms|dr|prof|hon|seller|buyer|grantor|grantee|witness|heir of|by|for|attn|attention|c/o|cc|dear|sincerely|client|contact|applicant|name|chief|to|with|call|ask)[\s.:,]*$")
#: Cue words of numbers that are no person's: before such a number a span is dropped.
_OTHER_NUMBER = re.compile(r"(?i)(?:s/n|permit|l\.s\.\s+lic\.\s+no\.|ledger|job\s+no\.|ticket|panel|zip|\bmd|parcel|map|tax\s+id:?|account\s+number|liber|folio|instrument|page|elev\.|area|epoch|\bpt)\s*#?:?\s*$")
_FULL_TYPES = set(TYPES)
#: A line that starts with one of these begins a new statement, so a name ends before it.
_NEXT_LINE = re.compile(r"(?i)\n\s*(?:seller|buyer|tenant|owner|drawn by|checked by|prepared for|party chief|grantor|notary copy:?|witness|attn:?|heir of|applicant|c/o|cc|spoke to|questions:?|mrs?\.|ms\.)\s")


def _whole_words(text: str, start: int, end: int) -> tuple[int, int]:
    """Bounds moved outwards to the ends of the words they cut."""
    while 0 < start < end and text[start].isalnum() and text[start - 1].isalnum():
        start -= 1
    while start < end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
        end += 1
    return start, end


def _name_bounds(text: str, start: int, end: int) -> tuple[int, int]:
    """Bounds of a name: of words parted by plain ones in lower case the longest run counts, and an initial does not end one."""
    words = [(m.start() + start, m.end() + start, m[0]) for m in re.finditer(r"\S+", text[start:end])]
    if not any(w[:1].isupper() for *_, w in words):
        return start, end
    plain = lambda w: w[:1].islower() and w.strip(".,;").lower() not in _PARTICLES
    runs: list[list[tuple[int, int, str]]] = [[]]
    for w in words:
        if plain(w[2]) or not any(c.isalpha() for c in w[2]):
            runs.append([])
        else:
            runs[-1].append(w)
    words = max(reversed(runs), key=len)
    start, end = words[0][0], words[-1][1]
    while end > start and text[end - 1] in ",;:":
        end -= 1
    if re.fullmatch(r"[A-Z]\.?", words[-1][2]) and "," not in text[start:end] and (m := re.match(r"\.?\s{1,2}([A-Z][\w'-]{2,})", text[end:])):
        end += m.end()
    return start, end


def settled(piece: str, kind: str) -> str:
    """The kind that the grouping of digits tells: three, three and four are a phone, three, two and four a social security number."""
    if kind in ("phone", "id_number"):
        return "phone" if _PHONE.fullmatch(piece) else "id_number" if _SOCIAL.fullmatch(piece) else kind
    return kind


_AFTER_TYPE = re.compile(r"(?i)[,\s]*(?:#\s*\w+|\b(?:ap[t+]|uni[t+]|ste|sui[t+]e|bldg)\b\.?\s*#?\s*\w+)")


def _address_end(piece: str) -> int:
    """End of an address: a line that begins after its street type belongs to it only as a unit."""
    for m in re.finditer(r"\n", piece):
        words = re.findall(r"[\w@+$|!]+", piece[: m.start()].upper().translate(TO_LETTER))
        if len(words) > 2 and any(w in TYPE_OF for w in words[2:]) and not _AFTER_TYPE.match(piece, m.start()):
            return m.start()
    return len(piece)


def check(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """Exact check of one span: its trimmed bounds, or None where it cannot be an item of its kind."""
    edge = " \t\r\n,;:<>\"'/" + chr(160)
    while start < end and (text[start] in edge or text[start] == "." or (text[start] == "-" and kind != "email")):
        start += 1
    while end > start and text[end - 1] in edge:
        end -= 1
    if start >= end:
        return None
    start, end = _whole_words(text, start, end)
    if kind == "id_number":
        while (m := _CUE.match(text[start:end])) is not None:
            start += m.end()
    if kind == "person_name":
        while (m := _TITLE.match(text[start:end])) is not None:
            start += m.end()
        start, end = _name_bounds(text, start, end)
    if kind == "phone" and (cut := text.find("\n", start, end)) >= 0 and len(_DIGITISH.findall(text[start:cut])) >= 10:
        end = cut
    while end > start and text[end - 1] == ".":
        end -= 1
    piece = text[start:end]
    if kind in ("phone", "id_number"):
        if piece.startswith("(") and ")" not in piece:
            start, piece = start + 1, piece[1:]
        if piece.endswith(")") and piece.count(")") > piece.count("("):
            end, piece = end - 1, piece[:-1]
        if piece.startswith("(") and piece.endswith(")"):
            start, end, piece = start + 1, end - 1, piece[1:-1]
        if _OTHER_NUMBER.search(text[max(0, start - 30) : start]):
            return None
    if not piece:
        return None
    digits = len(_DIGITISH.findall(piece))
    last = re.sub(r"[^\w]", "", piece.split()[-1] if piece.split() else "")
    dot = end < len(text) and text[end] == "."
    if kind == "street_address":
        word = last.upper().translate(TO_LETTER)
        if dot and word in TYPE_OF and word not in _FULL_TYPES:
            end += 1
        typed = any((w := re.sub(r"[^\w@+$|!]", "", x).upper().translate(TO_LETTER)) in TYPE_OF or any(f.startswith(w[:4]) for f in _FULL_TYPES if len(w) >= 3 and abs(len(f) - len(w)) <= 2) for x in piece.split()[2:])
        end = start + _address_end(text[start:end])
        piece = text[start:end]
        if not (typed and re.match(r"[0-9OIlSBZGo|]{1,6}\b", piece) and any(c.isdigit() for c in piece.split()[0])):
            return None
        return start, end
    if kind == "person_name" and last.upper() in TYPE_OF and len(last) > 2 and "," not in piece and not _PERSON_CUE.search(text[max(0, start - 20) : start]):
        return None
    if kind == "person_name" and dot and (last.lower() in ("sr", "jr") or len(last) == 1):
        end += 1
    good = {
        "email": ("@" in piece or re.search(r"(?i)[\[(\s]at[\])\s]", piece)) and len(piece) >= 6,
        "phone": digits >= 7,
        "id_number": digits >= 7,
        "person_name": sum(c.isalpha() for c in piece) >= 4 and re.search(r"[\s,.]", piece) and not _NOT_NAME.search(piece),
    }[kind]
    return (start, end) if good else None


def checked(text: str, start: int, end: int, kind: str) -> list[tuple[int, int]]:
    """Bounds of the items of one decoded span; two mail addresses in a row are taken apart."""
    parts = [(start, end)]
    if kind == "email" and (cut := [m for m in re.finditer(r"[;,]\s+", text[start:end])]):
        edges = [start, *(x for m in cut for x in (start + m.start(), start + m.end())), end]
        parts = list(zip(edges[::2], edges[1::2], strict=True))
    if kind == "person_name" and (cut := _NEXT_LINE.search(text, start, end)):
        parts = [(start, cut.start()), (cut.end(), end)]
    return [found for a, b in parts if (found := check(text, a, b, kind)) is not None]


_taggers: dict[str, Tagger] = {}


def tagger(path: str = MODEL) -> Tagger:
    if path not in _taggers:
        _taggers[path] = Tagger(path)
    return _taggers[path]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("pii_text", T.StringType())]))


def with_spans(rows: DataFrame, text: str = "ocr_text", spans: str = "pii", path: str = MODEL) -> DataFrame:
    """All rows and columns, ``pii array<struct<start,end,kind,pii_text>>`` and ``redacted`` (the text with placeholders).

    A null text has no spans and a null ``redacted``, an empty one no spans and an empty ``redacted``. Whole texts are tagged,
    however long. Columns of these names are replaced, repeated rows stay, an empty table gives an empty result. Narrow: no shuffle.
    """
    schema = T.StructType([f for f in rows.schema if f.name not in (spans, "redacted")] + [T.StructField(spans, SPANS), T.StructField("redacted", T.StringType())])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("pii_text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tagger(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                unique = list(dict.fromkeys(t for t in texts if t))
                by = dict(zip(unique, model.spans(unique), strict=True))
                found = [[{"start": a, "end": b, "kind": k, "pii_text": t[a:b]} for a, b, k in by[t]] if t else [] for t in texts]
                clean = [None if t is None else redact(t, by.get(t, [])) for t in texts]
                kept = [i for i, n in enumerate(batch.schema.names) if n not in (spans, "redacted")]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(found, kind), pa.array(clean, pa.string())], names=[*(batch.schema.names[i] for i in kept), spans, "redacted"])

    return rows.mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by the placeholder of its kind."""
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], PLACEHOLDER[kind]]
        at = end
    return "".join([*out, text[at:]])
