"""Rules and settings of extraction. Rule order is semantic, so rule lists are ordered pairs, never maps of Spark."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace
from typing import Any

LOOKUP_ONLY = "Lookup Only"
FIELD_NOTES = "Field Notes"

# Phrases of a register print-out.
LOOKUP_ANCHORS = ["department of assessments and taxation", "real property data search", "account identifier", "account number", "premises address"]
# Patterns of a register print-out's id.
LOOKUP_TAX_ID = [
    r"\bdistrict\s*[-:#]?\s*([0-9Oo]{1,2})\s+account\s+(?:number|no\.?|#)\s*[-:#]?\s*([0-9OoIl]{4,10})\b",
    r"\baccount\s+identifier.{0,80}?district\s*[-:#]?\s*([0-9Oo]{1,2}).{0,80}?account\s+(?:number|no\.?|#)\s*[-:#]?\s*([0-9OoIl]{4,10})\b",
]
# A site plan near an easement plat, in either order, outranks every rule.
SITE_PLAN_EASEMENT = r"\bsite\s+plan\b[\s\S]{0,160}?\beasement\s+plat\b|\beasement\s+plat\b[\s\S]{0,160}?\bsite\s+plan\b"
# Default rules.
DEFAULTS: dict[str, Any] = {
    "sdat_lookup": True,
    "default_county": "Calvert",
    "visual_field_notes_classifier": True,
    "visual_field_notes_threshold": 0.75,
    "lot_pattern": [r"\blot\s*[:#-]?\s*([0-9]+R?)\b"],
    "county_patterns": [r"\b([A-Za-z]+)\s+County\b"],
    "map_patterns": [r"\btax\s+map\s*[:#-]?\s*([0-9]+[A-Za-z]*)\b"],
    "parcel_patterns": [r"\bparcel\s*[:#-]?\s*([0-9A-Za-z]+)\b", r"\bmap\s*/\s*parcel\s*[:#-]?\s*[0-9A-Za-z]+\s*/\s*([0-9A-Za-z]+)\b"],
    "tax_id_patterns": [r"\btax\s*(?:id|i\.?d\.?|1\.?d\.?)\s*[:#.-]?\s*([0-9Oo]{1,2})\s*[- ]\s*([0-9OoIl]{4,8})\b"],
    "district_patterns": [r"\bdistrict\s*[:#-]?\s*([0-9A-Za-z]+)\b\bdist\.?\s*[:#-]?\s*([0-9A-Za-z]+)\b"],
    "account_patterns": [r"\baccount\s*(?:number|no\.?|#)?\s*[:#-]?\s*([0-9A-Za-z]+)\b", r"\bacct\.?\s*(?:no\.?|#)?\s*[:#-]?\s*([0-9A-Za-z]+)\b"],
    "address_patterns": [
        r"\s(?:property|site|project)\s+address\s*[:#-]?\s*(.+)",
        r"\saddress\s*[:#-]?\s*(.+)",
        r"(?<!\w)([1-9]\d{0,5}\s+[A-Za-z][A-Za-z0-9 .'-]*\s+(?:street|st\.?|road|rd\.?|avenue|ave\.?|boulevard|blvd\.?|drive|dr\.?|lane|ln\.?|court|ct\.?|circle|cir\.?|way|place|pl\.?)\b[^\n]*)",
    ],
    "bbox_address_bottom_fraction": 0.65,
    "bbox_address_line_tolerance": 0.75,
    "ignored_address_keywords": ["phone", "fax", "www", ".com", "@", "survey", "surveyor", "surveying", "engineer", "engineering"],
    "ignored_addresses": [],
    "project_code_patterns": [r"\s(aa|cc|ch|nav|pg|sm|usaf[0-9]{4})\s"],
    "document_type_keywords": [
        ("House Location", ["house location", "houselocation", "house loc", "hse location", "location drawing"]),
        ("Site Plan", ["site plan", "siteplan", "plot plan", "sitemap"]),
        ("Wall Check", ["wall check", "wallcheck", "wall chk", "foundation check"]),
        ("Plat/Replat", ["forest conservation amendment plat", "replat", "re plat"]),
        ("Construction Permit", ["septic construction permit", "construction permit"]),
        ("Field Notes", ["field notes", "fieldnotes", "field note", "notes"]),
    ],
    "document_type_regex_rules": [
        ("Site Plan", [r"\bsite\s+plan\b[\s\S]{0,160}?\beasement\s+plat\b", r"\b(?:sewage|drainage|utility|access|ingress|egress|storm\s*drain|water|sanitary)\s+easement\s+plat\b"]),
        ("Plat/Replat", [r"\bforest\s+conservation\s+amendment\s+plat\b"]),
        ("Construction Permit", [r"\bseptic\s+construction\s+permit\b"]),
    ],
    "document_type_patterns": [r"\s(wall check|site plan|field notes|replat|house location|construction permit)\s"],
}


def keyword_groups(raw: Any) -> list[tuple[str, list[str]]]:
    """S-14: ordered (label, phrases); a list of labels stands for itself, anything else is empty."""
    if isinstance(raw, dict):
        return [(str(k), [str(p) for p in (v or [])]) for k, v in raw.items()]
    if isinstance(raw, (list, tuple)):
        return [(str(x[0]), [str(p) for p in x[1]]) if isinstance(x, (list, tuple)) else (str(x), [str(x)]) for x in raw]
    return []


@dataclass(frozen=True)
class Config:
    """Extraction rules. ``parity`` keeps the known quirks of the behaviour this engine matches; without it the evident intent holds:
    the keyword ``@`` no longer rejects every address with an ``a``, tokens with a flat box take part in the layout lines, and a
    parcel is searched in the text as it stands before its digits are repaired."""

    rules: dict[str, Any] = field(default_factory=lambda: dict(DEFAULTS))
    parity: bool = True

    def get(self, key: str, default: Any = None) -> Any:
        return self.rules.get(key, default)

    def with_rules(self, **changes: Any) -> Config:
        return replace(self, rules=self.rules | changes)

    def keywords(self) -> list[tuple[str, list[str]]]:
        return keyword_groups(self.get("document_type_keywords"))

    def regex_rules(self) -> list[tuple[str, list[str]]] | None:
        raw = self.get("document_type_regex_rules")
        return keyword_groups(raw) if isinstance(raw, (dict, list, tuple)) and raw is not None else None

    @property
    def county(self) -> str:
        return str(self.get("default_county") or "").strip()


def overlay(base: dict[str, Any], changes: dict[str, Any]) -> dict[str, Any]:
    """U-5 / S-12: shallow; None, '' and [] leave the default, False, 0 and {} count."""
    return base | {k: v for k, v in changes.items() if not (v is None or v == "" or v == []) or v is False}


def load_config(path: str | None = None, county: str | None = None, parity: bool = True) -> Config:
    """S-12, S-13: defaults, overlaid by a JSON file and the county of the settings; cached by path, time and size."""
    rules = dict(DEFAULTS)
    if path and os.path.exists(path):
        stat = os.stat(path)
        rules = overlay(rules, _read(path, stat.st_mtime_ns, stat.st_size))
    if county:
        rules["default_county"] = county
    return Config(rules, parity)


_files: dict[tuple, dict[str, Any]] = {}


def _read(path: str, modified: int, size: int) -> dict[str, Any]:
    if (path, modified, size) not in _files:
        with open(path, encoding="utf-8") as f:
            _files[path, modified, size] = json.load(f)
    return _files[path, modified, size]


@dataclass(frozen=True)
class ScanSettings:
    """S-18, D11: settings of a run, coerced from loose input."""

    input_folder: str = ""
    output_folder: str = ""
    scan_mode: str = "batch"
    project_code: str = "Project"
    document_type: str = FIELD_NOTES
    section: str = ""
    county: str = "Calvert"
    dpi: int = 300
    lang: str = "en"
    ocr_device: str = "auto"
    gpu_device_id: int = 0
    in_place: bool = False

    @classmethod
    def of(cls, payload: dict[str, Any]) -> ScanSettings:
        def s(key: str, default: str = "") -> str:
            return str(payload.get(key) or "").strip() or default

        return cls(
            s("input_folder"), s("output_folder"), s("scan_mode", "batch").lower(), s("project_code").upper() or "Project", s("document_type", FIELD_NOTES), s("section"),
            s("county", "Calvert"), int(payload.get("dpi") or 300), s("lang", "en"), s("ocr_device", "auto").lower(), int(payload.get("gpu_device_id") or 0), bool(payload.get("in_place", False)),
        )


def folder_names(path: str) -> tuple[str, str]:
    """S-19 for one path: project and section; the section lies between the first dot and the first ``-`` after it."""
    name = str(path or "").rstrip("/").rsplit("/", 1)[-1]
    project, dot, rest = name.partition(".")
    return (project.strip(), rest.partition("-")[0].strip()) if dot else (name.strip(), "")


def named_run(settings: ScanSettings) -> ScanSettings:
    """R-4, R-5: section and, where none was entered, project code from the folder (the input folder in place, else the output folder)."""
    project, section = folder_names(settings.input_folder if settings.in_place else settings.output_folder)
    entered = settings.project_code.strip() if settings.project_code != "Project" else ""
    return replace(settings, section=section, project_code=(entered or project).upper().strip() or "Project")


def resolve_device(wanted: str, gpu_available: bool, gpu_id: int = 0) -> str:
    """S-11: auto takes a GPU where there is one; an explicit ``gpu`` needs one."""
    wanted = (wanted or "auto").strip().lower()
    if wanted.startswith("gpu") and not gpu_available:
        raise RuntimeError("a GPU was asked for, but none is available")
    return f"gpu:{gpu_id}" if wanted.startswith("gpu") or wanted == "auto" and gpu_available else "cpu"
