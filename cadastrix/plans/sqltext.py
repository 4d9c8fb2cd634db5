"""The same expressions as SQL text, for the second engine that checks results. Each function takes and returns SQL."""

from __future__ import annotations

from ..functions.identifiers import ADDRESS_STOP
from ..functions.text import DIGIT_MAP, LETTER_MAP
from ..operators.extract import fold
from ..operators.register import FIELDS, HIDDEN
from .config import DEFAULTS, LOOKUP_ANCHORS, LOOKUP_TAX_ID, SITE_PLAN_EASEMENT, keyword_groups

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def c(x: str) -> str:
    return f"coalesce({x}, '')"


def strip(x: str) -> str:
    return f"regexp_replace({c(x)}, {q(f'^{WS}|{WS}$')}, '', 'g')"


def t1(x: str) -> str:
    return f"trim(regexp_replace({c(x)}, {q(WS)}, ' ', 'g'), ' :-#.,;')"


def t2(x: str) -> str:
    return f"translate(lower({c(x)}), {q(LETTER_MAP[0])}, {q(LETTER_MAP[1])})"


def t3(x: str) -> str:
    return f"translate({c(x)}, {q(DIGIT_MAP[0])}, {q(DIGIT_MAP[1])})"


def t4(x: str) -> str:
    return f"regexp_replace({t2(x)}, '[^a-z0-9]', '', 'g')"


def t5(x: str) -> str:
    return f"regexp_replace(upper({c(x)}), '[^A-Z0-9]', '', 'g')"


def or_else(x: str, y: str) -> str:
    return f"coalesce(nullif({x}, ''), {y})"


def t6(x: str, fallback: str) -> str:
    bad = r'[<>:"/\\|?*\x00-\x1f]'
    cut = f"substr(trim(regexp_replace({or_else(t1(x), fallback)}, {q(bad)}, '', 'g'), ' .'), 1, 140)"
    return or_else(cut, fallback)


def known(x: str) -> str:
    s = strip(x)
    return f"({s} <> '' AND NOT starts_with(lower({s}), 'unknown') AND {s} NOT IN ('Project', 'Document'))"


def unknown(x: str) -> str:
    return f"({c(x)} = '' OR starts_with(lower({c(x)}), 'unknown') OR {c(x)} IN ('Project', 'Document'))"


def missing(field: str, x: str) -> str:
    s = f"lower({strip(x)})"
    extra = {"project_code": f" OR {s} = 'project'", "document_type": f" OR {s} = 'document'"}.get(field, "")
    return f"({s} = '' OR starts_with({s}, 'unknown'){extra})"


def zfill(x: str, w: int) -> str:
    return f"(CASE WHEN length({x}) < {w} THEN lpad({x}, {w}, '0') ELSE {x} END)"


def compact(x: str) -> str:
    return f"upper(regexp_replace({c(x)}, '[^0-9A-Za-z]', '', 'g'))"


def t9(x: str) -> str:
    return or_else(f"ltrim({compact(x)}, '0')", compact(x))


def t10(x: str, widths: tuple[int, ...]) -> str:
    k = compact(x)
    padded = ", ".join(f"CASE WHEN regexp_full_match({k}, '[0-9]+') AND length({k}) <= {w} THEN lpad({k}, {w}, '0') END" for w in widths)
    return f"(CASE WHEN {k} = '' THEN [] ELSE list_sort(list_distinct(list_filter([{k}, {or_else(f'ltrim({k}, {q('0')})', q('0'))}, {padded}], lambda o: o IS NOT NULL))) END)"


def t11(x: str) -> str:
    v = f"regexp_replace({t3(strip(x))}, '[–—−]', '-', 'g')"
    digits = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    left, right = f"regexp_replace(split_part({v}, '-', 1), '[^0-9]', '', 'g')", f"regexp_replace(regexp_replace({v}, '^[^-]*-', ''), '[^0-9]', '', 'g')"
    return f"(CASE WHEN {digits} = '' THEN '' WHEN contains({v}, '-') THEN {zfill(left, 2)} || '-' || {right} WHEN length({digits}) >= 6 THEN substr({digits}, 1, 2) || '-' || substr({digits}, 3) ELSE '' END)"


def tax_part(x: str, i: int) -> str:
    return f"regexp_extract({x}, '^([0-9]{{1,2}})-([0-9]{{4,8}})$', {i})"


def _re2(pattern: str) -> str:
    return pattern.replace(r"(?<!\w)", r"(?:^|\W)")


def first_match(x: str, patterns: list[str], numbers: bool = False) -> str:
    import re

    source = t3(x) if numbers else c(x)
    parts = []
    for p in patterns:
        n = re.compile(p).groups
        r = q("(?im)" + _re2(p))
        if n <= 1:
            value = t1(f"regexp_extract({source}, {r}, {n})")
        else:
            value = f"array_to_string(list_filter([{', '.join(t1(f'regexp_extract({source}, {r}, {i})') for i in range(1, n + 1))}], lambda g: g <> ''), '-')"
        parts.append(f"WHEN regexp_matches({source}, {r}) THEN {value}")
    return f"(CASE {' '.join(parts)} ELSE '' END)" if parts else "''"


def all_matches(x: str, patterns: list[str]) -> str:
    lists = ", ".join(f"list_transform(regexp_extract_all({c(x)}, {q('(?im)' + _re2(p))}, 1), lambda m: {t1('m')})" for p in patterns)
    return f"flatten([{lists}])"


def ignored(x: str, config: dict = DEFAULTS) -> str:
    tests = [f"contains({t2(x)}, {q(fold(k))})" for k in config["ignored_address_keywords"]]
    for b in config["ignored_addresses"]:
        tests += [f"contains({t2(x)}, {q(fold(b))})", f"contains(regexp_replace({t2(x)}, '[^a-z0-9]', '', 'g'), {q(''.join(ch for ch in fold(b) if ch.isalnum()))})"]
    return f"({' OR '.join(tests)})"


def hits(x: str) -> str:
    return "(" + " + ".join(f"contains({t2(x)}, {q(fold(a))})::INT" for a in LOOKUP_ANCHORS) + ")"


def is_lookup(x: str) -> str:
    has = [f"contains({t2(x)}, {q(fold(a))})" for a in LOOKUP_ANCHORS]
    return f"(({' AND '.join(has[:4])}) OR {hits(x)} >= 4)"


def lookup_tax(x: str) -> str:
    def part(p: str, i: int, w: int) -> str:
        return zfill("regexp_replace(" + t3(f"regexp_extract({c(x)}, {q('(?ims)' + p)}, {i})") + ", '[^0-9]', '', 'g')", w)

    return "(CASE " + " ".join(f"WHEN regexp_matches({c(x)}, {q('(?ims)' + p)}) THEN {part(p, 1, 2)} || '-' || {part(p, 2, 6)}" for p in LOOKUP_TAX_ID) + " ELSE '' END)"


def type_rules(config: dict = DEFAULTS) -> list[tuple[str, str]]:
    return [("Site Plan", SITE_PLAN_EASEMENT)] + [(label, p) for label, ps in keyword_groups(config["document_type_regex_rules"]) for p in ps]


def rule_label(x: str) -> str:
    return "(CASE " + " ".join(f"WHEN regexp_matches({c(x)}, {q('(?i)' + p)}) THEN {q(label)}" for label, p in type_rules()) + " END)"


def rule_start(x: str) -> str:
    return "(CASE " + " ".join(f"WHEN regexp_matches({c(x)}, {q('(?i)' + p)}) THEN instr({c(x)}, regexp_extract({c(x)}, {q('(?i)' + p)}, 0)) - 1" for _, p in type_rules()) + " END)"


def phrases(config: dict = DEFAULTS) -> list[tuple[str, str]]:
    return [(label, p) for label, ps in keyword_groups(config["document_type_keywords"]) for p in ps]


def exact(x: str, what: str) -> str:
    value = {"label": lambda label, p: q(label), "keyword": lambda label, p: q(p), "start": lambda label, p: f"instr({t2(x)}, {q(fold(p))}) - 1"}[what]
    return "(CASE " + " ".join(f"WHEN contains({t2(x)}, {q(fold(p))}) THEN {value(label, p)}" for label, p in phrases()) + " END)"


def layout_lines(bottom: float = 0.65, tolerance: float = 0.75) -> str:
    """X-9, X-10 with parity: scan_id and its lines. Tokens sorted by centre are folded into lines, each as {mean, n, rows}."""
    good = "list_filter(coalesce(i.polygon, []), lambda g: len(g) >= 2 AND g[1] IS NOT NULL AND g[2] IS NOT NULL)"
    edge = {name: f"list_{fn}(list_transform({good}, lambda g: g[{k}]))" for name, (fn, k) in {"x0": ("min", 1), "y0": ("min", 2), "y1": ("max", 2)}.items()}
    pages = "SELECT scan_id, generate_subscripts(ocr_pages, 1) AS pk, unnest(ocr_pages, recursive := false) AS p FROM scanned_documents"
    items = f"SELECT scan_id, pk, p.image_height::DOUBLE AS high, generate_subscripts(p.items, 1) AS ik, unnest(p.items, recursive := false) AS i FROM ({pages}) WHERE p.image_height > 0"
    tokens = f"SELECT scan_id, pk, ik, high, {t1('i.text')} AS text, {', '.join(f'{e} AS {k}' for k, e in edge.items())} FROM ({items}) WHERE coalesce(len(i.bbox), 0) = 0 AND len({good}) > 0"
    seen = f"SELECT *, (y0 + y1) / 2 AS y FROM ({tokens}) WHERE text <> '' AND (y0 + y1) / 2 >= high * {bottom}"
    folded = f"""SELECT scan_id, pk, list_sort(list(greatest(1.0, y1 - y0)))[CAST(floor(count(*) / 2) AS INT) + 1] AS mid,
  list({{'mean': y, 'n': 1, 'rows': [[{{'x': x0, 'y': y, 'at': ik, 'text': text}}]]}} ORDER BY y, x0, ik) AS t FROM ({seen}) GROUP BY scan_id, pk"""
    near = f"greatest(3.0, mid * {max(0.25, tolerance)})"
    joined = "{'mean': (a.mean * a.n + b.mean) / (a.n + 1), 'n': a.n + 1, 'rows': list_concat(a.rows[:-2], [list_concat(a.rows[-1], b.rows[1])])}"
    apart = "{'mean': b.mean, 'n': 1, 'rows': list_concat(a.rows, b.rows)}"
    reduced = f"SELECT scan_id, pk, list_reduce(t, lambda a, b: CASE WHEN b.mean - a.mean <= {near} THEN {joined} ELSE {apart} END).rows AS rows FROM ({folded})"
    read = f"list_filter(list_transform(rows, lambda r: {t1("array_to_string(list_transform(list_sort(r), lambda w: w.text), ' ')")}), lambda x: x <> '')"
    return f"SELECT scan_id, flatten(list({read} ORDER BY pk)) AS lines FROM ({reduced}) GROUP BY scan_id"


def extracted(table: str = "scanned_documents", keys: str = "scan_id, packet_id, ordinal, source_name") -> str:
    """X-12 without similarity, as the body of a CTE; addresses are sought in the layout lines first."""
    x, d = "ocr_text", DEFAULTS
    valid = f"lambda a: a <> '' AND NOT {ignored('a')}"
    addresses = f"list_concat(list_filter(flatten(list_transform(coalesce(lines, []), lambda line: {all_matches('line', d['address_patterns'])})), {valid}), list_filter({all_matches(x, d['address_patterns'])}, {valid}))"
    table = f"(SELECT * FROM {table} LEFT JOIN ({layout_lines()}) USING (scan_id))"
    kind = or_else(first_match(x, d["document_type_patterns"]), q("Field Notes"))
    return f"""SELECT {keys}, lookup AS is_lookup,
  CASE WHEN lookup THEN 'Unknown Lot' ELSE {t6(or_else(first_match('body', d['lot_pattern']), q('Unknown Lot')), q('Unknown Lot'))} END AS lot,
  CASE WHEN lookup THEN 'Unknown Address' ELSE {t6(or_else('coalesce(found[1], ' + q('') + ')', q('Unknown Address')), q('Unknown Address'))} END AS address,
  CASE WHEN lookup THEN 'Project' ELSE {t6(or_else(first_match(x, d['project_code_patterns']), q('Project')), q('Project'))} END AS project_code,
  CASE WHEN lookup THEN 'Lookup Only' ELSE {or_else(t1('coalesce(label, ' + kind + ')'), q('Field Notes'))} END AS document_type,
  CASE WHEN lookup THEN '' ELSE {t6(first_match(x, d['map_patterns']), q(''))} END AS tax_map,
  CASE WHEN lookup THEN '' ELSE {t6(first_match(x, d['parcel_patterns'], True), q(''))} END AS parcel,
  CASE WHEN lookup THEN {lookup_tax(x)} ELSE {t6(first_match(x, d['tax_id_patterns'], True), q(''))} END AS tax_id, '' AS section
FROM (SELECT *, {addresses} AS found, CASE WHEN label IS NULL THEN {c(x)} ELSE substr({c(x)}, start + 1) END AS body
  FROM (SELECT *, {is_lookup(x)} AS lookup, coalesce({rule_label(x)}, {exact(x, 'label')}) AS label, coalesce({rule_start(x)}, {exact(x, 'start')}) AS start FROM {table}))"""


def voted(source: str, keys: str, order: str, fields: list[str]) -> str:
    """A-1 for several fields, long form: keys, field, voted. ``source`` is a CTE or subquery."""
    k = keys
    long = " UNION ALL ".join(f"SELECT {k}, {q(f)} AS field, {f} AS value, {order} AS ord FROM {source}" for f in fields)
    return f"""SELECT {k}, field, arg_min(v, (-n, ord1)) AS voted FROM (
  SELECT {k}, field, {t4('value')} AS key, count(*) AS n, min(ord) AS ord1, arg_min(value, ord) AS v FROM ({long}) WHERE {known('value')} AND {t4('value')} <> '' GROUP BY {k}, field, {t4('value')})
GROUP BY {k}, field"""


def address_number(x: str) -> str:
    return f"regexp_extract(trim(upper(regexp_replace({c(x)}, '[^0-9A-Za-z ]', ' ', 'g'))), '^([0-9]+)(?: |$)', 1)"


def address_words(x: str) -> str:
    words = f"list_filter(string_split_regex(upper(regexp_replace({c(x)}, '[^0-9A-Za-z ]', ' ', 'g')), ' +'), lambda w: w <> '')"
    stop = "[" + ", ".join(map(q, ADDRESS_STOP)) + "]"
    return f"list_filter({words}[2:], lambda w: NOT list_contains({stop}, w) AND NOT regexp_full_match(w, '[0-9]+'))[1:3]"


def joined(sep: str, xs: list[str]) -> str:
    return f"array_to_string(list_filter([{', '.join(xs)}], lambda p: p <> ''), {q(sep)})"


def register() -> str:
    """The register under its short names with the display address, as the body of a CTE."""
    names = ", ".join(f"{c(v)} AS {k}" for k, v in FIELDS.items()) + ", " + ", ".join(f"{c(h)} AS {h}" for h in HIDDEN)
    n = {k: t1(k) for k in ("premise_number", "premise_name", "premise_type", "premise_city", "premise_zip", "mdp_address", "mdp_city", "mdp_zip")}
    premise = joined(" ", [n["premise_number"], n["premise_name"], n["premise_type"]])
    street = f"(CASE WHEN {premise} = '' THEN {n['mdp_address']} ELSE {premise} END)"
    city = f"(CASE WHEN {premise} = '' THEN {or_else(n['premise_city'], n['mdp_city'])} ELSE {n['premise_city']} END)"
    code = f"(CASE WHEN {premise} = '' THEN {or_else(n['premise_zip'], n['mdp_zip'])} ELSE {n['premise_zip']} END)"
    full = f"CASE WHEN {street} = '' THEN '' ELSE {joined(' ', [street, city, q('MD'), code])} END"
    return f"SELECT *, {full} AS full_address FROM (SELECT register_id, {names} FROM property_register)"


ORD = "account_id, district, account_number, register_id"


def record_value(field: str, r: str = "") -> str:
    """J-9: what a register row gives for a field, '' where it is silent."""
    p = f"{r}." if r else ""
    d, a = t1(f"{p}district"), t1(f"{p}account_number")
    values = {
        "lot": t1(f"{p}lot"), "address": f"{p}full_address", "tax_map": t1(f"{p}map"), "parcel": t1(f"{p}parcel"), "section": t1(f"{p}section"),
        "tax_id": f"(CASE WHEN {d} <> '' AND {a} <> '' THEN {zfill(d, 2)} || '-' || {zfill(a, 6)} ELSE '' END)",
    }
    return t6(values[field], q(""))


def lookup(probes: str, county: str) -> str:
    """J-2 over a CTE or subquery ``probes`` (probe, lot, tax_map, parcel, district, account_number); uses the CTE ``reg``."""
    inside = f"contains(upper(r.county), {q(county.upper())})" if county else "true"

    def base(strategy: str, on: str) -> str:
        return f"SELECT p.probe, p.lot AS p_lot, p.tax_map AS p_map, p.parcel AS p_parcel, p.district AS p_district, p.account_number AS p_account, r.*, {strategy} AS strategy FROM {probes} p JOIN reg r ON {on}"

    account = f"p.district <> '' AND p.account_number <> '' AND list_contains({t10('p.account_number', (6, 8))}, r.account_number) AND list_contains({t10('p.district', (2,))}, r.district)"
    parts = [base(f"CASE WHEN {inside} THEN 1 ELSE 2 END" if county else "2", account)]
    if county:
        parts += [base(str(s), f"p.{t} <> '' AND {inside} AND list_contains({t10(f'p.{t}', (3, 4))}, r.{col})") for s, t, col in ((3, "tax_map", "map"), (4, "parcel", "parcel"))]
    agree = " AND ".join(f"({p} = '' OR {t9(col)} = {t9(p)})" for p, col in (("p_map", "map"), ("p_parcel", "parcel"), ("p_lot", "lot"), ("p_district", "district"), ("p_account", "account_number")))
    return f"""SELECT *, row_number() OVER (PARTITION BY probe ORDER BY {ORD}) AS rank FROM (
 SELECT *, bool_or(ok) OVER (PARTITION BY probe) AS anyok FROM (
  SELECT *, {agree} AS ok FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY {ORD}) AS pos FROM (
    SELECT *, min(strategy) OVER (PARTITION BY probe) AS least FROM ({' UNION ALL '.join(parts)})) WHERE strategy = least) WHERE pos <= 200)) WHERE strategy <= 2 OR ok OR NOT anyok"""


def by_address(probes: str, county: str) -> str:
    """J-3, J-4 over ``probes`` (probe, address)."""
    inside = f"contains(upper(r.county), {q(county.upper())})" if county else "true"
    words, number = address_words("p.address"), address_number("p.address")
    cand = t5("full_address")
    score = f"(list_sum(list_transform(list_concat([number], words), lambda w: CASE WHEN w <> '' AND contains({cand}, w) THEN 1 ELSE 0 END)) + CASE WHEN {cand} = {t5('p_address')} THEN 5 ELSE 0 END)"
    return f"""SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, {ORD}) AS rank FROM (SELECT *, CAST({score} AS INT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY probe ORDER BY {ORD}) AS pos FROM (
   SELECT k.*, r.* FROM (SELECT probe, address AS p_address, {number} AS number, {words} AS words FROM {probes} p) k JOIN reg r ON r.premise_number = {zfill('k.number', 5)}
   WHERE k.number <> '' AND len(k.words) > 0 AND contains(upper(r.mdp_address), k.words[1]) AND {inside})) WHERE pos <= 25)"""


def unique_address(found: str) -> str:
    a, b = t5("p_address"), t5("full_address")
    return f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY probe) AS alike FROM ({found}) WHERE {a} <> '' AND {b} <> '' AND ({a} = {b} OR contains({a}, {b}) OR contains({b}, {a}))) WHERE alike = 1"


def folder(lot: str, address: str) -> str:
    return t6(f"'Lot ' || {c(lot)} || ' - ' || {c(address)}", q("Unknown Lot - Unknown Address"))


def filename(kind: str, lot: str, source: str) -> str:
    return t6(f"{c(kind)} || ' - Lot ' || {c(lot)}", f"regexp_replace({c(source)}, '^(.+)\\.[^.]*$', '\\1')") + " || '.pdf'"


def status(lookup_: str, *fields: str) -> str:
    return f"CASE WHEN {lookup_} THEN 'lookup_only' WHEN {' OR '.join(map(unknown, fields))} THEN 'needs_review' ELSE 'ready' END"
