"""The reference operators' chain as DuckDB SQL: common table expressions that oracles put together."""

from __future__ import annotations

from tagloom.functions.normalize import WHITE
from tagloom.operators import attributes as A
from tagloom.operators import documents as D
from tagloom.operators import grammar as G
from tagloom.plans.views import OCR_ITEMS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def canon(c: str) -> str:
    return f"regexp_replace(upper({strip(c)}), '^[0-9]{{2,3}}-', '')"


def twin(c: str) -> str:
    return f"regexp_replace({canon(c)}, '[A-Z]$', '')"


_LINE = r"upper(regexp_replace(rtrim(trim(regexp_replace(raw, '(?i)\s*NOTE\s*[0-9]+', '', 'g')), '-'), '\s+', '', 'g'))"


def size_case(tag: str) -> str:
    p0 = f"split_part({tag}, '-', 1)"
    inch = f"regexp_matches({p0}, '[\"'']')"
    clean = f"lower(regexp_replace({p0}, '[\"'' ]', '', 'g'))"
    digits = f"regexp_full_match({clean}, '[0-9]+')"
    n = f"coalesce(try_cast({clean} AS BIGINT), 1152921504606846976)"
    bad = f"'size_out_of_range(' || {p0} || ')'"
    return f"""CASE WHEN NOT regexp_matches({p0}, '^[0-9/]') THEN NULL
 WHEN regexp_matches({p0}, '^[0-9]{{4,}}"?$') OR ({inch} AND {digits} AND {n} > 60) THEN {bad}
 WHEN {clean} IN {among(G.INCH_SIZES)} OR CASE WHEN {digits} THEN {clean} || 'mm' ELSE {clean} END IN {among(G.MM_SIZES)} THEN NULL
 WHEN regexp_full_match({clean}, '[0-9]+/[0-9]+') THEN 'unrecognized_fraction_size'
 WHEN {digits} AND {n} BETWEEN 1 AND 600 THEN 'unverified_size_token' WHEN {digits} THEN {bad} END"""


_CODE = "upper(regexp_extract(raw, '(?i)^[0-9]{2}-([A-Z]{2,4})-', 1))"
_SEQ = "regexp_extract(raw, '(?i)^[0-9]{2}-[A-Z]{2,4}-([0-9A-Z]{3,6})', 1)"
_CODELIKE = f"(regexp_matches(tag, {q(G.SPEC_CODE)}) OR regexp_matches(tag, {q(G.SERVICE_CODE)}))"
_PLAIN = " ".join(f"WHEN rank = {r} THEN '{c}'" for r, c, _ in G.PATTERNS if r not in (2, 3))

NORM = f"""WITH {OCR_ITEMS},
norm AS (SELECT * FROM (SELECT *, trim(regexp_replace(text, '{WHITE}+', ' ', 'g')) t FROM ocr_items WHERE confidence >= 0.10 AND {strip('text')} <> '') WHERE length(t) >= 2)"""

SCAN = (
    NORM
    + ",\ncand AS ("
    + " UNION ALL ".join(f"SELECT drawing_id, item_idx, t, confidence conf, center_x, center_y, {r} rank, unnest(range(len(m))) pos, unnest(m) raw FROM (SELECT *, regexp_extract_all(t, {q(p)}, 1) m FROM norm)" for r, _, p in G.PATTERNS)
    + f"""),
tagged AS (SELECT * FROM (SELECT *, CASE WHEN rank = 2 THEN CASE WHEN length({_LINE}) >= 4 THEN {_LINE} END ELSE upper(raw) END tag FROM cand) WHERE tag IS NOT NULL),
sized AS (SELECT *, CASE WHEN rank = 2 THEN {size_case("tag")} END size FROM tagged),
found AS (SELECT drawing_id, item_idx, rank, pos, tag, t, center_x, center_y, coalesce(starts_with(size, 'size_out_of_range'), false) again,
  CASE WHEN rank = 2 THEN CASE WHEN coalesce(starts_with(size, 'size_out_of_range'), false) THEN 'NOTE' ELSE 'LINE_TAG' END
   WHEN rank = 3 THEN CASE WHEN {_CODE} IN {among(G.VALVE_CODES)} AND length(regexp_replace({_SEQ}, '[^0-9]', '', 'g')) >= 4 THEN 'VALVE_TAG' WHEN {_CODE} IN {among(G.INSTRUMENT_CODES)} THEN 'INSTRUMENT_TAG'
    WHEN {_CODE} IN {among(G.EQUIPMENT_CODES)} THEN 'EQUIPMENT_TAG' WHEN length({_SEQ}) >= 4 THEN 'INSTRUMENT_TAG' ELSE 'EQUIPMENT_TAG' END {_PLAIN} END classification,
  round(CASE WHEN starts_with(size, 'size_out_of_range') THEN 0.25 WHEN rank = 2 AND size IS NOT NULL THEN least(conf, 0.75) WHEN rank = 4 THEN least(conf, 0.85) ELSE conf END, 3) confidence,
  coalesce(size, CASE WHEN rank = 2 AND regexp_matches(raw, '(?i)NOTE\\s*[0-9]+') THEN 'note_ref_stripped(' || trim(regexp_extract(raw, '(?i)(\\s*NOTE\\s*[0-9]+)', 1)) || ')' END) flag_reason
 FROM sized WHERE NOT (rank = 3 AND (length({_SEQ}) = 6 OR {_CODELIKE})) AND NOT (rank = 5 AND regexp_matches(tag, '^[0-9]{{2}}[A-Z]{{2}}[0-9]{{7,}}'))
  AND NOT (rank = 12 AND ({_CODELIKE} OR split_part(tag, '-', 1) NOT IN {among(G.EQUIPMENT_PREFIXES)} OR regexp_matches(tag, {q(G.EQUIPMENT_REJECT)}))))"""
)

FIRST = (
    SCAN
    + f""",
placed AS (SELECT *, item_idx * 1048576 + rank * 16384 + least(pos, 16383) sq FROM found),
firsts AS (SELECT drawing_id, tag, sq, item_idx first_item FROM placed QUALIFY row_number() OVER (PARTITION BY drawing_id, tag ORDER BY sq) = 1),
chosen AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY drawing_id, tag ORDER BY again DESC, CASE WHEN again THEN -sq ELSE sq END) = 1),
said AS (SELECT drawing_id, item_idx, center_x sx, center_y sy FROM ocr_items WHERE regexp_matches(trim(text), {q(G.SETPOINT)})),
mentions AS (SELECT c.* EXCLUDE (sq), f.sq seq, f.first_item,
  c.rank = 4 AND c.classification = 'INSTRUMENT_TAG' AND length(regexp_replace(c.tag, '[^0-9]', '', 'g')) = 3 AND (
   EXISTS (SELECT 1 FROM said s WHERE s.drawing_id = c.drawing_id AND s.item_idx = c.item_idx)
   OR EXISTS (SELECT 1 FROM said s WHERE s.drawing_id = c.drawing_id AND s.item_idx <> c.item_idx AND sx > 0 AND sy > 0 AND c.center_x > 0 AND c.center_y > 0 AND abs(c.center_y - sy) <= 0.05 AND abs(c.center_x - sx) <= 0.20)) hit
 FROM chosen c JOIN firsts f USING (drawing_id, tag)),
tags AS (SELECT drawing_id, seq, item_idx, first_item, tag, CASE WHEN hit THEN 'NOTE' ELSE classification END classification, CASE WHEN hit THEN 0.15 ELSE confidence END confidence, CASE WHEN hit THEN 'ambiguous_setpoint_vs_tag' ELSE flag_reason END flag_reason, center_x, center_y FROM mentions)"""
)

_PRIORITY = "CASE classification " + " ".join(f"WHEN '{c}' THEN {i}" for c, i in G.PRIORITY.items()) + " ELSE 99 END"

ELEMENTS = (
    FIRST
    + f""",
gave AS (SELECT drawing_id, first_item item_idx FROM tags UNION SELECT drawing_id, item_idx FROM found WHERE again),
notes AS (SELECT drawing_id, item_idx * 1048576 + 245760 seq, item_idx, t tag, round(confidence, 3) confidence, center_x, center_y FROM norm n
  WHERE length(t) >= 3 AND NOT EXISTS (SELECT 1 FROM gave g WHERE g.drawing_id = n.drawing_id AND g.item_idx = n.item_idx)
  QUALIFY row_number() OVER (PARTITION BY drawing_id, t ORDER BY item_idx) = 1),
both_ AS (SELECT drawing_id, seq, item_idx, tag, classification, confidence, flag_reason, center_x x, center_y y FROM tags
 UNION ALL SELECT drawing_id, seq, item_idx, tag, 'NOTE', confidence, NULL, center_x, center_y FROM notes n WHERE NOT EXISTS (SELECT 1 FROM tags g WHERE g.drawing_id = n.drawing_id AND g.tag = n.tag)),
elements AS (SELECT drawing_id, {_PRIORITY}::BIGINT * 1125899906842624 + seq ord, seq, item_idx, tag, classification, confidence, flag_reason, x, y FROM both_)"""
)


def fold(name: str, rows: str, key: str, order: str) -> str:
    """<name>: drawing_id, key, tag (the longest), its order, the first row's order and tag, aliases as text."""
    return f"""
{name}_r AS (SELECT drawing_id, {key} key, tag, {order} o FROM {rows}),
{name}_w AS (SELECT *, first(tag) OVER w win, first(o) OVER w win_o FROM {name}_r WINDOW w AS (PARTITION BY drawing_id, key ORDER BY length(tag) DESC, o)),
{name}_p AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, key, o < win_o ORDER BY length(tag) DESC, o) p FROM {name}_w),
{name} AS (SELECT drawing_id, key, any_value(win) tag, any_value(win_o) win_o, min(o) first_o, arg_min(tag, o) first_tag, coalesce(string_agg(tag, ',' ORDER BY o) FILTER (WHERE o > win_o OR (o < win_o AND p = 1)), '') aliases FROM {name}_p GROUP BY 1, 2)"""


FOLDED = (
    ELEMENTS
    + ",\nprocess AS (SELECT * FROM elements WHERE classification IN "
    + among(G.FOLDED)
    + "),"
    + fold("al", "process", canon("tag"), "seq")
    + """,
el AS (SELECT e.*, a.aliases FROM process e JOIN al a ON a.drawing_id = e.drawing_id AND a.tag = e.tag AND a.win_o = e.seq
 UNION ALL SELECT e.*, '' FROM elements e WHERE classification NOT IN """
    + among(G.FOLDED)
    + ")"
)


def nearest(name: str, asked: str, among_: str, radius: float) -> str:
    """<name>: drawing_id, tag, near: the nearest candidate of the same drawing within the radius."""
    return f"""
{name} AS (SELECT a.drawing_id, a.tag, c.tag near FROM ({asked}) a JOIN ({among_}) c ON c.drawing_id = a.drawing_id AND sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)) < {radius}
 QUALIFY row_number() OVER (PARTITION BY a.drawing_id, a.tag ORDER BY sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)), c.ord) = 1)"""


def of_class(*classes: str) -> str:
    return f"SELECT * FROM el WHERE classification IN {among(classes)}"


_LINES, _EQ = of_class("LINE_TAG", "CIRCUIT_TAG"), of_class("EQUIPMENT_TAG")


def _seq(name: str, cls: str) -> str:
    return f"""
{name} AS (SELECT v.drawing_id, v.tag, l.tag near FROM ({of_class(cls)}) v JOIN ({_LINES}) l ON l.drawing_id = v.drawing_id AND regexp_extract(v.tag, '([0-9]{{3,5}})', 1) <> '' AND contains(l.tag, regexp_extract(v.tag, '([0-9]{{3,5}})', 1))
 QUALIFY row_number() OVER (PARTITION BY v.drawing_id, v.tag ORDER BY l.ord) = 1)"""


_BIT = 2**58


def _edge(part: int, target: str, kind: str, frm: str) -> str:
    return f"SELECT e.drawing_id, e.tag source_tag, {target} target_tag, '{kind}' rel_type, {part}::BIGINT * {_BIT} + e.ord rel_ord FROM {frm} WHERE {target} IS NOT NULL"


_TAKE = "(SELECT * FROM ({0}) QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY ord) <= {1})"

RELATIONS = (
    FOLDED
    + ","
    + ",".join(
        [
            _seq("vs", "VALVE_TAG"),
            nearest("vn", of_class("VALVE_TAG"), _LINES, 0.45),
            _seq("ins", "INSTRUMENT_TAG"),
            nearest("inl", of_class("INSTRUMENT_TAG"), _LINES, 0.45),
            nearest("ine", of_class("INSTRUMENT_TAG"), _EQ, 0.50),
            nearest("pe", of_class("PSV_TAG"), _EQ, 0.50),
            nearest("pl", of_class("PSV_TAG"), _LINES, 0.45),
            nearest("le", _LINES, _EQ, 0.45),
        ]
    )
    + f""",
bar AS (SELECT drawing_id, arg_min(tag, ord) bar FROM el WHERE classification = 'EARTH_BAR_TAG' GROUP BY 1),
r_valve AS ({_edge(0, "coalesce(a.near, b.near)", "INSTALLED_ON", f"({of_class('VALVE_TAG')}) e LEFT JOIN vs a ON a.drawing_id = e.drawing_id AND a.tag = e.tag LEFT JOIN vn b ON b.drawing_id = e.drawing_id AND b.tag = e.tag")}),
r_inst AS ({_edge(1, "coalesce(a.near, b.near, c.near)", "MONITORS", f"({of_class('INSTRUMENT_TAG')}) e LEFT JOIN ins a ON a.drawing_id = e.drawing_id AND a.tag = e.tag LEFT JOIN inl b ON b.drawing_id = e.drawing_id AND b.tag = e.tag LEFT JOIN ine c ON c.drawing_id = e.drawing_id AND c.tag = e.tag")}),
r_psv AS ({_edge(2, "coalesce(a.near, b.near)", "INSTALLED_ON", f"({of_class('PSV_TAG')}) e LEFT JOIN pe a ON a.drawing_id = e.drawing_id AND a.tag = e.tag LEFT JOIN pl b ON b.drawing_id = e.drawing_id AND b.tag = e.tag")}),
r_line AS ({_edge(3, "a.near", "CONNECTS_TO", f"({_LINES}) e JOIN le a ON a.drawing_id = e.drawing_id AND a.tag = e.tag")}),
r_feeds AS (SELECT p.drawing_id, p.tag source_tag, c.tag target_tag, 'FEEDS' rel_type, 4::BIGINT * {_BIT} + p.k * 100 + c.k rel_ord FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY ord) k FROM ({of_class("PANEL_TAG")})) WHERE k <= 5) p JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY ord) k FROM ({of_class("CIRCUIT_TAG", "LUMINAIRE_TAG")})) WHERE k <= 20) c ON c.drawing_id = p.drawing_id AND c.tag <> p.tag),
r_earth AS ({_edge(5, "b.bar", "EARTHED_TO", f"({of_class('EARTH_PIT_TAG', 'BOND_CONDUCTOR_TAG')}) e JOIN bar b ON b.drawing_id = e.drawing_id")} UNION ALL {_edge(6, "b.bar", "EARTHED_TO", f"{_TAKE.format(_EQ, 15)} e JOIN bar b ON b.drawing_id = e.drawing_id")}),
rels AS (SELECT drawing_id, source_tag, target_tag, rel_type, min(rel_ord) rel_ord FROM (SELECT * FROM r_valve UNION ALL SELECT * FROM r_inst UNION ALL SELECT * FROM r_psv UNION ALL SELECT * FROM r_line UNION ALL SELECT * FROM r_feeds UNION ALL SELECT * FROM r_earth) GROUP BY ALL)"""
)

_C = "trim(text)"


def _told(field: str) -> str:
    """The value that a text tells of a field, as SQL."""
    one = lambda p: f"nullif(regexp_extract({_C}, {q(p)}, 1), '')"
    label = dict(A.FIELDS)[field]
    tail = f"trim(regexp_replace(trim(regexp_replace({_C}, {q(label)}, '', 'g')), '^[:=\\- ]+', ''))"
    united = lambda n, units, default: f"{n} || ' ' || coalesce({one(units)}, {q(default)})"
    if field in ("duty", "flow_rate"):
        return united(one(A.NUMBER), rf"(?i)\b({A.DUTY_UNITS if field == 'duty' else A.FLOW_UNITS})\b", A.DEFAULTS[field])
    if field.endswith("pressure"):
        return united(one(A.PRESSURES), rf"(?i)\b({A.PRESSURE_UNITS})\b", A.DEFAULTS["pressure"])
    if field == "design_temperature":
        n = f"regexp_replace(trim({one(A.TEMPERATURES)}), '/+$', '')"
        return f"CASE WHEN length({n}) >= 2 THEN {united(n, A.DEGREES, A.DEFAULTS['temperature'])} END"
    if field == "vendor":
        v = f"trim(regexp_replace({_C}, {q(A.VENDOR_LABEL)}, '', 'g'))"
        bad = f"({v} = '' OR upper({v}) IN {among(A.NO_VENDOR)} OR (starts_with({v}, '(') AND ends_with({v}, ')')) OR regexp_matches(upper({v}), {q(A.NO_VENDOR_WORDS)}))"
        return f"CASE WHEN NOT {bad} AND (len(regexp_extract_all({v}, {q(A.CAPITAL_WORD)})) >= 2 OR regexp_matches(upper({v}), {q(A.VENDORS)})) THEN {v} END"
    if field == "quantity":
        return f"trim({one(A.QUANTITY)})"
    tail = f"CASE WHEN length({tail}) >= 2 THEN {tail} END"
    return f"CASE WHEN NOT starts_with({_C}, '(') AND NOT starts_with({tail}, '(') THEN {tail} END" if field == "type" else tail


_CLEAN = r"coalesce(nullif(upper(regexp_extract(tag, '\b([0-9]{2,3}-[A-Z]{2,3}-[0-9]{3,4}[A-Z0-9]*)\b', 1)), ''), trim(tag))"
_NEAR_PSV = "JOIN el e ON e.drawing_id = t.drawing_id AND e.classification = 'PSV_TAG' AND t.y >= 0 AND e.y >= 0 AND abs(t.y - e.y) < 0.10 QUALIFY row_number() OVER (PARTITION BY t.drawing_id, t.item_idx ORDER BY abs(t.y - e.y), e.ord) = 1"

#: What texts say beside tags: datasheet fields, set pressures and flanges, as further expressions behind FOLDED.
SHEETS = (
    ",\ntold AS (SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT drawing_id, item_idx, center_y y, '{f}' field, {_told(f)} AS value FROM ocr_items WHERE length({_C}) >= 3 AND regexp_matches({_C}, {q(label)})" for f, label in A.FIELDS)
    + f""") WHERE length(value) >= 2),
told_near AS (SELECT t.*, e.tag FROM told t JOIN el e ON e.drawing_id = t.drawing_id AND e.classification = 'EQUIPMENT_TAG' AND abs(t.y - e.y) < 0.15 AND t.y >= 0 AND e.y >= 0
  QUALIFY row_number() OVER (PARTITION BY t.drawing_id, t.item_idx, t.field ORDER BY abs(t.y - e.y), e.ord) = 1),
sheet AS (SELECT drawing_id, clean tag, field, arg_min(value, item_idx) AS value FROM (SELECT *, {_CLEAN} clean FROM told_near) GROUP BY 1, 2, 3),
sp AS (SELECT drawing_id, item_idx, center_y y, trim(coalesce({", ".join(f"nullif(regexp_extract({_C}, {q(p)}, 1), '')" for p in A.SET_PRESSURE)})) raw FROM ocr_items),
sp_text AS (SELECT *, CASE WHEN regexp_matches(v, '\\s+bar\\(g\\)') THEN v ELSE replace(v, 'bar(g)', ' bar(g)') END AS value FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(raw, '\\s+', ' ', 'g'), '(?i)bar\\s*\\(g\\)', 'bar(g)', 'g'), '(?i)barg', 'bar(g)', 'g') v FROM sp WHERE raw IS NOT NULL)),
sp_near AS (SELECT t.*, e.tag FROM sp_text t {_NEAR_PSV}),
pressures AS (SELECT drawing_id, tag, arg_min(value, item_idx) set_pressure, min(item_idx) told_idx FROM sp_near GROUP BY 1, 2),
fl AS (SELECT drawing_id, item_idx, center_y y, regexp_extract({_C}, {q(A.FLANGE)}, 1) a, regexp_extract({_C}, {q(A.FLANGE)}, 2) b, coalesce(nullif(regexp_extract({_C}, {q(A.FLANGE)}, 3), ''), '300#') c, coalesce(nullif(regexp_extract({_C}, {q(A.FLANGE)}, 4), ''), '150#') d FROM ocr_items WHERE regexp_matches({_C}, {q(A.FLANGE)})),
fl_near AS (SELECT t.*, e.tag FROM fl t {_NEAR_PSV}),
flanges AS (SELECT drawing_id, tag, arg_min({{'inlet_size': a, 'outlet_size': b, 'inlet_spec': c, 'remarks': 'Flange Rating: ' || c || ' x ' || d}}, item_idx) f, min(item_idx) told_idx FROM fl_near GROUP BY 1, 2)"""
)
VALUES = FOLDED + SHEETS


def kinds(texts: str, doc: str) -> str:
    """<doc>, drawing_type, score from `texts` (doc, body): CTEs ending in `kinds`."""
    v = D.vocabulary()
    vocab = ", ".join(f"({q(k)}, {p}, {q(t)}, {w})" for k, p, t, w in v)
    cascade = " ".join(f"WHEN regexp_matches(body, {q('(?i)' + p)}) THEN '{k}'" for p, k in D.KEYWORDS)
    return f"""vocab(kind, place, token, weight) AS (VALUES {vocab}),
scores AS (SELECT {doc}, kind, place, sum(CASE WHEN contains(lower(body), token) THEN weight ELSE 0 END)::INTEGER score FROM {texts} CROSS JOIN vocab GROUP BY ALL),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY {doc} ORDER BY score DESC, place) = 1),
kinds AS (SELECT t.{doc}, CASE {cascade} WHEN b.score >= {D.LEAST} THEN b.kind ELSE 'GENERIC' END drawing_type, b.score FROM {texts} t JOIN best b USING ({doc}))"""
