"""Values told near a tag: datasheet fields by nearest equipment in height, relief valve pressures and flanges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import normalize as N
from tagloom.operators.neighbours import nearest
from tagloom.operators.texts import told

# Field, what labels it.
FIELDS = [
    ("duty", r"(?i)\b(?:DUTY|POWER|RATED\s*POWER|MOTOR\s*POWER)\b"),
    ("flow_rate", r"(?i)\b(?:FLOW\s*RATE|MASS\s*FLOW|CAPACITY|THROUGHPUT)\b"),
    ("design_pressure", r"(?i)\b(?:DESIGN\s*PRESS(?:URE)?|MAWP|MAPD|DESIGN\s*P)\b"),
    ("operating_pressure", r"(?i)\b(?:OPERATING\s*PRESS(?:URE)?|OP\.\s*PRESS|WORKING\s*PRESS(?:URE)?|MOP|MAOP)\b"),
    ("design_temperature", r"(?i)\b(?:DESIGN\s*TEMP(?:ERATURE)?|OPERATING\s*TEMP(?:ERATURE)?|MAX\s*TEMP(?:ERATURE)?|DT)\b"),
    ("material", r"(?i)\b(?:MATERIAL(?:\s*OF\s*CONSTRUCTION)?|MOC|METALLURGY)\b"),
    ("vendor", r"(?i)\b(?:VENDOR|MANUFACTURER|SUPPLIER|MFR)\b"),
    ("quantity", r"(?i)\b(?:QUANTITY|QTY|NO\.\s*OF\s*UNITS|DUTY/STANDBY)\b"),
    ("service", r"(?i)\b(?:SERVICE|FLUID|DESCRIPTION|APPLICATION)\b"),
    ("type", r"(?i)\b(?:TYPE|MACHINE\s*TYPE|COMPRESSOR\s*TYPE|PUMP\s*TYPE|VESSEL\s*TYPE)\b"),
]
# Words by which a text is no vendor, and vendors that need no second capital word.
NO_VENDOR = ["VENDOR", "VENDOR SCOPE", "*", "YARD", "OFF-SKID"]
NO_VENDOR_WORDS = "SCOPE|SUPPLY|NOT IN|REFER|DRAWING|SPECIFICATION|DOC"
VENDORS = "MAN|ENERGY|SOLUTIONS|GE|SIEMENS|ELLIOTT|DRESSER|FLOWSERVE|SULZER|ABB|BAKER|HUGHES|SOLAR|TURBINES"
# Set pressure and flange patterns.
SET_PRESSURE = [r"(?i)SP\s*=\s*([\d.,]+\s*(?:bar[\s(g)]*|barg|psig|kPag))", r"(?i)SET\s*PRESS(?:URE)?\s*[=:]\s*([\d.,]+\s*(?:bar[\s(g)]*|barg|psig|kPag))"]
FLANGE = r"""(?i)\b(\d+(?:/\d+)?["']?)\s*[xX]\s*(\d+(?:/\d+)?["']?)\s*(?:(\d{3,4}#)\s*(\d{3,4}#)?)?"""


def _one(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _tail(c: Column, label: str) -> Column:
    t = F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, label, "")), "^[:=\\- ]+", ""))
    return F.when(F.length(t) >= 2, t)


# Patterns of values and their units, defaults, and what makes a vendor.
NUMBER = r"([\d,]+(?:\.\d+)?)"
DUTY_UNITS, FLOW_UNITS, PRESSURE_UNITS = "kW|MW|HP|BHP", "kg/h|t/h|m3/h|MMSCFD|Sm3/h|Nm3/h|bbl/d", r"barg|bar\s*\(g\)|psig|kPag|MPag"
PRESSURES = r"(?i)\b((?:FV\s*/\s*)?\d+(?:\.\d+)?(?:\s*/\s*(?:FV|\d+(?:\.\d+)?))*)\b"
TEMPERATURES, DEGREES = r"(-?\d+[\d.,\s/°CF-]{2,})", r"(°?\s*[CF])"
QUANTITY = r"(?i)(\d+\s*[xX]\s*\d+%|\d+\s*(?:DUTY|STANDBY|INSTALLED)?)"
VENDOR_LABEL, CAPITAL_WORD = r"(?i)^\s*(?:VENDOR|MANUFACTURER|SUPPLIER|MFR)\s*[:=]?\s*", r"\b([A-Z0-9-]{2,})\b"
DEFAULTS = {"duty": "kW", "flow_rate": "kg/h", "pressure": "Barg", "temperature": "°C"}


def _with_unit(c: Column, number: Column, units: str, default: str) -> Column:
    return F.concat(number, F.lit(" "), F.coalesce(_one(c, units), F.lit(default)))


def _temperature(c: Column) -> Column:
    n = F.regexp_replace(F.trim(_one(c, TEMPERATURES)), "/+$", "")
    return F.when(F.length(n) >= 2, _with_unit(c, n, DEGREES, DEFAULTS["temperature"]))


def vendor(c: Column) -> Column:
    """The vendor a text names: the line below a VENDOR heading, else what follows the label; null for scope markers and single plain words."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    v = F.when((F.size(lines) >= 2) & F.upper(F.get(lines, F.lit(0))).contains("VENDOR"), F.get(lines, F.lit(1))).otherwise(F.trim(F.regexp_replace(c, VENDOR_LABEL, "")))
    u = F.upper(v)
    bad = (v == "") | u.isin(NO_VENDOR) | (v.startswith("(") & v.endswith(")")) | u.rlike(NO_VENDOR_WORDS)
    return F.when(~bad & ((F.size(F.regexp_extract_all(v, F.lit(CAPITAL_WORD), F.lit(1))) >= 2) | u.rlike(VENDORS)), v)


def extract(c: Column, field: str) -> Column:
    """The field's value in a labelled text, null if there is none of two characters or more."""
    tail = _tail(c, dict(FIELDS)[field])
    value = {
        "duty": lambda: _with_unit(c, _one(c, NUMBER), rf"(?i)\b({DUTY_UNITS})\b", DEFAULTS["duty"]),
        "flow_rate": lambda: _with_unit(c, _one(c, NUMBER), rf"(?i)\b({FLOW_UNITS})\b", DEFAULTS["flow_rate"]),
        "design_pressure": lambda: _with_unit(c, _one(c, PRESSURES), rf"(?i)\b({PRESSURE_UNITS})\b", DEFAULTS["pressure"]),
        "operating_pressure": lambda: _with_unit(c, _one(c, PRESSURES), rf"(?i)\b({PRESSURE_UNITS})\b", DEFAULTS["pressure"]),
        "design_temperature": lambda: _temperature(c),
        "vendor": lambda: vendor(c),
        "quantity": lambda: F.trim(_one(c, QUANTITY)),
        "type": lambda: F.when(~F.trim(c).startswith("(") & ~tail.startswith("("), tail),
    }
    v = value.get(field, lambda: tail)()
    return F.when(F.length(v) >= 2, v)


def _placed(items: DataFrame) -> DataFrame:
    return items.select("drawing_id", "item_idx", "text", F.col("center_y").alias("y"))


def labelled(items: DataFrame) -> DataFrame:
    """drawing_id, item_idx, y, field, value: every field that a text labels and gives. Texts below three characters are passed over."""
    c = F.trim("text")
    all_fields = F.array(*[F.when(c.rlike(label), F.struct(F.lit(f).alias("field"), extract(c, f).alias("value"))) for f, label in FIELDS])
    said = told(items, f=F.when(F.length(c) >= 3, F.filter(all_fields, lambda x: x.isNotNull() & x["value"].isNotNull())))
    named = said.select("text", F.explode("f").alias("f")).select("text", "f.field", "f.value")
    return _placed(items).join(named, "text").drop("text")


def nearest_in_height(values: DataFrame, anchors: DataFrame, radius: float, keep: list[str]) -> DataFrame:
    """values (drawing_id, item_idx, y, keep...) with anchor: the anchor (drawing_id, tag, ord, y) nearest in height, strictly within radius.

    Equal distances go to the smallest ord. Null or negative heights meet nothing. It is the
    nearest-neighbour search with every x the same.
    """
    v = values.where("y >= 0").select("drawing_id", "item_idx", F.lit(0.0).alias("x"), "y", *keep)
    found = nearest(v, anchors.where("y >= 0").select("drawing_id", "tag", "ord", F.lit(0.0).alias("x"), "y"), radius, "anchor", square=True)
    return found.where("anchor is not null").drop("x")


def positions(elements: DataFrame, raw: DataFrame) -> DataFrame:
    """drawing_id, tag, classification, x, y: the elements and, as notes, all recognised items with their places; what beside tags is read by place is read from these.

    raw: drawing_id, text, center_x, center_y and, if there is one, box. Pixels become shares of the page; without centre and box an item is in the middle.
    """
    box = F.col("box") if "box" in raw.columns else F.lit(None).cast("array<double>")
    e = elements.select("drawing_id", "tag", "classification", N.page_x(F.coalesce("x", F.lit(-1.0))).alias("x"), N.page_y(F.coalesce("y", F.lit(-1.0))).alias("y"))
    r = raw.select("drawing_id", F.coalesce("text", F.lit("")).alias("tag"), F.lit("NOTE").alias("classification"), N.position(F.col("center_x"), box, 1).alias("x"), N.position(F.col("center_y"), box, 0).alias("y"))
    return e.unionByName(r)


def datasheet(items: DataFrame, elements: DataFrame) -> DataFrame:
    """drawing_id, tag, field, value: the first value of each field for the equipment nearest in height within 0.15."""
    anchors = elements.where("classification = 'EQUIPMENT_TAG'").select("drawing_id", "tag", "ord", "y")
    near = nearest_in_height(labelled(items), anchors, 0.15, ["field", "value"])
    clean = F.coalesce(F.upper(_one(F.col("anchor"), r"\b(\d{2,3}-[A-Z]{2,3}-\d{3,4}[A-Z0-9]*)\b")), F.trim("anchor"))
    return near.groupBy("drawing_id", clean.alias("tag"), "field").agg(F.min_by("value", F.struct("item_idx", "value")).alias("value"))


def set_pressures(items: DataFrame, elements: DataFrame) -> DataFrame:
    """drawing_id, tag, set_pressure, told_idx: for each relief valve the first pressure whose nearest valve in height, within 0.10, it is."""
    c = F.trim("text")
    raw = F.coalesce(*[_one(c, p) for p in SET_PRESSURE])
    known = told(items, value=N.pressure_text(F.trim(raw))).where("value is not null")
    said = _placed(items).join(known, "text").drop("text")
    return _first_for_valve(said, elements, ["value"]).select("drawing_id", "tag", F.col("r.value").alias("set_pressure"), "told_idx")


def flanges(items: DataFrame, elements: DataFrame) -> DataFrame:
    """drawing_id, tag, inlet_size, outlet_size, inlet_spec, remarks, told_idx: the first flange text for each relief valve, found like set pressures."""
    c = F.trim("text")
    inlet, outlet = F.coalesce(_one(c, FLANGE, 3), F.lit("300#")), F.coalesce(_one(c, FLANGE, 4), F.lit("150#"))
    keep = ["inlet_size", "outlet_size", "inlet_spec", "remarks"]
    known = told(items, met=c.rlike(FLANGE), inlet_size=_one(c, FLANGE, 1), outlet_size=_one(c, FLANGE, 2), inlet_spec=inlet, remarks=F.concat(F.lit("Flange Rating: "), inlet, F.lit(" x "), outlet)).where("met")
    said = _placed(items).join(known.select("text", *keep), "text").drop("text")
    return _first_for_valve(said, elements, keep).select("drawing_id", "tag", *[F.col(f"r.{k}").alias(k) for k in keep], "told_idx")


def _first_for_valve(said: DataFrame, elements: DataFrame, keep: list[str]) -> DataFrame:
    anchors = elements.where("classification = 'PSV_TAG'").select("drawing_id", "tag", "ord", "y")
    near = nearest_in_height(said, anchors, 0.10, keep)
    return near.groupBy("drawing_id", F.col("anchor").alias("tag")).agg(F.min_by(F.struct(*keep), F.struct("item_idx", *keep)).alias("r"), F.min("item_idx").alias("told_idx"))


def with_twins(valves: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """valves (drawing_id, tag, ...) with `columns` from the same row of values: by tag, else by canonical tag, else the first told (told_idx, else tag) of a twin (same tag but for the last letter)."""
    first = "told_idx" if "told_idx" in values.columns else "tag"
    row = F.struct(*columns)
    own = values.select(F.col("drawing_id").alias("e_drawing"), F.col("tag").alias("e_tag"), row.alias("e"))
    twin = values.groupBy(F.col("drawing_id").alias("t_drawing"), N.twin_key(F.col("tag")).alias("t_key")).agg(F.min_by(row, F.struct(first, "tag")).alias("t"))
    canon = own.select(F.col("e_drawing").alias("c_drawing"), F.col("e_tag").alias("c_tag"), F.col("e").alias("c"))
    j = valves.join(own, (F.col("drawing_id") == F.col("e_drawing")) & (F.col("tag") == F.col("e_tag")), "left")
    j = j.join(canon, (F.col("drawing_id") == F.col("c_drawing")) & (N.canonical_tag(F.col("tag")) == F.col("c_tag")), "left")
    j = j.join(twin, (F.col("drawing_id") == F.col("t_drawing")) & (N.twin_key(F.col("tag")) == F.col("t_key")), "left")
    won = F.coalesce("e", "c", "t")
    return j.withColumns({c: won[c] for c in columns}).drop("e_drawing", "e_tag", "e", "c_drawing", "c_tag", "c", "t_drawing", "t_key", "t")


def overlay(old: Column, new: Column) -> Column:
    """A map with the other's values where it has none or an empty one."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(old, empty), F.coalesce(new, empty), lambda k, a, b: F.coalesce(F.nullif(a, F.lit("")), b))


def block_sheets(blocks: DataFrame) -> DataFrame:
    """drawing_id, tag, field, value from a page's text blocks (drawing_id, page, block_idx, x0, y0, text), as a printed datasheet has them.

    A block with TAG NUMBER and an equipment tag anchors a column: blocks at most 80 aside, from 5
    above to 300 below. Their first line names the field, the rest is the value; the lowest block
    of a field wins, and the last anchor of a tag. Both sides are cut into cells of 80 by 305, so a
    column meets the blocks of nine cells. Null or blank blocks say nothing.
    """
    lines = F.filter(F.transform(F.split(F.trim("text"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    b = blocks.where(F.trim("text") != "").withColumn("lines", lines)
    tag = F.upper(_one(F.array_join("lines", "\n"), r"\b(\d{2,3}-[A-Z]{2,3}-\d{3,4}[A-Z0-9]*)\b"))
    cell = lambda c, s: F.floor(F.col(c) / s).cast("long")
    around = lambda c, s: F.explode(F.array(*[cell(c, s) + d for d in (-1, 0, 1)]))
    a = b.where(F.upper("text").contains("TAG NUMBER")).withColumn("tag", tag).where("tag is not null")
    a = a.select(F.col("drawing_id").alias("a_d"), F.col("page").alias("a_p"), F.col("block_idx").alias("a_i"), F.col("x0").alias("ax"), F.col("y0").alias("ay"), "tag").withColumn("cx", around("ax", 80.0)).withColumn("cy", around("ay", 305.0))
    n = b.select("drawing_id", "page", "block_idx", "x0", "y0", F.col("text").alias("block"), "lines", cell("x0", 80.0).alias("bx"), cell("y0", 305.0).alias("by"))
    col = n.join(a, (F.col("drawing_id") == F.col("a_d")) & (F.col("page") == F.col("a_p")) & (F.col("bx") == F.col("cx")) & (F.col("by") == F.col("cy")) & (F.abs(F.col("x0") - F.col("ax")) <= 80) & (F.col("y0") >= F.col("ay") - 5) & (F.col("y0") <= F.col("ay") + 300))
    label, value = F.upper(F.get("lines", F.lit(0))), F.array_join(F.slice("lines", F.lit(2), F.size("lines")), " ")
    plain = F.trim(F.regexp_replace(value, r"(?i)\s*NOTE.*", ""))
    number = _one(value, r"([\d,.]+)")
    # Labels in the order in which they are tried, with default units.
    rules = [
        ("DUTY", "duty", F.concat(number, F.lit(" kW"))),
        ("FLOW RATE", "flow_rate", F.concat(number, F.lit(" kg/h"))),
        ("DESIGN PRESS", "design_pressure", F.when(F.upper(plain).contains("BARG"), plain).otherwise(F.concat(plain, F.lit(" Barg")))),
        ("DESIGN TEMP", "design_temperature", F.when(F.upper(plain).contains("C"), plain).otherwise(F.concat(plain, F.lit(" °C")))),
        ("MATERIAL", "material", F.trim(value)),
        ("QUANTITY", "quantity", F.trim(value)),
        ("VENDOR", "vendor", vendor(F.col("block"))),
    ]
    said = None
    for words, field, v in rules:
        s = F.struct(F.lit(field).alias("field"), v.alias("value"))
        said = F.when(label.contains(words), s) if said is None else said.when(label.contains(words), s)
    found = col.withColumn("f", said).where("f.value is not null")
    return found.groupBy("drawing_id", "tag", F.col("f.field").alias("field")).agg(F.max_by("f.value", F.struct("page", "a_i", "y0", "block_idx")).alias("value"))
