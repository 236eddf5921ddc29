"""Typed entity tables from classified elements, boxes, relations and datasheet values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import normalize as N
from tagloom.operators import dedup
from tagloom.operators.neighbours import first_within, nearest

# Kind of equipment by code.
EQUIPMENT_KINDS = {
    "KA": "Compressor", "KB": "Blower", "KC": "Compressor", "KT": "Turbine", "CP": "Compressor", "CM": "Compressor", "KZ": "Package/Skid Unit", "HA": "Heat Exchanger", "HB": "Heat Exchanger", "HX": "Heat Exchanger", "HE": "Heat Exchanger", "EA": "Air Cooler", "EB": "Boiler",
    "VA": "Vessel", "VB": "Vessel", "VC": "Vessel", "TK": "Storage Tank", "DA": "Drum", "DB": "Drum", "CA": "Column", "CB": "Column", "R": "Reactor", "PA": "Pump", "PB": "Pump", "PC": "Pump", "PM": "Pump", "PU": "Pump", "GA": "Pump", "GB": "Pump",
    "FA": "Filter", "FB": "Filter", "ST": "Strainer", "CX": "Separator", "SK": "Skid", "PK": "Package", "MA": "Machinery", "MB": "Machinery", "ME": "Mechanical Equipment",
}
# Kind of instrument by code.
INSTRUMENT_KINDS = {
    "PIT": "Pressure Indicating Transmitter", "PDT": "Differential Pressure Transmitter", "PDIT": "Differential Pressure Indicating Transmitter", "PT": "Pressure Transmitter", "PI": "Pressure Indicator", "PIC": "Pressure Indicating Controller", "PSV": "Pressure Safety Valve", "PRV": "Pressure Relief Valve", "PDI": "Differential Pressure Indicator", "PCV": "Pressure Control Valve",
    "TIT": "Temperature Indicating Transmitter", "TT": "Temperature Transmitter", "TI": "Temperature Indicator", "TIC": "Temperature Indicating Controller", "TE": "Temperature Element", "TW": "Thermowell", "TCV": "Temperature Control Valve",
    "FIT": "Flow Indicating Transmitter", "FT": "Flow Transmitter", "FI": "Flow Indicator", "FE": "Flow Element", "FCV": "Flow Control Valve", "FIC": "Flow Indicating Controller", "FO": "Flow Orifice",
    "LIT": "Level Indicating Transmitter", "LT": "Level Transmitter", "LI": "Level Indicator", "LG": "Level Glass", "LCV": "Level Control Valve", "AIT": "Analytical Indicating Transmitter", "AT": "Analytical Transmitter", "VIT": "Vibration Indicating Transmitter", "VT": "Vibration Transmitter",
    "HV": "Hand Operated Valve", "XV": "On-Off Valve", "FV": "Flow Valve", "PY": "Pressure Relay/Converter", "TY": "Temperature Relay",
}
# Kind of valve by what its tag holds, in order, then by its beginning.
VALVE_HOLDS = [("GB|GATE", "Gate Valve"), ("CB|CHECK", "Check Valve"), ("BALL|BV", "Ball Valve"), ("GLOBE|GLV", "Globe Valve"), ("NEEDLE|NV", "Needle Valve"), ("BUTTERFLY|BFV", "Butterfly Valve"), ("^(HV|XV|CV|FCV|PCV|TCV|LCV)", "Control Valve"), ("^(MOV|SDV|BDV|EV)", "On-Off Valve")]
# Fitting by what a luminaire's tag holds.
FITTINGS = [("FLOODLIGHT|FL", "Floodlight"), ("WELLGLASS|WG", "Wellglass Fitting"), ("HIGH.*BAY|BAY.*HIGH", "High Bay Luminaire"), ("EMERGENCY|EL|EML", "Emergency Light"), ("LED", "LED Fitting"), ("TL", "Tube Light Fitting")]
# Panel types looked for in a tag, in order.
PANEL_TYPES = "EMDB MVDB LVDB SMDB LPDB EPDB MDB LDB MSB SDB PDB MLP ELP SLP MCC PCC".split()
# Defaults of electrical and earthing tables.
VOLTAGE, WATTAGE, CABLE = "415V / 230V 3-Phase", "70W / 2x36W (Typ.)", "XLPE/PVC Armoured"
DATASHEET = "design_pressure design_temperature flow_rate duty material vendor quantity".split()


def _lookup(code: Column, table: dict[str, str], other: Column) -> Column:
    """A small constant table as a map literal."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, code), other)


def first_boxes(symbols: DataFrame) -> DataFrame:
    """b_drawing, b_tag, symbol_type, ymin, xmin, ymax, xmax: each tag's first symbol by sym_ord."""
    cols = ["symbol_type", "ymin", "xmin", "ymax", "xmax"]
    g = symbols.where("inferred_tag is not null").groupBy(F.col("drawing_id").alias("b_drawing"), F.col("inferred_tag").alias("b_tag")).agg(F.min_by(F.struct(*cols), "sym_ord").alias("s"))
    return g.select("b_drawing", "b_tag", *[f"s.{c}" for c in cols])


def with_box(rows: DataFrame, symbols: DataFrame | None, tag: str = "tag") -> DataFrame:
    """rows with symbol_type and coordinates of their first symbol, null without one."""
    if symbols is None:
        return rows.withColumns({"symbol_type": F.lit(None).cast("string"), "coordinates": F.lit(None).cast("array<double>")})
    j = rows.join(first_boxes(symbols), (F.col("drawing_id") == F.col("b_drawing")) & (F.col(tag) == F.col("b_tag")), "left")
    return j.withColumn("coordinates", F.when(F.col("ymin").isNotNull(), F.array("ymin", "xmin", "ymax", "xmax"))).drop("b_drawing", "b_tag", "ymin", "xmin", "ymax", "xmax")


def equipment(e: DataFrame, values: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """drawing_id, ord, tag, name, type, description, datasheet fields, coordinates, aliases, confidence.

    One row per equipment key (without area number and unit suffix): the longest tag, everything
    else from the key's first row. values: drawing_id, tag, field, value. Confidence is 0.60 plus
    0.40 times the share of the seven datasheet fields that are filled.
    """
    rows = e if "aliases" in e.columns else dedup.plain(e)
    t = dedup.fold(rows, N.equipment_key(F.col("tag")), ["EQUIPMENT_TAG"], "ord", first=("aliases",)).select("drawing_id", F.col("tag").alias("master"), "first_tag", F.col("first_ord").alias("ord"), F.col("first_aliases").alias("aliases"))
    t = with_box(t, symbols, "first_tag")
    fields = [*DATASHEET, "type", "service", "location"]
    if values is not None:
        # The datasheet's tag is the element's own, else one with the same canonical form, the first by tag.
        v = values.groupBy(F.col("drawing_id").alias("v_drawing"), F.col("tag").alias("v_tag")).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m"))
        exact = v.select("v_drawing", "v_tag", F.col("m").alias("m1"))
        canon = v.groupBy(F.col("v_drawing").alias("c_drawing"), N.canonical_tag(F.col("v_tag")).alias("c_tag")).agg(F.min_by("m", "v_tag").alias("m2"))
        t = t.join(exact, (F.col("drawing_id") == F.col("v_drawing")) & (F.col("first_tag") == F.col("v_tag")), "left").join(canon, (F.col("drawing_id") == F.col("c_drawing")) & (N.canonical_tag(F.col("first_tag")) == F.col("c_tag")), "left")
        m = F.coalesce("m1", "m2")
        t = t.withColumns({f"a_{x}": F.try_element_at(m, F.lit(x)) for x in fields})
    else:
        t = t.withColumns({f"a_{x}": F.lit(None).cast("string") for x in fields})
    code = F.upper(F.regexp_extract("first_tag", r"(?i)([A-Z]{1,3})(?=-?\d)", 1))
    kind = F.coalesce(F.col("symbol_type"), _lookup(code, EQUIPMENT_KINDS, F.lit("Generic Equipment")))
    filled = reduce(lambda a, b: a + b, [F.col(f"a_{x}").isNotNull().cast("int") for x in DATASHEET])
    return t.select("drawing_id", "ord", F.col("master").alias("tag"), F.col("first_tag").alias("name"), F.coalesce("a_type", kind).alias("type"), F.coalesce("a_service", "first_tag").alias("description"), *[F.col(f"a_{x}").alias(x) for x in DATASHEET], F.col("a_location").alias("location"), "coordinates", "aliases", F.round(F.lit(0.60) + F.lit(0.40) * (filled / 7.0), 2).alias("confidence"))


def parse_line(tag: Column) -> Column:
    """struct(size, service, system, sequence_number, spec, insulation) of a line tag."""
    p = F.filter(F.transform(F.split(tag, "-"), lambda x: F.trim(x)), lambda x: x != "")
    p0 = F.get(p, F.lit(0))
    sized = (p0.rlike("^[0-9]|[\"']") | F.upper(p0).rlike("IN|MM|DN")) & (F.size(p) >= 2)
    rem = F.when(sized, F.slice(p, F.lit(2), F.size(p))).otherwise(p)
    n = F.size(rem)
    at = lambda i: F.get(rem, F.lit(i))
    system4 = at(1).rlike("^[0-9]{1,3}$")
    return F.struct(
        F.when(sized, p0).otherwise("").alias("size"),
        F.coalesce(at(0), F.lit("UNK")).alias("service"),
        F.when((n >= 5) | ((n == 4) & system4), at(1)).alias("system"),
        F.when((n >= 5) | ((n == 4) & system4), at(2)).when(n >= 2, at(1)).otherwise("0000").alias("sequence_number"),
        F.when((n >= 5) | ((n == 4) & system4), at(3)).when(n >= 3, at(2)).otherwise("UNSPEC").alias("spec"),
        F.when(n >= 5, at(4)).when((n == 4) & ~system4, at(3)).alias("insulation"),
    )


def _other_end(rels: DataFrame, kinds: list[str], last: bool, ends: str = "both") -> DataFrame:
    """o_drawing, o_tag, other: the tag at the other end of a tag's first (or last) relation of the kinds; `ends`: both, source (tag is the source) or target."""
    r = rels.where(F.upper("rel_type").isin(kinds))
    src = r.select(F.col("drawing_id").alias("o_drawing"), F.col("source_tag").alias("o_tag"), F.col("target_tag").alias("other"), (F.col("rel_ord")).alias("o"), F.lit(0).alias("s"))
    tgt = r.where("source_tag <> target_tag").select(F.col("drawing_id").alias("o_drawing"), F.col("target_tag").alias("o_tag"), F.col("source_tag").alias("other"), F.col("rel_ord").alias("o"), F.lit(1).alias("s"))
    rows = {"both": src.unionByName(tgt), "source": src, "target": tgt}[ends]
    pick = F.max_by if last else F.min_by
    return rows.groupBy("o_drawing", "o_tag").agg(pick("other", F.struct("o", "s")).alias("other"))


def _join_end(rows: DataFrame, ends: DataFrame, out: str, tag: str = "tag") -> DataFrame:
    return rows.join(ends.withColumnRenamed("other", out), (F.col("drawing_id") == F.col("o_drawing")) & (F.col(tag) == F.col("o_tag")), "left").drop("o_drawing", "o_tag")


def callouts(e: DataFrame, word: str, ending: str) -> DataFrame:
    """drawing_id, ord, x, y, tag (the place named) of texts that say where a line comes from or goes to."""
    place = F.trim(F.regexp_extract("tag", rf"(?i)\b{word}\s+([A-Z0-9\s-]+(?:{ending})?)\b", 1))
    return e.withColumn("place", place).where((F.length("place") >= 3) & ~F.upper("place").isin("BE", "THE", "SUCTION", "A", "AN")).select("drawing_id", "ord", "x", "y", F.col("place").alias("tag"))


def lines(e: DataFrame, rels: DataFrame, traces: DataFrame | None = None, legacy_axis: bool = False) -> DataFrame:
    """drawing_id, ord, tag, size, service, spec, sequence_number, insulation, from_node, to_node.

    Ends are the last relations that touch the line; an empty end takes the nearest off-page
    callout within 0.15 of the line's centre (its trace's, else its text's).
    legacy_axis reads trace points as (x, y).
    """
    kinds = ["CONNECTS_TO", "FEEDS", "INSTALLED_ON"]
    t = e.where("classification = 'LINE_TAG'").select("drawing_id", "ord", "tag", "x", "y", parse_line(F.col("tag")).alias("p"), *_flags(e))
    t = _join_end(t, _other_end(rels, kinds, True, "source"), "to_rel")
    t = _join_end(t, _other_end(rels, kinds, True, "target"), "from_rel")
    if traces is not None:
        cy, cx = (F.col("t_y0") + F.col("t_y1")) / 2, (F.col("t_x0") + F.col("t_x1")) / 2
        if legacy_axis:
            cy, cx = cx, cy
        tr = traces.select(F.col("drawing_id").alias("t_drawing"), F.col("tag").alias("t_tag"), *[F.col(c).alias(f"t_{c}") for c in ("y0", "x0", "y1", "x1")])
        t = t.join(tr, (F.col("drawing_id") == F.col("t_drawing")) & (F.col("tag") == F.col("t_tag")), "left").withColumns({"x": F.coalesce(cx, "x"), "y": F.coalesce(cy, "y")}).drop("t_drawing", "t_tag", "t_y0", "t_x0", "t_y1", "t_x1")
    t = nearest(t, callouts(e, "TO", "FLARE|DRAIN|HEADER|UNIT|SYSTEM|ATMOSPHERE"), 0.15, "to_call")
    t = nearest(t, callouts(e, "FROM", "FLARE|DRAIN|HEADER|UNIT|SYSTEM|VESSEL"), 0.15, "from_call")
    off = lambda c: F.concat(F.col(c), F.lit(" (off-page)"))
    return t.select("drawing_id", "ord", "tag", "p.size", "p.service", "p.spec", "p.sequence_number", "p.insulation", F.coalesce("from_rel", off("from_call")).alias("from_node"), F.coalesce("to_rel", off("to_call")).alias("to_node"), "confidence", "flag_reason")


def _flags(e: DataFrame) -> list[Column]:
    """The element's confidence and flag, null where it has none."""
    return [(F.col(c) if c in e.columns else F.lit(None)).cast(t).alias(c) for c, t in (("confidence", "double"), ("flag_reason", "string"))]


FLAGS = ("confidence", "flag_reason")


def _flagged(e: DataFrame) -> DataFrame:
    return e.withColumns(dict(zip(FLAGS, _flags(e))))


def instruments(e: DataFrame, rels: DataFrame, line_table: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """drawing_id, ord, tag, type, service, location, loop_id, coordinates: one row per instrument key, the longest tag, the rest from the first row.

    The loop is the first number in a text within 0.10 of the symbol's centre, else in one within
    0.015 of its height, else in the tag, else 0000. The service is the first relation's line
    (with its service) or other end.
    """
    f = dedup.fold(_flagged(e), N.instrument_key(F.col("tag")), ["INSTRUMENT_TAG"], "ord", first=FLAGS).select("drawing_id", F.col("tag").alias("master"), "first_tag", F.col("first_ord").alias("ord"), *[F.col(f"first_{c}").alias(c) for c in FLAGS])
    t = with_box(f, symbols, "first_tag")
    t = _join_end(t, _other_end(rels, ["MONITORS", "INSTALLED_ON"], False), "host", "first_tag")
    li = line_table.groupBy(F.col("drawing_id").alias("li_drawing"), F.col("tag").alias("li_tag")).agg(F.min_by("service", "ord").alias("li_service"))
    t = t.join(li, (F.col("drawing_id") == F.col("li_drawing")) & (F.col("host") == F.col("li_tag")), "left")
    code = F.coalesce(F.nullif(F.regexp_extract("first_tag", r"([A-Z]{2,5})(?=-?\d)", 1), F.lit("")), F.nullif(F.regexp_extract("first_tag", "([A-Z]+)", 1), F.lit("")), F.lit("INST"))
    number = lambda c: F.nullif(F.regexp_extract(c, r"([0-9]{3,5}[A-Z]?)", 1), F.lit(""))
    near = None
    if symbols is not None:
        near = loop_texts(t.where("coordinates is not null"), e)
        t = t.join(near, (F.col("drawing_id") == F.col("n_drawing")) & (F.col("ord") == F.col("n_ord")), "left")
    loop = F.coalesce(*([F.col("near_loop")] if near is not None else []), number("first_tag"), F.lit("0000"))
    service = F.when(F.col("li_tag").isNotNull(), F.concat("li_service", F.lit(" ("), "li_tag", F.lit(")"))).otherwise(F.col("host"))
    return t.select("drawing_id", "ord", F.col("master").alias("tag"), _lookup(code, INSTRUMENT_KINDS, code).alias("type"), service.alias("service"), F.lit("Field").alias("location"), loop.alias("loop_id"), "coordinates", "confidence", "flag_reason")


def loop_texts(boxed: DataFrame, e: DataFrame) -> DataFrame:
    """n_drawing, n_ord, near_loop: the first number in texts within 0.10 of a box's centre, else in texts less than 0.015 above or below it."""
    c = F.col("coordinates")
    b = boxed.select("drawing_id", "ord", ((F.get(c, F.lit(1)) + F.get(c, F.lit(3))) / 2).alias("x"), ((F.get(c, F.lit(0)) + F.get(c, F.lit(2))) / 2).alias("y"))
    t = e.where((F.col("x") >= 0) & (F.col("y") >= 0) & F.col("tag").rlike("[0-9]{3,5}")).select("drawing_id", "ord", "x", "y", F.regexp_extract("tag", r"([0-9]{3,5}[A-Z]?)", 1).alias("tag"))
    close = first_within(b, t, 0.10, "close")
    level = first_within(close.withColumn("x", F.when(F.col("close").isNull(), 0.0)), t.withColumn("x", F.lit(0.0)), 0.015, "level", square=True)
    return level.select(F.col("drawing_id").alias("n_drawing"), F.col("ord").alias("n_ord"), F.coalesce("close", "level").alias("near_loop"))


def valves(e: DataFrame, rels: DataFrame, line_table: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """drawing_id, ord, tag, type, size, line_tag, coordinates, type_source, confidence, aliases: one row per valve key; the size is the host line's."""
    rows = _flagged(e if "aliases" in e.columns else dedup.plain(e))
    f = dedup.fold(rows, N.valve_key(F.col("tag")), ["VALVE_TAG"], "ord", first=("aliases", *FLAGS)).select("drawing_id", F.col("tag").alias("master"), "first_tag", F.col("first_ord").alias("ord"), F.col("aliases").alias("folded"), F.col("first_aliases").alias("own_aliases"), *[F.col(f"first_{c}").alias(c) for c in FLAGS])
    t = with_box(f, symbols, "first_tag")
    t = _join_end(t, _other_end(rels, ["INSTALLED_ON", "CONNECTS_TO", "MONITORS"], False), "line_tag", "first_tag")
    li = line_table.groupBy(F.col("drawing_id").alias("li_drawing"), F.col("tag").alias("li_tag")).agg(F.min_by("size", "ord").alias("size"))
    t = t.join(li, (F.col("drawing_id") == F.col("li_drawing")) & (F.col("line_tag") == F.col("li_tag")), "left")
    u = F.upper("first_tag")
    kind = reduce(lambda c, x: c.when(u.rlike(x[0]), x[1]), VALVE_HOLDS, F).otherwise("Valve")
    return t.select("drawing_id", "ord", F.col("master").alias("tag"), kind.alias("type"), "size", "line_tag", "coordinates", F.lit("inferred_from_prefix").alias("type_source"), "confidence", "flag_reason", F.array_distinct(F.concat("own_aliases", "folded")).alias("aliases"))


def relief_valves(e: DataFrame, pressures: DataFrame | None = None, flange: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """drawing_id, ord, tag, unit, set_pressure, inlet_size, outlet_size, inlet_spec, remarks, coordinates; N/A where nothing was said."""
    from tagloom.operators.attributes import with_twins

    t = e.where("classification = 'PSV_TAG'").select("drawing_id", "ord", "tag")
    na = F.lit("N/A")
    if pressures is not None:
        t = with_twins(t, pressures, ["set_pressure"])
    if flange is not None:
        t = with_twins(t, flange, ["inlet_size", "outlet_size", "inlet_spec", "remarks"])
    t = with_box(t, symbols)
    have = lambda c, d: F.coalesce(F.col(c), d).alias(c) if c in t.columns else d.alias(c)
    unit = F.regexp_extract("tag", "^([0-9]{2})-", 1)
    return t.select("drawing_id", "ord", "tag", F.lit("PSV").alias("type"), F.col("tag").alias("service"), unit.alias("unit"), have("set_pressure", na), have("inlet_size", na), have("outlet_size", na), have("inlet_spec", na), have("remarks", F.lit(None).cast("string")), "coordinates")


def luminaires(e: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    u = F.upper("tag")
    kind = reduce(lambda c, x: c.when(u.rlike(x[0]), x[1]), FITTINGS, F).otherwise("Lighting Fitting")
    t = with_box(e.where("classification = 'LUMINAIRE_TAG'").select("drawing_id", "ord", "tag"), symbols)
    return t.select("drawing_id", "ord", "tag", F.coalesce("symbol_type", kind).alias("fitting_type"), F.coalesce(F.nullif(F.regexp_extract(u, r"([0-9]{2,3}\s*W\b)", 1), F.lit("")), F.lit(WATTAGE)).alias("wattage"), F.lit(1).alias("quantity"), "coordinates")


def panels(e: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    u = F.upper("tag")
    kind = reduce(lambda c, p: c.when(u.contains(p), p), PANEL_TYPES, F.when(u.contains("LIGHTING"), "Lighting Panel").when(u.contains("EARTHING"), "Earthing Main Panel")).otherwise("Distribution Board")
    t = with_box(e.where("classification = 'PANEL_TAG'").select("drawing_id", "ord", "tag"), symbols)
    return t.select("drawing_id", "ord", "tag", kind.alias("panel_type"), F.lit(VOLTAGE).alias("voltage"), F.col("tag").alias("description"), "coordinates")


def cables(e: DataFrame, rels: DataFrame) -> DataFrame:
    """drawing_id, ord, tag, cable_type, from_panel, to_equipment: the last FEEDS or CONNECTS_TO relations that touch a circuit."""
    t = e.where("classification IN ('CIRCUIT_TAG', 'CABLE_TAG')").select("drawing_id", "ord", "tag")
    r = rels.where("rel_type IN ('FEEDS', 'CONNECTS_TO')")
    t = _join_end(t, _other_end(r, ["FEEDS", "CONNECTS_TO"], True, "source"), "to_equipment")
    t = _join_end(t, _other_end(r, ["FEEDS", "CONNECTS_TO"], True, "target"), "from_panel")
    return t.select("drawing_id", "ord", "tag", F.lit(CABLE).alias("cable_type"), "from_panel", "to_equipment")


def earthing(e: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """drawing_id, ord, tag, component_type, material, size, resistance, coordinates."""
    t = with_box(e.where("classification IN ('EARTH_BAR_TAG', 'EARTH_PIT_TAG', 'BOND_CONDUCTOR_TAG')").select("drawing_id", "ord", "tag", "classification"), symbols)
    u, c = F.upper("tag"), F.regexp_replace("classification", "_TAG$", "")
    copper = u.rlike("COPPER|CU")
    got = lambda p: F.nullif(F.regexp_extract(u, p, 1), F.lit(""))
    # Materials, sizes and resistance assumed where a tag doesn't say.
    material = F.when(c == "EARTH_BAR", F.when(copper, "Tinned Copper Flat Bar").otherwise("Tinned Copper / GI Bar")).when(c == "EARTH_PIT", "Copper-Bonded Steel Electrode (50mm Dia, 3m L)").otherwise(F.when(copper, "Bare Copper Tape").when(u.rlike("GI|GS"), "Galvanized Iron Flat Strip").otherwise("Bare Copper Tape / GI Strip"))
    size = F.when(c == "EARTH_BAR", F.coalesce(got(r"([0-9]{2,3}\s*[xX]\s*[0-9]{1,2})"), F.lit("50x6 mm"))).when(c == "BOND_CONDUCTOR", F.coalesce(got(r"([0-9]{2,3}\s*[xX]\s*[0-9]{1,2}|[0-9]{2,3}\s*SQMM)"), F.lit("25x3 mm")))
    return t.select("drawing_id", "ord", "tag", c.alias("component_type"), material.alias("material"), size.alias("size"), F.when(c == "EARTH_PIT", "< 1.0 Ohm (Earth Electrode Grid)").alias("resistance"), "coordinates")


#: Classes and, where spellings are folded, the key of each entity table.
ROWS = {
    "equipment": (["EQUIPMENT_TAG"], N.equipment_key), "lines": (["LINE_TAG"], None), "instruments": (["INSTRUMENT_TAG"], N.instrument_key), "valves": (["VALVE_TAG"], N.valve_key), "relief_valves": (["PSV_TAG"], None),
    "luminaires": (["LUMINAIRE_TAG"], None), "panels": (["PANEL_TAG"], None), "cables": (["CIRCUIT_TAG", "CABLE_TAG"], None), "earthing": (["EARTH_BAR_TAG", "EARTH_PIT_TAG", "BOND_CONDUCTOR_TAG"], None), "generic": (["EQUIPMENT_TAG", "GENERIC_TAG"], None),
}


def rows(e: DataFrame, name: str) -> DataFrame:
    """drawing_id, ord, tag, aliases: the rows of an entity table, without what texts, boxes and relations say of them. Lines, instruments and relief valves have no aliases."""
    classes, key = ROWS[name]
    own = e.where(F.col("classification").isin(classes)).select("drawing_id", "ord", "tag", "classification", "aliases")
    if key is None:
        return own.select("drawing_id", "ord", "tag", F.array().cast("array<string>").alias("aliases"))
    f = dedup.fold(own, key(F.col("tag")), classes, "ord", first=("aliases",))
    told = {"instruments": F.array().cast("array<string>"), "valves": F.array_distinct(F.concat("first_aliases", "aliases"))}.get(name, F.col("first_aliases"))
    return f.select("drawing_id", F.col("first_ord").alias("ord"), "tag", told.alias("aliases"))


def line_parts(e: DataFrame) -> DataFrame:
    """drawing_id, ord, tag, size, service of the lines, as their tags say; their ends are `lines`' to find."""
    return e.where("classification = 'LINE_TAG'").select("drawing_id", "ord", "tag", parse_line(F.col("tag")).alias("p")).select("drawing_id", "ord", "tag", "p.size", "p.service")


def generic(e: DataFrame) -> DataFrame:
    return e.where("classification IN ('EQUIPMENT_TAG', 'GENERIC_TAG')").select("drawing_id", "ord", "tag", "classification", F.col("tag").alias("description"))


def annotations(e: DataFrame) -> DataFrame:
    kind = F.when(F.col("classification") == "ELEVATION_TAG", "ELEVATION").otherwise(F.col("classification"))
    return e.where("classification IN ('NOTE', 'ELEVATION_TAG', 'RATING')").select("drawing_id", "ord", F.col("tag").alias("text"), kind.alias("annotation_type"), F.col("x").alias("position_x"), F.col("y").alias("position_y"))


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """drawing_id, total_items: rows of all entity tables; relationships aren't entities."""
    return reduce(DataFrame.unionByName, [t.select("drawing_id") for k, t in tables.items() if k != "relationships"]).groupBy("drawing_id").agg(F.count(F.lit(1)).alias("total_items"))
