"""Deliverables: flat, hierarchical and per-sheet forms of the entity tables, and their writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagloom.functions import normalize as N
from tagloom.operators.prefix import salted_prefix

# Entity type, table, and the five properties of the wide form.
WIDE = [
    ("EQUIPMENT", "equipment", ["name", "type", "description", "location", None]), ("PIPING_LINE", "lines", ["size", "service", "spec", "from_node", "to_node"]), ("INSTRUMENT", "instruments", ["type", "loop_id", "location", None, None]), ("VALVE", "valves", ["type", "size", "line_tag", "rating", "normal_state"]),
    ("SAFETY_RELIEF_VALVE", "relief_valves", ["type", "set_pressure", "inlet_size", "outlet_size", "relief_destination"]), ("LUMINAIRE", "luminaires", ["fitting_type", "wattage", "circuit", "panel", "location"]), ("ELECTRICAL_PANEL", "panels", ["panel_type", "voltage", "capacity_kva", "feeder_from", "location"]),
    ("CABLE", "cables", ["cable_type", "size_mm2", "cores", "from_panel", "to_equipment"]), ("EARTHING", "earthing", ["component_type", "material", "size", "connected_to", "resistance"]), ("GENERIC_COMPONENT", "generic", ["classification", "description", None, None, None]),
]


def _text(t: DataFrame, c: str | None) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in t.columns else F.lit("")


def wide(tables: dict[str, DataFrame]) -> DataFrame:
    """drawing_id, entity_type, tag, property_1 to property_5; relationships as rows with their confidence. Missing tables and columns are empty."""
    rows = []
    for kind, name, props in WIDE:
        if name in tables:
            t = tables[name]
            rows.append(t.select("drawing_id", F.lit(kind).alias("entity_type"), _text(t, "tag").alias("tag"), *[_text(t, p).alias(f"property_{i + 1}") for i, p in enumerate(props)]))
    if "relationships" in tables:
        r = tables["relationships"]
        conf = F.col("confidence") if "confidence" in r.columns else F.lit(1.0)
        rows.append(r.select("drawing_id", F.lit("RELATIONSHIP").alias("entity_type"), F.col("source").alias("tag"), F.upper("type").alias("property_1"), F.col("target").alias("property_2"), F.format_string("conf=%.2f", conf).alias("property_3"), F.lit("").alias("property_4"), F.lit("").alias("property_5")))
    return reduce(DataFrame.unionByName, rows)


def relationship_rows(edges: DataFrame) -> DataFrame:
    """drawing_id, source, target, type, confidence, attributes (JSON), flag_reason."""
    has = edges.columns
    return edges.select("drawing_id", "source", "target", F.lower("type").alias("type"), (F.col("confidence") if "confidence" in has else F.lit(1.0)).alias("confidence"), (F.coalesce(F.to_json("attributes"), F.lit("{}")) if "attributes" in has else F.lit("{}")).alias("attributes"), _text(edges, "flag_reason").alias("flag_reason"))


def flagged(elements: DataFrame) -> DataFrame:
    """drawing_id, item_type, tag, confidence, flag_reason of every element that was flagged."""
    return elements.where("flag_reason is not null").select("drawing_id", F.col("classification").alias("item_type"), "tag", "confidence", "flag_reason")


def sheet(t: DataFrame, columns: list[str]) -> DataFrame:
    """A table as a sheet per drawing: a row number by ord, `-` for what is null, confidence in whole percent."""

    def show(c: str) -> Column:
        if c == "confidence":
            return F.coalesce(F.concat(F.floor(F.col(c) * 100).cast("string"), F.lit("%")), F.lit("-"))
        if t.schema[c].dataType.simpleString() == "array<double>":
            return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(c, N.number_text), ", "), F.lit("]")), F.lit("-"))
        return F.coalesce(F.col(c).cast("string"), F.lit("-"))

    # Numbered by a bucketed running count: no task sorts a whole drawing.
    bucket = F.struct("ord.class_no", F.floor(F.col("ord.item") / 4096)) if isinstance(t.schema["ord"].dataType, StructType) else F.floor(F.col("ord") / 4096)
    numbered = salted_prefix(t.withColumn("__one", F.lit(1)), ["drawing_id"], ["ord"], "__one", "__before", bucket=bucket)
    return numbered.select("drawing_id", (F.col("__before") + 1).cast("int").alias("row_no"), *[show(c).alias(c) for c in columns])


# Class, table, attribute and column of the hierarchical form.
OBJECTS = [
    ("Equipment", "equipment", [("Name", "name"), ("Type", "type"), ("Description", "description"), ("Material", "material")]),
    ("PipeLine", "lines", [("NominalSize", "size"), ("ServiceCode", "service"), ("PipingSpec", "spec"), ("FromConnection", "from_node"), ("ToConnection", "to_node")]),
    ("InstrumentBubble", "instruments", [("InstrumentType", "type"), ("LoopID", "loop_id"), ("Location", "location")]),
    ("ValveComponent", "valves", [("ValveType", "type"), ("NominalSize", "size"), ("NormalState", "normal_state"), ("RatingClass", "rating"), ("HostLine", "line_tag")]),
    ("SafetyReliefValve", "relief_valves", [("ValveType", "type"), ("Description", "service"), ("SetPressure", "set_pressure"), ("InletSize", "inlet_size"), ("OutletSize", "outlet_size"), ("InletSpec", "inlet_spec"), ("ReliefDestination", "relief_destination")]),
    ("Luminaire", "luminaires", [("FittingType", "fitting_type"), ("Wattage", "wattage"), ("Circuit", "circuit"), ("Panel", "panel")]),
    ("ElectricalPanel", "panels", [("PanelType", "panel_type"), ("Voltage", "voltage"), ("Capacity", "capacity_kva"), ("FeederFrom", "feeder_from")]),
    ("Cable", "cables", [("CableType", "cable_type"), ("SizeMM2", "size_mm2"), ("Cores", "cores"), ("FromPanel", "from_panel"), ("ToEquipment", "to_equipment")]),
    ("EarthingComponent", "earthing", [("ComponentType", "component_type"), ("Material", "material"), ("ConnectedTo", "connected_to")]),
]
# Table, group, element, its attributes and its children with their columns, of the XML form.
GROUPS = [
    ("equipment", "EquipmentGroup", "Equipment", [("Tag", "tag"), ("Type", "type")], [("Description", "description"), ("DesignPressure", "design_pressure"), ("DesignTemperature", "design_temperature"), ("Duty", "duty")]),
    ("lines", "PipingNetwork", "Pipeline", [("Tag", "tag"), ("Size", "size"), ("Spec", "spec")], [("Service", "service"), ("From", "from_node"), ("To", "to_node")]),
    ("instruments", "Instrumentation", "Instrument", [("Tag", "tag"), ("Type", "type")], [("LoopID", "loop_id")]),
    ("valves", "Valves", "Valve", [("Tag", "tag"), ("Type", "type"), ("Size", "size")], [("LineTag", "line_tag"), ("Rating", "rating"), ("NormalState", "normal_state")]),
    ("relief_valves", "SafetyReliefValves", "SafetyReliefValve", [("Tag", "tag"), ("Type", "type"), ("SetPressure", "set_pressure")], [("Description", "service"), ("InletSize", "inlet_size"), ("OutletSize", "outlet_size"), ("InletSpec", "inlet_spec"), ("ReliefDestination", "relief_destination")]),
    ("luminaires", "Luminaires", "Luminaire", [("Tag", "tag"), ("FittingType", "fitting_type")], [("Wattage", "wattage"), ("Circuit", "circuit"), ("Panel", "panel")]),
    ("panels", "ElectricalPanels", "Panel", [("Tag", "tag"), ("Type", "panel_type")], [("Voltage", "voltage"), ("CapacityKVA", "capacity_kva"), ("FeederFrom", "feeder_from")]),
    ("cables", "Cables", "Cable", [("Tag", "tag"), ("Type", "cable_type")], [("SizeMM2", "size_mm2"), ("FromPanel", "from_panel"), ("ToEquipment", "to_equipment")]),
    ("earthing", "Earthing", "EarthingComponent", [("Tag", "tag"), ("Type", "component_type")], [("Material", "material"), ("ConnectedTo", "connected_to")]),
]
# Sheets by kind of drawing.
_PIPING, _LIGHTING, _EARTHING, _SWITCHGEAR = ["lines", "instruments", "valves", "relief_valves", "equipment"], ["luminaires", "panels", "cables"], ["earthing", "equipment", "relationships"], ["panels", "cables", "relationships"]
SHEETS = {"PID": _PIPING, "PFD": _PIPING, "ISOMETRIC": _PIPING, "ELECTRICAL_LAYOUT": _LIGHTING, "EARTHING_LAYOUT": _EARTHING, "SLD": _SWITCHGEAR}


def objects(tables: dict[str, DataFrame]) -> DataFrame:
    """drawing_id, class, tag, attributes (JSON; null where nothing is known): the rows of the hierarchical form."""
    rows = []
    for kind, name, attributes in OBJECTS:
        if name in tables:
            t = tables[name]
            own = [(F.col(c).cast("string") if c in t.columns else F.lit(None).cast("string")).alias(a) for a, c in attributes]
            rows.append(t.select("drawing_id", F.lit(kind).alias("class"), "tag", F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("attributes")))
    return reduce(DataFrame.unionByName, rows)


def plant_xml(tables: dict[str, DataFrame]) -> DataFrame:
    """drawing_id, group_no, group_name, ord, element: every entity as an XML element of its group; null is the empty text."""

    def safe(c: Column) -> Column:
        for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(raw), F.lit(shown))
        return c

    rows = []
    for n, (name, group, element, attributes, children) in enumerate(GROUPS):
        if name in tables:
            t = tables[name]
            parts = [F.lit(f"<{element}")]
            for a, c in attributes:
                parts += [F.lit(f' {a}="'), safe(_text(t, c)), F.lit('"')]
            parts.append(F.lit(">"))
            for x, c in children:
                parts += [F.lit(f"<{x}>"), safe(_text(t, c)), F.lit(f"</{x}>")]
            rows.append(t.select("drawing_id", F.lit(n).alias("group_no"), F.lit(group).alias("group_name"), "ord", F.concat(*parts, F.lit(f"</{element}>")).alias("element")))
    return reduce(DataFrame.unionByName, rows)


def xml_documents(elements: DataFrame) -> DataFrame:
    """drawing_id, place, line of each drawing's document: root, groups that have elements, elements. In the order of place they are the text."""
    groups = elements.select("drawing_id", "group_no", "group_name").distinct()
    drawings = elements.select("drawing_id").distinct()
    none = F.lit(None).cast(elements.schema["ord"].dataType)
    line = lambda df, n, step, o, text: df.select("drawing_id", F.struct(n.alias("group"), F.lit(step).alias("step"), o.alias("ord")).alias("place"), text.alias("line"))
    parts = [
        line(drawings, F.lit(-1), 0, none, F.lit('<?xml version="1.0" ?><PlantModel SchemaVersion="1.0">')),
        line(groups, F.col("group_no"), 0, none, F.concat(F.lit("<"), "group_name", F.lit(">"))),
        line(elements, F.col("group_no"), 1, F.col("ord"), F.col("element")),
        line(groups, F.col("group_no"), 2, none, F.concat(F.lit("</"), "group_name", F.lit(">"))),
        line(drawings, F.lit(len(GROUPS)), 0, none, F.lit("</PlantModel>")),
    ]
    return reduce(DataFrame.unionByName, parts)


def master(tables: dict[str, DataFrame]) -> DataFrame:
    """drawing_id, section, record (JSON of the whole row, nulls included): the whole graph, one line an entry; a drawing's lines are its master document."""
    rows = [t.select("drawing_id", F.lit(k).alias("section"), F.to_json(F.struct(*[c for c in t.columns if c not in ("drawing_id", "ord", "rel_ord")]), {"ignoreNullFields": "false"}).alias("record")) for k, t in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def flagged_entities(tables: dict[str, DataFrame]) -> DataFrame:
    """drawing_id, category, tag, confidence (whole percent), flag_reason, details: the review queue over instruments, valves, lines and relationships."""
    kinds = [
        ("Instrument", "instruments", F.col("tag"), ["Type: ", "type", ", Location: ", "location"]),
        ("Valve", "valves", F.col("tag"), ["Type: ", "type", ", Source: ", "type_source"]),
        ("Line Tag", "lines", F.col("tag"), ["Size: ", "size", ", Spec: ", "spec"]),
        ("Relationship", "relationships", F.concat("source", F.lit(" -> "), "target"), ["Rel Type: ", "type"]),
    ]
    rows = []
    for kind, name, tag, said in kinds:
        t = tables.get(name)
        if t is not None and "flag_reason" in t.columns:
            details = F.concat(*[_text(t, x) if x in t.columns else F.lit(x) for x in said])
            conf = F.coalesce(F.col("confidence"), F.lit(1.0)) if "confidence" in t.columns else F.lit(1.0)
            rows.append(t.where("flag_reason is not null").select("drawing_id", F.lit(kind).alias("category"), tag.alias("tag"), F.concat(F.floor(conf * 100).cast("string"), F.lit("%")).alias("confidence"), "flag_reason", details.alias("details")))
    return reduce(DataFrame.unionByName, rows)


def sheets(tables: dict[str, DataFrame], kinds: DataFrame) -> DataFrame:
    """drawing_id, sheet, row_no, tag: the sheets that a drawing of its kind (kinds: drawing_id, drawing_type) has, numbered; always its annotations; drawings of other kinds list components."""
    rows = []
    for name, t in tables.items():
        drawn = [k for k, own in SHEETS.items() if name in own]
        wanted = F.lit(True) if name == "annotations" else ~F.col("drawing_type").isin(list(SHEETS)) if name == "generic" else F.col("drawing_type").isin(drawn) if drawn else None
        if wanted is None:
            continue
        edge = name == "relationships"
        tag = F.col("text") if name == "annotations" else F.concat("source", F.lit(" -> "), "target") if edge else F.col("tag")
        place = F.struct((F.col("rel_ord.part") * 100 + F.col("rel_ord.place.class_no")).alias("class_no"), "rel_ord.place.item", "rel_ord.place.rank", "rel_ord.place.pos") if edge else F.col("ord")
        own = t.select("drawing_id", F.lit(name).alias("sheet"), place.alias("ord"), tag.alias("tag")).join(kinds.select(F.col("drawing_id").alias("k_drawing"), "drawing_type"), F.col("drawing_id") == F.col("k_drawing")).where(wanted)
        rows.append(own.select("drawing_id", "sheet", "ord", "tag"))
    every = reduce(DataFrame.unionByName, rows).withColumn("__one", F.lit(1))
    n = salted_prefix(every, ["drawing_id", "sheet"], ["ord", "tag"], "__one", "__before", bucket=F.struct("ord.class_no", F.floor(F.col("ord.item") / 4096)))
    return n.select("drawing_id", "sheet", (F.col("__before") + 1).cast("int").alias("row_no"), "tag")


def write(tables: dict[str, DataFrame], path: str) -> None:
    """All deliverables below path, each partitioned by drawing: wide and relationship CSV, object and master JSON, objects as XML rows, one XML document a drawing, one Parquet table per entity type.

    Rows are brought together by drawing before they are written, large drawings in several parts
    and small ones many to a task, so a drawing gets few files.
    """
    part = lambda df: df.hint("rebalance", "drawing_id").write.mode("overwrite").partitionBy("drawing_id")
    part(wide(tables)).option("header", True).csv(f"{path}/wide_csv")
    if "relationships" in tables:
        part(relationship_rows(tables["relationships"])).option("header", True).csv(f"{path}/relationships_csv")
    part(objects(tables)).json(f"{path}/objects_json")
    objects(tables).write.mode("overwrite").format("xml").option("rootTag", "Plant").option("rowTag", "Object").save(f"{path}/objects_xml")
    part(master(tables)).json(f"{path}/master_json")
    # A document is one file, so its lines pass one task in order; they are sorted on disk, not held.
    lines = xml_documents(plant_xml(tables)).repartition("drawing_id").sortWithinPartitions("drawing_id", "place")
    lines.select("drawing_id", "line").write.mode("overwrite").partitionBy("drawing_id").text(f"{path}/plant_xml")
    for name, t in tables.items():
        part(t).parquet(f"{path}/tables/{name}")
