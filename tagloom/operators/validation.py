"""Consistency rules over entity tables, and what they leave to look for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The box looked at where an entity has none.
FALLBACK = [0.2, 0.4, 0.35, 0.65]


def _report(df: DataFrame, rule: str, severity: str, message) -> DataFrame:
    return df.select("drawing_id", F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.col("tag").alias("target_tag"), message.alias("message"))


def duplicate_tags(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """VAL-001: a tag that an earlier row has, in the order equipment, lines, instruments, valves; one report per repeat, naming the row before it.

    The window's groups are one tag's rows in one drawing's entity tables, a row or two each.
    """
    rows = reduce(DataFrame.unionByName, [t.select("drawing_id", "tag", F.lit(name).alias("kind"), F.struct(F.lit(i).alias("i"), "ord").alias("w")) for i, (name, t) in enumerate(tables)])
    before = rows.withColumn("seen", F.lag("kind").over(Window.partitionBy("drawing_id", "tag").orderBy("w"))).where("seen is not null")
    return _report(before, "VAL-001", "ERROR", F.concat(F.lit("Duplicate tag '"), "tag", F.lit("' detected across "), "seen", F.lit(" and "), "kind", F.lit(".")))


def size_mismatch(valves: DataFrame, lines: DataFrame) -> DataFrame:
    """VAL-002: a valve whose size isn't that of the first line with its line's tag, quotes aside."""
    li = lines.groupBy(F.col("drawing_id").alias("l_drawing"), F.col("tag").alias("l_tag")).agg(F.min_by("size", "ord").alias("l_size"))
    j = valves.where("line_tag <> ''").join(li, (F.col("drawing_id") == F.col("l_drawing")) & (F.col("line_tag") == F.col("l_tag")))
    bare = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("None")), '"', ""))
    return _report(j.where(bare("size") != bare("l_size")), "VAL-002", "ERROR", F.concat(F.lit("Valve size ("), F.coalesce("size", F.lit("None")), F.lit(") mismatch with host line size ("), F.coalesce("l_size", F.lit("None")), F.lit(") on '"), "line_tag", F.lit("'.")))


def orphan_valves(valves: DataFrame) -> DataFrame:
    """VAL-003: a valve without a line."""
    return _report(valves.where("coalesce(line_tag, '') = ''"), "VAL-003", "WARNING", F.concat(F.lit("Orphan valve: Valve '"), "tag", F.lit("' is not associated with any pipeline.")))


def orphan_instruments(instruments: DataFrame, edges: DataFrame) -> DataFrame:
    """VAL-004: an instrument that no relationship touches."""
    ends = edges.select("drawing_id", F.explode(F.array("source", "target")).alias("tag"))
    return _report(instruments.join(ends, ["drawing_id", "tag"], "left_anti"), "VAL-004", "WARNING", F.concat(F.lit("Orphan instrument: Instrument '"), "tag", F.lit("' has no logical connections to lines or equipment.")))


def odd_equipment(equipment: DataFrame) -> DataFrame:
    """VAL-005: an equipment tag that begins with neither an area number nor letters and a number."""
    return _report(equipment.where(~F.col("tag").rlike(r"(?i)^([0-9]{2}-|[A-Z]{1,4}-?[0-9]+)")), "VAL-005", "WARNING", F.concat(F.lit("Equipment tag '"), "tag", F.lit("' does not match standard engineering equipment tag format.")))


def validate(t: dict[str, DataFrame]) -> DataFrame:
    """drawing_id, rule_id, severity, target_tag, message of all rules. t: equipment, lines, instruments, valves, relationships."""
    parts = [
        duplicate_tags([("Equipment", t["equipment"]), ("Line", t["lines"]), ("Instrument", t["instruments"]), ("Valve", t["valves"])]),
        size_mismatch(t["valves"], t["lines"]),
        orphan_valves(t["valves"]),
        orphan_instruments(t["instruments"], t["relationships"]),
        odd_equipment(t["equipment"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def missing(reports: DataFrame, valves: DataFrame, instruments: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """drawing_id, item_type, target_tag, coordinates, reason: orphans not tried before, with the box of the instrument, else of the valve, else the fallback."""
    r = reports.where("rule_id IN ('VAL-003', 'VAL-004')")
    if tried is not None:
        r = r.join(tried.select("drawing_id", "target_tag"), ["drawing_id", "target_tag"], "left_anti")
    box = lambda t, p: t.where("coordinates is not null").groupBy(F.col("drawing_id").alias(f"{p}_d"), F.col("tag").alias(f"{p}_t")).agg(F.min_by("coordinates", "ord").alias(f"{p}_box"))
    r = r.join(box(valves, "v"), (F.col("drawing_id") == F.col("v_d")) & (F.col("target_tag") == F.col("v_t")), "left").join(box(instruments, "i"), (F.col("drawing_id") == F.col("i_d")) & (F.col("target_tag") == F.col("i_t")), "left")
    kind = F.when(F.col("rule_id") == "VAL-003", "PIPING_CONNECTION").otherwise("INSTRUMENT_LINK")
    return r.select("drawing_id", kind.alias("item_type"), "target_tag", F.coalesce("i_box", "v_box", F.array(*map(F.lit, FALLBACK))).alias("coordinates"), F.col("message").alias("reason"))


def first_missing(m: DataFrame, k: int = 5) -> DataFrame:
    """The first k missing entities of each drawing, with the class to look for."""
    w = Window.partitionBy("drawing_id").orderBy("item_type", "target_tag")
    c = F.when(F.col("item_type").contains("VALVE"), "VALVE_TAG").when(F.col("item_type").contains("INST"), "INSTRUMENT_TAG").otherwise("LINE_TAG")
    return m.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).withColumn("classification", c)


def refine(state: dict[str, DataFrame], find, recompile, rounds: int = 3) -> tuple[dict[str, DataFrame], int]:
    """Look again for what is missing until nothing is or `rounds` are over; gives the last tables and the rounds run.

    find(missing) -> new elements of these drawings; recompile(elements) -> entity tables with
    reports. Each round's elements are written to the shared folder, and only drawings with
    something missing go on.
    """
    from tagloom.session import stage

    elements, tables, tried = state["elements"], recompile(state["elements"]), None
    for n in range(rounds):
        m = stage(first_missing(missing(tables["reports"], tables["valves"], tables["instruments"], tried)), "missing")
        if m.isEmpty():
            return tables, n
        tried = m.select("drawing_id", "target_tag") if tried is None else stage(tried.unionByName(m.select("drawing_id", "target_tag")), "tried")
        elements = stage(elements.unionByName(find(m), allowMissingColumns=True), "elements")
        tables = recompile(elements)
    return tables, rounds


def found_again(found: DataFrame) -> dict[str, DataFrame]:
    """What looking again brought (drawing_id, target_tag, coordinates, tag, type, value, host) as rows to append: elements, symbols in the box looked at, valves installed on their host."""
    kind = F.when(F.col("type").contains("VALVE"), "VALVE_TAG").when(F.col("type").contains("INST"), "INSTRUMENT_TAG").otherwise("LINE_TAG")
    box = [F.get("coordinates", F.lit(i)).alias(c) for i, c in enumerate(("ymin", "xmin", "ymax", "xmax"))]
    on = found.where(F.col("type").contains("VALVE") & F.col("host").isNotNull())
    return {
        "elements": found.select("drawing_id", "tag", kind.alias("classification"), F.coalesce("value", "type").alias("value")),
        "symbols": found.select("drawing_id", F.col("type").alias("symbol_type"), F.col("tag").alias("inferred_tag"), *box),
        "relations": on.select("drawing_id", F.col("tag").alias("source_tag"), F.col("host").alias("target_tag"), F.lit("INSTALLED_ON").alias("rel_type")),
    }
