"""Kind of drawing from its texts: keywords in order, else the best score over a vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.normalize import WHITE
from tagloom.operators.prefix import salted_prefix
from tagloom.operators.texts import told

# Kinds in order, with label and discipline.
KINDS = [
    ("PID", "Piping & Instrumentation Diagram (P&ID)", "Process"), ("PFD", "Process Flow Diagram (PFD)", "Process"), ("ELECTRICAL_LAYOUT", "Electrical Layout Drawing", "Electrical"),
    ("EARTHING_LAYOUT", "Earthing / Grounding Layout", "Electrical"), ("SLD", "Single Line Diagram (SLD)", "Electrical"), ("HVAC_LAYOUT", "HVAC / Ventilation Layout", "Mechanical"),
    ("STRUCTURAL_LAYOUT", "Structural / Civil Layout", "Civil/Structural"), ("ISOMETRIC", "Pipe Isometric Drawing", "Process/Piping"), ("CABLE_SCHEDULE", "Cable Schedule / Routing", "Electrical"), ("GENERIC", "Engineering Drawing (Generic)", "Multi-discipline"),
]
# Title keywords in order.
KEYWORDS = [
    (r"\bP\s*&\s*I\s*D\b|\bPIPING\s+(AND\s+)?INSTRUMENTATION\b", "PID"),
    (r"\bPROCESS\s+FLOW\s+(DIAGRAM|CHART)\b|\bPFD\b", "PFD"),
    (r"\bEARTHING\b|\bGROUNDING\b|\bEARTH\s+LAYOUT\b|\bEARTH\s+GRID\b|\bBONDING\b", "EARTHING_LAYOUT"),
    (r"\bSINGLE\s+LINE\s+(DIAGRAM|SCHEMATIC)\b|\bSLD\b|\bONE\s+LINE\b", "SLD"),
    (r"\bLIGHTING\b|\bELECTRICAL\s+LAYOUT\b|\bPOWER\s+LAYOUT\b|\bLUMINAIRE\b|\bLIGHTING\s+LAYOUT\b", "ELECTRICAL_LAYOUT"),
    (r"\bCABLE\s+(SCHEDULE|TRAY|ROUTING|LAYOUT)\b", "CABLE_SCHEDULE"),
    (r"\bHVAC\b|\bVENTILATION\s+LAYOUT\b|\bAIR\s+HANDLING\b|\bDUCT\s+LAYOUT\b", "HVAC_LAYOUT"),
    (r"\bSTRUCTURAL\s+LAYOUT\b|\bFRAMING\s+PLAN\b|\bFOUNDATION\s+PLAN\b|\bCIVIL\s+LAYOUT\b", "STRUCTURAL_LAYOUT"),
    (r"\bISOMETRIC\b|\bISO\s+DRAWING\b|\bPIPE\s+ISO\b", "ISOMETRIC"),
]
# The small words that an item must hold, one at least, if a title keyword begins in it; P & I D may be cut behind its P.
BEGINNINGS = "piping process pfd earth grounding bonding single sld one lighting electrical power luminaire cable hvac ventilation air duct structural framing foundation civil iso pipe".split()
PID_BEGINS = r"(?i)\bP\s*(?:&|$)"
# Vocabulary as (kind, token, weight).
VOCABULARY = [
    ("PID", "pit", 4), ("PID", "tit", 4), ("PID", "fit", 4), ("PID", "lit", 4), ("PID", "ait", 4), ("PID", "pdit", 4), ("PID", "psv", 4), ("PID", "prv", 3), ("PID", "pdt", 3), ("PID", "pt", 2), ("PID", "ti", 2), ("PID", "fi", 2), ("PID", "li", 2), ("PID", "pict", 3), ("PID", "frc", 3), ("PID", "vsd", 3), ("PID", "fc11s", 5), ("PID", "ac21s", 5), ("PID", "gc11s", 5), ("PID", "compressor", 3), ("PID", "separator", 3), ("PID", "cooler", 3), ("PID", "vessel", 3), ("PID", "scrubber", 3), ("PID", "exchanger", 3), ("PID", "glycol", 2), ("PID", "flare", 3), ("PID", "header", 2), ("PID", "nozzle", 2), ("PID", "drain", 2), ("PID", "coalescer", 3), ("PID", "skid", 2),
    ("PFD", "stream", 5), ("PFD", "mass balance", 5), ("PFD", "flow rate", 4), ("PFD", "temperature", 3), ("PFD", "pressure", 3), ("PFD", "mole", 4), ("PFD", "composition", 4), ("PFD", "pfd", 6), ("PFD", "heat duty", 4), ("PFD", "enthalpy", 4),
    ("ELECTRICAL_LAYOUT", "luminaire", 6), ("ELECTRICAL_LAYOUT", "lighting", 5), ("ELECTRICAL_LAYOUT", "light", 3), ("ELECTRICAL_LAYOUT", "fluorescent", 5), ("ELECTRICAL_LAYOUT", "led", 3), ("ELECTRICAL_LAYOUT", "fitting", 3), ("ELECTRICAL_LAYOUT", "fixture", 3), ("ELECTRICAL_LAYOUT", "db", 3), ("ELECTRICAL_LAYOUT", "mdb", 5), ("ELECTRICAL_LAYOUT", "ldb", 5), ("ELECTRICAL_LAYOUT", "distribution board", 6), ("ELECTRICAL_LAYOUT", "panel", 3), ("ELECTRICAL_LAYOUT", "mcb", 5), ("ELECTRICAL_LAYOUT", "rccb", 5), ("ELECTRICAL_LAYOUT", "acb", 5), ("ELECTRICAL_LAYOUT", "socket", 4), ("ELECTRICAL_LAYOUT", "outlet", 3), ("ELECTRICAL_LAYOUT", "switch", 3), ("ELECTRICAL_LAYOUT", "conduit", 4), ("ELECTRICAL_LAYOUT", "cable tray", 5), ("ELECTRICAL_LAYOUT", "wiring", 4), ("ELECTRICAL_LAYOUT", "circuit", 3), ("ELECTRICAL_LAYOUT", "kw", 2), ("ELECTRICAL_LAYOUT", "kvah", 3), ("ELECTRICAL_LAYOUT", "amps", 3), ("ELECTRICAL_LAYOUT", "voltage", 3), ("ELECTRICAL_LAYOUT", "electrical layout", 8), ("ELECTRICAL_LAYOUT", "power layout", 7), ("ELECTRICAL_LAYOUT", "el.", 3), ("ELECTRICAL_LAYOUT", "tl.", 3),
    ("EARTHING_LAYOUT", "earthing", 8), ("EARTHING_LAYOUT", "grounding", 8), ("EARTHING_LAYOUT", "earth", 5), ("EARTHING_LAYOUT", "earth bar", 8), ("EARTHING_LAYOUT", "earth pit", 8), ("EARTHING_LAYOUT", "earth rod", 7), ("EARTHING_LAYOUT", "bonding", 6), ("EARTHING_LAYOUT", "conductor", 4), ("EARTHING_LAYOUT", "equipotential", 7), ("EARTHING_LAYOUT", "copper tape", 6), ("EARTHING_LAYOUT", "copper conductor", 6), ("EARTHING_LAYOUT", "earth electrode", 7), ("EARTHING_LAYOUT", "test link", 5), ("EARTHING_LAYOUT", "eb", 4), ("EARTHING_LAYOUT", "ep", 4), ("EARTHING_LAYOUT", "bc", 3),
    ("SLD", "busbar", 7), ("SLD", "bus bar", 7), ("SLD", "transformer", 5), ("SLD", "incomer", 6), ("SLD", "feeder", 5), ("SLD", "breaker", 4), ("SLD", "mccb", 6), ("SLD", "vcb", 5), ("SLD", "acb", 4), ("SLD", "relay", 4), ("SLD", "ct", 3), ("SLD", "pt", 3), ("SLD", "mvdb", 7), ("SLD", "lvdb", 7), ("SLD", "single line", 8), ("SLD", "sld", 8), ("SLD", "switchgear", 6), ("SLD", "kv", 4), ("SLD", "mva", 5), ("SLD", "fault level", 5),
    ("HVAC_LAYOUT", "ahu", 7), ("HVAC_LAYOUT", "air handling unit", 8), ("HVAC_LAYOUT", "vav", 6), ("HVAC_LAYOUT", "fcu", 6), ("HVAC_LAYOUT", "diffuser", 6), ("HVAC_LAYOUT", "grille", 5), ("HVAC_LAYOUT", "duct", 5), ("HVAC_LAYOUT", "ductwork", 6), ("HVAC_LAYOUT", "chiller", 5), ("HVAC_LAYOUT", "cooling tower", 5), ("HVAC_LAYOUT", "supply air", 5), ("HVAC_LAYOUT", "return air", 5), ("HVAC_LAYOUT", "exhaust", 4), ("HVAC_LAYOUT", "hvac", 8), ("HVAC_LAYOUT", "ventilation", 5), ("HVAC_LAYOUT", "cfm", 4), ("HVAC_LAYOUT", "l/s", 3),
    ("STRUCTURAL_LAYOUT", "column", 4), ("STRUCTURAL_LAYOUT", "beam", 4), ("STRUCTURAL_LAYOUT", "slab", 5), ("STRUCTURAL_LAYOUT", "footing", 5), ("STRUCTURAL_LAYOUT", "foundation", 5), ("STRUCTURAL_LAYOUT", "rebar", 5), ("STRUCTURAL_LAYOUT", "reinforcement", 5), ("STRUCTURAL_LAYOUT", "grid", 3), ("STRUCTURAL_LAYOUT", "level", 2), ("STRUCTURAL_LAYOUT", "elevation", 3), ("STRUCTURAL_LAYOUT", "structural", 6), ("STRUCTURAL_LAYOUT", "framing", 6), ("STRUCTURAL_LAYOUT", "civil", 4), ("STRUCTURAL_LAYOUT", "concrete", 4), ("STRUCTURAL_LAYOUT", "steel", 3),
    ("ISOMETRIC", "isometric", 8), ("ISOMETRIC", "iso", 5), ("ISOMETRIC", "spool", 7), ("ISOMETRIC", "elbow", 5), ("ISOMETRIC", "flange", 4), ("ISOMETRIC", "tee", 4), ("ISOMETRIC", "reducer", 4), ("ISOMETRIC", "pipe support", 6), ("ISOMETRIC", "weld", 4), ("ISOMETRIC", "bw", 3), ("ISOMETRIC", "north", 3), ("ISOMETRIC", "east", 3), ("ISOMETRIC", "up", 2),
    ("CABLE_SCHEDULE", "cable", 5), ("CABLE_SCHEDULE", "cable no", 7), ("CABLE_SCHEDULE", "cable schedule", 9), ("CABLE_SCHEDULE", "route", 4), ("CABLE_SCHEDULE", "from panel", 5), ("CABLE_SCHEDULE", "to panel", 5), ("CABLE_SCHEDULE", "core", 4), ("CABLE_SCHEDULE", "mm2", 5), ("CABLE_SCHEDULE", "armoured", 5), ("CABLE_SCHEDULE", "xlpe", 5), ("CABLE_SCHEDULE", "pvc", 3), ("CABLE_SCHEDULE", "length", 3), ("CABLE_SCHEDULE", "tray", 4), ("CABLE_SCHEDULE", "conduit", 4), ("CABLE_SCHEDULE", "drum", 4),
]
#: The score that a kind must reach.
LEAST = 5


def vocabulary() -> list[tuple[str, int, str, int]]:
    """(kind, place of the kind, token, weight)."""
    place = {k: i for i, (k, _, _) in enumerate(KINDS)}
    return [(k, place[k], t, w) for k, t, w in VOCABULARY]


def signals(texts: DataFrame, doc: str, text: str, words: bool = True, phrases: bool = True) -> DataFrame:
    """doc, keyword (place of the first keyword pattern hit, null if none), tokens hit (single words, phrases or both): per row, before any shuffle."""
    c = F.col(text)
    hits = _hits(text, words, phrases)
    if not phrases:
        return texts.select(doc, F.lit(None).cast("int").alias("keyword"), hits.alias("hits"))
    first = F.coalesce(*[F.when(c.rlike("(?i)" + p), F.lit(i)) for i, (p, _) in enumerate(KEYWORDS)])
    return texts.select(doc, first.alias("keyword"), hits.alias("hits"))


def _hits(text: str, words: bool, phrases: bool) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.contains(t), F.lit(i)) for i, (_, _, t, _) in enumerate(vocabulary()) if (phrases if " " in t else words)]))


def begins(text: str = "text") -> Column:
    """Whether a title keyword or a phrase may begin in the text: it holds the first word of one."""
    low = F.lower(text)
    firsts = dict.fromkeys([*BEGINNINGS, *[t.split(" ")[0] for _, _, t, _ in vocabulary() if " " in t]])
    return reduce(lambda a, b: a | b, [low.contains(w) for w in firsts]) | F.col(text).rlike(PID_BEGINS)


def confident(items: DataFrame) -> DataFrame:
    """The items that a drawing's kind is told from."""
    return items.where((F.col("confidence") >= 0.25) & (F.col("text") != ""))


def chained(items: DataFrame, span: int = 4, block: int = 4096, only: Column | None = None) -> DataFrame:
    """drawing_id, text: each confident item with the span - 1 items after it, joined by blanks.

    No keyword or token spans more items than that, so these rows hold every hit that the drawing's
    whole text would. Items of white space don't count as items; where they stood, two blanks join
    their neighbours, as more than one blank would in the whole text. Items get their rank by a
    bucketed running count, which counts the white ones beside; windows run over blocks of ranks,
    which overlap by the span, so a large drawing is many windows. `only` keeps the rows whose
    first item fulfils it: with `begins` they still hold every hit, each where it begins.
    """
    said = F.col("text").rlike(f"(?!{WHITE})[\\s\\S]")
    t = confident(items).select("drawing_id", "item_idx", "text", said.alias("said"))
    t = t.withColumn("one", F.when(F.col("said"), F.lit(2**32)).otherwise(F.lit(1)).cast("long"))
    r = salted_prefix(t, ["drawing_id"], ["item_idx"], "one", "place", bucket=F.floor(F.col("item_idx") / block)).where("said")
    r = r.withColumns({"rank": F.shiftright("place", 32), "white": F.col("place").bitwiseAND(F.lit(2**32 - 1))})
    r = r.withColumn("kept", F.lit(True) if only is None else only)
    b = F.floor(F.col("rank") / block)
    r = r.withColumn("block", F.explode(F.when((F.col("rank") % block < span - 1) & (b > 0), F.array(b, b - 1)).otherwise(F.array(b))))
    w = Window.partitionBy("drawing_id", "block").orderBy("rank")
    parts = [F.col("text")]
    for i in range(1, span):
        before = F.lead("white", i - 1).over(w) if i > 1 else F.col("white")
        parts.append(F.concat(F.when(F.lead("white", i).over(w) > before, "  ").otherwise(" "), F.lead("text", i).over(w)))
    return r.withColumn("text", F.concat_ws("", *parts)).where((b == F.col("block")) & F.col("kept")).select("drawing_id", "text")


def kinds(texts: DataFrame, doc: str = "drawing_id", text: str = "text", title: str | None = None, filename: str | None = None, singles: DataFrame | None = None) -> DataFrame:
    """doc, drawing_type, label, discipline, score.

    Keyword patterns are tried on title and file name first, then on the texts, to which title and
    file name (with blanks for _ and -) belong; the first in the list wins.
    Else each kind scores the weights of its tokens that occur in any text; the best wins from 5
    on, the earlier kind of equals, else GENERIC. Each text is looked at alone (`chained` makes
    rows that hold what spans items; `singles` are the items alone, in each of which single words
    are looked for once instead) and only the hits, at most a few hundred distinct numbers per
    doc, are combined. Null texts say nothing.
    """
    s = signals(texts, doc, text, words=singles is None)
    if singles is not None:
        said = told(singles, text, hits=_hits(text, words=True, phrases=False))
        s = s.unionByName(singles.select(doc, text).join(said, text, "left").select(doc, F.lit(None).cast("int").alias("keyword"), "hits"))
    if title or filename:
        head = F.concat_ws(" ", *[c for c in (title, filename) if c])
        t = texts.select(F.col(doc), F.coalesce(*[F.when(head.rlike("(?i)" + p), F.lit(i - 100)) for i, (p, _) in enumerate(KEYWORDS)]).alias("keyword"), F.array().cast("array<int>").alias("hits"))
        names = ([F.col(title)] if title else []) + ([F.regexp_replace(filename, "[_-]", " ")] if filename else [])
        s = s.unionByName(t).unionByName(signals(texts.select(doc, F.concat_ws(" ", *names).alias("__name")), doc, "__name"))
    v = vocabulary()
    heard = s.select(doc, "keyword", F.explode_outer("hits").alias("hit")).distinct().groupBy(doc).agg(F.min("keyword").alias("keyword"), F.collect_set("hit").alias("hits"))
    scores = F.array(*[F.struct(reduce(lambda a, b: a + b, [F.when(F.array_contains("hits", j), w).otherwise(0) for j, (k2, _, _, w) in enumerate(v) if k2 == k]).alias("score"), F.lit(-i).alias("place"), F.lit(k).alias("kind")) for i, (k, _, _) in enumerate(KINDS[:-1])])
    best = F.array_max(scores)
    key = F.pmod(F.col("keyword") + 100, F.lit(100))
    by_key = reduce(lambda c, x: c.when(key == x[0], x[1][1]), enumerate(KEYWORDS), F)
    d = heard.withColumn("best", best).select(doc, F.when(F.col("keyword").isNotNull(), by_key).when(F.col("best.score") >= LEAST, F.col("best.kind")).otherwise("GENERIC").alias("drawing_type"), F.col("best.score").alias("score"))
    label = reduce(lambda c, x: c.when(F.col("drawing_type") == x[0], x[1]), KINDS, F)
    area = reduce(lambda c, x: c.when(F.col("drawing_type") == x[0], x[2]), KINDS, F)
    return d.select(doc, "drawing_type", label.alias("label"), area.alias("discipline"), "score")


def title_block(items: DataFrame) -> DataFrame:
    """drawing_id, drawing_number, revision: the last items that give one; UNKNOWN and 0 where none does."""
    t = F.trim("text")
    numbered = t.rlike(r"(?i)\b(DWG|DRAWING|DOC)\s*(NO|NUM|\.|#)?:?\s*([A-Z0-9\-_]{6,30})\b")
    token = F.regexp_extract(t, r"\b([A-Z0-9\-_]{6,30})\b", 1)  # the first of capitals, whatever the label's case
    number = F.when(numbered & (F.length(token) > 6), token)
    rev = F.when(~numbered & F.upper(t).contains("REV"), F.nullif(F.regexp_extract(t, r"(?i)\b(REV\s*[-.:]?\s*[A-Z0-9]{1,3})\b", 1), F.lit("")))
    at = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("item_idx")))
    return items.groupBy("drawing_id").agg(F.coalesce(at(number), F.lit("UNKNOWN")).alias("drawing_number"), F.coalesce(at(rev), F.lit("0")).alias("revision"))


def metadata(items: DataFrame, names: DataFrame, least: int = 10, crop: tuple[float, float, float, float] = (0.65, 0.55, 1.0, 1.0)) -> DataFrame:
    """drawing_id, drawing_number, revision, found_in: the title block from all texts if a drawing has more than `least`, else from those in the crop (ymin, xmin, ymax, xmax), else from the file name.

    names: drawing_id, filename; every drawing there has a row.
    """
    n = items.groupBy(F.col("drawing_id").alias("n_drawing")).agg(F.count(F.lit(1)).alias("n"))
    sized = items.join(n, F.col("drawing_id") == F.col("n_drawing"))
    inside = F.col("center_y").between(crop[0], crop[2]) & F.col("center_x").between(crop[1], crop[3])
    whole = title_block(sized.where(F.col("n") > least)).withColumn("found_in", F.lit("texts"))
    part = title_block(sized.where((F.col("n") <= least) & inside)).withColumn("found_in", F.lit("crop"))
    told = whole.unionByName(part).withColumnRenamed("drawing_id", "t_drawing")
    j = names.select("drawing_id", "filename").join(told, F.col("drawing_id") == F.col("t_drawing"), "left")
    named = F.nullif(F.regexp_extract(F.regexp_replace("filename", r"\.[A-Za-z0-9]{1,5}$", ""), r"([A-Z0-9][A-Z0-9_-]{5,29})", 1), F.lit(""))
    return j.select("drawing_id", F.coalesce("drawing_number", named, F.lit("UNKNOWN")).alias("drawing_number"), F.coalesce("revision", F.lit("0")).alias("revision"), F.coalesce("found_in", F.lit("filename")).alias("found_in"))
