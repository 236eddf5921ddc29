"""Views over the test tables that look like recognised drawings, in Spark and as DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.session import table

#: The text of an item by kind, as SQL that both engines read; p and n are part and line number.
_TEXTS = """CASE kind
 WHEN 0 THEN '26-KA-' || CAST(900 + p % 40 AS {s}) WHEN 1 THEN 'KA-' || CAST(900 + p % 40 AS {s})
 WHEN 2 THEN '26-PIT-' || CAST(9000 + p % 60 AS {s}) WHEN 3 THEN 'PIT-' || CAST(9000 + p % 60 AS {s})
 WHEN 4 THEN '8"-PV-26-' || CAST(9000 + p % 80 AS {s}) || '-FC11S-08' WHEN 5 THEN '262"-VA-26-' || CAST(9000 + p % 80 AS {s}) || '-AS20S-00'
 WHEN 6 THEN '26CB' || CAST(9000 + p % 90 AS {s}) WHEN 7 THEN '26-PSV-' || CAST(9000 + p % 30 AS {s}) || CASE WHEN n % 2 = 0 THEN 'A' ELSE 'B' END
 WHEN 8 THEN 'SP= ' || CAST(100 + p % 200 AS {s}) || '.5 barg' WHEN 9 THEN 'SD HH: PI-' || CAST(100 + p % 100 AS {s})
 WHEN 10 THEN 'DUTY kW ' || CAST(1000 + p % 900 AS {s}) WHEN 11 THEN 'TO HP DRAIN ' || CAST(p % 9 AS {s})
 WHEN 12 THEN 'DB-' || CAST(10 + p % 9 AS {s}) WHEN 13 THEN 'TL-' || CAST(100 + p % 50 AS {s})
 WHEN 14 THEN CASE WHEN n % 2 = 0 THEN 'EB-' ELSE 'EP-' END || CAST(10 + p % 20 AS {s})
 WHEN 15 THEN '  HIGH   POINT   NOTE ' || CAST(p % 50 AS {s}) || '  '
 WHEN 16 THEN CASE WHEN n % 3 = 0 THEN 'COPPER TAPE' WHEN n % 3 = 1 THEN 'GI STRIP' ELSE 'BC-' || CAST(10 + p % 9 AS {s}) END WHEN 17 THEN 'CK-' || CAST(100 + p % 60 AS {s})
 WHEN 18 THEN CAST(10 + p % 90 AS {s}) || 'barg' WHEN 19 THEN '6"-PV-26-' || CAST(9100 + p % 40 AS {s}) || '-FC11S-08NOTE' || CAST(p % 9 AS {s})
 WHEN 20 THEN 'MASS FLOW kg/h ' || CAST(60000 + p % 900 AS {s}) WHEN 21 THEN 'DESIGN PRESSURE: FV / ' || CAST(200 + p % 90 AS {s}) || ' barg' WHEN 22 THEN 'OPERATING PRESSURE ' || CAST(40 + p % 90 AS {s}) || ' psig'
 WHEN 23 THEN 'DESIGN TEMPERATURE -29 / ' || CAST(150 + p % 90 AS {s}) || ' C' WHEN 24 THEN 'MATERIAL: SS' || CAST(304 + p % 20 AS {s})
 WHEN 25 THEN CASE WHEN n % 3 = 0 THEN 'VENDOR: MAN ENERGY SOLUTIONS' WHEN n % 3 = 1 THEN '* VENDOR SCOPE OF SUPPLY' ELSE 'MFR = Sulzer' END WHEN 26 THEN 'QTY ' || CAST(1 + p % 3 AS {s}) || 'x100%'
 WHEN 27 THEN 'SERVICE: GAS ' || CAST(p % 7 AS {s}) WHEN 28 THEN CASE WHEN n % 2 = 0 THEN 'TYPE: CENTRIFUGAL' ELSE 'TYPE: (SEE LIST)' END WHEN 29 THEN CAST(2 + p % 3 AS {s}) || '"x' || CAST(3 + p % 3 AS {s}) || '" 300#' || CASE WHEN n % 2 = 0 THEN ' 150#' ELSE '' END
 WHEN 30 THEN 'LIT-' || CAST(70000 + p % 40 AS {s}) WHEN 31 THEN 'XV-' || CAST(70100 + p % 30 AS {s})
 WHEN 32 THEN 'Drawing no: AB-' || CAST(12000 + p % 700 AS {s}) || '-C' ELSE 'rev ' || CAST(n AS {s}) END"""
#: The same texts as parts: by kind what comes before a number, its least value, how many values it takes (0: no number), what comes after.
#: More than one row is a choice by line number: two by n % 2 (0, other), three by n % 3 (0, 1, other). 19 and 29 have two numbers and stand as the CASE says.
_PARTS = {
    0: [("26-KA-", 900, 40, "")], 1: [("KA-", 900, 40, "")], 2: [("26-PIT-", 9000, 60, "")], 3: [("PIT-", 9000, 60, "")], 4: [('8"-PV-26-', 9000, 80, "-FC11S-08")], 5: [('262"-VA-26-', 9000, 80, "-AS20S-00")], 6: [("26CB", 9000, 90, "")], 7: [("26-PSV-", 9000, 30, "A"), ("26-PSV-", 9000, 30, "B")],
    8: [("SP= ", 100, 200, ".5 barg")], 9: [("SD HH: PI-", 100, 100, "")], 10: [("DUTY kW ", 1000, 900, "")], 11: [("TO HP DRAIN ", 0, 9, "")], 12: [("DB-", 10, 9, "")], 13: [("TL-", 100, 50, "")], 14: [("EB-", 10, 20, ""), ("EP-", 10, 20, "")], 15: [("  HIGH   POINT   NOTE ", 0, 50, "  ")],
    16: [("COPPER TAPE", 0, 0, ""), ("GI STRIP", 0, 0, ""), ("BC-", 10, 9, "")], 17: [("CK-", 100, 60, "")], 18: [("", 10, 90, "barg")], 20: [("MASS FLOW kg/h ", 60000, 900, "")], 21: [("DESIGN PRESSURE: FV / ", 200, 90, " barg")], 22: [("OPERATING PRESSURE ", 40, 90, " psig")],
    23: [("DESIGN TEMPERATURE -29 / ", 150, 90, " C")], 24: [("MATERIAL: SS", 304, 20, "")], 25: [("VENDOR: MAN ENERGY SOLUTIONS", 0, 0, ""), ("* VENDOR SCOPE OF SUPPLY", 0, 0, ""), ("MFR = Sulzer", 0, 0, "")], 26: [("QTY ", 1, 3, "x100%")], 27: [("SERVICE: GAS ", 0, 7, "")], 28: [("TYPE: CENTRIFUGAL", 0, 0, ""), ("TYPE: (SEE LIST)", 0, 0, "")],
    30: [("LIT-", 70000, 40, "")], 31: [("XV-", 70100, 30, "")], 32: [("Drawing no: AB-", 12000, 700, "-C")],
}
#: Kinds of items; those of 30 and 31 lie far aside, so that nothing is near them.
_KINDS = 34
#: The detector's name for a box by kind.
_SYMBOLS = "CASE kind % 8 WHEN 0 THEN 'PSV' WHEN 1 THEN ' gate_valve' WHEN 2 THEN 'BIG PUMP HOUSE' WHEN 3 THEN 'VALVE' WHEN 4 THEN 'INST_BUBBLE' WHEN 5 THEN 'motor' WHEN 6 THEN 'FLANGE 300' ELSE 'class_' || CAST(kind AS {s}) END"


def item_text() -> Column:
    """The text of an item as _TEXTS has it, from kind, p and n. Looked up by kind: a CASE of so many branches is one method too long to be compiled."""
    by = {1: (0,) * 6, 2: (0, 0, 0, 1, 1, 1), 3: (0, 1, 2) * 2}
    rows = [v[by[len(v)][i]] for k in range(_KINDS) for v in [_PARTS.get(k, [("rev ", 0, 0, "")])] for i in range(6)]
    before, least, values, after = (F.lit(list(c)) for c in zip(*rows))
    other = F.coalesce(~F.col("kind").between(0, _KINDS - 2), F.lit(True))
    at = F.when(other, _KINDS - 1).otherwise(F.col("kind")) * 6 + F.when(F.col("n") % 2 == 0, 0).otherwise(3) + F.when(F.col("n") % 3 == 0, 0).when(F.col("n") % 3 == 1, 1).otherwise(2)
    number = F.when(other, F.col("n")).when(F.get(values, at) > 0, F.get(least, at) + F.col("p") % F.get(values, at)).cast("string")
    whole = F.concat(F.get(before, at), F.when(other | (F.get(values, at) > 0), number).otherwise(""), F.get(after, at))
    two = {k: F.expr(re.search(rf"WHEN {k} THEN (.*?)(?: WHEN 20|\n)", _TEXTS)[1].format(s="string")) for k in (19, 29)}
    return F.when(F.col("kind") == 19, two[19]).when(F.col("kind") == 29, two[29]).otherwise(whole)


def ocr_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drawing_id, item_idx, kind, text, confidence, center_x, center_y: one item per line of the order table."""
    l = table(spark, sf_dir, "lineitem")
    idx = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1
    base = l.select(
        F.col("l_suppkey").alias("drawing_id"),
        idx.cast("long").alias("item_idx"),
        F.col("l_partkey").alias("p"),
        F.col("l_linenumber").cast("long").alias("n"),
        ((F.col("l_partkey") + F.col("l_linenumber")) % _KINDS).cast("int").alias("kind"),
        (F.lit(1.0) - F.col("l_tax") * 12).alias("confidence"),
        (((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 10007).cast("double") / 10007).alias("center_x"),
        (((F.col("l_partkey") * 1299709 + F.col("l_linenumber") * F.lit(15485863).cast("long") + F.col("l_orderkey") * 31) % 10009).cast("double") / 10009).alias("center_y"),
    )
    aside = F.when(F.col("kind").isin(30, 31), 3.0).otherwise(0.0)
    return base.select("drawing_id", "item_idx", "kind", item_text().alias("text"), "confidence", (F.col("center_x") + aside).alias("center_x"), (F.col("center_y") + aside).alias("center_y"), "p", "n")


OCR_ITEMS = f"""ocr_items AS (SELECT drawing_id, item_idx, kind, {_TEXTS.format(s="VARCHAR")} AS text, confidence, center_x + CASE WHEN kind IN (30, 31) THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END center_x, center_y + CASE WHEN kind IN (30, 31) THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END center_y, p, n FROM (
 SELECT l_suppkey drawing_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS item_idx, l_partkey p, l_linenumber::BIGINT n,
  ((l_partkey + l_linenumber) % {_KINDS})::INTEGER kind, 1.0::DOUBLE - l_tax * 12 confidence,
  ((l_orderkey * 7919 + l_linenumber::BIGINT * 104729) % 10007)::DOUBLE / 10007 center_x,
  ((l_partkey * 1299709 + l_linenumber::BIGINT * 15485863 + l_orderkey * 31) % 10009)::DOUBLE / 10009 center_y FROM lineitem))"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drawing_id, page, line_idx, text, x0, y0, x1, y1, center_x, center_y: instrument items told as a code word above a number word."""
    o = ocr_items(spark, sf_dir).where("kind IN (2, 3)")
    code = F.regexp_extract("text", "([A-Z]+)", 1)
    number = F.regexp_extract("text", r"([0-9]{4})$", 1)
    gap = (F.col("item_idx") % 7).cast("double") / 100

    def one(text: Column, y: Column, line: Column) -> Column:
        return F.struct(text.alias("text"), F.col("center_x").alias("x0"), y.alias("y0"), (F.col("center_x") + 0.01).alias("x1"), (y + 0.004).alias("y1"), line.cast("long").alias("line_idx"))

    pair = F.array(one(code, F.col("center_y"), F.col("item_idx") * 2), one(number, F.col("center_y") + gap, F.col("item_idx") * 2 + F.when(gap == 0, 0).otherwise(1)))
    w = o.select("drawing_id", "item_idx", F.posexplode(pair).alias("k", "w"))
    return w.select("drawing_id", F.lit(1).alias("page"), (F.col("item_idx") * 2 + F.col("k")).alias("word_idx"), "w.*", ((F.col("w.x0") + F.col("w.x1")) / 2).alias("center_x"), ((F.col("w.y0") + F.col("w.y1")) / 2).alias("center_y"))


WORDS = """pairs AS (SELECT drawing_id, item_idx, regexp_extract(text, '([A-Z]+)', 1) code, regexp_extract(text, '([0-9]{4})$', 1) num, center_x x0, center_y y0, (item_idx % 7)::DOUBLE / 100 gap FROM ocr_items WHERE kind IN (2, 3)),
words AS (SELECT *, x0 + 0.01 x1, y0 + 0.004 y1, (x0 + (x0 + 0.01)) / 2 center_x, (y0 + (y0 + 0.004)) / 2 center_y FROM (
 SELECT drawing_id, item_idx * 2 word_idx, code AS text, x0, y0, item_idx * 2 line_idx FROM pairs
 UNION ALL SELECT drawing_id, item_idx * 2 + 1, num, x0, y0 + gap, item_idx * 2 + CASE WHEN gap = 0 THEN 0 ELSE 1 END FROM pairs))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drawing_id, box_idx, symbol_type, confidence, ymin, xmin, ymax, xmax from the order lines."""
    o = ocr_items(spark, sf_dir)
    l = table(spark, sf_dir, "lineitem")
    idx = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1
    q = l.select(F.col("l_suppkey").alias("q_drawing"), idx.cast("long").alias("q_idx"), (F.col("l_quantity") / 1000).alias("side"))
    return o.join(q, (F.col("drawing_id") == F.col("q_drawing")) & (F.col("item_idx") == F.col("q_idx"))).select(
        "drawing_id", F.col("item_idx").alias("box_idx"), F.expr(_SYMBOLS.format(s="string")).alias("symbol_type"), "text", "confidence", F.col("center_y").alias("ymin"), F.col("center_x").alias("xmin"), (F.col("center_y") + F.col("side")).alias("ymax"), (F.col("center_x") + F.col("side")).alias("xmax")
    )


BOXES = f"""sides AS (SELECT l_suppkey drawing_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS item_idx, l_quantity / 1000 side FROM lineitem),
boxes AS (SELECT drawing_id, item_idx box_idx, {_SYMBOLS.format(s="VARCHAR")} symbol_type, text, confidence, center_y ymin, center_x xmin, center_y + side ymax, center_x + side xmax FROM ocr_items JOIN sides USING (drawing_id, item_idx))"""


def item_entities(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The item tables as entity tables, for the rules: every row that has a tag; a line relates itself and its two ends."""
    t = {k: table(spark, sf_dir, f"{n}_items").where("tag is not null").withColumn("ord", F.col("item_id")) for k, n in (("equipment", "equipment"), ("lines", "line"), ("instruments", "instrument"), ("valves", "valve"))}
    l = table(spark, sf_dir, "line_items")
    ends = l.select("drawing_id", F.explode(F.array("tag", "from_node", "to_node")).alias("source")).where("source is not null").distinct()
    return t | {"relationships": ends.withColumn("target", F.col("source"))}
