"""Page-level assembly of recognised words into items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.normalize import number_text
from tagloom.operators.grammar import INSTRUMENT_CODES
from tagloom.operators.prefix import salted_prefix


def assemble_lines(words: DataFrame) -> DataFrame:
    """drawing_id, page, text, min/max box and centre: words of one line and height joined without and with blanks.

    Words are grouped by line_idx and y0 to one decimal; groups of one word make no line. Within a
    line words go by x0, then by word_idx. A line's array holds one line's words, whatever the page's size.
    """
    w = F.array_sort(F.collect_list(F.struct("x0", "word_idx", "text")))
    g = words.groupBy("drawing_id", "page", "line_idx", F.round("y0", 1).alias("band")).agg(w.alias("w"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).where(F.size("w") > 1)
    t = F.transform("w", lambda x: x["text"])
    return g.select("drawing_id", "page", "line_idx", F.explode(F.array_distinct(F.array(F.array_join(t, ""), F.array_join(t, " ")))).alias("text"), "x0", "y0", "x1", "y1")


def assemble_bubbles(words: DataFrame) -> DataFrame:
    """drawing_id, page, text, center_x, center_y: an instrument code with the number just below it.

    The number is less than 0.02 aside and more than 0.005, less than 0.04 below. Both sides are
    cut into bands of 0.04 and columns of 0.02, so the join's keys are cells, not pages.
    """
    code, number = F.upper("text").isin(INSTRUMENT_CODES), F.upper("text").rlike("^[0-9]{3,5}[A-Z]?$")
    cell = lambda c, s: F.floor(F.col(c) / s).cast("long")
    a = words.where(code).select("drawing_id", "page", F.upper("text").alias("code"), "center_x", "center_y").withColumn("cx", F.explode(F.array(*[cell("center_x", 0.02) + d for d in (-1, 0, 1)]))).withColumn("cy", F.explode(F.array(cell("center_y", 0.04), cell("center_y", 0.04) + 1)))
    b = words.where(number).select(F.col("drawing_id").alias("b_drawing"), F.col("page").alias("b_page"), F.upper("text").alias("num"), F.col("center_x").alias("bx"), F.col("center_y").alias("by"), cell("center_x", 0.02).alias("b_cx"), cell("center_y", 0.04).alias("b_cy"))
    dy = F.col("by") - F.col("center_y")
    j = a.join(b, (F.col("drawing_id") == F.col("b_drawing")) & (F.col("page") == F.col("b_page")) & (F.col("cx") == F.col("b_cx")) & (F.col("cy") == F.col("b_cy")) & (F.abs(F.col("center_x") - F.col("bx")) < 0.02) & (dy > 0.005) & (dy < 0.04))
    return j.select("drawing_id", "page", F.concat_ws("-", "code", "num").alias("text"), "center_x", "center_y")


def lines_of_text(texts: DataFrame, text: str = "text") -> DataFrame:
    """One item per line that isn't blank: item_idx, text trimmed, confidence 0.9."""
    t = texts.select(*[c for c in texts.columns if c != text], F.posexplode(F.split(text, "\n")).alias("item_idx", "t"))
    return t.withColumn("text", F.trim("t")).where("text <> ''").drop("t").withColumn("confidence", F.lit(0.9))


def described() -> Column:
    """An item as text for a reader: its words, confidence and place."""
    n = lambda c: F.coalesce(number_text(F.col(c)), F.lit("None"))
    return F.concat("text", F.lit(" | conf="), n("confidence"), F.lit(" | pos=("), n("center_x"), F.lit(","), n("center_y"), F.lit(")"))


def reader_texts(items: DataFrame, per: int = 1000) -> DataFrame:
    """drawing_id, part, text: a drawing's items as lines in order, at most `per` in a part, so that no text holds a whole large drawing."""
    n = salted_prefix(items.withColumn("__one", F.lit(1)), ["drawing_id"], ["item_idx"], "__one", "__n", bucket=F.floor(F.col("item_idx") / 4096))
    g = n.groupBy("drawing_id", F.floor(F.col("__n") / per).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("item_idx", described().alias("line")))).alias("v"))
    return g.select("drawing_id", "part", F.array_join(F.transform("v", lambda x: x["line"]), "\n").alias("text"))
