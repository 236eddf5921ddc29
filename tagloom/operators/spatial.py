"""Nearest-neighbour and sequence joins between elements of a drawing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.neighbours import nearest, prepared
from tagloom.session import stage


def number_of(tag: Column) -> Column:
    """The first run of three to five digits; null if there is none."""
    return F.nullif(F.regexp_extract(tag, "([0-9]{3,5})", 1), F.lit(""))


def numbered(lines: DataFrame) -> DataFrame:
    """l_drawing, l_number, l_tag: the first line (by ord) whose tag contains the number.

    Every line offers the substrings of three to five digits of its tag, so the containment test
    is an equi-join on (drawing, number).
    """
    runs = F.regexp_extract_all("tag", F.lit("[0-9]{3,}"), F.lit(0))
    parts = F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(F.sequence(F.lit(1), F.length(r) - 2), lambda i: F.transform(F.sequence(F.lit(3), F.least(F.lit(5), F.length(r) - i + 1)), lambda n: F.substring(r, i, n))))))
    offered = lines.select(F.col("drawing_id").alias("l_drawing"), "ord", "tag", F.explode(F.array_distinct(parts)).alias("l_number"))
    return offered.groupBy("l_drawing", "l_number").agg(F.min_by("tag", "ord").alias("l_tag"))


def by_sequence(asked: DataFrame, numbers: DataFrame, out: str) -> DataFrame:
    """Adds `out`: the first line of the drawing whose tag contains the asked tag's number, or null. numbers: the result of `numbered`."""
    first = numbers.withColumnRenamed("l_tag", out)
    return asked.join(first, (F.col("drawing_id") == F.col("l_drawing")) & (number_of(F.col("tag")) == F.col("l_number")), "left").drop("l_drawing", "l_number")


def _unless(df: DataFrame, found: str) -> DataFrame:
    """Rows that have an answer lose their place: nothing more is looked for."""
    return df.withColumn("x", F.when(F.col(found).isNull(), F.col("x")))


def of_class(elements: DataFrame, *classes: str) -> DataFrame:
    return elements.where(F.col("classification").isin(*classes)).select("drawing_id", "tag", "ord", "x", "y")


def _edges(df: DataFrame, target: str, kind: str, part: int) -> DataFrame:
    """Edges with rel_ord, their order: the part, then the source's place."""
    return df.where(F.col(target).isNotNull()).select("drawing_id", F.col("tag").alias("source_tag"), F.col(target).alias("target_tag"), F.lit(kind).alias("rel_type"), F.struct(F.lit(part).alias("part"), F.col("ord").alias("place")).alias("rel_ord"))


def _lines(e: DataFrame) -> DataFrame:
    return of_class(e, "LINE_TAG", "CIRCUIT_TAG")


def valve_lines(e: DataFrame, lines=None, numbers: DataFrame | None = None) -> DataFrame:
    """INSTALLED_ON: the first line with the valve's number, else the nearest line within 0.45.

    Here and below lines, equipment and numbers are candidates `prepared` and `numbered` before, if they are.
    """
    s = by_sequence(of_class(e, "VALVE_TAG"), numbers or numbered(_lines(e)), "s")
    return _edges(nearest(_unless(s, "s"), lines or _lines(e), 0.45, "n").withColumn("t", F.coalesce("s", "n")), "t", "INSTALLED_ON", 0)


def instrument_lines(e: DataFrame, lines=None, equipment=None, numbers: DataFrame | None = None) -> DataFrame:
    """MONITORS: the first line with the number, else the nearest line within 0.45, else the nearest equipment within 0.50."""
    s = by_sequence(of_class(e, "INSTRUMENT_TAG"), numbers or numbered(_lines(e)), "s")
    n = nearest(_unless(s, "s"), lines or _lines(e), 0.45, "n")
    q = nearest(_unless(n, "n"), equipment or of_class(e, "EQUIPMENT_TAG"), 0.50, "q")
    return _edges(q.withColumn("t", F.coalesce("s", "n", "q")), "t", "MONITORS", 1)


def relief_hosts(e: DataFrame, lines=None, equipment=None) -> DataFrame:
    """INSTALLED_ON: the nearest equipment within 0.50, else the nearest line within 0.45."""
    q = nearest(of_class(e, "PSV_TAG"), equipment or of_class(e, "EQUIPMENT_TAG"), 0.50, "q")
    return _edges(nearest(_unless(q, "q"), lines or _lines(e), 0.45, "n").withColumn("t", F.coalesce("q", "n")), "t", "INSTALLED_ON", 2)


def line_ends(e: DataFrame, equipment=None) -> DataFrame:
    """CONNECTS_TO: a line's nearest equipment within 0.45."""
    return _edges(nearest(_lines(e), equipment or of_class(e, "EQUIPMENT_TAG"), 0.45, "t"), "t", "CONNECTS_TO", 3)


def _first(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("drawing_id").orderBy("ord")
    return df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)  # a group limit: each task keeps k rows a drawing before the shuffle


def panel_feeds(e: DataFrame) -> DataFrame:
    """FEEDS: the first 5 panels each feed the first 20 circuits and luminaires: 100 edges a drawing at most."""
    p = _first(of_class(e, "PANEL_TAG"), 5)
    c = _first(of_class(e, "CIRCUIT_TAG", "LUMINAIRE_TAG"), 20).select(F.col("drawing_id").alias("c_drawing"), F.col("tag").alias("c_tag"), F.col("k").alias("c_k"))
    both = p.join(c, (F.col("drawing_id") == F.col("c_drawing")) & (F.col("tag") != F.col("c_tag")))
    place = F.struct(F.col("k").alias("class_no"), F.col("c_k").cast("long").alias("item"), F.lit(0).alias("rank"), F.lit(0).alias("pos"))
    return both.select("drawing_id", F.col("tag").alias("source_tag"), F.col("c_tag").alias("target_tag"), F.lit("FEEDS").alias("rel_type"), F.struct(F.lit(4).alias("part"), place.alias("place")).alias("rel_ord"))


def earthing(e: DataFrame) -> DataFrame:
    """EARTHED_TO the drawing's first earth bar: every pit and conductor, and the first 15 equipment tags."""
    bar = of_class(e, "EARTH_BAR_TAG").groupBy(F.col("drawing_id").alias("b_drawing")).agg(F.min_by("tag", "ord").alias("bar"))
    pits = of_class(e, "EARTH_PIT_TAG", "BOND_CONDUCTOR_TAG")
    eq = _first(of_class(e, "EQUIPMENT_TAG"), 15).drop("k")
    a = pits.join(bar, F.col("drawing_id") == F.col("b_drawing"))
    b = eq.join(bar, F.col("drawing_id") == F.col("b_drawing"))
    return _edges(a, "bar", "EARTHED_TO", 5).unionByName(_edges(b, "bar", "EARTHED_TO", 6))


def relations(e: DataFrame) -> DataFrame:
    """drawing_id, source_tag, target_tag, rel_type, rel_ord: all relations, the first of equals."""
    lines, equipment, numbers = prepared(_lines(e)), prepared(of_class(e, "EQUIPMENT_TAG")), stage(numbered(_lines(e)), "numbers")
    parts = [valve_lines(e, lines, numbers), instrument_lines(e, lines, equipment, numbers), relief_hosts(e, lines, equipment), line_ends(e, equipment), panel_feeds(e), earthing(e)]
    return reduce(DataFrame.unionByName, parts).groupBy("drawing_id", "source_tag", "target_tag", "rel_type").agg(F.min("rel_ord").alias("rel_ord"))


def traces(e: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """drawing_id, tag, ord, y0, x0, y1, x1: a line's nearest segment by midpoint within 0.25, else a level stroke of 0.20 each way."""
    lines = of_class(e, "LINE_TAG", "CIRCUIT_TAG")
    x0, x1 = F.round(F.greatest(F.lit(0.05), F.col("x") - 0.20), 4), F.round(F.least(F.lit(0.95), F.col("x") + 0.20), 4)
    y = F.round("y", 4)
    if segments is None:
        return lines.select("drawing_id", "tag", "ord", y.alias("y0"), x0.alias("x0"), y.alias("y1"), x1.alias("x1"))
    mids = segments.select("drawing_id", F.col("segment_id").cast("string").alias("tag"), F.col("segment_id").alias("ord"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    hit = nearest(lines, mids, 0.25, "segment")
    s = segments.select(F.col("drawing_id").alias("s_drawing"), F.col("segment_id").cast("string").alias("s_id"), *[F.col(c).alias(f"s_{c}") for c in ("y0", "x0", "y1", "x1")])
    j = hit.join(s, (F.col("drawing_id") == F.col("s_drawing")) & (F.col("segment") == F.col("s_id")), "left")
    return j.select("drawing_id", "tag", "ord", F.coalesce("s_y0", y).alias("y0"), F.coalesce("s_x0", x0).alias("x0"), F.coalesce("s_y1", y).alias("y1"), F.coalesce("s_x1", x1).alias("x1"))
