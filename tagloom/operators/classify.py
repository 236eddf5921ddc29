"""Recognised texts to classified tags: scan by pattern, first mention wins, the rest stays as notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import normalize as N
from tagloom.operators import grammar as G
from tagloom.operators.neighbours import nearest
from tagloom.operators.texts import told
from tagloom.session import stage

#: The least confidence an item must have.
LEAST = 0.10


def normalized(items: DataFrame) -> DataFrame:
    """The items that are scanned, with t: their cleaned and repaired text.

    Items with a null or blank text or a confidence below 0.10 (or none) are left out, as are
    those of which fewer than two characters stay.
    """
    some = items.where(F.col("confidence") >= LEAST)
    return some.drop("t").join(told(some, t=_cleaned()).where(F.length("t") >= 2), "text").select(*[c for c in items.columns if c != "t"], "t")


def _cleaned() -> Column:
    """The cleaned and repaired text; null for a blank one."""
    return F.when(F.col("text").rlike(f"(?!{N.WHITE})."), N.repair(N.clean_text(F.col("text"))))


def size_check(tag: Column) -> Column:
    """What is wrong with a line tag's size: null, a flag to keep with the tag, or size_out_of_range(...)."""
    p0 = F.split_part(tag, F.lit("-"), F.lit(1))
    inch = p0.rlike("[\"']")
    clean = F.lower(F.regexp_replace(p0, "[\"' ]", ""))
    digits = clean.rlike("^[0-9]+$")
    n = F.coalesce(clean.try_cast("bigint"), F.lit(2**60))
    bad = F.concat(F.lit("size_out_of_range("), p0, F.lit(")"))
    return (
        F.when(~p0.rlike("^[0-9/]"), None)
        .when(p0.rlike('^[0-9]{4,}"?$') | (inch & digits & (n > 60)), bad)
        .when(clean.isin(G.INCH_SIZES) | F.when(digits, F.concat(clean, F.lit("mm"))).otherwise(clean).isin(G.MM_SIZES), None)
        .when(clean.rlike("^[0-9]+/[0-9]+$"), "unrecognized_fraction_size")
        .when(digits & n.between(1, 600), "unverified_size_token")
        .when(digits, bad)
    )


def tags(items: DataFrame) -> DataFrame:
    """text, t, rank, pos, tag, size, classification, flag_reason, again: every match of every pattern, once for each distinct text.

    All patterns' matches are collected in one array, exploded once and judged. `again` marks line
    tags of an impossible size, which replace earlier mentions.
    """
    some = items.where(F.col("confidence") >= LEAST)

    def matches(rank: int, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(_cleaned(), F.lit(pattern), F.lit(1)), lambda m, i: F.struct(F.lit(rank).alias("rank"), i.alias("pos"), m.alias("raw")))

    found = [matches(r, p) for r, _, p in G.PATTERNS]
    texts = told(some, t=_cleaned(), m=F.concat(*found)).where(F.length("t") >= 2)
    m = texts.select("text", "t", F.explode("m").alias("m")).select("text", "t", "m.rank", "m.pos", "m.raw")
    line = F.col("rank") == 2
    m = m.withColumn("tag", F.when(line, N.line_tag(F.col("raw"))).otherwise(F.upper("raw"))).where("tag is not null")
    m = m.withColumn("size", F.when(line, size_check(F.col("tag"))))
    code = F.upper(F.regexp_extract("raw", r"(?i)^[0-9]{2}-([A-Z]{2,4})-", 1))
    seq = F.regexp_extract("raw", r"(?i)^[0-9]{2}-[A-Z]{2,4}-([0-9A-Z]{3,6})", 1)
    project = (
        F.when(code.isin(G.VALVE_CODES) & (F.length(F.regexp_replace(seq, "[^0-9]", "")) >= 4), "VALVE_TAG")
        .when(code.isin(G.INSTRUMENT_CODES), "INSTRUMENT_TAG")
        .when(code.isin(G.EQUIPMENT_CODES), "EQUIPMENT_TAG")
        .when(F.length(seq) >= 4, "INSTRUMENT_TAG")
        .otherwise("EQUIPMENT_TAG")
    )
    code_like = F.col("tag").rlike(G.SPEC_CODE) | F.col("tag").rlike(G.SERVICE_CODE)
    drop = (
        ((F.col("rank") == 3) & ((F.length(seq) == 6) | code_like))
        | ((F.col("rank") == 5) & F.col("tag").rlike("^[0-9]{2}[A-Z]{2}[0-9]{7,}"))
        | ((F.col("rank") == 12) & (code_like | ~F.split_part("tag", F.lit("-"), F.lit(1)).isin(G.EQUIPMENT_PREFIXES) | F.col("tag").rlike(G.EQUIPMENT_REJECT)))
    )
    again = F.coalesce(F.col("size").startswith("size_out_of_range"), F.lit(False))
    plain = reduce(lambda c, x: c.when(F.col("rank") == x[0], x[1]), ((r, c) for r, c, _ in G.PATTERNS if r not in (2, 3)), F.when(line, F.when(again, "NOTE").otherwise("LINE_TAG")).when(F.col("rank") == 3, project))
    note = F.trim(F.regexp_extract("raw", r"(?i)(\s*NOTE\s*[0-9]+)", 1))
    flag = F.coalesce("size", F.when(line & (note != ""), F.concat(F.lit("note_ref_stripped("), note, F.lit(")"))))
    return m.where(~drop).select("text", "t", "rank", "pos", "tag", "size", plain.alias("classification"), flag.alias("flag_reason"), again.alias("again"))


def that_may_be(said: DataFrame, classes: list[str]) -> DataFrame:
    """Of the tags of texts those that are of one of the classes in some text, with all their matches: a mention of these classes is among them."""
    return said.join(said.where(F.col("classification").isin(classes)).select("tag").distinct(), "tag", "left_semi")


def _placed(items: DataFrame) -> DataFrame:
    return items.where(F.col("confidence") >= LEAST).select("drawing_id", "item_idx", "text", F.col("confidence").alias("conf"), "center_x", "center_y")


def _confidence(again: Column, rank: Column, size: Column) -> Column:
    """A mention's confidence, from its item's (conf)."""
    return F.round(F.when(again, 0.25).when((rank == 2) & size.isNotNull(), F.least("conf", F.lit(0.75))).when(rank == 4, F.least("conf", F.lit(0.85))).otherwise(F.col("conf")), 3)


def scan(items: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """drawing_id, item_idx, rank, pos, tag, classification, confidence, flag_reason, again, t, center_x, center_y: every match of every pattern.

    The items meet their texts' tags (`said`: the result of `tags`, if there is one). Columns
    beyond these are not read.
    """
    said = tags(items) if said is None else said
    return _placed(items).join(said, "text").select("drawing_id", "item_idx", "rank", "pos", "tag", "classification", _confidence(F.col("again"), F.col("rank"), F.col("size")).alias("confidence"), "flag_reason", "again", "t", "center_x", "center_y")


def seq(item: Column, rank: Column, pos: Column) -> Column:
    """A mention's place in reading order: item, pattern, match. A struct, so none of them has a bound."""
    return F.struct(item.cast("long").alias("item"), rank.cast("int").alias("rank"), pos.cast("int").alias("pos"))


def first_mentions(items: DataFrame, said: DataFrame) -> DataFrame:
    """One row per drawing and tag: the first mention, or the last of an impossible size; `seq` is the first's place. said: the result of `tags`.

    An aggregate, not a window: a tag with a third of all mentions is combined before the shuffle.
    Within a text the mention is known beforehand, so between items only numbers are compared (a
    hash aggregate holds nothing else): the item and which tag of which text it has.
    """
    keep = ["rank", "pos", "classification", "flag_reason", "size", "again"]
    row = F.struct(*keep)
    own = said.groupBy("text", "t", "tag").agg(F.min(row).alias("a"), F.max(F.when(F.col("again"), row)).alias("z"))
    own = stage(own.withColumn("id", F.monotonically_increasing_id()), "mentioned")
    m = _placed(items).join(own.select("text", "tag", "id", "a.rank", "a.pos", F.col("z").isNotNull().alias("again")), "text").withColumn("last", F.when(F.col("again"), F.col("item_idx")))
    first = [F.min_by(c, "item_idx").alias(f"a_{c}") for c in ("id", "rank", "pos", "conf", "center_x", "center_y")]
    last = [F.max_by(c, "last").alias(f"z_{c}") for c in ("id", "conf", "center_x", "center_y")]
    g = m.groupBy("drawing_id", "tag").agg(F.min("item_idx").alias("first_item"), *first, F.max("last").alias("last"), *last)
    w = F.col("last").isNotNull()
    g = g.select("drawing_id", "tag", "first_item", seq(F.col("first_item"), F.col("a_rank"), F.col("a_pos")).alias("seq"), F.coalesce("last", "first_item").alias("item_idx"), w.alias("w"), *[F.when(w, F.col(f"z_{c}")).otherwise(F.col(f"a_{c}")).alias(c) for c in ("id", "conf", "center_x", "center_y")])
    r = F.when(F.col("w"), F.col("z")).otherwise(F.col("a"))
    j = g.join(own.select("id", "t", "a", "z"), "id").withColumn("r", r)
    return j.select("drawing_id", "seq", "tag", "item_idx", "r.rank", "r.pos", "r.classification", _confidence(r["again"], r["rank"], r["size"]).alias("confidence"), "r.flag_reason", "t", "center_x", "center_y", "first_item")


def setpoint_words(items: DataFrame) -> DataFrame:
    """The items of any confidence whose text has a set-point word."""
    return items.join(told(items, said=F.trim("text").rlike(G.SETPOINT)).where("said").select("text"), "text", "left_semi")


def guarded(mentions: DataFrame, items: DataFrame) -> DataFrame:
    """First mentions with set points among the bare three-digit instruments turned into notes.

    A set-point word counts in the item itself, in an item at most 0.05 up or down and 0.20
    sideways (both with positions above 0), or within 35 characters of the match. With a quarter
    of x the box is a square, so the search is for the nearest set point by the larger difference.
    """
    p = next(p for r, _, p in G.PATTERNS if r == 4)
    suspect = (F.col("rank") == 4) & (F.col("classification") == "INSTRUMENT_TAG") & (F.length(F.regexp_replace("tag", "[^0-9]", "")) == 3)
    # The match's place: lengths of the parts between matches and of the matches before it.
    whole, parts = F.regexp_extract_all("t", F.lit(p), F.lit(0)), F.split("t", p, -1)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    start = total(F.slice(parts, 1, F.col("pos") + 1)) + total(F.slice(whole, F.lit(1), F.col("pos")))
    end = start + F.length("tag")
    window = F.substring(F.col("t"), F.greatest(start - 35, F.lit(0)) + 1, end + 35 - F.greatest(start - 35, F.lit(0)))
    said = setpoint_words(items)
    own = said.select("drawing_id", "item_idx").distinct().withColumn("own", F.lit(True))
    doubted = mentions.where(suspect).select("drawing_id", "tag", "item_idx", "pos", "t", "center_x", "center_y").join(own, ["drawing_id", "item_idx"], "left")
    doubted = stage(doubted.select("drawing_id", "tag", "center_x", "center_y", (F.col("own").isNotNull() | F.coalesce(window.rlike(G.SETPOINT), F.lit(False))).alias("sure")), "suspects")
    # Set points are looked for near those only that nothing else has told.
    left = doubted.where("not sure and center_x > 0 and center_y > 0")
    square = ["drawing_id", (F.col("center_x") / 4).alias("x"), F.col("center_y").alias("y")]
    beside = said.where("center_x > 0 and center_y > 0").join(left.select("drawing_id").distinct(), "drawing_id", "left_semi")
    near = nearest(left.select(*square, "tag"), beside.select(*square, F.lit("").alias("tag"), F.col("item_idx").alias("ord")), 0.05, "n_near", square=True, inclusive=True)
    hits = doubted.where("sure").select("drawing_id", "tag").unionByName(near.where("n_near is not null").select("drawing_id", "tag"))
    hits = stage(hits.select("drawing_id", "tag", F.lit(True).alias("hit")), "setpoints")
    hit = lambda told, c: F.when(F.col("hit"), told).otherwise(F.col(c))
    return mentions.join(hits, ["drawing_id", "tag"], "left").withColumns({"classification": hit("NOTE", "classification"), "confidence": hit(0.15, "confidence"), "flag_reason": hit("ambiguous_setpoint_vs_tag", "flag_reason")}).drop("hit")


def kept_notes(items: DataFrame, said: DataFrame, mentions: DataFrame) -> DataFrame:
    """Items that brought no new tag, as notes with their own text, first mention of each text. said: the result of `tags`."""
    again = _placed(items).join(said.where("again").select("text").distinct(), "text", "left_semi").select("drawing_id", "item_idx")
    gave = mentions.select("drawing_id", F.col("first_item").alias("item_idx")).unionByName(again)
    rest = normalized(items).where(F.length("t") >= 3).join(gave, ["drawing_id", "item_idx"], "left_anti")
    first = [F.min_by(c, "item_idx").alias(c) for c in ("confidence", "center_x", "center_y")]
    notes = rest.groupBy("drawing_id", F.col("t").alias("tag")).agg(F.min("item_idx").alias("item"), *first)
    fresh = notes.join(mentions.select("drawing_id", "tag"), ["drawing_id", "tag"], "left_anti")
    return fresh.select("drawing_id", seq(F.col("item"), F.lit(15), F.lit(0)).alias("seq"), "tag", F.col("item").alias("item_idx"), F.lit("NOTE").alias("classification"), F.round("confidence", 3).alias("confidence"), F.lit(None).cast("string").alias("flag_reason"), "center_x", "center_y")


def ordered(elements: DataFrame) -> DataFrame:
    """Adds ord: the place after sorting by class, then by first mention (class_no, item, rank, pos)."""
    rank = reduce(lambda c, x: c.when(F.col("classification") == x[0], x[1]), G.PRIORITY.items(), F).otherwise(99)
    return elements.withColumn("ord", F.struct(rank.cast("int").alias("class_no"), "seq.item", "seq.rank", "seq.pos"))


def shaped(rows: DataFrame) -> DataFrame:
    """Mentions or notes as elements: drawing_id, ord, seq, item_idx, tag, classification, confidence, flag_reason, x, y. A missing position is 0."""
    return ordered(rows).select("drawing_id", "ord", "seq", "item_idx", "tag", "classification", "confidence", "flag_reason", F.coalesce("center_x", F.lit(0.0)).alias("x"), F.coalesce("center_y", F.lit(0.0)).alias("y"))


def classify(items: DataFrame) -> DataFrame:
    """drawing_id, ord, seq, item_idx, tag, classification, confidence, flag_reason, x, y: all tags and notes, before spellings are folded.

    Items need drawing_id, item_idx (distinct in its drawing), text, confidence, center_x and
    center_y. A missing position is 0. Repeated texts are mentions of one tag. Empty tables give none.
    """
    # Read several times: written once, the patterns run once over each text.
    said = stage(tags(items), "tags")
    mentions = stage(guarded(first_mentions(items, said), items), "mentions")
    return shaped(mentions).unionByName(shaped(kept_notes(items, said, mentions)))


def breakdown(elements: DataFrame) -> DataFrame:
    """Per drawing and class: number of elements, of flagged ones."""
    return elements.groupBy("drawing_id", "classification").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("flag_reason").isNotNull()).alias("n_flagged"))
