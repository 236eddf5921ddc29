"""Edges with provenance, resolved to master tags, without loops and repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import normalize as N


def merge(*parts: DataFrame) -> DataFrame:
    """The first of equal relations; earlier parts come first. Columns: drawing_id, source_tag, target_tag, rel_type, rel_ord."""
    tagged = [p.select("drawing_id", "source_tag", "target_tag", "rel_type", F.struct(F.lit(i).alias("part"), F.col("rel_ord").alias("o")).alias("w")) for i, p in enumerate(parts)]
    g = reduce(DataFrame.unionByName, tagged).groupBy("drawing_id", "source_tag", "target_tag", "rel_type").agg(F.min("w").alias("w"))
    return g.select("drawing_id", "source_tag", "target_tag", "rel_type", F.col("w").alias("rel_ord"))


def tokens(elements: DataFrame) -> DataFrame:
    """drawing_id, token: tags as told and in canonical form."""
    u = F.upper(F.trim("tag"))
    return elements.where("tag <> ''").select("drawing_id", F.explode(F.array(u, N.canonical_tag(F.col("tag")))).alias("token")).distinct()


def provenance(rels: DataFrame, toks: DataFrame) -> DataFrame:
    """rels with known: whether either end, as told or canonical, is among the drawing's tokens. A drawing without tokens knows everything."""
    t = toks.select(F.col("drawing_id").alias("k_drawing"), "token").distinct()
    ends = rels.select("drawing_id", F.explode(F.array(*[f for c in ("source_tag", "target_tag") for f in (F.upper(F.trim(c)), N.canonical_tag(F.col(c)))])).alias("e")).distinct()
    seen = ends.join(t, (F.col("drawing_id") == F.col("k_drawing")) & (F.col("e") == F.col("token")), "left_semi").select(F.col("drawing_id").alias("s_drawing"), F.col("e").alias("s"))
    told = t.select(F.col("k_drawing").alias("h_drawing")).distinct()

    def hit(df: DataFrame, c: str, out: str) -> DataFrame:
        a = seen.select(F.col("s_drawing").alias("a_drawing"), F.col("s").alias("a"))
        j = df.join(a, (F.col("drawing_id") == F.col("a_drawing")) & (F.upper(F.trim(c)) == F.col("a")), "left")
        b = seen.select(F.col("s_drawing").alias("b_drawing"), F.col("s").alias("b"))
        j = j.join(b, (F.col("drawing_id") == F.col("b_drawing")) & (N.canonical_tag(F.col(c)) == F.col("b")), "left")
        return j.withColumn(out, F.col("a").isNotNull() | F.col("b").isNotNull()).drop("a_drawing", "a", "b_drawing", "b")

    j = hit(hit(rels, "source_tag", "ks"), "target_tag", "kt").join(told, F.col("drawing_id") == F.col("h_drawing"), "left")
    return j.withColumn("known", F.col("ks") | F.col("kt") | F.col("h_drawing").isNull()).drop("ks", "kt", "h_drawing")


def clean(rels: DataFrame, toks: DataFrame) -> DataFrame:
    return provenance(rels, toks).where("known").drop("known")


def dropped(rels: DataFrame, toks: DataFrame) -> DataFrame:
    return provenance(rels, toks).where("not known").drop("known").withColumn("flag_reason", F.lit("cross_document_contamination"))


def alias_map(entities: list[DataFrame]) -> DataFrame:
    """m_drawing, m_key, master: upper and canonical forms of tags and aliases; later tables and rows win.

    entities: drawing_id, ord, tag, aliases, in the order equipment, instruments, valves, lines, relief valves.
    """
    def keys(i: int, t: DataFrame) -> DataFrame:
        a = F.col("aliases") if "aliases" in t.columns else F.array().cast("array<string>")
        named = t.select("drawing_id", "ord", "tag", F.posexplode(F.concat(F.array("tag"), F.coalesce(a, F.array().cast("array<string>")))).alias("p", "n"))
        forms = named.select("drawing_id", "ord", "tag", "p", F.posexplode(F.array(F.upper("n"), N.canonical_tag(F.col("n")))).alias("q", "m_key"))
        return forms.select(F.col("drawing_id").alias("m_drawing"), "m_key", "tag", F.struct(F.lit(i).alias("i"), "ord", "p", "q").alias("w"))

    rows = reduce(DataFrame.unionByName, [keys(i, t) for i, t in enumerate(entities)])
    return rows.groupBy("m_drawing", "m_key").agg(F.max_by("tag", "w").alias("master"))


def resolve(rels: DataFrame, aliases: DataFrame) -> DataFrame:
    """drawing_id, source, target, type, rel_ord: ends by upper form, then canonical form, else as told; no blank ends, no loops, the first of canonically equal edges."""
    r = rels.where("source_tag <> '' and target_tag <> ''")
    for c, out in (("source_tag", "source"), ("target_tag", "target")):
        a = aliases.select(F.col("m_drawing").alias("a_d"), F.col("m_key").alias("a_k"), F.col("master").alias("a_m"))
        b = aliases.select(F.col("m_drawing").alias("b_d"), F.col("m_key").alias("b_k"), F.col("master").alias("b_m"))
        r = r.join(a, (F.col("drawing_id") == F.col("a_d")) & (F.upper(c) == F.col("a_k")), "left").join(b, (F.col("drawing_id") == F.col("b_d")) & (N.canonical_tag(F.col(c)) == F.col("b_k")), "left")
        r = r.withColumn(out, F.coalesce("a_m", "b_m", c)).drop("a_d", "a_k", "a_m", "b_d", "b_k", "b_m")
    s, t = N.canonical_tag(F.col("source")), N.canonical_tag(F.col("target"))
    r = r.withColumns({"cs": s, "ct": t, "type": F.lower("rel_type")}).where("source <> target and cs <> ct")
    return r.groupBy("drawing_id", "cs", "ct", "type").agg(F.min(F.struct("rel_ord", "source", "target")).alias("w")).select("drawing_id", "w.source", "w.target", "type", "w.rel_ord")
