"""Spellings of one tag folded into its longest form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import normalize as N
from tagloom.operators import grammar as G


def fold(elements: DataFrame, key: Column, classes: list[str], order: str, keep: tuple[str, ...] = (), first: tuple[str, ...] = ()) -> DataFrame:
    """drawing_id, classification-wide folding: per key the longest tag, the first of equals, and what it displaced.

    Columns: drawing_id, key, tag, <order> of the tag's own row, first_<order> (the key's first
    row), first_tag, aliases; `keep` adds columns of the tag's own row, `first` those of the key's
    first row as first_<column>. The tags of one key in one drawing differ only in an area number or a
    suffix of few characters, so a key's array is short whatever the drawing's size.
    aliases: the tag displaced last, then all later ones, in order.
    """
    more = list(dict.fromkeys([*keep, *first]))
    rows = elements.where(F.col("classification").isin(classes)).groupBy("drawing_id", key.alias("key")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("tag").alias("tag"), *more))).alias("v"))
    alone = F.size("v") == 1
    longest = F.array_max(F.transform("v", lambda x: F.length(x["tag"])))
    at = F.when(alone, 1).otherwise(F.array_position(F.transform("v", lambda x: F.length(x["tag"])), longest).cast("int"))
    rows = rows.withColumn("at", at)
    before = F.slice("v", F.lit(1), F.col("at") - 1)
    most = F.array_max(F.transform(before, lambda x: F.length(x["tag"])))
    displaced = F.slice(F.filter(before, lambda x: F.length(x["tag"]) == most), 1, 1)
    after = F.slice("v", F.col("at") + 1, F.size("v"))
    aliases = F.when(alone, F.array().cast("array<string>")).otherwise(F.transform(F.concat(displaced, after), lambda x: x["tag"]))
    win, head = F.get("v", F.col("at") - 1), F.get("v", F.lit(0))
    return rows.select("drawing_id", "key", win["tag"].alias("tag"), win["o"].alias(order), head["o"].alias(f"first_{order}"), head["tag"].alias("first_tag"), aliases.alias("aliases"), *[win[c].alias(c) for c in keep], *[head[c].alias(f"first_{c}") for c in first])


def fold_aliases(elements: DataFrame) -> DataFrame:
    """The elements with process tags folded across classes by canonical tag; adds aliases (empty for the others)."""
    rest = tuple(c for c in elements.columns if c not in ("drawing_id", "tag", "seq"))
    won = fold(elements, N.canonical_tag(F.col("tag")), G.FOLDED, "seq", keep=rest).select("drawing_id", "tag", "seq", *rest, "aliases")
    return won.unionByName(plain(elements.where(~F.col("classification").isin(G.FOLDED))))


def plain(elements: DataFrame) -> DataFrame:
    """Elements whose spellings aren't folded, with no aliases."""
    return elements.withColumn("aliases", F.array().cast("array<string>"))


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key the row with the smallest order, as an aggregate that combines before the shuffle. `order` must be distinct within a key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])
