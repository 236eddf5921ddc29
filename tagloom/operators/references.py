"""References to records that do not exist, or not at the time: orphans by table, state and period.

Parent and child keys are united in long form, tagged by side, and grouped by parent space and key.
The groups carry only counts and extremes, so a key with a third of all rows is combined on the map
side. A group whose earliest never-deleted parent precedes all of its children is done with; what
stays is joined back to its children. Only children whose answer depends on single lifetimes (parents
that were deleted) go through a sweep over time, whose running sums are cut by key and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.prefix import salted_prefix
from tagloom.session import stage

PARENT = ["space", "key", "valid_from", "valid_to"]
CHILD = ["space", "key", "ref_table", "ref_field", "item_id", "at", "period"]


def dangling(parents: DataFrame, children: DataFrame, scope: list[str]) -> DataFrame:
    """The references without a living target.

    parents: scope..., space, key, valid_from, valid_to (null: never deleted);
    children: scope..., space, key, ref_table, ref_field, item_id, at, period.
    `space` names the set of parent tables a child may point to. Result: ref_table, ref_field,
    item_id, ref_state (`missing`: the key has no parent at all; `late`: parents, but none with
    valid_from <= at; `deleted`: the rest), period. A reference is fine if some parent has
    valid_from <= at < valid_to. A parent without valid_from counts as not yet there; a child
    without `at` is `missing` or `late`. Scope values and keys of null match nothing: such a child
    is `missing`. Repeated children each give a row. Empty tables are fine.
    """
    k = [*scope, "space", "key"]
    when = children.schema["at"].dataType
    known = F.lit(True)
    for c in k:
        known = known & F.col(c).isNotNull()
    cols = ["ref_table", "ref_field", "item_id", "ref_state", "period"]
    loose = children.where(~known).withColumn("ref_state", F.lit("missing")).select(*cols)
    parents, children = parents.where(known), children.where(known)
    long = parents.select(*k, F.lit(1).alias("__p"), "valid_from", F.when(F.col("valid_to").isNull(), F.col("valid_from")).alias("__open_from"), F.lit(None).cast(when).alias("at")).unionByName(
        children.select(*k, F.lit(0).alias("__p"), F.lit(None).cast(when).alias("valid_from"), F.lit(None).cast(when).alias("__open_from"), "at")
    )
    groups = long.groupBy(*k).agg(
        F.max("__p").alias("__has_parent"),
        F.max(1 - F.col("__p")).alias("__has_child"),
        F.min("valid_from").alias("__first"),
        F.min("__open_from").alias("__open_first"),
        F.min("at").alias("__child_first"),
        F.max((1 - F.col("__p")) * F.col("at").isNull().cast("int")).alias("__untimed"),
    )
    settled = (F.col("__has_parent") == 1) & (F.col("__open_first") <= F.col("__child_first")) & (F.col("__untimed") == 0)
    open_groups = groups.where((F.col("__has_child") == 1) & ~F.coalesce(settled, F.lit(False))).select(*k, "__has_parent", "__first", "__open_first")
    state = F.when(F.col("__has_parent") == 0, "missing").when(F.coalesce(F.col("__first") > F.col("at"), F.lit(True)), "late").when(F.coalesce(F.col("__open_first") <= F.col("at"), F.lit(False)), "fine").otherwise("swept")
    judged = children.join(open_groups, k).withColumn("ref_state", state).where("ref_state <> 'fine'")
    # Few references are left; written once, as the sweep reads them several times.
    judged = stage(judged.select(*k, "at", *cols), "judged")
    rest = judged.where("ref_state = 'swept'")
    dead = uncovered(parents.where("valid_to is not null"), rest.select(*k, "at"), k)
    swept = rest.join(dead, [*k, "at"], "left_semi").withColumn("ref_state", F.lit("deleted"))
    return judged.where("ref_state <> 'swept'").select(*cols).unionByName(swept.select(*cols)).unionByName(loose)


def uncovered(lifetimes: DataFrame, points: DataFrame, k: list[str]) -> DataFrame:
    """The distinct points (k..., at) that lie in no lifetime [valid_from, valid_to) of their key.

    A sweep: +1 where a lifetime begins, -1 where it ends, summed up to each point. Events of one
    moment are added up first, and the running sum is cut by day, so no task holds a whole key.
    """
    span = lifetimes.where("valid_from < valid_to").join(points.select(*k).distinct(), k, "left_semi")
    events = (
        span.select(*k, F.col("valid_from").alias("at"), F.lit(1).alias("__d"), F.lit(0).alias("__q"))
        .unionByName(span.select(*k, F.col("valid_to").alias("at"), F.lit(-1).alias("__d"), F.lit(0).alias("__q")))
        .unionByName(points.select(*k, "at", F.lit(0).alias("__d"), F.lit(1).alias("__q")))
    )
    moments = events.groupBy(*k, "at").agg(F.sum("__d").alias("__d"), F.max("__q").alias("__q"))
    alive = salted_prefix(moments, k, ["at"], "__d", "__before", bucket=F.date_trunc("day", F.col("at")))
    return alive.where((F.col("__q") == 1) & (F.col("__before") + F.col("__d") <= 0)).select(*k, "at")


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts of dangling references by table, field, state and period."""
    return found.groupBy("ref_table", "ref_field", "ref_state", "period").agg(F.count(F.lit(1)).alias("n_references"))


def is_reference(c: Column) -> Column:
    """A text that names a target: it holds a digit and is not marked off-page."""
    return c.rlike("[0-9]") & ~c.rlike(r"(?i)\boff[\s_\-‐-―]*page\b")
