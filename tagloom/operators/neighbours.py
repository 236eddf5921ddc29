"""Neighbour searches within a scope (a drawing), however many points it has and however they cluster.

A scope of few candidates is searched as one short array, joined by the scope. The candidates of a
crowded scope form a tree of cells, each cut into 4 x 4 until few candidates are left in one; the
asked points go down the tree together, level by level, and keep only the cells that can still
hold their answer. So a point meets a few cells a level, not all candidates near it, and dense
clusters cost no more than even ones.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import stage

#: Candidates of a scope that is searched as one array, and of a cell that isn't cut further.
CELL, LEAF = 2048, 64
#: Cuts of a cell at most; its side is then the root's by 4^DEEP.
DEEP = 8


class Candidates(NamedTuple):
    """What is searched, made ready by `prepared`: arrays by scope of few candidates; the candidates and names of crowded scopes, if there are any."""

    arrays: DataFrame
    many: DataFrame | None
    crowded: DataFrame | None


def prepared(among: DataFrame, scope: str = "drawing_id") -> Candidates:
    """Candidates (scope, tag, ord, x, y) for several searches: their arrays are written once."""
    c = _candidates(among, scope)
    return c._replace(arrays=stage(c.arrays, "arrays"))


def _candidates(among: DataFrame, scope: str) -> Candidates:
    c = among.where("x is not null and y is not null and tag is not null").select(F.col(scope).alias("c_scope"), "x", "y", "ord", "tag")
    crowded = c.groupBy("c_scope").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).select("c_scope")
    few, many = c, None
    if crowds := not crowded.isEmpty():
        crowded = stage(crowded, "crowded")
        few = c.join(crowded, "c_scope", "left_anti")
        # Of the candidates at one place only the first can be an answer.
        many = stage(c.join(crowded, "c_scope", "left_semi").groupBy("c_scope", "x", "y").agg(F.min(F.struct("ord", "tag")).alias("c")).select("c_scope", "x", "y", "c.ord", "c.tag"), "candidates")
    # In order, so that the first of equals is the one to take, and as plain arrays: their distances are told without a struct a candidate.
    arrays = few.groupBy("c_scope").agg(F.sort_array(F.collect_list(F.struct("ord", "tag", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("v"))
    return Candidates(arrays.select("c_scope", F.col("v.x").alias("__xs"), F.col("v.y").alias("__ys"), F.col("v.tag").alias("__tags")), many, crowded if crowds else None)


def _distance(dx: Column, dy: Column, square: bool, nulls: bool = True) -> Column:
    if not square:
        return F.sqrt(dx * dx + dy * dy)
    if not nulls:
        return F.greatest(F.abs(dx), F.abs(dy))
    return F.when(dx.isNotNull() & dy.isNotNull(), F.greatest(F.abs(dx), F.abs(dy)))


def nearest(asked: DataFrame, among: DataFrame | Candidates, radius: float, out: str, scope: str = "drawing_id", square: bool = False, inclusive: bool = False) -> DataFrame:
    """Adds `out`: the tag of the nearest candidate of the same scope within radius, or null.

    asked: scope, x, y and any columns; among: scope, tag, ord, x, y, or these `prepared`. The radius itself is outside
    unless inclusive. `square` measures by the larger of the two differences. Equal distances go
    to the smallest ord. Null positions find nothing and are found by nothing; repeated rows get
    their answers each.
    """
    within = (lambda d: d <= radius) if inclusive else (lambda d: d < radius)

    def best(v: Column, x: Column, y: Column) -> Column:
        met = F.array_min(F.transform(F.when(x.isNotNull() & y.isNotNull(), v), lambda c: F.struct(_distance(x - c["x"], y - c["y"], square).alias("d"), c["ord"].alias("ord"), c["tag"].alias("tag"))))
        return F.when(within(met["d"]), met)

    def easy(d: Column) -> Column:
        """The place of the first of the least distances, null unless it is within."""
        return F.when(within(F.array_min(d)), F.array_position(d, F.array_min(d)))

    # A cell may hold the nearest if its near side is no farther than the far corner of another.
    return _search(asked, among, radius, out, scope, square, within, best, easy, low=lambda near, _: near, high=lambda far, _: far, keep=lambda low, high: high.isNull() | (low <= high * (1 + 1e-12) + 1e-300))


def first_within(asked: DataFrame, among: DataFrame | Candidates, radius: float, out: str, scope: str = "drawing_id", square: bool = False) -> DataFrame:
    """Adds `out`: the tag of the candidate with the smallest ord strictly within radius, or null. Columns as for `nearest`."""

    def best(v: Column, x: Column, y: Column) -> Column:
        return F.array_min(F.transform(F.filter(v, lambda c: _distance(x - c["x"], y - c["y"], square) < radius), lambda c: F.struct(c["ord"].alias("ord"), c["tag"].alias("tag"))))

    def easy(d: Column) -> Column:
        """The place of the first distance within, 0 if there is none."""
        return F.array_position(F.transform(d, lambda x: x < radius), F.lit(True))

    # A cell that lies within the radius as a whole answers with its first; others are opened if their first comes before.
    return _search(asked, among, radius, out, scope, square, lambda d: d < radius, best, easy, low=lambda _, top: top, high=lambda far, top: F.when(far * (1 + 1e-12) < radius, top), keep=lambda low, high: high.isNull() | (low < high), whole=True)


def _search(asked: DataFrame, among: DataFrame | Candidates, radius: float, out: str, scope: str, square: bool, within: Callable, best: Callable, easy_best: Callable, low: Callable, high: Callable, keep: Callable, whole: bool = False) -> DataFrame:
    point = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "ord", "tag")
    arrays, c, crowded = among if isinstance(among, Candidates) else _candidates(among, scope)
    crowds = crowded is not None
    easy = asked.join(crowded, F.col(scope) == F.col("c_scope"), "left_anti") if crowds else asked
    done = easy.join(arrays, F.col(scope) == F.col("c_scope"), "left")
    apart = F.zip_with("__xs", "__ys", lambda a, b: _distance(F.col("x") - a, F.col("y") - b, square, False))
    done = done.withColumn("__d", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), apart)).withColumn("__at", easy_best(F.col("__d")))
    done = done.withColumn(out, F.when(F.col("__at") > 0, F.get("__tags", F.col("__at").cast("int") - 1))).select(*asked.columns, out)
    if not crowds:
        return done
    hard = stage(asked.join(crowded, F.col(scope) == F.col("c_scope"), "left_semi").withColumn("__p", F.monotonically_increasing_id()), "asked")
    nodes, leaves = _tree(c, point, radius)
    state = _descend(hard.where("x is not null and y is not null").select("__p", F.col(scope).alias("s"), "x", "y"), nodes, radius, square, within, low, high, keep)
    at = state.select("__p", "s", "x", "y", F.explode("leaves").alias("l")).select("__p", "s", "x", "y", "l.*")
    j = at.join(leaves, (F.col("s") == F.col("c_scope")) & (F.col("level") == F.col("c_level")) & (F.col("gx") == F.col("cx")) & (F.col("gy") == F.col("cy")))
    found = j.select("__p", best(F.col("v"), F.col("x"), F.col("y")).alias("b"))
    if whole:
        found = found.unionByName(state.select("__p", F.col("ub").alias("b")))
    won = found.groupBy("__p").agg(F.min("b").alias("b")).select(F.col("__p").alias("__w"), F.col("b.tag").alias(out))
    return done.unionByName(hard.join(won, F.col("__p") == F.col("__w"), "left").select(*asked.columns, out))


def _tree(c: DataFrame, point: Column, side: float) -> tuple[DataFrame, DataFrame]:
    """The cells (c_scope, level, cx, cy, leaf, top: the first candidate) and the leaves' candidates (c_scope, c_level, cx, cy, v)."""
    fine = side / 4**DEEP
    f = c.withColumns({"fx": F.floor(F.col("x") / fine).cast("long"), "fy": F.floor(F.col("y") / fine).cast("long")})
    f = f.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(DEEP))))
    f = f.withColumns({"cx": F.expr(f"shiftright(fx, 2 * ({DEEP} - level))"), "cy": F.expr(f"shiftright(fy, 2 * ({DEEP} - level))")})
    cells = stage(f.groupBy("c_scope", "level", "cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "tag")).alias("top")), "cells")
    small = F.col("n") <= LEAF
    above = cells.where(small).select("c_scope", (F.col("level") + 1).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    # Below a leaf there is nothing: cells whose parent is cut.
    real = cells.withColumns({"px": F.shiftright("cx", 2), "py": F.shiftright("cy", 2)}).join(above, ["c_scope", "level", "px", "py"], "left_anti")
    real = stage(real.select("c_scope", "level", "cx", "cy", (small | (F.col("level") == DEEP)).alias("leaf"), "top"), "tree")
    ends = real.where("leaf").select("c_scope", "level", "cx", "cy")
    leaves = f.join(ends, ["c_scope", "level", "cx", "cy"]).groupBy("c_scope", F.col("level").alias("c_level"), "cx", "cy").agg(F.collect_list(point).alias("v"))
    return real, leaves


def _descend(points: DataFrame, nodes: DataFrame, side: float, square: bool, within: Callable, low: Callable, high: Callable, keep: Callable) -> DataFrame:
    """__p, s, x, y, ub (the best upper bound), leaves: the leaf cells that each point must look into."""
    cell = "struct<gx:bigint,gy:bigint>"
    root = [F.struct((F.floor(F.col("x") / side) + dx).cast("long").alias("gx"), (F.floor(F.col("y") / side) + dy).cast("long").alias("gy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    bound = low(F.lit(0.0), F.col("top"))
    kind = nodes.select(bound.alias("b")).schema["b"].dataType.simpleString()
    state = points.withColumns({"ub": F.lit(None).cast(kind), "leaves": F.array().cast(f"array<struct<level:int,gx:bigint,gy:bigint,low:{kind}>>"), "open": F.array(*root)})
    for k in range(DEEP + 1):
        size = side / 4**k
        f = state.select("__p", "s", "x", "y", F.explode("open").alias("o"))
        j = f.join(nodes.where(F.col("level") == k), (F.col("s") == F.col("c_scope")) & (F.col("o.gx") == F.col("cx")) & (F.col("o.gy") == F.col("cy")))
        lo = {v: F.col(c) * size for v, c in (("x", "cx"), ("y", "cy"))}
        hi = {v: (F.col(c) + 1) * size for v, c in (("x", "cx"), ("y", "cy"))}
        gap = {v: F.greatest(lo[v] - F.col(v), F.col(v) - hi[v], F.lit(0.0)) for v in "xy"}
        reach = {v: F.greatest(F.abs(F.col(v) - lo[v]), F.abs(F.col(v) - hi[v])) for v in "xy"}
        near, far = _distance(gap["x"], gap["y"], square) * (1 - 1e-12), _distance(reach["x"], reach["y"], square) * (1 + 1e-12)
        g = j.where(within(near)).groupBy("__p").agg(F.min(high(far, F.col("top"))).alias("hi"), F.collect_list(F.struct(F.lit(k).alias("level"), F.col("cx").alias("gx"), F.col("cy").alias("gy"), low(near, F.col("top")).alias("low"), "leaf")).alias("met"))
        t = state.join(g.withColumnRenamed("__p", "__q"), F.col("__p") == F.col("__q"), "left").withColumn("ub", F.least("ub", "hi")).withColumn("met", F.filter("met", lambda m: keep(m["low"], F.col("ub"))))
        mine = F.transform(F.filter("met", lambda m: m["leaf"]), lambda m: F.struct(m["level"].alias("level"), m["gx"].alias("gx"), m["gy"].alias("gy"), m["low"].alias("low")))
        below = F.flatten(F.transform(F.filter("met", lambda m: ~m["leaf"]), lambda m: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct((m["gx"] * 4 + i % 4).cast("long").alias("gx"), (m["gy"] * 4 + F.floor(i / 4)).cast("long").alias("gy")))))
        t = t.select("__p", "s", "x", "y", "ub", F.filter(F.concat("leaves", F.coalesce(mine, F.array().cast(state.schema["leaves"].dataType))), lambda m: keep(m["low"], F.col("ub"))).alias("leaves"), F.coalesce(below, F.array().cast(f"array<{cell}>")).alias("open"))
        state = stage(t, "descent")
        if state.where(F.size("open") > 0).isEmpty():
            break
    return state
