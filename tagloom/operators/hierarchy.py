"""Parent-child links to whole hierarchies by nested-set ranges, for trees of any depth and width.

Subtree sizes are summed upward, preorder ranges are handed out downward by prefix sums over
siblings. Both passes jump in doubled steps (a node's pointer goes 1, 2, 4, ... levels up), so a
chain of a million nodes takes twenty rounds, not a million. Nodes whose pointer never passes a
root stay unprocessed: they lie on a loop or run into one. Every round is written to the shared
folder, so lineage stays short and a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tagloom.operators.prefix import salted_prefix
from tagloom.session import stage


def climb(nodes: DataFrame) -> DataFrame:
    """id, pid -> id, pid, top, depth, size, state: sizes upward, roots and depths, loops.

    pid null marks a root. state: `none`, `on` (on a loop) or `under` (its chain runs into one).
    For `on` and `under` top and depth are null. size counts the node and all below it; for `on`
    all nodes of the loop and below. A pid that is no id makes its node a root. Ids must be
    distinct and not null.
    """
    known = nodes.select(F.col("id").alias("k_id"))
    start = nodes.join(known, F.col("pid") == F.col("k_id"), "left").select("id", F.col("k_id").alias("pid"))
    t = stage(start.select("id", "pid", F.col("pid").alias("anc"), F.coalesce("pid", "id").alias("top"), F.when(F.col("pid").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.lit(1).cast("long").alias("size")), "climb")
    last = None
    for _ in range(64):
        n = t.where("anc is not null").agg(F.count("anc").alias("n"), F.count_distinct("anc").alias("m")).first()
        if n["n"] == 0 or (n["n"], n["m"]) == last:
            break
        last = (n["n"], n["m"])
        b = t.select(F.col("id").alias("b_id"), F.col("anc").alias("b_anc"), F.col("top").alias("b_top"), F.col("dist").alias("b_dist"))
        up = t.join(b, F.col("anc") == F.col("b_id"), "left")
        far = F.col("anc").isNotNull()
        up = up.select("id", "pid", F.col("b_anc").alias("n_anc"), F.when(far, F.col("b_top")).otherwise(F.col("top")).alias("top"), (F.col("dist") + F.coalesce("b_dist", F.lit(0))).alias("dist"), "size")
        gain = t.where(far).groupBy(F.col("anc").alias("g_id")).agg(F.sum("size").alias("gain"))
        t = stage(up.join(gain, F.col("id") == F.col("g_id"), "left").select("id", "pid", F.col("n_anc").alias("anc"), "top", "dist", (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size")), "climb")
    on = t.where("anc is not null").select(F.col("anc").alias("on_id")).distinct()
    marked = t.join(on, F.col("id") == F.col("on_id"), "left")
    t = marked.select("id", "pid", "size", F.when(F.col("anc").isNull(), F.col("top")).alias("top"), F.when(F.col("anc").isNull(), F.col("dist")).alias("depth"), F.when(F.col("on_id").isNotNull(), "on").when(F.col("anc").isNotNull(), "under").otherwise("none").alias("state"))
    if last is None or n["n"] == 0:
        return t
    t = stage(t, "climbed")
    loops = loop_sizes(t)
    return t.join(loops, F.col("id") == F.col("l_id"), "left").select("id", "pid", F.coalesce("loop_size", "size").alias("size"), "top", "depth", "state")


def loop_sizes(t: DataFrame) -> DataFrame:
    """l_id, loop_size of every node on a loop: the nodes of its loop and of all trees hanging from it."""
    on = t.where("state = 'on'").select("id", "pid")
    below = t.where("state = 'under'").join(on.select(F.col("id").alias("o_id")), F.col("pid") == F.col("o_id")).groupBy(F.col("pid").alias("h_id")).agg(F.sum("size").alias("hang"))
    c = stage(on.join(below, F.col("id") == F.col("h_id"), "left").select("id", F.col("pid").alias("anc"), F.col("id").alias("low"), (F.coalesce("hang", F.lit(0)) + 1).alias("own")), "loops")
    for _ in range(64):
        seen = Observation()
        b = c.select(F.col("id").alias("b_id"), F.col("anc").alias("b_anc"), F.col("low").alias("b_low"))
        new = c.join(b, F.col("anc") == F.col("b_id")).select("id", F.col("b_anc").alias("anc"), F.least("low", "b_low").alias("n_low"), "own", (F.col("b_low") < F.col("low")).cast("int").alias("moved"))
        c = stage(new.observe(seen, F.sum("moved").alias("moved")).select("id", "anc", F.col("n_low").alias("low"), "own"), "loops")
        if not seen.get["moved"]:
            break
    total = c.groupBy(F.col("low").alias("t_low")).agg(F.sum("own").alias("loop_size"))
    return c.join(total, F.col("low") == F.col("t_low")).select(F.col("id").alias("l_id"), "loop_size")


def nested_sets(nodes: DataFrame) -> DataFrame:
    """id, pid -> id, root_id, depth, path, range_left, range_right, n_descendants, cycle_state.

    Within its tree a node's range [range_left, range_right) holds exactly the ranges of its
    descendants, so n_descendants is the range's length less 1, and `descendants` is a range
    join. path joins the ids from the root by '/'. For nodes on or under a loop root_id and
    depth are -1, path is '' and the range is null; n_descendants counts all they feed but
    themselves. A node that is its own parent is a loop of one. Siblings stand in a fixed order
    without meaning. Ids must be distinct and not null; a pid without a node makes a root; an
    empty table gives an empty result.
    """
    t = stage(climb(nodes), "sizes")
    tree = t.where("state = 'none'")
    # Downward: a child's range starts 1 after its parent's start, past the sizes of the siblings before it.
    first = salted_prefix(tree.where("pid is not null").select("id", "pid", "size"), ["pid"], ["id"], "size", "skip").select(F.col("id").alias("s_id"), (F.col("skip") + 1).alias("skip"))
    d = stage(
        tree.join(first, F.col("id") == F.col("s_id"), "left").select("id", F.col("pid").alias("anc"), F.coalesce("skip", F.lit(0)).alias("left"), F.col("id").cast("string").alias("path")), "ranges"
    )
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    for _ in range(int(deepest).bit_length()):
        b = d.select(F.col("id").alias("b_id"), F.col("anc").alias("b_anc"), F.col("left").alias("b_left"), F.col("path").alias("b_path"))
        d = stage(
            d.join(b, F.col("anc") == F.col("b_id"), "left").select("id", F.col("b_anc").alias("anc"), (F.col("left") + F.coalesce("b_left", F.lit(0))).alias("left"), F.concat_ws("/", "b_path", "path").alias("path")), "ranges"
        )
    d = d.select(F.col("id").alias("d_id"), "left", "path")
    out = t.join(d, F.col("id") == F.col("d_id"), "left")
    return out.select(
        "id",
        F.coalesce("top", F.lit(-1)).alias("root_id"),
        F.coalesce("depth", F.lit(-1)).cast("int").alias("depth"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.col("left").alias("range_left"),
        (F.col("left") + F.col("size")).alias("range_right"),
        (F.col("size") - 1).alias("n_descendants"),
        F.col("state").alias("cycle_state"),
    )


def descendants(sets: DataFrame, ancestors: DataFrame) -> DataFrame:
    """ancestor_id, id: everything below the nodes of `ancestors` (id), by a range join inside each tree.

    The named ancestors are few; both sides are cut into blocks of preorder numbers, so a join key
    is (root, block) and a large tree spreads over many tasks.
    """
    block = 4096
    a = sets.join(ancestors.select(F.col("id").alias("a_id")).distinct(), F.col("id") == F.col("a_id"), "left_semi").where("range_right > range_left + 1")
    a = a.select(F.col("id").alias("ancestor_id"), F.col("root_id").alias("a_root"), F.col("range_left").alias("lo"), F.col("range_right").alias("hi"), F.explode(F.sequence((F.col("range_left") / block).cast("long"), ((F.col("range_right") - 1) / block).cast("long"))).alias("a_block"))
    n = sets.where("range_left is not null").select("id", "root_id", "range_left", (F.col("range_left") / block).cast("long").alias("block"))
    return n.join(a, (F.col("root_id") == F.col("a_root")) & (F.col("block") == F.col("a_block")) & (F.col("range_left") > F.col("lo")) & (F.col("range_left") < F.col("hi"))).select("ancestor_id", "id")
