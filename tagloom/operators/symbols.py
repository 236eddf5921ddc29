"""Symbol boxes: overlap, suppression, tiles, boxes from tags, dataset rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import stage

BOX = ["ymin", "xmin", "ymax", "xmax"]
# Symbol classes; a class's number is its place.
CLASSES = "INST_BUBBLE COMPRESSOR MOTOR COOLER FILTER VESSEL PUMP HEAT_EXCHANGER GLOBE_VALVE GATE_VALVE CHECK_VALVE BALL_VALVE CONTROL_VALVE NEEDLE_VALVE BUTTERFLY_VALVE SAFETY_VALVE PSV STRAINER REDUCER NOZZLE SPECTACLE_BLIND TEE FLANGE SKID COALESCER SEPARATOR".split()
# Symbol of a tag class.
OF_TAG = {"EQUIPMENT_TAG": "EQUIPMENT", "INSTRUMENT_TAG": "INST_BUBBLE", "PSV_TAG": "PSV", "LUMINAIRE_TAG": "LUMINAIRE", "PANEL_TAG": "PANEL", "EARTH_BAR_TAG": "EARTH_BAR", "EARTH_PIT_TAG": "EARTH_PIT"}


def iou(a: str, b: str) -> Column:
    """Shared area by joint area of two boxes given by column prefixes; 0 if the joint area is."""
    c = F.col
    h = F.greatest(F.lit(0.0), F.least(c(f"{a}ymax"), c(f"{b}ymax")) - F.greatest(c(f"{a}ymin"), c(f"{b}ymin")))
    w = F.greatest(F.lit(0.0), F.least(c(f"{a}xmax"), c(f"{b}xmax")) - F.greatest(c(f"{a}xmin"), c(f"{b}xmin")))
    area = lambda p: (c(f"{p}ymax") - c(f"{p}ymin")) * (c(f"{p}xmax") - c(f"{p}xmin"))
    joint = area(a) + area(b) - h * w
    return F.when(joint <= 0, 0.0).otherwise(h * w / joint)


def _clash(threshold: float, a: Column, b: Column) -> Column:
    """Whether two boxes (structs) overlap by more than the threshold."""
    h = F.greatest(F.lit(0.0), F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"]))
    v = F.greatest(F.lit(0.0), F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"]))
    area = lambda z: (z["ymax"] - z["ymin"]) * (z["xmax"] - z["xmin"])
    joint = area(a) + area(b) - h * v
    return (joint > 0) & (h * v > threshold * joint)


def suppress(boxes: DataFrame, threshold: float = 0.45, idx: str = "box_idx", small: int = 256) -> DataFrame:
    """The boxes that greedy suppression keeps, by drawing and symbol type: best confidence first, then the smallest idx; a box goes if it overlaps a kept one by more than the threshold.

    Boxes without a confidence (null or NaN) come last. Boxes with a null coordinate or without an
    area overlap nothing and stay. Groups of up to `small` boxes are folded, larger ones decided in
    rounds (`_rounds`); the answer is the same. The threshold is at least 0.01; from 1 on all stay.
    """
    if threshold < 0.01:
        raise ValueError("the threshold must be at least 0.01")
    if threshold >= 1:
        return boxes
    keys = ["drawing_id", "symbol_type"]
    columns = boxes.columns
    solid = F.coalesce((F.col("ymax") > F.col("ymin")) & (F.col("xmax") > F.col("xmin")), F.lit(False))
    order = F.struct(F.when(F.col("confidence") <= 1e308, -F.col("confidence").cast("double")).otherwise(F.lit(float("inf"))).alias("c"), F.col(idx).alias("i"))
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in keys])
    sized = boxes.where(solid).groupBy(*[F.col(k).alias(f"n_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    crowded = sized.where(F.col("n") > small).select(*[f"n_{k}" for k in keys])
    few = boxes.where(solid)
    done = [boxes.where(~solid)]
    if not crowded.isEmpty():
        crowded = stage(crowded, "crowded")
        done.append(_rounds(few.join(crowded, same("", "n_"), "left_semi"), keys, order, threshold).select(columns))
        few = few.join(crowded, same("", "n_"), "left_anti")
    g = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*columns).alias("r")))).alias("v")).withColumn("v", F.transform("v", lambda x: x["r"]))
    kept = F.aggregate("v", F.slice("v", 1, 0), lambda acc, b: F.when(F.exists(acc, lambda k: _clash(threshold, k, b)), acc).otherwise(F.concat(acc, F.array(b))))
    done.append(g.select(F.inline(kept)).select(columns))
    return reduce(DataFrame.unionByName, done)


def _rounds(boxes: DataFrame, keys: list[str], order: Column, threshold: float) -> DataFrame:
    """Greedy suppression of large groups: a box that comes before all undecided ones around it is kept and settles those it overlaps.

    Two boxes can overlap by more than the threshold only if their longer sides differ by less
    than its inverse. So a box lies in a cell as large as itself, and the cells around, of sizes
    near its own, hold all that it can meet. Only cells' first boxes are sent around, one a cell;
    kept boxes don't overlap each other much, so few of them meet a box. A round decides at least
    one box of each group, usually a large part.
    """
    spread = max(1, math.ceil(math.log2(1 / threshold)))
    side = F.greatest(F.col("ymax") - F.col("ymin"), F.col("xmax") - F.col("xmin"))
    level = F.floor(F.log2(side)).cast("int")
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("__l") + 1)).cast("long")
    at = ["__l", "__y", "__x"]
    todo = stage(boxes.withColumn("__o", order).withColumn("__l", level).withColumn("__y", cell("ymin")).withColumn("__x", cell("xmin")), "boxes")
    # Box extents in cells are below 2, so cells i (of one level) and k (d levels up) can meet if their doubled ranges do.
    lo = lambda c, d: (F.floor(F.col(c) * 2.0**-d - 2) + 1).cast("long")
    hi = lambda c, d: (F.ceil((F.col(c) + 2) * 2.0**-d) - 1).cast("long")

    def cells(d: int) -> Column:
        row = lambda y: F.transform(F.sequence(lo("__x", d), hi("__x", d)), lambda x: F.struct((F.col("__l") + d).alias("l"), y.alias("y"), x.alias("x")))
        return F.flatten(F.transform(F.sequence(lo("__y", d), hi("__y", d)), row))

    near = F.flatten(F.array(*[cells(d) for d in range(-spread, spread + 1)]))
    on = lambda p: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{p}_{k}")) for k in keys] + [F.col(f"__{c}") == F.col(f"{p}.{c}") for c in "lyx"])
    kept = []
    while not todo.isEmpty():
        first = todo.groupBy(*keys, *at).agg(F.min("__o").alias("first"))
        around = first.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.explode(near).alias("r"), F.col("first").alias("other")).groupBy(*[f"r_{k}" for k in keys], "r").agg(F.min("other").alias("other"))
        wins = first.join(around, on("r")).where(F.col("first") <= F.col("other")).select(*[F.col(k).alias(f"w_{k}") for k in keys], F.struct(*[F.col(f"__{c}").alias(c) for c in "lyx"]).alias("w"), F.col("first").alias("w_first"))
        won = stage(todo.join(wins, on("w") & (F.col("__o") == F.col("w_first"))).drop(*[f"w_{k}" for k in keys], "w", "w_first").dropDuplicates([*keys, "__o"]), "kept")
        kept.append(won)
        cover = won.select(*[F.col(k).alias(f"c_{k}") for k in keys], F.explode(near).alias("c"), F.col("__o").alias("c_o"), F.struct(*BOX).alias("c_box"))
        todo = stage(todo.join(cover, on("c") & ((F.col("__o") == F.col("c_o")) | _clash(threshold, F.struct(*BOX), F.col("c_box"))), "left_anti"), "boxes")
    return reduce(DataFrame.unionByName, kept)


def tiles(pages: DataFrame, size: int = 800, stride: int = 500, least: int = 1200) -> DataFrame:
    """pages (width, height, ...) with x, y, x2, y2 of their tiles; pages up to `least` on both sides are one tile."""
    big = (F.col("width") > least) | (F.col("height") > least)
    at = lambda n: F.when(big, F.sequence(F.lit(0), n.cast("int") - 1, F.lit(stride))).otherwise(F.array(F.lit(0)))
    t = pages.where("width > 0 and height > 0").withColumn("y", F.explode(at(F.col("height")))).withColumn("x", F.explode(at(F.col("width"))))
    end = lambda p, n: F.when(big, F.least(F.col(p) + size, F.col(n).cast("int"))).otherwise(F.col(n).cast("int"))
    return t.withColumn("x2", end("x", "width")).withColumn("y2", end("y", "height"))


def from_tile(boxes: DataFrame) -> DataFrame:
    """Boxes in pixels of a tile at (x, y) as shares of a page of width by height, clamped, to four places."""
    s = lambda o, c, n: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(o) + F.col(c)) / F.col(n))), 4)
    return boxes.withColumns({"ymin": s("y", "ymin", "height"), "xmin": s("x", "xmin", "width"), "ymax": s("y", "ymax", "height"), "xmax": s("x", "xmax", "width")})


def from_tags(elements: DataFrame, boxed: DataFrame | None = None, wide: dict[str, float] | None = None) -> DataFrame:
    """drawing_id, symbol_type, inferred_tag, ymin, xmin, ymax, xmax: a box of 0.02 each way for tags that have none; `wide` gives other reaches by class."""
    kind = reduce(lambda c, x: c.when(F.col("classification") == x[0], x[1]), OF_TAG.items(), F.when(F.col("classification") == "VALVE_TAG", F.when(F.upper("tag").rlike("CB|CHECK"), "CHECK_VALVE").otherwise("VALVE")))
    e = elements.withColumn("symbol_type", kind).where("symbol_type is not null")
    if boxed is not None:
        e = e.join(boxed.select("drawing_id", F.col("inferred_tag").alias("tag")), ["drawing_id", "tag"], "left_anti")
    reach = reduce(lambda c, x: c.when(F.col("classification") == x[0], x[1]), (wide or {}).items(), F.when(F.lit(False), 0.0)).otherwise(0.02)
    lo, hi = (lambda c: F.round(F.greatest(F.lit(0.0), F.col(c) - reach), 4)), (lambda c: F.round(F.least(F.lit(1.0), F.col(c) + reach), 4))
    return e.select("drawing_id", "symbol_type", F.col("tag").alias("inferred_tag"), lo("y").alias("ymin"), lo("x").alias("xmin"), hi("y").alias("ymax"), hi("x").alias("xmax"))


def class_id(c: Column) -> Column:
    """A symbol type's class number: exact, else the first class that holds it or that it holds, else 0."""
    u = F.upper(F.trim(c))
    exact = reduce(lambda w, x: w.when(u == x[1], x[0]), enumerate(CLASSES), F)
    part = reduce(lambda w, x: w.when(u.contains(x[1]) | F.lit(x[1]).contains(u), x[0]), enumerate(CLASSES), F)
    return F.coalesce(exact, part, F.lit(0))


def yolo(boxes: DataFrame) -> DataFrame:
    """Boxes of an area with class_id, x_center, y_center, width, height (clamped to the page) and the row's text with six places."""
    b = boxes.where("xmax > xmin and ymax > ymin").withColumns({"ymin": F.greatest("ymin", F.lit(0.0)), "xmin": F.greatest("xmin", F.lit(0.0)), "ymax": F.least("ymax", F.lit(1.0)), "xmax": F.least("xmax", F.lit(1.0))})
    b = b.withColumns({"class_id": class_id(F.col("symbol_type")), "x_center": (F.col("xmin") + F.col("xmax")) / 2, "y_center": (F.col("ymin") + F.col("ymax")) / 2, "width": F.col("xmax") - F.col("xmin"), "height": F.col("ymax") - F.col("ymin")})
    return b.withColumn("line", F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "x_center", "y_center", "width", "height"))


def coco(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes with class_id, bbox_x, bbox_y, bbox_w, bbox_h, area in pixels, to two places."""
    px = {"bbox_x": F.col("xmin") * width, "bbox_y": F.col("ymin") * height, "bbox_w": (F.col("xmax") - F.col("xmin")) * width, "bbox_h": (F.col("ymax") - F.col("ymin")) * height}
    b = boxes.withColumns({k: F.round(v, 2) for k, v in px.items()})
    return b.withColumns({"class_id": class_id(F.col("symbol_type")), "area": F.round(px["bbox_w"] * px["bbox_h"], 2)})


def crop_box(width: Column, height: Column, box: list[Column]) -> Column:
    """struct(left, top, right, bottom): a box of page shares (ymin, xmin, ymax, xmax) in pixels, inside the image, one pixel at least."""
    ymin, xmin, ymax, xmax = box
    px = lambda s, n: (s * n).cast("int")
    left = F.greatest(F.lit(0), F.least(px(xmin, width), width.cast("int") - 1))
    top = F.greatest(F.lit(0), F.least(px(ymin, height), height.cast("int") - 1))
    right = F.greatest(left + 1, F.least(px(xmax, width), width.cast("int")))
    bottom = F.greatest(top + 1, F.least(px(ymax, height), height.cast("int")))
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))
