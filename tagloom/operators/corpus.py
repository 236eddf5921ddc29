"""Dataset building over many drawings: metrics, splits, manifests, chat records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagloom.operators.prefix import salted_prefix
from tagloom.session import stage


def metrics(tables: dict[str, DataFrame]) -> DataFrame:
    """drawing_id and n_<table> for each table: one aggregate over all rows' tags, no join per table."""
    rows = reduce(DataFrame.unionByName, [t.select("drawing_id", F.lit(k).alias("t")) for k, t in tables.items()])
    return rows.groupBy("drawing_id").agg(*[F.count_if(F.col("t") == k).alias(f"n_{k}") for k in tables])


def corpus_summary(m: DataFrame, status: str = "status") -> DataFrame:
    """One row: averages of the counts over successes; successes by all entries."""
    ok = F.col(status) == "success"
    return m.agg(*[F.avg(F.when(ok, F.col(c))).alias(c.replace("n_", "avg_", 1)) for c in m.columns if c.startswith("n_")], (F.count_if(ok) / F.count(F.lit(1))).alias("success_rate"))


def numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """rows with their place from 0 in the order of any columns: range partitions in order, counted apart, so no task sorts the whole table."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(rows.repartitionByRange(n, *order).withColumns({"__b": F.spark_partition_id(), "__all": F.lit(1), "__one": F.lit(1)}), "ranged")
    return salted_prefix(ranged, ["__all"], order, "__one", out, bucket=F.col("__b")).drop("__all", "__one", "__b")


def split(rows: DataFrame, order: list[str], share: float = 0.8) -> DataFrame:
    """rows with `part`: train for the first share of rows in order, val for the rest. The order may be of any type."""
    placed = numbered(rows, order, "__place")
    n = placed.count()
    return placed.withColumn("part", F.when(F.col("__place") < int(n * share), "train").otherwise("val")).drop("__place")


def annotation_ids(boxes: DataFrame, images: DataFrame, idx: str = "box_idx") -> DataFrame:
    """boxes with image_id and ann_id: images (drawing_id, part) are numbered from 0, train before val, and the boxes run through them."""
    first = numbered(images.select("drawing_id", "part", F.when(F.col("part") == "train", 0).otherwise(1).alias("__p")), ["__p", "drawing_id"], "image_id").select(F.col("drawing_id").alias("i_drawing"), "image_id")
    j = boxes.join(first, F.col("drawing_id") == F.col("i_drawing")).drop("i_drawing")
    return numbered(j, ["image_id", idx], "ann_id")


def patch_offset(c):
    """struct(x, y) of a patch's place in its file name (..._x120_y40.png); null without one."""
    x, y = F.regexp_extract(c, r"_x([0-9]+)_y[0-9]+\.png$", 1), F.regexp_extract(c, r"_x[0-9]+_y([0-9]+)\.png$", 1)
    return F.when(x != "", F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")))


def chat_records(items: DataFrame, least: int = 3, most_chars: int = 8000, image: Column | None = None) -> DataFrame:
    """drawing_id, part, n_items, record: chat records (JSON) that ask for a drawing's tags and give them.

    A drawing is cut into parts of about most_chars characters of answer, in order, so a record's
    length is bounded whatever the drawing's. Drawings with fewer than `least` items are left out.
    `image` is the page's address.
    """
    size = F.length("tag") + F.length("classification") + 32
    bucket = F.struct("ord.class_no", F.floor(F.col("ord.item") / 4096)) if isinstance(items.schema["ord"].dataType, StructType) else F.floor(F.col("ord") / 4096)
    cut = salted_prefix(items, ["drawing_id"], ["ord"], size, "__before", bucket=bucket)
    enough = items.groupBy(F.col("drawing_id").alias("e_drawing")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    cut = cut.join(enough, F.col("drawing_id") == F.col("e_drawing"), "left_semi")
    tags = cut.groupBy("drawing_id", F.floor(F.col("__before") / most_chars).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("ord", "tag", "classification"))).alias("t"))
    answer = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["tag"].alias("tag"), x["classification"].alias("classification"))).alias("items")))
    turn = lambda who, what: F.struct(F.lit(who).alias("role"), what.alias("content"))
    page = F.coalesce(image if image is not None else F.lit(None).cast("string"), F.concat(F.lit("drawing-"), F.col("drawing_id").cast("string"), F.lit(".png")))
    asked = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("List the tags of this drawing, part "), (F.col("part") + 1).cast("string"), F.lit(".")).alias("value")), F.struct(F.lit("image_url").alias("type"), page.alias("value"))))
    turns = F.array(turn("system", F.lit("You read engineering drawings and answer in JSON.")), turn("user", asked), turn("model", answer))
    return tags.select("drawing_id", "part", F.size("t").alias("n_items"), F.to_json(F.struct(turns.alias("messages"))).alias("record"))


def outcome(rows: DataFrame, error: str = "error", skipped: str = "skipped") -> DataFrame:
    """rows with status: failed with an error, skipped, else success."""
    return rows.withColumn("status", F.when(F.col(error).isNotNull(), "failed").when(F.col(skipped), "skipped").otherwise("success"))
