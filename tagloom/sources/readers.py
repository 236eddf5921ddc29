"""Sources: recognised items, manifests, pages as binary files, and plug-in extractors.

Recognition itself (text, vision and language models) is outside: a source is a table it left, or
a function over page images that the caller brings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "drawing_id long, item_idx long, text string, confidence double, center_x double, center_y double"
MANIFEST = "type string, filename string, width int, height int"
#: The least confidence of an item by engine.
LEAST = {"easyocr": 0.15, "paddle_v2": 0.2, "paddle_v3": 0.15, "pdf_text": 0.0}


def items(spark: SparkSession, path: str, format: str = "parquet", engine: str | None = None) -> DataFrame:
    """Recognised items; JSON and CSV are read with the schema, not guessed. Blank texts and those below the engine's confidence are left out."""
    r = spark.read.format(format)
    df = (r.schema(ITEMS).option("header", True) if format in ("json", "csv") else r).load(path)
    return df.where((F.trim("text") != "") & (F.col("confidence") >= LEAST.get(engine or "", 0.0)))


def manifest(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A dataset manifest: CSV with type, filename, width, height. The filter on type reaches the scan."""
    df = spark.read.schema(MANIFEST).option("header", True).csv(path)
    return df.where(F.col("type") == kind) if kind else df


def page_files(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,pdf}") -> DataFrame:
    """path, length, content of page files. The content column is pruned where it isn't used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def extract(pages: DataFrame, run: Callable[[str, bytes], list[dict]], keys: list[str] | None = None) -> DataFrame:
    """Items of pages by a caller's function (path, content) -> items, with what went wrong kept per page.

    Columns: path, item_idx, text, confidence, center_x, center_y, error. A page whose extraction
    raises gives one row with the error, so one bad page fails neither its task nor the job.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    for i, x in enumerate(run(path, content)):
                        out.append((path, i, x.get("text"), x.get("confidence"), x.get("center_x"), x.get("center_y"), None))
                except Exception as e:  # noqa: BLE001
                    out.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "item_idx", "text", "confidence", "center_x", "center_y", "error"]).astype({"item_idx": "Int64", "confidence": "Float64", "center_x": "Float64", "center_y": "Float64"})

    return pages.select("path", "content").mapInPandas(each, "path string, item_idx long, text string, confidence double, center_x double, center_y double, error string")


def first_of(sources: list[DataFrame], least: list[int]) -> DataFrame:
    """Per drawing the items of the first source that has more than its `least` number of them.

    Counting is an aggregate; items are then kept by a join on (drawing, source).
    """
    both = reduce(DataFrame.unionByName, [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)])
    n = both.groupBy("drawing_id", "source_no").agg(F.count(F.lit(1)).alias("n"))
    enough = reduce(lambda c, x: c.when(F.col("source_no") == x[0], F.col("n") > x[1]), enumerate(least), F)
    pick = n.where(enough).groupBy("drawing_id").agg(F.min("source_no").alias("source_no"))
    return both.join(pick, ["drawing_id", "source_no"], "left_semi").drop("source_no")
