"""Recognised items as a stream: whole drawings per batch, or running counts with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagloom.operators import classify, dedup
from tagloom.sources.readers import ITEMS


def item_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Items from files as they appear. A drawing's items must lie in one file, so that each batch has whole drawings."""
    return spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def classify_stream(items: DataFrame, target: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Classify and fold each batch of whole drawings into target/batch=<n>.

    A batch that is run again after a failure overwrites its own folder, so results come once.
    """

    def one(batch: DataFrame, n: int) -> None:
        out = dedup.fold_aliases(classify.classify(batch))
        out.write.mode("overwrite").parquet(f"{target}/batch={n}")
        if after:
            after(batch.sparkSession.read.parquet(f"{target}/batch={n}"), n)

    return items.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_counts(events: DataFrame, at: str, key: str, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Events per key and window of event time; rows later than `late` behind the newest are left to a batch correction, and the state stays bounded."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
