"""Job history as append-only events: current state, lists, counts, time lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.normalize import duration


def current(events: DataFrame, key: str, at: str, columns: list[str], tie: str) -> DataFrame:
    """key with the last value that isn't null of each column, by (at, tie): partial updates folded to the present state.

    An aggregate, so a job with a third of all events is combined before the shuffle.
    """
    return events.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(at, tie))).alias(c) for c in columns], F.max(at).alias("updated_at"))


def without(jobs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The jobs or logs that were not deleted."""
    return jobs.join(gone.select(key), key, "left_anti")


def counts(jobs: DataFrame, status: str, values: dict[str, str]) -> DataFrame:
    """One row: total and a count for each named status."""
    return jobs.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == v).alias(k) for k, v in values.items()])


def summary(jobs: DataFrame, progress: str, seconds: str, created: str) -> DataFrame:
    """The jobs with percent, duration and created (to the second) as text."""
    return jobs.withColumns({"percent": F.concat(F.floor(F.col(progress) * 100).cast("string"), F.lit("%")), "duration": duration(F.col(seconds)), "created": F.date_format(created, "yyyy-MM-dd HH:mm:ss")})


def field(c: str, path: str):
    """A value inside a JSON text; null where the text is no JSON or has no such path."""
    return F.try_variant_get(F.try_parse_json(c), path, "string")


def append(rows: DataFrame, path: str) -> None:
    """Add jobs or log entries: a new file beside the others, so nothing that is there is touched; columns may be new."""
    rows.write.mode("append").parquet(path)


def read(spark, path: str) -> DataFrame:
    """All that was appended; columns that older files lack are null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def with_logs(jobs: DataFrame, logs: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The jobs' columns with log_no and the log columns: one row a log entry in order, one without number for a job that has none.

    Rows, not an array a job: a job may have any number of entries.
    """
    from tagloom.operators.prefix import salted_prefix

    numbered = salted_prefix(logs.withColumn("__one", F.lit(1)), [key], order, "__one", "__before", bucket=F.lit(0) if len(order) > 1 else F.floor(F.col(order[0]) / 4096))
    own = numbered.select(F.col(key).alias("__key"), (F.col("__before") + 1).cast("int").alias("log_no"), *columns)
    return jobs.join(own, F.col(key) == F.col("__key"), "left").drop("__key")


def timeline(logs: DataFrame, key: str, at: str, step: str, level: str, message: str) -> DataFrame:
    """key, timestamp (text to the second), step_name, log_level, message of each log entry."""
    return logs.select(key, F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col(step).alias("step_name"), F.col(level).alias("log_level"), F.col(message).alias("message"))
