"""Running sums and ranks over groups of any size, without one task ever holding a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def salted_prefix(df: DataFrame, keys: list[str], order: list[str], value: Column | str, out: str, salts: int | None = None, bucket: Column | None = None) -> DataFrame:
    """Add `out`: the sum of `value` over the rows before this one in its group.

    Each group is cut into buckets; a window runs inside each (group, bucket) and the buckets'
    totals, a few rows a group, are accumulated apart. The order is (bucket, *order). Without
    `bucket` a hash of the order columns spreads even the largest group evenly over `salts`
    buckets (four a shuffle partition, 64 at least), which suits ranks and allocations where any fixed order will do; with a `bucket` that
    grows with the order columns the result is the running sum in that order.

    A null value counts as 0. Null keys form a group of their own. An empty table stays empty.
    """
    v, b, tot = "__pv", "__pb", "__pt"
    if salts is None:
        salts = max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    value = F.col(value) if isinstance(value, str) else value
    df = df.withColumn(v, F.coalesce(value.cast("long"), F.lit(0))).withColumn(b, bucket if bucket is not None else F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, b).agg(F.sum(v).alias(tot)).withColumn(tot, F.coalesce(F.sum(tot).over(before), F.lit(0)))
    inner = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn(out, F.coalesce(F.sum(v).over(inner), F.lit(0)))
    t = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(b).alias("__kb"), tot)
    on = F.col(b).eqNullSafe(F.col("__kb"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(t, on).withColumn(out, F.col(out) + F.col(tot)).drop(v, b, tot, "__kb", *[f"__k{i}" for i in range(len(keys))])
