"""What depends on a text alone is worked out once for each distinct text, not for each item that has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tagloom.session import stage


def told(rows: DataFrame, column: str = "text", **made: Column) -> DataFrame:
    """`column` and `made` for each distinct value, null left out. Written: what reads it meets plain columns, so no pattern is run again beyond the join."""
    return stage(rows.where(rows[column].isNotNull()).select(column).distinct().select(column, *[c.alias(k) for k, c in made.items()]), "texts")
