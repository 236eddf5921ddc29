"""Tag keys: the form in which two spellings of one tag are equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_key(c: Column | str) -> Column:
    """The tag's ASCII letter groups and digit groups, upper-cased, sorted, joined by a blank.

    Two tags are the same tag if their keys are equal: case, order and whatever stands between
    the groups don't count, repeated groups do. A null tag gives null, one without any ASCII
    letter or digit the empty text; callers treat both as no tag.
    """
    c = F.col(c) if isinstance(c, str) else c
    groups = F.regexp_extract_all(c, F.lit("[A-Za-z]+|[0-9]+"), F.lit(0))
    return F.array_join(F.array_sort(F.split(F.upper(F.array_join(groups, " ")), " ")), " ")


#: The same in DuckDB, for oracles.
def tag_key_sql(c: str) -> str:
    return f"array_to_string(list_sort(regexp_extract_all(upper(regexp_replace({c}, '[^A-Za-z0-9]', ' ', 'g')), '[A-Z]+|[0-9]+')), ' ')"
