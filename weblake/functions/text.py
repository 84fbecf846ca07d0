"""Small text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_key(path: Column) -> Column:
    """The last segment of an object path; null if the path ends in a slash."""
    return F.nullif(F.substring_index(path, "/", -1), F.lit(""))
