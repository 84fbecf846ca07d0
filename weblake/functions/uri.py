"""Request-path splitting and index-page expansion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rest(text: Column, head: Column) -> Column:
    return F.substring(text, F.length(head) + 1, F.length(text))


def split_first(text: Column, delimiter: str) -> tuple[Column, Column]:
    """What precedes the first delimiter, and what starts with it ('' if there is none)."""
    head = F.substring_index(text, delimiter, 1)
    return head, _rest(text, head)


def split_last(text: Column, delimiter: str) -> tuple[Column, Column]:
    """As :func:`split_first`, at the last delimiter."""
    after = F.length(F.substring_index(text, delimiter, -1)) + len(delimiter)
    head = F.when(F.contains(text, F.lit(delimiter)), F.left(text, F.length(text) - after)).otherwise(text)
    return head, _rest(text, head)


def expand_index(uri: Column) -> Column:
    """Point a path without a file name at its ``index.html``; query and fragment stay."""
    before_fragment, fragment = split_first(uri, "#")
    path, query = split_first(before_fragment, "?")
    folder, segment = split_last(path, "/")
    suffix = (
        F.when(F.contains(segment, F.lit(".")), F.lit(""))
        .when(F.endswith(segment, F.lit("/")), F.lit("index.html"))
        .otherwise(F.lit("/index.html"))
    )
    return F.concat(folder, segment, suffix, query, fragment)
