"""Scalar expressions over columns; all run inside the JVM."""

from weblake.functions.address import mask_address, mask_field
from weblake.functions.dates import date_path, log_date, target_day, target_day_of
from weblake.functions.text import source_key
from weblake.functions.uri import expand_index, split_first, split_last

__all__ = [
    "date_path",
    "expand_index",
    "log_date",
    "mask_address",
    "mask_field",
    "source_key",
    "split_first",
    "split_last",
    "target_day",
    "target_day_of",
]
