"""Natural keys of the five dimensions: collecting, telling known from new, assigning ids.

All five are handled in one pass: a key is a row (dim, key), so one shuffle serves them all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblake.operators.numbering import dense_ids
from weblake.schema import DIMENSIONS
from weblake.session import scratch_path, stage_table

INT_MAX = 2**31 - 1


def stage_keys(stage: DataFrame) -> DataFrame:
    """The distinct natural keys of a stage as (dim, key, n), n being the rows that carry them.

    Counts are summed map-side first, so a key on a third of all rows costs one row per task.
    """
    pairs = F.array(
        *[F.struct(F.lit(d.name).alias("dim"), F.col(d.stage_column).alias("key")) for d in DIMENSIONS.values()]
    )
    return stage.select(F.inline(pairs)).groupBy("dim", "key").agg(F.count("*").alias("n"))


def dimension_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """The dimension tables as one (dim, key, id)."""
    frames = [
        tables[d.name].select(
            F.lit(d.name).alias("dim"), F.col(d.key).alias("key"), F.col("id").cast("long").alias("id")
        )
        for d in DIMENSIONS.values()
        if d.name in tables
    ]
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    return union


def known_keys(keys: DataFrame, dims: DataFrame) -> DataFrame:
    """The stage keys that have an id already: (dim, key, n, id)."""
    return keys.join(dims, ["dim", "key"])


def new_keys(keys: DataFrame, known: DataFrame) -> DataFrame:
    """The stage keys that have none: an anti-join, which also lets a null key through."""
    return keys.join(known.select("dim", "key"), ["dim", "key"], "left_anti")


def assign_ids(fresh: DataFrame, dims: DataFrame, staging: str | None = None, used: dict[str, int] | None = None) -> DataFrame:
    """Ids for new keys, continuing each dimension after its largest id: (dim, key, n, id).

    ``used``: the largest ids among rows that ``dims`` leaves out.
    """
    # One row per dimension.
    largest = {r["dim"]: r["base"] for r in dims.groupBy("dim").agg(F.max("id").alias("base")).collect()}
    for dim, base in (used or {}).items():
        largest[dim] = max(base, largest.get(dim, base))
    narrow = [d.name for d in DIMENSIONS.values() if d.id_type == T.IntegerType()]
    overflow = F.col("dim").isin(narrow) & (F.col("id") > INT_MAX)
    message = F.concat(F.lit("no INT id left in "), F.col("dim"))
    return dense_ids(fresh, "dim", "key", largest, staging).withColumn(
        "id", F.when(overflow, F.raise_error(message).cast("long")).otherwise(F.col("id"))
    )


@dataclass(frozen=True)
class KeySize:
    """Of one dimension in one load: its keys, their bytes, the rows that carry them, the new keys."""

    keys: int
    bytes: int
    rows: int
    fresh: int


@dataclass(frozen=True)
class KeySplit:
    """The keys of one load with their ids: (key, id, n, is_new), in one folder per dimension.

    ``staging`` holds the table; whoever asked for the split discards it after use.
    """

    table: DataFrame
    sizes: dict[str, KeySize]
    staging: str

    def lookup(self, dim: str) -> DataFrame:
        """(key, id, n) of one dimension, limited to the keys of this load."""
        return self.table.where(F.col("dim") == dim).select("key", "id", "n")

    def fresh(self, dim: str) -> DataFrame:
        """(key, id) of the keys that were new to the dimension."""
        return self.table.where((F.col("dim") == dim) & F.col("is_new")).select("key", "id")


def split_keys(
    stage: DataFrame, dims: DataFrame | Callable[[DataFrame], tuple[DataFrame, dict[str, int]]], staging: str | None = None
) -> KeySplit:
    """Collect the keys of ``stage``, match them with ``dims`` and assign ids to the rest.

    ``dims``: all (dim, key, id), or what gives, for the load's keys, those that may match and the largest ids of the rest.

    Each step is staged in a small table: the stage and the dimension tables are read once, and a
    small key table is broadcast to the dimensions instead of shuffling them.
    """
    staging = staging or scratch_path(stage.sparkSession, "keys")
    keys = stage_table(stage_keys(stage), f"{staging}/all")
    dims, used = dims(keys) if callable(dims) else (dims, None)
    known = stage_table(known_keys(keys, dims), f"{staging}/known")
    fresh = assign_ids(new_keys(keys, known), dims, f"{staging}/fresh", used)
    columns = ["dim", "key", "id", "n", "is_new"]
    both = known.withColumn("is_new", F.lit(False)).select(*columns).unionByName(
        fresh.withColumn("is_new", F.lit(True)).select(*columns)
    )
    table = stage_table(both, f"{staging}/ids", ["dim"])
    measured = table.groupBy("dim").agg(
        F.count("*").alias("keys"),
        F.sum(F.octet_length("key") + 16).alias("bytes"),
        F.sum("n").alias("rows"),
        F.count_if("is_new").alias("fresh"),
    )
    # One row per dimension.
    sizes = {r["dim"]: KeySize(r["keys"], r["bytes"], r["rows"], r["fresh"]) for r in measured.collect()}
    return KeySplit(table, sizes, staging)
