"""Checks that a table format without constraints cannot make by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblake.schema import DIMENSIONS


def _unpivot(counted: DataFrame, columns: list[str], name: str, value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias(value)) for c in columns])
    return counted.select(F.inline(pairs))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, violations) for columns that hold nulls, in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return _unpivot(counted, columns, "column_name", "violations").where("violations > 0")


def length_counts(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(column_name, violations) for text columns longer than their limit in bytes, in one pass."""
    counted = df.agg(*[F.count_if(too_long(c, n)).alias(c) for c, n in limits.items()])
    return _unpivot(counted, list(limits), "column_name", "violations").where("violations > 0")


def too_long(column: str, limit: int) -> Column:
    return F.octet_length(F.col(column)) > limit


def duplicate_keys(dims: DataFrame) -> DataFrame:
    """(dim, what, value, n) for every natural key or id that a dimension holds more than once."""
    values = F.array(
        F.struct(F.lit("key").alias("what"), F.col("key").alias("value")),
        F.struct(F.lit("id").alias("what"), F.col("id").cast("string").alias("value")),
    )
    return (
        dims.select("dim", F.inline(values))
        .groupBy("dim", "what", "value")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
    )


def fact_ids(fact: DataFrame) -> DataFrame:
    """The distinct foreign keys of a fact table as (dim, id, n); null references are left out."""
    pairs = F.array(
        *[
            F.struct(F.lit(d.name).alias("dim"), F.col(d.fact_column).cast("long").alias("id"))
            for d in DIMENSIONS.values()
        ]
    )
    return (
        fact.select(F.inline(pairs)).where("id is not null").groupBy("dim", "id").agg(F.count("*").alias("n"))
    )


def orphan_ids(fact: DataFrame, dims: DataFrame) -> DataFrame:
    """(dim, id, n) for ids of the fact table that their dimension lacks."""
    return fact_ids(fact).join(dims.select("dim", "id"), ["dim", "id"], "left_anti")
