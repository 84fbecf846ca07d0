"""Row numbers and dense ids without putting a whole group, or a whole table, into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblake.session import scratch_path, stage_table

# Rows with consecutive positions that are numbered together: 2^20.
CHUNK_BITS = 20


def chunk_of(pos: Column, bits: int = CHUNK_BITS) -> Column:
    """Consecutive positions in runs of at most 2^bits."""
    return F.shiftright(pos, bits)


def number_rows(
    rows: DataFrame,
    group: list[str],
    segment: list[str],
    order: list[str],
    to_count: DataFrame | None = None,
    out: str = "row_num",
) -> DataFrame:
    """Number the rows of each ``group`` from 1 in the order of ``segment`` and then ``order``.

    A group may hold any share of the table, so a task numbers one *segment* of a group: a run of
    rows that the caller bounds. What precedes a segment is counted beforehand and enters the
    running sum as one extra row at the segment's head, so no join or broadcast is needed.
    ``to_count`` are the rows of groups that have several segments (default: all rows).
    """
    counts = (rows if to_count is None else to_count).groupBy(*group, *segment).count()
    earlier = F.sum("count").over(
        Window.partitionBy(*group).orderBy(*segment).rowsBetween(Window.unboundedPreceding, -1)
    )
    heads = counts.select(*group, *segment, earlier.alias("_step")).where(F.col("_step").isNotNull())
    stepped = rows.withColumn("_step", F.lit(1).cast("long")).withColumn("_is_row", F.lit(True))
    heads = heads.withColumn("_is_row", F.lit(False))
    in_segment = Window.partitionBy(*group, *segment).orderBy("_is_row", *order)
    running = F.sum("_step").over(in_segment.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        stepped.unionByName(heads, allowMissingColumns=True)
        .withColumn(out, running)
        .where("_is_row")
        .drop("_step", "_is_row")
        .withColumn(out, F.col(out).cast("int"))
    )


def dense_ids(
    keys: DataFrame, scope: str, key: str, base: dict[str, int], staging: str | None = None, out: str = "id"
) -> DataFrame:
    """Give each distinct (scope, key) the next id of its scope, in key order.

    ``base`` is the largest id in use per scope; scopes are few. Keys are range-partitioned and
    sorted, so an id is its place in the partition plus the sizes of the partitions before. They are
    staged first: range bounds come from sampling, and a second evaluation could cut the ranges
    elsewhere.
    """
    placed = (
        keys.repartitionByRange(scope, key)
        .sortWithinPartitions(scope, key)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_place", 33))
    )
    staged = stage_table(placed, staging or scratch_path(keys.sparkSession, "new-keys"))
    # One row per range partition, plus one for every scope that starts inside a partition.
    sizes = staged.groupBy(scope, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(
        Window.partitionBy(scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    used = F.lit(0)
    for name, largest in base.items():
        used = F.when(F.col(scope) == name, F.lit(largest)).otherwise(used)
    shift = used + F.coalesce(before, F.lit(0)) - F.col("_first")
    starts = sizes.select(scope, "_part", shift.alias("_shift"))
    return (
        staged.join(F.broadcast(starts), [scope, "_part"])
        .withColumn(out, F.col("_shift") + F.col("_place") + 1)
        .drop("_part", "_place", "_shift")
    )
