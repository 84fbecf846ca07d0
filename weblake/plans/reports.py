"""Reports over the star schema."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblake.operators.lookup import BROADCAST_BYTES, resolve
from weblake.operators.quality import fact_ids
from weblake.schema import DIMENSIONS, STAGE_COLUMNS
from weblake.session import discard, scratch_path, stage_table
from weblake.warehouse import Warehouse

ID_BYTES = 24


def _lookups(fact: DataFrame, dims: DataFrame, limit: int) -> dict[str, tuple[DataFrame, int, int]]:
    """Per dimension: (key=id, id=name, n), its bytes, and the fact rows that use it.

    Only for dimensions beyond ``limit`` are the uses of their ids counted, in one pass.
    """
    named = dims.select("dim", F.col("id").alias("key"), F.col("key").alias("id"))
    measured = named.groupBy("dim").agg(F.sum(F.octet_length("id") + ID_BYTES).alias("bytes"))
    sizes = {r["dim"]: r["bytes"] for r in measured.collect()}  # a row for each dimension
    large = [name for name in DIMENSIONS if sizes.get(name, 0) > limit]
    rows: dict[str, int] = {}
    used = named.withColumn("n", F.lit(0).cast("long"))
    if large:
        counts = fact_ids(fact).where(F.col("dim").isin(large)).select("dim", F.col("id").alias("key"), "n")
        counted = named.join(counts, ["dim", "key"]).select("dim", "key", "id", "n")
        # The folder is read by the frame that is returned, so its user's cluster folder keeps it.
        table = stage_table(counted, scratch_path(fact.sparkSession, "names"), ["dim"])
        rows = {r["dim"]: r["n"] for r in table.groupBy("dim").agg(F.sum("n").alias("n")).collect()}
        used = used.where(~F.col("dim").isin(large)).unionByName(table.select("dim", "key", "id", "n"))
    return {
        name: (used.where(F.col("dim") == name).select("key", "id", "n"), sizes.get(name, 0), rows.get(name, 0))
        for name in DIMENSIONS
    }


def decode_star(fact: DataFrame, dims: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Fact rows with ids turned back into natural keys: the stage rows they came from.

    Every fact row stays: a null id, and an id that its dimension lacks, decode to null.
    """
    lookups = _lookups(fact, dims, broadcast_bytes)
    rows = fact
    for d in DIMENSIONS.values():
        lookup, size, total = lookups[d.name]
        rows = resolve(rows, d.fact_column, lookup, d.stage_column, size, total, broadcast_bytes, keep_unmatched=True)
    return rows.select(*STAGE_COLUMNS)


def daily_page_views(fact: DataFrame, pages: DataFrame) -> DataFrame:
    """Requests and bytes per day and page; ids are summed up before they are named. The path of an id
    that the dimension lacks is null."""
    views = fact.groupBy("log_date", "page").agg(F.count("*").alias("views"), F.sum("sc_bytes").alias("bytes"))
    named = views.join(pages.select(F.col("id").alias("page"), "path"), "page", "left")
    return named.select("log_date", "path", "views", "bytes")


# log2 of the buckets of a distinct-count sketch: a standard error of 1.04 / sqrt(2^12), 1.6 %, on large counts; small
# ones, of up to some hundred, are kept as they are.
SKETCH_BITS = 12


def refresh_page_views(warehouse: Warehouse, days: Sequence[datetime.date]) -> None:
    """Bring the table ``page_views`` up to date with days of the fact table: only their partitions are read and rewritten.

    Per day and page it holds requests, bytes, and a mergeable sketch of the distinct user agents.
    """
    rows = warehouse.fact().where(F.col("log_date").isin(list(days)))
    views = rows.groupBy("page", "log_date").agg(
        F.count("*").alias("views"), F.sum("sc_bytes").alias("bytes"), F.hll_sketch_agg("user_agent", SKETCH_BITS).alias("agents")
    )
    path = warehouse.path("page_views")
    (
        views.select("page", "views", "bytes", "agents", "log_date")
        .hint("rebalance", "log_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("log_date")
        .parquet(path)
    )
    # A dynamic overwrite leaves days alone that have no rows any more.
    left = {r.log_date for r in rows.select("log_date").distinct().collect()}
    for day in set(days) - left:
        discard(warehouse.spark, f"{path}/log_date={day}")


def page_totals(warehouse: Warehouse, first: datetime.date | None = None, last: datetime.date | None = None) -> DataFrame:
    """Requests, bytes and distinct user agents (estimated from the merged sketches) per page over a range of days."""
    views = warehouse.table("page_views")
    for bound, inside in ((first, F.col("log_date") >= F.lit(first)), (last, F.col("log_date") <= F.lit(last))):
        views = views if bound is None else views.where(inside)
    agents = F.hll_sketch_estimate(F.hll_union_agg("agents")).alias("agents")
    totals = views.groupBy("page").agg(F.sum("views").alias("views"), F.sum("bytes").alias("bytes"), agents)
    pages = warehouse.table("page").select(F.col("id").alias("page"), "path")
    return totals.join(pages, "page", "left").select("path", "views", "bytes", "agents")


def result_mix(fact: DataFrame, result_types: DataFrame) -> DataFrame:
    """Requests per result type and status; the type of an id that the dimension lacks is null."""
    counts = fact.groupBy(F.col("edge_response_result_type").alias("id"), "status").agg(F.count("*").alias("requests"))
    return counts.join(result_types, "id", "left").select("result_type", "status", "requests")
