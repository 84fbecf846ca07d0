"""Maintenance: re-sorting and compacting tables, retiring sources that are fully masked."""

from __future__ import annotations

import datetime
import itertools
import logging
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.functions import source_key
from weblake.plans.key_index import INDEX_BYTES, write_index
from weblake.schema import DIMENSIONS, FACT_SORT, FACT_TABLE
from weblake.session import discard, folder_names, rename, stage_table
from weblake.sources.logfiles import is_data_line
from weblake.sources.notices import finished_sources
from weblake.warehouse import TABLES, Warehouse, version_name

LOG = logging.getLogger(__name__)

# Files deleted at the same time.
DELETERS = 16
# About the size of a file that compaction writes.
FILE_BYTES = 256 * 1024 * 1024


def table_bytes(spark: SparkSession, path: str) -> int:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(target).getLength() if files.exists(target) else 0


def file_count(spark: SparkSession, path: str, file_bytes: int = FILE_BYTES) -> int:
    """How many files of about ``file_bytes`` hold what is under ``path``."""
    return max(1, -(-table_bytes(spark, path) // file_bytes))


def compact_fact(warehouse: Warehouse, days: Sequence[datetime.date]) -> None:
    """Rewrite days as few files, sorted by time across and within files.

    Dynamic overwrite writes the new files aside and swaps the folders of the days at commit.
    """
    rows = warehouse.fact().where(F.col("log_date").isin(list(days)))
    path = warehouse.path(FACT_TABLE)
    files = sum(file_count(warehouse.spark, f"{path}/log_date={day}") for day in days)
    order = ["log_date", *FACT_SORT]
    (
        rows.repartitionByRange(max(1, files), *order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("log_date")
        .parquet(path)
    )


def compact_dimension(warehouse: Warehouse, name: str, file_bytes: int = FILE_BYTES, index_bytes: int = INDEX_BYTES) -> None:
    """Rewrite a dimension sorted by natural key, as a new version that is renamed into place when it is whole.
    A version of ``index_bytes`` or more gets an index.

    Until the rename the table is untouched; a job that dies before it leaves a hidden folder only. The
    version before stays for readers that have begun, the one before that goes.
    """
    spark, key = warehouse.spark, DIMENSIONS[name].key
    table, current = warehouse.table(name), warehouse.version(name)
    aside = f"{warehouse.home(name)}/.next"
    files = file_count(spark, warehouse.path(name), file_bytes)
    copy = stage_table(table.repartitionByRange(files, key).sortWithinPartitions(key), aside)
    before, after = table.count(), copy.count()
    if before != after:
        raise RuntimeError(f"the copy of {name} in {aside} has {after} rows, not {before}")
    number = int(current[2:])
    rename(spark, aside, f"{warehouse.home(name)}/{version_name(number + 1)}")
    for old in folder_names(spark, warehouse.home(name)):
        if old.startswith("v=") and old < version_name(number):
            discard(spark, f"{warehouse.home(name)}/{old}")
            discard(spark, f"{warehouse.home(name)}/_index/{old}")
    if table_bytes(spark, warehouse.path(name)) >= index_bytes:
        write_index(warehouse, name)


def compact_table(warehouse: Warehouse, table: str, days: Sequence[datetime.date]) -> str:
    """Compact one table; a failure is logged and returned as a status, never raised."""
    try:
        if table == FACT_TABLE:
            compact_fact(warehouse, days)
        else:
            compact_dimension(warehouse, table)
    except Exception:
        LOG.exception("compaction of %s failed", table)
        return "FAILED"
    return "FINISHED"


def compact_all(warehouse: Warehouse, days: Sequence[datetime.date]) -> dict[str, str]:
    """Compact the six tables one after another, the fact table for ``days``, those that were loaded.

    A table that fails doesn't keep the others from their turn; after that it is an error, so that what was left
    as it was is never taken for compacted. The log has the causes.
    """
    statuses = {table: compact_table(warehouse, table, days) for table in TABLES}
    failed = [table for table, status in statuses.items() if status != "FINISHED"]
    if failed:
        raise RuntimeError(f"compaction failed: {', '.join(failed)}")
    return statuses


def source_status(lines: DataFrame, commits: DataFrame) -> DataFrame:
    """Per source file: data lines, masked and rejected rows, and whether it may be retired.

    A source is done when one batch of the commit log accounts for every one of its lines; sources
    without data lines are done as well.
    """
    raw = lines.groupBy("src_file").agg(F.count_if(is_data_line()).alias("raw_rows"))
    best = commits.groupBy("src_file").agg(F.max(F.struct(F.col("kept") + F.col("rejected"), "kept", "rejected")).alias("best"))
    counts = best.select("src_file", F.col("best.kept").alias("masked_rows"), F.col("best.rejected").alias("rejected_rows"))
    return (
        raw.join(counts, "src_file", "left")
        .na.fill(0, ["masked_rows", "rejected_rows"])
        .withColumn("done", F.col("raw_rows") == F.col("masked_rows") + F.col("rejected_rows"))
    )


def notified_status(messages: DataFrame, bucket: str, prefix: str, lines: DataFrame, commits: DataFrame) -> DataFrame:
    """:func:`source_status` of the sources that notifications about masked objects name."""
    named = finished_sources(messages, bucket, prefix)
    key = source_key(F.col("src_file"))
    return source_status(lines.join(named, key == F.col("source_key"), "left_semi"), commits)


def retire_sources(spark: SparkSession, status: DataFrame) -> int:
    """Delete the sources that are done; returns how many there were.

    Paths arrive a batch at a time, so the list is never held whole.
    """
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()

    def delete(row) -> bool:
        path = path_of(row.src_file)
        return bool(path.getFileSystem(conf).delete(path, False))

    retired = 0
    with ThreadPoolExecutor(max_workers=DELETERS) as pool:
        for rows in itertools.batched(status.where("done").select("src_file").toLocalIterator(), 1000):
            retired += sum(pool.map(delete, rows))
    return retired
