"""Incremental sort of the fact table: only files whose key ranges overlap are merged, the others stay as they are.

Every job of this library writes sorted files, so a day is in order once its files' ranges don't overlap. A day's
files are few; their ranges come from one scan of the sort columns.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblake.plans.maintain import FILE_BYTES
from weblake.schema import FACT_SORT, FACT_TABLE
from weblake.session import discard, existing, file_name, rename, stage_table
from weblake.warehouse import Warehouse

JOURNAL_SCHEMA = "old string, aside string, target string"


def file_ranges(rows: DataFrame) -> DataFrame:
    """(log_date, file, bytes, n_rows, lo, hi) of the files that fact rows are in."""
    key = F.struct(*FACT_SORT)
    files = rows.select("log_date", *FACT_SORT, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return files.groupBy("log_date", "file", "bytes").agg(F.count("*").alias("n_rows"), F.min(key).alias("lo"), F.max(key).alias("hi"))


def overlap_groups(ranges: DataFrame) -> DataFrame:
    """``ranges`` with ``group``, the number of the run of overlapping files, and ``n_files`` in it, per day.

    Files are taken by their least key; a new run begins where it isn't below any greatest key before.
    """
    by_start = Window.partitionBy("log_date").orderBy("lo", "hi", "file")
    highest = F.max("hi").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("lo") >= highest, F.lit(True)).cast("int")
    grouped = ranges.withColumn("_begins", begins).withColumn("group", F.sum("_begins").over(by_start)).drop("_begins")
    return grouped.withColumn("n_files", F.count("*").over(Window.partitionBy("log_date", "group")))


def sort_overlapping(warehouse: Warehouse, days: Sequence[datetime.date], file_bytes: int = FILE_BYTES) -> DataFrame:
    """Merge the overlapping files of days into sorted ones. Returns (log_date, file, n_rows, rewritten) of the files before.

    The new files are written aside; then a journal names what comes and what goes, and both are done. A run that
    dies before the journal has changed nothing, one that dies after it is finished by the next (:func:`finish`).
    Between the first rename and the last deletion a reader may see rows twice, as with any folder swap.
    """
    spark, work = warehouse.spark, _work(warehouse)
    finish(warehouse)
    rows = warehouse.fact().where(F.col("log_date").isin(list(days)))
    groups = stage_table(overlap_groups(file_ranges(rows)), f"{work}/ranges")
    report = groups.select("log_date", "file", "n_rows", (F.col("n_files") > 1).alias("rewritten")).collect()
    merged = groups.where("n_files > 1")
    if any(r.rewritten for r in report):
        # A merged file's rows are found by its name; files are few, so this is a broadcast if Spark measures it as small.
        named = merged.select(F.col("file").alias("_file"), "group")
        old = rows.withColumn("_path", F.col("_metadata.file_path")).join(named, F.col("_path") == F.col("_file")).drop("_file", "_path")
        size = merged.agg(F.sum("bytes")).first()[0]
        order = ["log_date", "group", *FACT_SORT]
        (
            old.repartitionByRange(max(1, -(-size // file_bytes)), *order)
            .sortWithinPartitions(*order)
            .write.mode("overwrite")
            .partitionBy("log_date", "group")
            .parquet(f"{work}/next")
        )
        _write_journal(warehouse, merged)
    finish(warehouse)
    return spark.createDataFrame(report, "log_date date, file string, n_rows bigint, rewritten boolean")


def _work(warehouse: Warehouse) -> str:
    return f"{warehouse.path(FACT_TABLE)}/_resort"


def _write_journal(warehouse: Warehouse, merged: DataFrame) -> None:
    spark, work = warehouse.spark, _work(warehouse)
    written = spark.read.option("basePath", f"{work}/next").parquet(f"{work}/next").select("log_date", F.col("_metadata.file_path").alias("aside"))
    day = F.concat(F.lit(f"{warehouse.path(FACT_TABLE)}/log_date="), F.col("log_date").cast("string"), F.lit("/"))
    name = F.concat(F.lit("sorted-"), F.xxhash64("aside").cast("string"), F.lit("-"), F.regexp_extract("aside", "([^/]+)$", 1))
    none = F.lit(None).cast("string")
    lines = merged.select(F.col("file").alias("old"), none.alias("aside"), none.alias("target")).unionByName(
        written.distinct().select(none.alias("old"), "aside", F.concat(day, name).alias("target"))
    )
    lines.write.parquet(f"{work}/journal")


def finish(warehouse: Warehouse) -> None:
    """Finish, or clear away, what an earlier run left: files come, then files go, then the journal."""
    spark, work = warehouse.spark, _work(warehouse)
    if existing(spark, [f"{work}/journal/_SUCCESS"]):
        lines = spark.read.schema(JOURNAL_SCHEMA).parquet(f"{work}/journal")
        for line in lines.where("aside is not null").toLocalIterator():
            aside = file_name(line.aside)
            if existing(spark, [aside]):
                rename(spark, aside, line.target)
        for line in lines.where("old is not null").toLocalIterator():
            discard(spark, file_name(line.old))
    discard(spark, work)
