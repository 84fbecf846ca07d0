"""The masked layer: Parquet by record date and batch, and its gzip TSV interchange form."""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.schema import (
    CDN_FIELDS,
    MASKED_SCHEMA,
    NO_VALUE,
    RAW_COLUMNS,
    RAW_SCHEMA,
    ROW_NUMBER_FIELD,
)
from weblake.session import discard_matching, existing, scratch, stage_table

# A quote character no log holds: fields are neither quoted nor unquoted.
NO_QUOTE = "\u0000"


def read_masked(spark: SparkSession, path: str) -> DataFrame:
    """All masked rows that have a date. Filters on ``log_date`` and ``batch_id`` prune folders."""
    return _masked(spark, path).where("log_date is not null")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Rows that were not masked: where they came from and why, without any of their fields."""
    rejects = _masked(spark, path).where("log_date is null")
    return rejects.select("src_file", F.col("row_num").alias("reject_num"), "reject", "batch_id")


def _masked(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MASKED_SCHEMA).parquet(path)


def write_masked(rows: DataFrame, path: str, batch_id: int, rebalance: bool = True) -> None:
    """Write one batch. Written again, it overwrites its own folders and no others.

    ``rebalance`` sizes the files of each day by a shuffle whose large parts Spark splits; without it every
    task writes a file for each day that it holds.
    """
    batch = rows.withColumn("batch_id", F.lit(batch_id).cast("long")).select(*MASKED_SCHEMA.fieldNames())
    if rebalance:
        batch = batch.hint("rebalance", "log_date")
    (
        batch.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("log_date", "batch_id")
        .parquet(path)
    )


# --- commit log: which batch holds what ---------------------------------------------------------

CLAIM_SCHEMA = "run string, run_batch bigint, batch_id bigint"
COMMIT_SCHEMA = "src_file string, kept bigint, rejected bigint, days array<date>, run string, run_batch bigint, batch_id bigint"


def _log(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of the log. Its folder begins with an underscore, so that readers of the layer pass it by."""
    where = f"{path.rstrip('/')}/_log/{name}"
    if not existing(spark, [f"{where}/*"]):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(where)


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """One row for each source file of each batch: its kept and rejected rows and their days."""
    return _log(spark, path, "commits", COMMIT_SCHEMA)


def _claim(spark: SparkSession, path: str, run: str, run_batch: int) -> int:
    """The number of the batch in the layer: the one it had before, else the next. Written first, so that a
    run that dies and comes back finds it; one job at a time writes a layer."""
    claims = _log(spark, path, "claims", CLAIM_SCHEMA)
    own = (F.col("run") == run) & (F.col("run_batch") == run_batch)
    seen = claims.agg(F.max(F.when(own, F.col("batch_id"))).alias("own"), F.max("batch_id").alias("last")).first()
    if seen.own is not None:
        return seen.own
    number = 0 if seen.last is None else seen.last + 1
    row = spark.createDataFrame([(run, run_batch, number)], CLAIM_SCHEMA).coalesce(1)
    row.write.mode("append").parquet(f"{path.rstrip('/')}/_log/claims")
    return number


def next_batch(spark: SparkSession, path: str, run: str) -> int:
    """The batch of a run that is to be written next: the first one that is not committed."""
    done = read_commits(spark, path).where(F.col("run") == run)
    return done.agg(F.coalesce(F.max("run_batch") + 1, F.lit(0))).first()[0]


def commit_batch(rows: DataFrame, path: str, run: str, run_batch: int, rebalance: bool = True) -> int:
    """Write one batch and then its rows in the commit log; returns its number.

    The same (run, run_batch) again replaces the batch if its sources are the same; with others it is
    refused, before anything of the layer is touched, instead of silently replacing them.
    """
    spark = rows.sparkSession
    number = _claim(spark, path, run, run_batch)
    before = read_commits(spark, path).where(F.col("batch_id") == number).select("src_file")
    if before.limit(1).isEmpty():
        # What a try that died has left, of days that this one may not touch.
        discard_matching(spark, f"{path.rstrip('/')}/log_date=*/batch_id={number}")
        write_masked(rows, path, number, rebalance)
    else:
        # Staged: the check must not mask the sources again.
        with scratch(spark, "batch") as staging:
            batch = stage_table(rows, staging)
            new = batch.select("src_file").distinct()
            if not new.exceptAll(before).union(before.exceptAll(new)).limit(1).isEmpty():
                raise ValueError(f"batch {run_batch} of {run!r} holds other sources already")
            write_masked(batch, path, number, rebalance)
    sources = _batch_rows(spark, path, number).groupBy("src_file").agg(
        F.count("log_date").alias("kept"),
        F.count_if(F.col("log_date").isNull()).alias("rejected"),
        F.array_sort(F.collect_set("log_date")).alias("days"),
    )
    named = sources.withColumns({"run": F.lit(run), "run_batch": F.lit(run_batch).cast("long")})
    (
        named.withColumn("batch_id", F.lit(number).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(f"{path.rstrip('/')}/_log/commits")
    )
    return number


def _batch_rows(spark: SparkSession, path: str, number: int) -> DataFrame:
    """(src_file, log_date) of one batch, found by its folders, one for each day that it touched."""
    folders = f"{path.rstrip('/')}/log_date=*/batch_id={number}"
    if not existing(spark, [folders]):
        return spark.createDataFrame([], "src_file string, log_date date")
    rows = spark.read.schema(MASKED_SCHEMA).option("basePath", path).parquet(folders)
    return rows.select("src_file", "log_date")


MESSAGE_REJECT_SCHEMA = "message_id string, entry int, reason string, arrived timestamp, run string, run_batch bigint"


def commit_message_rejects(rejects: DataFrame, path: str, run: str, run_batch: int) -> None:
    """Keep what a batch of notifications could not use; the same batch again replaces it."""
    named = rejects.select(
        "message_id", "entry", "reason", "arrived", F.lit(run).alias("run"), F.lit(run_batch).cast("long").alias("run_batch")
    )
    folder = f"{hashlib.sha256(run.encode()).hexdigest()[:32]}-{run_batch}"
    named.write.mode("overwrite").parquet(f"{path.rstrip('/')}/_log/message_rejects/{folder}")


def read_message_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Notifications, or entries of them, that were skipped, and why."""
    where = f"{path.rstrip('/')}/_log/message_rejects/*"
    if not existing(spark, [where]):
        return spark.createDataFrame([], MESSAGE_REJECT_SCHEMA)
    return spark.read.schema(MESSAGE_REJECT_SCHEMA).parquet(where)


def no_rows(spark: SparkSession) -> DataFrame:
    """An empty batch."""
    return spark.createDataFrame([], MASKED_SCHEMA).drop("batch_id")


def has_day(masked: DataFrame, day: datetime.date) -> bool:
    """Whether any record of ``day`` exists."""
    return not masked.where(F.col("log_date") == F.lit(day)).limit(1).isEmpty()


def affected_days(commits: DataFrame, since_batch: int) -> list[datetime.date]:
    """The days touched after ``since_batch``, from the commit log. One value per day."""
    newer = commits.where(F.col("batch_id") > since_batch)
    days = newer.select(F.explode("days").alias("day")).distinct().orderBy("day")
    return [row.day for row in days.collect()]


def last_batch(commits: DataFrame) -> int:
    """The newest committed batch, -1 if there is none."""
    return commits.agg(F.coalesce(F.max("batch_id"), F.lit(-1)).alias("b")).first().b


def compact_masked(spark: SparkSession, path: str, day: datetime.date, batches: Sequence[int]) -> None:
    """Rewrite a day's files of closed batches as few: each batch keeps its folder, so the log stays true."""
    rows = _masked(spark, path).where((F.col("log_date") == F.lit(day)) & F.col("batch_id").isin(list(batches)))
    (
        rows.hint("rebalance", "log_date", "batch_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("log_date", "batch_id")
        .parquet(path)
    )


def tsv_day_path(prefix: str, day: datetime.date) -> str:
    return f"{prefix.rstrip('/')}/{day:%Y/%m/%d}/"


def export_days(masked: DataFrame, prefix: str, days: Sequence[datetime.date]) -> int:
    """Write days as gzip TSV with headers, ``{prefix}/yyyy/mm/dd/{source}``; returns the number of files.

    One job for all days: a file for each (source file, date), as the format asks for, in row order. Files
    are written aside and renamed into place, which replaces those of the same name.
    """
    spark = masked.sparkSession
    columns = [F.col("row_num").alias(ROW_NUMBER_FIELD)]
    columns += [F.col(c).alias(field) for c, field in zip(RAW_COLUMNS, CDN_FIELDS)]
    source = F.regexp_replace(F.substring_index("src_file", "/", -1), "[.]gz$", "")
    rows = masked.where(F.col("log_date").isin(list(days))).withColumns({"_day": F.col("log_date"), "_source": source})
    with scratch(spark, "tsv") as aside:
        (
            rows.repartition("_day", "_source")
            .sortWithinPartitions("_day", "_source", "src_file", "row_num")
            .select("_day", "_source", *columns)
            .write.partitionBy("_day", "_source")
            .csv(aside, sep="\t", header=True, compression="gzip", quote=NO_QUOTE, nullValue=NO_VALUE)
        )
        return _put_in_place(spark, aside, prefix.rstrip("/"))


def _put_in_place(spark: SparkSession, aside: str, prefix: str) -> int:
    """Rename ``_day=/_source=/part`` files, listed folder by folder, side by side."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    here = path_of(aside).getFileSystem(conf)

    def move(file) -> None:
        folder = file.getParent()
        day, source = folder.getParent().getName()[5:], unquote(folder.getName()[8:])
        target = path_of(f"{prefix}/{day.replace('-', '/')}/{source}.gz")
        here.mkdirs(target.getParent())
        here.delete(target, False)
        if not here.rename(file, target):
            raise OSError(f"cannot write {target}")

    files = here.globStatus(path_of(f"{aside}/_day=*/_source=*/part-*")) or []
    with ThreadPoolExecutor(max_workers=16) as pool:
        return len(list(pool.map(move, [s.getPath() for s in files])))


def read_days_tsv(spark: SparkSession, prefix: str, days: Sequence[datetime.date]) -> DataFrame:
    """Read TSV days by position and by type; '-' is null and any other misfit fails the job."""
    return spark.read.csv(
        [tsv_day_path(prefix, day) for day in days],
        schema=RAW_SCHEMA,
        sep="\t",
        header=True,
        quote="",
        nullValue=NO_VALUE,
        dateFormat="yyyy-M-d",
        mode="FAILFAST",
    )


def as_masked(raw: DataFrame) -> DataFrame:
    """TSV days in the shape of the masked layer, ready for loading; rows are filed by their own date."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(NO_VALUE)).alias(c) for c in RAW_COLUMNS]
    return raw.select(
        F.col("seq_num").alias("row_num"), *texts, F.col("date").alias("log_date"), F.lit(None).cast("string").alias("src_file")
    )
