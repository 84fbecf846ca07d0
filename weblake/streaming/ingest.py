"""Mask log files as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weblake.plans.mask import FILES_PER_BATCH, mask_batch, mask_keys
from weblake.session import few_listing_tasks, scratch, settings, stage_table
from weblake.sources.logfiles import MAX_FILE_AGE, stream_lines
from weblake.sources.masked import commit_message_rejects
from weblake.sources.notices import judged_entries


# A stream's session plans without adaptive execution, for the sake of its state. What a batch writes has none, and needs
# it: the rebalancing shuffle is left out otherwise, and every task writes a file for each day.
ADAPTIVE = "spark.sql.adaptive.enabled"


def start_masking(
    spark: SparkSession,
    source_dir: str,
    masked_path: str,
    checkpoint: str,
    fields: Sequence[str] | None = None,
    on_error: str = "quarantine",
    max_files: int = 1000,
    every: str | None = None,
    clean_source: str = "off",
    archive_dir: str | None = None,
    glob: str = "*",
) -> StreamingQuery:
    """Mask every new file once. Runs on ``every`` interval, or until no file is left if None.

    The file source hands over whole files, so row numbers are complete within a batch. A batch that
    is replayed after a failure overwrites what its first try wrote. Batches are named by the
    checkpoint, so streams with other checkpoints add to the same layer. ``fields`` declares the
    layout and saves a second scan of every file: the form for production.
    """

    adaptive = spark.conf.get(ADAPTIVE)

    def take(lines: DataFrame, batch_id: int) -> None:
        with settings(lines.sparkSession, {ADAPTIVE: adaptive}):
            mask_batch(lines, masked_path, batch_id, f"stream {checkpoint}", fields, on_error)

    lines = stream_lines(spark, source_dir, max_files, glob, clean_source, archive_dir)
    writer = lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    # The stream keeps the settings it starts with.
    with few_listing_tasks(spark):
        return writer.trigger(**trigger).start()


def stream_messages(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A message table (Parquet: message_id, body) as it grows; ``arrived`` is when its file was written.

    A message's time of arrival never lags far behind the ones before, however late it was sent.
    """
    reader = spark.readStream.schema("message_id string, body string").option("maxFilesPerTrigger", max_files)
    return reader.option("maxFileAge", MAX_FILE_AGE).parquet(path).select(
        "message_id", "body", F.col("_metadata.file_modification_time").alias("arrived")
    )


def start_masking_notified(
    messages: DataFrame,
    bucket: str,
    root: str,
    masked_path: str,
    checkpoint: str,
    prefix: str = "",
    delay: str = "1 day",
    every: str | None = None,
    per_batch: int = FILES_PER_BATCH,
    **options,
) -> StreamingQuery:
    """Mask the objects that a stream of notifications (message_id, body, arrived) names, each once.

    Messages are delivered at least once and in any order. Keys seen within ``delay`` (by arrival) are dropped by the
    stream's state, whose size that bounds; a key that comes later than that meets the commit log, which knows all
    files ever masked. A batch that died is repeated and masks what is not committed yet. Messages and entries
    that name no object of ``bucket`` under ``prefix`` are kept with the reason (``read_message_rejects``).
    """
    name, spark = f"notices {checkpoint}", messages.sparkSession
    adaptive = spark.conf.get(ADAPTIVE)
    entries = judged_entries(messages, bucket, prefix)
    # A rejected entry is known by its message, a good one by its object.
    once = F.when(F.col("reason").isNull(), F.struct("object_key", F.lit(None).cast("string").alias("message_id"), F.lit(-1).alias("entry"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("object_key"), "message_id", F.coalesce("entry", F.lit(-1)).alias("entry"))
    )
    fresh = entries.withColumn("once", once).withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["once"])

    def take(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession, "notices") as staging:
            # Written once, so that the state is not read again for each use.
            found = stage_table(batch.drop("once"), staging)
            with settings(found.sparkSession, {ADAPTIVE: adaptive}):
                commit_message_rejects(found.where("reason is not null"), masked_path, name, batch_id)
                keys = found.where("reason is null").select("object_key")
                mask_keys(keys, root, masked_path, f"{name} {batch_id}", per_batch, **options)

    writer = fresh.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    # The stream keeps the settings it starts with.
    with few_listing_tasks(spark):
        return writer.trigger(**trigger).start()
