"""Masking job: raw lines in, numbered rows of truncated addresses out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.operators.numbering import chunk_of, number_rows
from weblake.session import existing, scratch, scratch_path, stage_table
from weblake.sources.logfiles import POSITION, parse_files, read_lines, spread_fields
from weblake.sources.masked import commit_batch, next_batch, no_rows, read_commits
from weblake.sources.notices import created_keys, manifest

# A file up to this size is numbered in one task; a larger one in runs of 2^20 rows.
WHOLE_FILE_BYTES = 32 * 1024 * 1024

# Files that notifications name and that are masked as one batch.
FILES_PER_BATCH = 10_000

FATAL = ["no_header", "field_count", "bad_address"]
ON_ERROR = ("quarantine", "drop_file", "fail")


def mask_lines(
    lines: DataFrame,
    fields: Sequence[str] | None = None,
    on_error: str = "quarantine",
    whole_file_bytes: int = WHOLE_FILE_BYTES,
    staging: str | None = None,
) -> DataFrame:
    """Masked, numbered rows of log lines; rows are numbered per (source file, record date).

    ``on_error``, for rows that are worse than a bad date: "quarantine" keeps a note of them (see
    :mod:`weblake.sources.masked`) and the other rows of their files; "drop_file" keeps the notes and
    nothing else of their files, whose sources are then never done; "fail" raises, so that nothing is
    written. ``staging``: a folder the caller discards when the result is no longer read.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}, not {on_error!r}")
    staging = staging or scratch_path(lines.sparkSession, "masking")
    rows_of = parse_files(lines, f"{staging}/headers", fields)
    fatal = F.col("reject").isin(FATAL)
    if on_error == "drop_file":
        # A name for each failing file; joined by broadcast only if Spark measures it as small.
        failing = stage_table(rows_of(lines).where(fatal).select("src_file").distinct(), f"{staging}/failing")
    # Both uses of the large files read the same file set, so that positions agree between them.
    small = rows_of(lines.where(F.col("src_bytes") <= whole_file_bytes))
    large = rows_of(lines.where(F.col("src_bytes") > whole_file_bytes))
    unsplit = F.lit(-1).cast("long")
    small = small.withColumn("part_block", unsplit).withColumn("part_chunk", unsplit)
    large = large.withColumn("part_block", F.col("block_start")).withColumn("part_chunk", chunk_of(F.col("pos")))
    rows = small.unionByName(large)
    if on_error == "drop_file":
        rows = rows.join(failing.withColumn("_failed", F.lit(True)), "src_file", "left")
        rows = rows.where(F.col("_failed").isNull() | F.coalesce(fatal, F.lit(False))).drop("_failed")
    numbered = number_rows(rows, ["src_file", "log_date"], ["part_block", "part_chunk"], POSITION, to_count=large)
    if on_error == "fail":
        message = F.concat(F.col("reject"), F.lit(" in "), F.col("src_file"))
        numbered = numbered.withColumn(
            "reject", F.when(fatal, F.raise_error(message).cast("string")).otherwise(F.col("reject"))
        )
    return spread_fields(numbered.drop("part_block", "part_chunk", *POSITION))


def mask_batch(
    lines: DataFrame,
    masked_path: str,
    batch_id: int,
    run: str = "files",
    fields: Sequence[str] | None = None,
    on_error: str = "quarantine",
    rebalance: bool = True,
) -> int:
    """Mask lines as one batch of the masked layer, all or nothing; returns its place in the commit log.

    ``run`` and ``batch_id`` name the batch: the same name again replaces it, if it has the same sources.
    """
    spark = lines.sparkSession
    with scratch(spark, "masking") as staging:
        rows = mask_lines(lines, fields, on_error, staging=staging)
        return commit_batch(rows, masked_path, run, batch_id, rebalance)


def mask_files(
    spark: SparkSession,
    paths: Sequence[str],
    masked_path: str,
    batch_id: int,
    fields: Sequence[str] | None = None,
    on_error: str = "quarantine",
    rebalance: bool = True,
    recursive: bool = False,
    run: str = "files",
) -> int:
    """:func:`mask_batch` for files and folders. Paths that have vanished are skipped."""
    there = existing(spark, paths)
    if not there:
        return commit_batch(no_rows(spark), masked_path, run, batch_id)
    return mask_batch(read_lines(spark, *there, recursive=recursive), masked_path, batch_id, run, fields, on_error, rebalance)


def mask_keys(
    keys: DataFrame, root: str, masked_path: str, run: str, per_batch: int = FILES_PER_BATCH, **options
) -> list[int]:
    """Mask the files that a table of object keys names, in batches of about ``per_batch`` files; returns their numbers.

    Keys meet a listing of ``root`` by a join. Files that the commit log holds already are left out, whoever masked
    them, so a key that is named again, or a run that died and comes back, masks nothing twice. Only the
    paths of one batch come to the driver, as they do for any read.
    """
    spark = keys.sparkSession
    if keys.isEmpty():
        return []
    done = read_commits(spark, masked_path).select("src_file")
    with scratch(spark, "manifest") as staging:
        files = stage_table(manifest(keys, root).join(done, "src_file", "left_anti"), f"{staging}/files")
        count = files.count()
        batches = max(1, -(-count // per_batch))
        parted = files.withColumn("batch", F.pmod(F.xxhash64("path"), F.lit(batches)))
        parted = stage_table(parted, f"{staging}/batches", ["batch"]) if batches > 1 else parted
        numbers: list[int] = []
        first = next_batch(spark, masked_path, run)
        for batch in range(batches if count else 0):
            paths = sorted(r.path for r in parted.where(F.col("batch") == batch).select("path").collect())
            if paths:
                lines = read_lines(spark, *paths)
                numbers.append(mask_batch(lines, masked_path, first + len(numbers), run, **options))
        return numbers


def mask_created(
    messages: DataFrame, bucket: str, root: str, masked_path: str, batch_id: int, prefix: str = "", run: str = "notices", **options
) -> list[int]:
    """Mask the objects that a batch of notifications names: key ``k`` is the file ``{root}/k``.

    Objects that have vanished are skipped; what is skipped among the messages is :func:`message_rejects`.
    """
    return mask_keys(created_keys(messages, bucket, prefix), root, masked_path, f"{run} {batch_id}", **options)
