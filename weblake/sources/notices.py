"""Object notifications held as JSON messages in a table or a stream: what they name, and what is wrong with the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.functions import source_key
from weblake.session import few_listing_tasks, qualified

# The event kind that counts, and the name of an entry without one.
CREATED = "ObjectCreated:"
UNNAMED = "?"


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def entries_of(messages: DataFrame, body: str = "body") -> DataFrame:
    """One row per entry of every message, and one with a null ``entry`` for a message without entries.

    Messages of any shape are read as VARIANT: ``fault`` says why one has no entries ("no body", "not json",
    "no records"; test messages have none). The columns of ``messages`` but ``body`` are kept.
    """
    kept = [c for c in messages.columns if c != body]
    parsed = messages.select(*kept, F.col(body).isNotNull().alias("_there"), F.try_parse_json(F.col(body)).alias("_parsed"))
    records = F.try_variant_get("_parsed", "$.Records", "array<variant>")
    fault = (
        F.when(~F.col("_there"), "no body").when(F.col("_parsed").isNull(), "not json").when(F.col("_records").isNull(), "no records")
    )
    rows = parsed.withColumn("_records", records).select(*kept, fault.alias("fault"), F.posexplode_outer("_records").alias("entry", "_entry"))
    has_object = F.try_variant_get("_entry", "$.s3", "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get("_entry", "$.s3", "variant"))
    return rows.select(
        *kept,
        "entry",
        "fault",
        F.coalesce(_text(F.col("_entry"), "$.eventName"), F.lit(UNNAMED)).alias("event_name"),
        has_object.alias("has_object"),
        _text(F.col("_entry"), "$.s3.bucket.name").alias("bucket"),
        _text(F.col("_entry"), "$.s3.object.key").alias("object_key"),
    )


def judged_entries(messages: DataFrame, bucket: str, prefix: str = "", body: str = "body") -> DataFrame:
    """Entries with ``reason``: null where one names an object created in ``bucket`` under ``prefix``, else why it doesn't."""
    reason = (
        F.when(F.col("fault").isNotNull(), F.col("fault"))
        # A list of records that is empty holds nothing to say about.
        .when(F.col("entry").isNull(), "no entries")
        .when(~F.startswith("event_name", F.lit(CREATED)), "other event")
        .when(~F.col("has_object"), "no object")
        .when(F.col("bucket").isNull(), "no bucket")
        .when(F.col("bucket") != bucket, "other bucket")
        .when(F.col("object_key").isNull(), "no key")
        .when(~F.startswith("object_key", F.lit(prefix)), "other prefix")
    )
    return entries_of(messages, body).withColumn("reason", reason).drop("fault", "has_object")


def message_rejects(messages: DataFrame, bucket: str, prefix: str = "", body: str = "body") -> DataFrame:
    """What is skipped and why: the columns of ``messages`` but the body, the entry's place (null: the whole message), reason."""
    kept = [c for c in messages.columns if c != body]
    return judged_entries(messages, bucket, prefix, body).where("reason is not null").select(*kept, "entry", "reason")


def object_events(messages: DataFrame, body: str = "body") -> DataFrame:
    """One row per entry of every readable message; broken and test messages have no entries."""
    return entries_of(messages, body).where("entry is not null").select("event_name", "bucket", "object_key")


def created_keys(messages: DataFrame, bucket: str, prefix: str = "", body: str = "body") -> DataFrame:
    """The distinct keys of objects created in ``bucket`` under ``prefix``."""
    return judged_entries(messages, bucket, prefix, body).where("reason is null").select("object_key").distinct()


def finished_sources(messages: DataFrame, bucket: str, prefix: str, body: str = "body") -> DataFrame:
    """The source file names behind masked objects: the last segment of their keys."""
    keys = created_keys(messages, bucket, prefix, body)
    return keys.select(source_key(F.col("object_key")).alias("source_key")).where("source_key is not null").distinct()


# --- keys meet the files that are there ---------------------------------------------------------


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """path, src_file (as rows of the file name it), bytes and the object key of every file below ``root``.

    The listing is a scan whose tasks look files up; their contents are not read.
    """
    with few_listing_tasks(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = qualified(spark, root).rstrip("/") + "/"
    key = F.substring(F.col("path"), F.length(F.lit(base)) + 1, F.length("path"))
    return files.select("path", F.col("_metadata.file_path").alias("src_file"), F.col("length").alias("bytes"), key.alias("object_key"))


def manifest(keys: DataFrame, root: str) -> DataFrame:
    """The files that ``keys`` (``object_key``) name, an object each or the part files of a folder; vanished ones have none."""
    listing = file_listing(keys.sparkSession, root)
    folder = F.regexp_replace("object_key", "/[^/]*$", "")
    named = listing.withColumn("object_key", F.explode(F.array_distinct(F.array("object_key", folder))))
    return named.join(keys.select("object_key").distinct(), "object_key", "left_semi").select("path", "src_file", "bytes").distinct()
