"""Queries over the driver's tables, and the SQL each of them must agree with.

``queries()`` runs the library's own jobs on the access-log view of ``events`` (and on ``pages``);
jobs that write do so in the shared scratch folder.
"""

from __future__ import annotations

import dataclasses
import datetime
import functools
import sys
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import oracle
from weblake.functions import date_path, expand_index, log_date, mask_address, mask_field, split_first, split_last, target_day
from weblake.operators.keys import assign_ids, known_keys, new_keys, split_keys, stage_keys
from weblake.operators.observed import CHECK_SCHEMA, LoadChecks
from weblake.operators.quality import duplicate_keys, length_counts, null_counts, orphan_ids
from event_log import events_of, log_view, masked_view, with_addresses, write_log_files
from weblake.plans.load import encode, load_affected, load_days, load_previous_day, load_rejects, stage_rows
from weblake.plans.maintain import compact_all, compact_dimension, notified_status, source_status
from weblake.plans.maintain import retire_sources as retire
from weblake.plans.mask import mask_created, mask_files, mask_lines
from weblake.plans.reports import daily_page_views, decode_star, page_totals, refresh_page_views, result_mix
from weblake.plans.resort import sort_overlapping
from weblake.schema import CDN_FIELDS, DIMENSIONS, FACT_NOT_NULL, STAGE_COLUMNS
from weblake.session import rename_all, run_together, scratch_path, stage_table
from weblake.sources.logfiles import read_lines
from weblake.sources.masked import (
    as_masked, commit_batch, export_days, read_commits, read_days_tsv, read_masked, read_message_rejects, read_rejects,
)
from weblake.sources.notices import created_keys, file_listing, finished_sources, message_rejects
from weblake.streaming.ingest import start_masking, start_masking_notified, stream_messages
from weblake.warehouse import Warehouse

Query = Callable[[SparkSession, str], DataFrame]

# The measures of stage and fact rows are FLOAT; results are compared as DOUBLE.
MEASURES = ["time_taken", "time_to_first_byte"]


def _comparable(rows: DataFrame) -> DataFrame:
    return rows.withColumns({m: F.col(m).cast("double") for m in MEASURES})


def _stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_rows(masked_view(events_of(spark, sf_dir)), "trust")


def _no_dims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "dim string, key string, id bigint")


def _days(rows: DataFrame) -> list[datetime.date]:
    return [r.log_date for r in rows.select("log_date").distinct().orderBy("log_date").collect()]


def _masked_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view masked, numbered and written as one batch of the masked layer."""
    path = scratch_path(spark, "masked")
    commit_batch(masked_view(events_of(spark, sf_dir)), path, "view", 0)
    return read_masked(spark, path)


def _loaded(spark: SparkSession, sf_dir: str) -> Warehouse:
    """A warehouse that holds every day of the view."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    load_days(warehouse, _masked_layer(spark, sf_dir))
    return warehouse


# --- masking -----------------------------------------------------------------------------------


def mask_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_of(spark, sf_dir).select("event_id", F.expr(oracle.ADDRESS).alias("addr"))
    return rows.select(
        "event_id",
        mask_field(F.col("addr")).alias("masked_ip"),
        F.when(F.col("addr") != "-", mask_address(F.col("addr")).isNotNull()).alias("valid"),
    )


def number_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_view(events_of(spark, sf_dir)).select("src_file", "log_date", "pos", "row_num", "c_ip")


def route_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_of(spark, sf_dir).select(
        F.expr(oracle.SOURCE).alias("src_file"), log_date(F.expr(oracle.SPARK_RAW_DATE)).alias("day")
    )
    return (
        rows.groupBy("src_file", "day")
        .agg(F.count("*").alias("n_rows"))
        .select("src_file", F.coalesce(date_path(F.col("day")), F.lit("rejected")).alias("date_path"), "n_rows")
    )


def _raw_files(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "raw-logs")
    write_log_files(log_view(events_of(spark, sf_dir)), path)
    return path


def _source_name(path: Column) -> Column:
    return F.regexp_extract(path, "src=([^/]+)/", 1)


def _file_rows(masked: DataFrame) -> DataFrame:
    return masked.select(
        _source_name(F.col("src_file")).alias("src"),
        "log_date",
        "row_num",
        "time",
        "c_ip",
        "cs_uri_stem",
        F.col("sc_bytes").cast("bigint").alias("sc_bytes"),
    )


def mask_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = scratch_path(spark, "masked")
    mask_files(spark, [_raw_files(spark, sf_dir)], masked, 0)
    return _file_rows(read_masked(spark, masked))


def stream_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = scratch_path(spark, "masked")
    raw = f"{_raw_files(spark, sf_dir)}/*"
    start_masking(spark, raw, masked, scratch_path(spark, "checkpoint"), CDN_FIELDS, max_files=_few(spark, raw)).awaitTermination()
    return _file_rows(read_masked(spark, masked))


def _few(spark: SparkSession, files: str) -> int:
    """Files per micro-batch: a handful of batches at any size."""
    return -(-len(read_lines(spark, files).inputFiles()) // 4)


def two_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams, each with its own checkpoint and batch ids from 0, feed one masked layer."""
    masked, view = scratch_path(spark, "masked"), log_view(events_of(spark, sf_dir))
    for part in (F.col("src_file") < "E03", F.col("src_file") >= "E03"):
        raw = scratch_path(spark, "raw-logs")
        write_log_files(view.where(part), raw)
        start_masking(spark, f"{raw}/*", masked, scratch_path(spark, "checkpoint"), CDN_FIELDS, max_files=_few(spark, f"{raw}/*")).awaitTermination()
    return _file_rows(read_masked(spark, masked))


def _layer_counts(spark: SparkSession, masked: str) -> DataFrame:
    kept = read_masked(spark, masked).select("src_file", F.lit(None).cast("string").alias("reject"))
    both = kept.unionByName(read_rejects(spark, masked).select("src_file", "reject"))
    return both.groupBy(_source_name(F.col("src_file")).alias("src"), "reject").agg(F.count("*").alias("n_rows"))


def mixed_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch of files in two column orders and of files without a header."""
    raw, masked, view = scratch_path(spark, "raw-logs"), scratch_path(spark, "masked"), log_view(events_of(spark, sf_dir))
    write_log_files(view.where("src_file < 'E03'"), f"{raw}/usual")
    write_log_files(view.where("src_file between 'E03' and 'E05.gz'"), f"{raw}/turned", CDN_FIELDS[::-1])
    write_log_files(view.where("src_file > 'E05.gz'"), f"{raw}/bare", None)
    mask_files(spark, [raw], masked, 0, recursive=True)
    return _layer_counts(spark, masked)


def mask_bad_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row with a bad address costs its whole file; other files stand."""
    raw, masked = scratch_path(spark, "raw-logs"), scratch_path(spark, "masked")
    view = log_view(events_of(spark, sf_dir))
    write_log_files(with_addresses(view, F.col("pos") % 4001 == 7, "300.1.1.1"), raw)
    mask_files(spark, [raw], masked, 0, on_error="drop_file")
    return _layer_counts(spark, masked)


def mask_notified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only objects that notifications name are masked; one of them has vanished."""
    raw, masked = _raw_files(spark, sf_dir), scratch_path(spark, "masked")
    sources = events_of(spark, sf_dir).where("event_id div 5000 % 2 = 0").select(F.expr(oracle.RAW_NAME).alias("src")).distinct()
    keys = sources.select(F.concat(F.lit("src="), F.col("src")).alias("key")).union(spark.range(1).select(F.lit("src=gone")))
    messages = keys.select(F.expr(oracle.KEY_MESSAGE).alias("body"))
    mask_created(messages, "logs", raw, masked, 0, "src=")
    return _layer_counts(spark, masked).select("src", "n_rows")


def _flat_files(spark: SparkSession, sf_dir: str) -> str:
    """The raw files as objects named after their sources: ``{src}.gz``."""
    spread, root = _raw_files(spark, sf_dir), scratch_path(spark, "objects")
    # Dealt to few parts: each of the iterator's parts is a job.
    files = (r.path for r in file_listing(spark, spread).select("path").repartition(16).toLocalIterator())
    rename_all(spark, ((path, f"{root}/{path.rsplit('/src=', 1)[1].split('/')[0]}.gz") for path in files))
    return root


def _object_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of every other run of events, as (src, key)."""
    sources = events_of(spark, sf_dir).where("event_id div 5000 % 2 = 0").select(F.expr(oracle.RAW_NAME).alias("src")).distinct()
    return sources.select("src", F.concat("src", F.lit(".gz")).alias("key"))


def _stream_notices(spark: SparkSession, sf_dir: str) -> str:
    """A layer masked by a stream of notifications: each is delivered three times, in three orders, the last time late,
    among test messages and messages about another bucket."""
    raw, masked, table = _flat_files(spark, sf_dir), scratch_path(spark, "masked"), scratch_path(spark, "messages")
    names = stage_table(_object_names(spark, sf_dir), scratch_path(spark, "names"))
    good = names.select(F.concat(F.lit("good "), "key").alias("message_id"), F.expr(oracle.KEY_MESSAGE).alias("body"))
    test = names.select(F.concat(F.lit("test "), "key").alias("message_id"), F.lit('{"Event":"s3:TestEvent"}').alias("body"))
    other = good.select(F.concat(F.lit("other "), "message_id").alias("message_id"), F.replace("body", F.lit('"logs"'), F.lit('"other"')).alias("body"))
    for order in ("message_id", "body", "reverse(message_id)"):
        delivery = good.union(test).union(other).orderBy(F.expr(order))
        delivery.coalesce(1).write.mode("append").parquet(table)
    messages = stream_messages(spark, table, max_files=1)
    start_masking_notified(messages, "logs", raw, masked, scratch_path(spark, "checkpoint")).awaitTermination()
    return masked


def stream_notified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects masked as notifications name them, each once however often it is named."""
    rows = read_masked(spark, _stream_notices(spark, sf_dir))
    return rows.groupBy(F.regexp_extract("src_file", "([^/]+)[.]gz$", 1).alias("src")).agg(F.count("*").alias("n_rows"))


def notified_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream of notifications skipped, each message once."""
    rejects = read_message_rejects(spark, _stream_notices(spark, sf_dir))
    return rejects.groupBy("reason").agg(F.count("*").alias("n_messages"))


def message_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = events_of(spark, sf_dir).select("event_id", F.expr(oracle.NOTICE).alias("body"))
    return message_rejects(messages, "logs", "raw/")


def clean_up_notified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects left after every other one was masked and notifications about masked objects of most sources
    have had their originals deleted."""
    raw, masked = _flat_files(spark, sf_dir), scratch_path(spark, "masked")
    names = _object_names(spark, sf_dir)
    mask_created(names.select(F.expr(oracle.KEY_MESSAGE).alias("body")), "logs", raw, masked, 0)
    done = events_of(spark, sf_dir).select(F.expr(oracle.RAW_NAME).alias("src")).distinct().where("cast(substr(src, 2, 2) as int) % 3 <> 0")
    keys = done.select(F.concat(F.lit("masked/2024/01/01/"), "src", F.lit(".gz")).alias("key"))
    messages = keys.select(F.expr(oracle.KEY_MESSAGE).alias("body"))
    status = notified_status(messages, "logs", "masked/", read_lines(spark, raw), read_commits(spark, masked))
    retire(spark, status)
    return file_listing(spark, raw).select(F.regexp_extract("object_key", "^(.*)[.]gz$", 1).alias("src"))


def retire_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources may go when the rows of one date are not masked yet."""
    masked = scratch_path(spark, "masked")
    lines = read_lines(spark, _raw_files(spark, sf_dir))
    arrived = mask_lines(lines).where(F.col("log_date") != F.lit(datetime.date(2024, 1, 10)))
    commit_batch(arrived, masked, "files", 0)
    status = source_status(lines, read_commits(spark, masked))
    return status.select(
        _source_name(F.col("src_file")).alias("src"), "raw_rows", "masked_rows", "rejected_rows", "done"
    )


def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked layer as one TSV file for each source and date, read back and staged."""
    masked, prefix = _masked_layer(spark, sf_dir), scratch_path(spark, "tsv")
    days = _days(masked)
    export_days(masked, prefix, days)
    staged = stage_rows(as_masked(read_days_tsv(spark, prefix, days)), "fail")
    return _comparable(staged.select(*STAGE_COLUMNS))


# --- load --------------------------------------------------------------------------------------


def stage_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = stage_rows(masked_view(events_of(spark, sf_dir)), "quarantine")
    return _comparable(staged.drop("log_date"))


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with absent numbers and with values that do not fit."""
    changed = {c: F.expr(e) for c, e in oracle.DIRT.items()}
    return masked_view(events_of(spark, sf_dir)).withColumns(changed)


def quarantine_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparable(stage_rows(_dirty(spark, sf_dir), "quarantine").drop("log_date"))


def load_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_rejects(_dirty(spark, sf_dir)).select("src_file", "seq_num", "reason")


def reload_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third day is loaded again with rows that are all rejected, then one of them is mended."""
    masked = _masked_layer(spark, sf_dir)
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    third = masked.where(F.dayofmonth("log_date") % 3 == 0)
    load_days(warehouse, masked, on_error="quarantine")
    load_days(warehouse, third.withColumn("status", F.lit("x")), on_error="quarantine")
    load_days(warehouse, masked.where(F.dayofmonth("log_date") == 3), on_error="quarantine")
    kinds = [(warehouse.fact(), "loaded"), (warehouse.table("load_rejects"), "rejected")]
    counts = [t.groupBy("log_date").agg(F.count("*").alias("n_rows")).withColumn("kind", F.lit(k)) for t, k in kinds]
    return counts[0].unionByName(counts[1])


def _new(name: str) -> Query:
    """New keys of one dimension when the errors of the first three hours are loaded already."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = events_of(spark, sf_dir)
        early = events.where("event_type = 'error' and ts < timestamp_ntz '2024-01-01 03:00:00'")
        dims = assign_ids(stage_keys(stage_rows(masked_view(early), "trust")), _no_dims(spark))
        keys = stage_keys(_stage(spark, sf_dir)).where(F.col("dim") == name)
        return new_keys(keys, known_keys(keys, dims)).select("key", F.col("n").alias("n_rows"))

    return query


def assign_dim_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_ids(stage_keys(_stage(spark, sf_dir)), _no_dims(spark)).select("dim", "key", "id")


def encode_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = stage_rows(_masked_layer(spark, sf_dir), "trust")
    return _comparable(encode(stage, split_keys(stage, _no_dims(spark))).drop("log_date"))


def load_two_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions after two loads: the first day alone, then all the others."""
    masked = _masked_layer(spark, sf_dir)
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    load_previous_day(warehouse, masked, "2024-01-02T02:00:00Z")
    load_days(warehouse, masked.where(F.col("log_date") > F.lit(datetime.date(2024, 1, 1))))
    return warehouse.dimensions()


def reload_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows per day when some sources arrive only after a first load."""
    masked = masked_view(events_of(spark, sf_dir))
    path = scratch_path(spark, "masked")
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    late = F.col("src_file") >= "E04"
    for batch, part in enumerate([masked.where(~late), masked.where(late)]):
        commit_batch(part, path, "view", batch)
        load_affected(warehouse, path)
    return warehouse.fact().groupBy("log_date").agg(F.count("*").alias("n_rows"), F.sum("sc_bytes").alias("bytes"))


def load_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``load_two_days``, with the dimensions compacted and indexed in between."""
    masked = _masked_layer(spark, sf_dir)
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    load_previous_day(warehouse, masked, "2024-01-02T02:00:00Z")
    run_together([functools.partial(compact_dimension, warehouse, name, file_bytes=2_000, index_bytes=0) for name in DIMENSIONS])
    load_days(warehouse, masked.where(F.col("log_date") > F.lit(datetime.date(2024, 1, 1))))
    return warehouse.dimensions()


def resort_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day and half, its rows, and those in files that an incremental sort left alone: mornings were loaded once,
    afternoons in two loads that overlap."""
    masked = _masked_layer(spark, sf_dir)
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    late = F.substring("time", 1, 2) >= "12"
    for part in (~late, late & (F.col("row_num") % 2 == 0), late & (F.col("row_num") % 2 == 1)):
        load_days(warehouse, masked.where(part), mode="append")
    before = sort_overlapping(warehouse, _days(masked)).select("file")
    rows = warehouse.fact().select("log_date", "datetime", F.col("_metadata.file_path").alias("file"))
    kept = rows.join(before.withColumn("kept", F.lit(True)), "file", "left")
    return kept.groupBy("log_date", (F.hour("datetime") >= 12).alias("late")).agg(
        F.count("*").alias("n_rows"), F.count("kept").alias("kept_rows")
    )


def compact_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    warehouse = _loaded(spark, sf_dir)
    compact_all(warehouse, _days(warehouse.fact()))
    return _comparable(warehouse.fact().drop("log_date"))


def compact_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five dimensions after a compaction."""
    warehouse = _loaded(spark, sf_dir)
    compact_all(warehouse, [])
    return warehouse.dimensions()


def unsorted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table, rows that come before their predecessor in a file: files must be sorted after a load and
    after a compaction."""
    warehouse, found = _loaded(spark, sf_dir), []
    for step in ("loaded", "compacted"):
        orders = {"access_log": "datetime", **{d.name: d.key for d in DIMENSIONS.values()}}
        for name, column in orders.items():
            rows = warehouse.table(name).select(F.col(column).alias("key"), F.monotonically_increasing_id().alias("pos"), "_metadata.file_path")
            before = F.lag("key").over(Window.partitionBy("file_path").orderBy("pos"))
            wrong = rows.withColumn("wrong", F.coalesce(F.col("key") < before, F.lit(False)))
            found.append(wrong.agg(F.count_if("wrong").alias("n_wrong")).select(F.lit(f"{step} {name}").alias("checked"), "n_wrong"))
        counts = [r for frame in found for r in frame.collect()]
        found = [spark.createDataFrame(counts, "checked string, n_wrong bigint")]
        compact_all(warehouse, _days(warehouse.fact()))
    return found[0]


# --- checks ------------------------------------------------------------------------------------


def dim_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a broken copy: '/view' pages are there twice, and so is the id of every 'Hit'."""
    dims = assign_ids(stage_keys(_stage(spark, sf_dir)), _no_dims(spark)).select("dim", "key", "id")
    twice = dims.where("dim = 'page' and key like '/view/%'").withColumn("id", F.col("id") + 1_000_000_000)
    clash = dims.where("dim = 'result_type' and key = 'Hit'").withColumn("key", F.lit("Hit again"))
    return duplicate_keys(dims.unionByName(twice).unionByName(clash))


def fact_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a broken copy: the dimensions lack 'Error' and the '/click' pages."""
    warehouse = _loaded(spark, sf_dir)
    dims = warehouse.dimensions().where("not (key = 'Error' or key like '/click/%')")
    return orphan_ids(warehouse.fact(), dims)


def not_null_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a broken copy: errors lack a method, not-modified replies a byte count."""
    stage = _stage(spark, sf_dir)
    fact = encode(stage, split_keys(stage, _no_dims(spark)))
    broken = fact.withColumns(
        {
            "cs_method": F.when(F.col("status") != 500, F.col("cs_method")),
            "sc_bytes": F.when(F.col("status") != 304, F.col("sc_bytes")),
        }
    )
    return null_counts(broken, FACT_NOT_NULL)


def length_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a broken copy: long paths, and referers that exceed their limit in bytes only."""
    view = masked_view(events_of(spark, sf_dir))
    broken = view.withColumns(
        {
            "cs_uri_stem": F.expr("repeat(cs_uri_stem, 200)"),
            "referer": F.when(F.col("referer") != "-", F.repeat(F.lit("é"), 1100)).otherwise(F.col("referer")),
        }
    )
    limits = {d.stage_column: d.limit for d in DIMENSIONS.values()}
    return length_counts(broken, limits)


def observed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one write of a broken copy counts by itself: purchases lack a method, not-modified replies a byte count, paths and
    referers are too long, and the dimension lacks 'Error'."""
    view = masked_view(events_of(spark, sf_dir))
    changed = {"cs_uri_stem": "repeat(cs_uri_stem, 200)", "referer": "if(referer = '-', '-', repeat('é', 1100))"}
    stage = stage_rows(view.withColumns({c: F.expr(e) for c, e in changed.items()}), "trust")
    keys = split_keys(stage, _no_dims(spark))
    lacking = dataclasses.replace(keys, table=keys.table.where("not (dim = 'result_type' and key = 'Error')"))
    checks = LoadChecks()
    fact = encode(checks.of_stage(stage), lacking).withColumns(
        {"cs_method": F.expr("nullif(cs_method, 'POST')"), "sc_bytes": F.expr("if(status = 304, null, sc_bytes)")}
    )
    checks.of_fact(fact).write.parquet(scratch_path(spark, "broken"))
    return spark.createDataFrame([r for r in checks.rows() if r[2]], CHECK_SCHEMA)


def load_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks that two loads kept by themselves."""
    masked = _masked_layer(spark, sf_dir)
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    first = F.col("log_date") <= F.lit(datetime.date(2024, 1, 5))
    for part in (first, ~first):
        load_days(warehouse, masked.where(part))
    return warehouse.table("load_checks").groupBy("check").agg(
        F.count("*").alias("n_checks"), F.sum("violations").alias("violations"), F.sum(F.size("days")).alias("n_days")
    )


# --- locations and notifications ---------------------------------------------------------------


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.regexp_replace("url", "^[a-z]+://[^/?#]*", "").alias("uri"))


def expand_page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir).select("page_id", expand_index(F.col("uri")).alias("expanded"))


def split_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, fragment = split_first(F.col("uri"), "#")
    path, query = split_first(before, "?")
    folder, segment = split_last(path, "/")
    return _located(spark, sf_dir).select(
        "page_id",
        fragment.alias("fragment"),
        query.alias("query"),
        folder.alias("folder"),
        segment.alias("segment"),
    )


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(spark, sf_dir).select("event_id", F.expr(oracle.MESSAGE).alias("body"))


def created_object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return created_keys(_messages(spark, sf_dir), "logs")


def finished_source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished_sources(_messages(spark, sf_dir), "logs", "masked/1")


def target_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = events_of(spark, sf_dir).select("event_id", F.expr(oracle.SPARK_ISO_TIME).alias("time"))
    return times.select("event_id", target_day(F.col("time")).alias("target_day"))


# --- reports -----------------------------------------------------------------------------------


def decoded_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    warehouse = _loaded(spark, sf_dir)
    return _comparable(decode_star(warehouse.fact(), warehouse.dimensions()))


def decode_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows without a referer, and with a result type that the dimension lacks."""
    warehouse = _loaded(spark, sf_dir)
    fact = warehouse.fact().withColumn("referer", F.when(F.col("status") != 304, F.col("referer")))
    return _comparable(decode_star(fact, warehouse.dimensions().where("key <> 'Error'")))


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    warehouse = _loaded(spark, sf_dir)
    return daily_page_views(warehouse.fact(), warehouse.table("page"))


def maintained_page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per page from a view that is kept up day by day, when some sources arrive only after a first load."""
    masked, path = masked_view(events_of(spark, sf_dir)), scratch_path(spark, "masked")
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    late = F.col("src_file") >= "E04"
    for batch, part in enumerate([masked.where(~late), masked.where(late & (F.dayofmonth("log_date") > 2))]):
        commit_batch(part, path, "view", batch)
        refresh_page_views(warehouse, load_affected(warehouse, path))
    return page_totals(warehouse)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    warehouse = _loaded(spark, sf_dir)
    return result_mix(warehouse.fact(), warehouse.table("result_type"))


# --- driver contract ---------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: events masked, loaded into the star, and decoded again."""
    return decoded_star(spark, "/root/testdata/sf0.001")


def _training_data():
    """The queries of the subpackage ``llm`` and their SQL, if it is there at all."""
    try:
        from weblake.llm import queries as module
    except ModuleNotFoundError as error:
        if error.name not in ("weblake.llm", "weblake.llm.queries", "corpus_pipeline"):
            raise
        return {}, {}
    except ImportError:  # an empty folder of that name
        return {}, {}
    return module.queries(), module.oracle_sql()


def queries() -> dict[str, Query]:
    return {
        "mask_ips": mask_ips,
        "number_rows": number_rows,
        "route_by_date": route_by_date,
        "mask_log_files": mask_log_files,
        "stream_mask": stream_mask,
        "two_streams": two_streams,
        "mixed_layouts": mixed_layouts,
        "mask_bad_files": mask_bad_files,
        "mask_notified": mask_notified,
        "stream_notified": stream_notified,
        "notified_rejects": notified_rejects,
        "message_rejects": message_reject_reasons,
        "clean_up_notified": clean_up_notified,
        "tsv_round_trip": tsv_round_trip,
        "retire_sources": retire_sources,
        "stage_day": stage_day,
        "quarantine_day": quarantine_day,
        "load_reject_reasons": load_reject_reasons,
        "reload_rejected": reload_rejected,
        "new_referers": _new("referer"),
        "new_pages": _new("page"),
        "new_edge_locations": _new("edge_location"),
        "new_user_agents": _new("user_agent"),
        "new_result_types": _new("result_type"),
        "assign_dim_ids": assign_dim_ids,
        "encode_fact": encode_fact,
        "load_two_days": load_two_days,
        "reload_affected": reload_affected,
        "load_indexed": load_indexed,
        "resort_overlapping": resort_overlapping,
        "compact_fact": compact_fact,
        "compact_dims": compact_dims,
        "unsorted_files": unsorted_files,
        "dim_uniqueness": dim_uniqueness,
        "fact_orphans": fact_orphans,
        "not_null_violations": not_null_violations,
        "length_violations": length_violations,
        "observed_checks": observed_checks,
        "load_checks": load_checks,
        "expand_page_urls": expand_page_urls,
        "split_url_parts": split_url_parts,
        "created_object_keys": created_object_keys,
        "finished_source_keys": finished_source_keys,
        "target_day": target_days,
        "decode_star": decoded_star,
        "decode_nulls": decode_nulls,
        "daily_page_views": page_views,
        "maintained_page_views": maintained_page_views,
        "result_mix": results,
        **_training_data()[0],
    }


def oracle_sql() -> dict[str, str]:
    return oracle.statements() | _training_data()[1]
