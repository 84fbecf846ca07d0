"""Daily load: masked rows of some days become fact rows and new dimension rows."""

from __future__ import annotations

import datetime
import functools
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblake.functions import target_day_of
from weblake.operators.keys import KeySplit, split_keys
from weblake.operators.lookup import BROADCAST_BYTES, resolve
from weblake.operators.observed import CHECK_SCHEMA, LoadChecks
from weblake.plans.key_index import narrowed_dimensions
from weblake.schema import (
    BYTE_LIMIT,
    COLUMN_TYPE,
    DIMENSIONS,
    Dimension,
    FACT_COLUMNS,
    FACT_SORT,
    FACT_TABLE,
    NO_VALUE,
    RAW_COLUMNS,
    STAGE_COLUMNS,
    STAGE_NOT_NULL,
)
from weblake.session import discard, run_together, scratch
from weblake.sources.masked import affected_days, has_day, last_batch, read_commits, read_masked
from weblake.warehouse import Warehouse

# The raw columns a stage row is made of.
USED_COLUMNS = ["date", "time"] + [c for c in STAGE_COLUMNS if c in COLUMN_TYPE]


# What a bulk load takes for a number; a cast alone would also take '1.5f', ' 7 ' or 'NaN'.
_WHOLE = "'^[+-]?[0-9]+$'"
_DECIMAL = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
SHAPE = {"bigint": _WHOLE, "int": _WHOLE, "smallint": _WHOLE, "float": _DECIMAL}

_DATETIME = "try_cast(try_cast(date as date) || ' ' || time as timestamp_ntz)"


def typed(column: str) -> str:
    """A masked text field as its staged type; null for the no-value mark.

    The mark is taken out first: a failing try_cast is as slow as the exception it catches.
    """
    kind = COLUMN_TYPE[column]
    text = f"nullif({column}, '{NO_VALUE}')"
    return text if kind == "string" else f"try_cast({text} as {kind})"


def _value_checks(columns: Sequence[str]) -> list[tuple[str, str]]:
    """Conditions on presence and type, never null, with what is wrong where one does not hold."""
    checks = [(f"{_DATETIME} is not null", "no valid datetime")]
    for c in columns:
        if COLUMN_TYPE[c] != "string":
            kind = COLUMN_TYPE[c]
            fits = f"try_cast({c} as {kind}) is not null" + (f" and {c} rlike {SHAPE[kind]}" if kind in SHAPE else "")
            absent = f"({c} <> '{NO_VALUE}' and {fits})" if c in STAGE_NOT_NULL else f"({c} is null or {c} = '{NO_VALUE}' or ({fits}))"
            checks.append((absent, f"bad value in {c}"))
        elif c in STAGE_NOT_NULL:
            checks.append((f"({c} is not null and {c} <> '{NO_VALUE}')", f"no {c}"))
    return checks


def _limited(columns: Sequence[str]) -> dict[int, list[str]]:
    limits: dict[int, list[str]] = {}
    for c in columns:
        if c in BYTE_LIMIT:
            limits.setdefault(BYTE_LIMIT[c], []).append(c)
    return limits


def _loadable(columns: Sequence[str]) -> str:
    """All checks as one short condition; lengths are compared once per limit."""
    lengths = [
        f"coalesce(greatest({', '.join(f'octet_length({c})' for c in same)}), 0) <= {limit}"
        for limit, same in _limited(columns).items()
    ]
    return " and ".join([holds for holds, _ in _value_checks(columns)] + lengths)


def load_rejects(masked: DataFrame) -> DataFrame:
    """Rows whose used fields do not fit the stage, with the first reason found."""
    cases = [f"when not {holds} then '{message}'" for holds, message in _value_checks(USED_COLUMNS)]
    for limit, same in _limited(USED_COLUMNS).items():
        cases += [f"when octet_length({c}) > {limit} then '{c} is too long'" for c in same]
    rows = masked.selectExpr("src_file", "row_num as seq_num", f"case {' '.join(cases)} end as reason", "log_date")
    return rows.where("reason is not null")


def stage_rows(masked: DataFrame, on_error: str = "fail") -> DataFrame:
    """The 14 stage columns of masked rows, typed, with (src_file, log_date).

    "fail" checks every field of a row and raises on the first misfit, as a bulk load does;
    "quarantine" checks the fields it uses and drops misfits (see :func:`load_rejects`); "trust"
    checks nothing, for rows that have been checked, and so reads no more columns than it returns.
    The checks are plain conditions, so that they and the conversions compile into one small method.
    """
    if on_error == "fail":
        message = "concat_ws(' ', 'a row cannot be loaded: row', row_num, 'of', log_date, 'in', src_file)"
        masked = masked.where(f"case when {_loadable(RAW_COLUMNS)} then true else cast(raise_error({message}) as boolean) end")
    elif on_error == "quarantine":
        masked = masked.where(_loadable(USED_COLUMNS))
    elif on_error != "trust":
        raise ValueError(f"on_error must be 'quarantine', 'fail' or 'trust', not {on_error!r}")
    columns = {c: typed(c) for c in STAGE_COLUMNS if c in COLUMN_TYPE}
    columns["datetime"] = _DATETIME
    columns["seq_num"] = "row_num"
    # An absent referer or agent is a key of its own.
    for c in ("referer", "user_agent"):
        columns[c] = f"coalesce({c}, '{NO_VALUE}')"
    return masked.selectExpr(*[f"{columns[c]} as {c}" for c in STAGE_COLUMNS], "src_file", "log_date")


def encode(stage: DataFrame, keys: KeySplit, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Stage rows with their natural keys replaced by ids, plus ``log_date``."""
    rows = stage.select(*STAGE_COLUMNS, "log_date")
    for d in DIMENSIONS.values():
        size = keys.sizes[d.name]
        rows = resolve(
            rows, d.stage_column, keys.lookup(d.name), d.fact_column, size.bytes, size.rows, broadcast_bytes
        )
    ids = {d.fact_column: F.col(d.fact_column).cast(d.id_type) for d in DIMENSIONS.values()}
    return rows.select(*[ids.get(c, F.col(c)).alias(c) for c in FACT_COLUMNS], "log_date")


def append_dimensions(warehouse: Warehouse, keys: KeySplit) -> None:
    """Add new dimension rows, each table's in natural-key order."""

    def append(d: Dimension) -> None:
        rows = keys.fresh(d.name).select(F.col("id").cast(d.id_type).alias("id"), F.col("key").alias(d.key))
        rows.sortWithinPartitions(d.key).write.mode("append").parquet(warehouse.path(d.name))

    grown = [d for d in DIMENSIONS.values() if keys.sizes[d.name].fresh]
    run_together([functools.partial(append, d) for d in grown])


def write_fact(warehouse: Warehouse, fact: DataFrame, mode: str = "overwrite") -> None:
    """Write fact rows sorted within files. "overwrite" replaces the days present, "append" adds.

    The rebalancing shuffle sizes the files of each day, and Spark splits the parts of a large day.
    """
    (
        fact.hint("rebalance", "log_date")
        .sortWithinPartitions("log_date", *FACT_SORT)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("log_date")
        .parquet(warehouse.path(FACT_TABLE))
    )


def keep_checks(warehouse: Warehouse, checks: LoadChecks, days: Iterable[datetime.date]) -> None:
    """Append what a load's checks found to the table ``load_checks``."""
    rows = warehouse.spark.createDataFrame(checks.rows(), CHECK_SCHEMA).coalesce(1)
    named = rows.select(F.current_timestamp().alias("loaded_at"), F.lit(sorted(days)).alias("days"), "*")
    named.write.mode("append").parquet(warehouse.path("load_checks"))


def load_days(
    warehouse: Warehouse,
    masked: DataFrame,
    days: Sequence[datetime.date] | None = None,
    on_error: str = "fail",
    mode: str = "overwrite",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> bool:
    """Load the given days (default: all) in one pass; False if they hold no rows.

    Dimension rows are committed before fact rows: a load that dies in between leaves unused keys,
    which its next run finds and uses. The write itself counts nulls, over-long texts and lost rows (table
    ``load_checks``). With "overwrite", what an earlier load left of a covered day
    (fact rows, rejects) goes even if this load has none for it.
    """
    rows = masked if days is None else masked.where(F.col("log_date").isin(list(days)))
    covered = _days_of(rows)
    if not covered:
        return False
    warehouse.create_tables()
    stage = stage_rows(rows, on_error)
    with scratch(warehouse.spark, "keys") as staging:
        keys = split_keys(stage, functools.partial(narrowed_dimensions, warehouse), staging)
        if on_error == "fail":
            stage = stage_rows(rows, "trust")
        if keys.sizes:
            append_dimensions(warehouse, keys)
            checks = LoadChecks()
            write_fact(warehouse, checks.of_fact(encode(checks.of_stage(stage), keys, broadcast_bytes)), mode)
            keep_checks(warehouse, checks, covered)
    if on_error == "quarantine":
        (
            load_rejects(rows)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("log_date")
            .parquet(warehouse.path("load_rejects"))
        )
    if mode == "overwrite":
        loaded = covered if on_error != "quarantine" else _days_of(rows.where(_loadable(USED_COLUMNS)))
        _clear(warehouse, FACT_TABLE, covered - loaded)
    rejected = _days_of(load_rejects(rows)) if on_error == "quarantine" else set()
    _clear(warehouse, "load_rejects", covered - rejected)
    return True


def _days_of(rows: DataFrame) -> set[datetime.date]:
    """The days that rows have: one value per day."""
    return {r.log_date for r in rows.select("log_date").distinct().collect()}


def _clear(warehouse: Warehouse, table: str, days: set[datetime.date]) -> None:
    """Remove days from a table; a dynamic overwrite leaves days alone that it has no row for."""
    for day in sorted(days):
        discard(warehouse.spark, f"{warehouse.path(table)}/log_date={day}")


def load_previous_day(warehouse: Warehouse, masked: DataFrame, time: str, on_error: str = "fail") -> bool:
    """The scheduled load: the day before ``time``, if it has records."""
    day = target_day_of(time)
    return has_day(masked, day) and load_days(warehouse, masked, [day], on_error)


def load_affected(warehouse: Warehouse, masked_path: str, on_error: str = "fail") -> list[datetime.date]:
    """Reload every day touched since the last run, so that late records are not lost.

    Which days those are is read from the commit log of the masked layer, not from its rows.
    """
    warehouse.create_tables()
    spark = warehouse.spark
    state = warehouse.table("load_state").agg(F.coalesce(F.max("batch_id"), F.lit(-1)).alias("b")).first().b
    commits = read_commits(spark, masked_path)
    newest = last_batch(commits)
    days = affected_days(commits.where(F.col("batch_id") <= newest), state)
    if days:
        rows = read_masked(spark, masked_path).where(F.col("batch_id") <= newest)
        if not load_days(warehouse, rows, days, on_error):
            raise RuntimeError(f"the masked layer lacks the rows of {days}")
    if newest > state:
        mark = spark.range(1).select(F.lit(newest).cast("long").alias("batch_id"), F.current_timestamp().alias("loaded_at"))
        mark.write.mode("append").parquet(warehouse.path("load_state"))
    return days
