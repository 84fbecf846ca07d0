"""Where the star schema lives, and how its tables are created and read."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblake.operators.keys import dimension_keys
from weblake.schema import DIMENSIONS, FACT_SCHEMA, FACT_TABLE
from weblake.session import folder_names, run_together

FACT_STORED = T.StructType(FACT_SCHEMA.fields + [T.StructField("log_date", T.DateType())])
REJECT_SCHEMA = T.StructType(
    [
        T.StructField("src_file", T.StringType()),
        T.StructField("seq_num", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("log_date", T.DateType()),
    ]
)
STATE_SCHEMA = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("loaded_at", T.TimestampType())])

CHECKS_SCHEMA = T.StructType(
    [
        T.StructField("loaded_at", T.TimestampType()),
        T.StructField("days", T.ArrayType(T.DateType())),
        T.StructField("check", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("violations", T.LongType()),
    ]
)
VIEWS_SCHEMA = T.StructType(
    [
        T.StructField("page", T.IntegerType()),
        T.StructField("views", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("agents", T.BinaryType()),
        T.StructField("log_date", T.DateType()),
    ]
)
# Tables beside the six of the star.
OTHERS = {"load_rejects": REJECT_SCHEMA, "load_state": STATE_SCHEMA, "load_checks": CHECKS_SCHEMA, "page_views": VIEWS_SCHEMA}

TABLES = [FACT_TABLE, *DIMENSIONS]


def version_name(number: int) -> str:
    return f"v={number:06d}"


@dataclass(frozen=True)
class Warehouse:
    """Six Parquet tables under one root, plus rejected rows, checks and state of loads, and the page views.

    One job writes at a time; readers may run beside it. A dimension has its current rows in the folder
    of its highest version, ``{table}/v=000001``; compaction writes the next one and renames it into place.
    """

    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        """Where a table's current rows are."""
        return f"{self.home(table)}/{self.version(table)}" if table in DIMENSIONS else self.home(table)

    def home(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def version(self, table: str) -> str:
        """The current version of a dimension."""
        return max((v for v in folder_names(self.spark, self.home(table)) if v.startswith("v=")), default=version_name(1))

    def _schema(self, table: str) -> T.StructType:
        if table in DIMENSIONS:
            return DIMENSIONS[table].schema
        return {FACT_TABLE: FACT_STORED, **OTHERS}[table]

    def create_tables(self) -> None:
        """Create what is absent; tables that exist are left alone."""
        names = [*TABLES, *OTHERS]
        run_together([functools.partial(self._create, name) for name in names])

    def _create(self, table: str) -> None:
        schema = self._schema(table)
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
        writer = self.spark.range(0, 0, 1, 1).select(*nulls).write.mode("ignore")
        if "log_date" in schema.fieldNames():
            writer = writer.partitionBy("log_date")
        writer.parquet(self.path(table))

    def register_tables(self, database: str) -> None:
        """Make the six tables known to SQL users under ``database``; again after a compaction, which moves
        dimensions."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        for table in TABLES:
            schema = self._schema(table)
            columns = ", ".join(
                f"{f.name} {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL") for f in schema.fields
            )
            layout = "PARTITIONED BY (log_date)" if "log_date" in schema.fieldNames() else ""
            if table in DIMENSIONS:
                self.spark.sql(f"DROP TABLE IF EXISTS {database}.{table}")
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {database}.{table} ({columns}) USING parquet {layout} "
                f"LOCATION '{self.path(table)}'"
            )
            if layout:
                self.spark.sql(f"MSCK REPAIR TABLE {database}.{table}")
            self.spark.catalog.refreshTable(f"{database}.{table}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._schema(name)).parquet(self.path(name))

    def files_of(self, name: str, files: list[str]) -> DataFrame:
        """Some files of a table."""
        reader = self.spark.read.schema(self._schema(name))
        return reader.parquet(*files) if files else self.spark.createDataFrame([], self._schema(name))

    def fact(self) -> DataFrame:
        return self.table(FACT_TABLE)

    def dimensions(self) -> DataFrame:
        """The five dimensions as one (dim, key, id)."""
        return dimension_keys({name: self.table(name) for name in DIMENSIONS})
