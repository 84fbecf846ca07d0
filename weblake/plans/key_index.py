"""An index of a dimension's version: which of its files may hold a natural key.

Written with a compaction, which leaves files of disjoint key ranges: the range of each file, and a
blocked Bloom filter of all keys as a table of 256-bit blocks, about 2.5 bytes a key. A load tests its keys first:
those the filter knows nothing of are new without a look at the dimension, and the rest decides which files are
read. Files that were appended after the compaction are not in the index and are always read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblake.operators.keys import dimension_keys
from weblake.schema import DIMENSIONS
from weblake.session import existing, run_together
from weblake.warehouse import Warehouse

# Keys a block of the filter holds on average: 16 bits a key.
KEYS_PER_BLOCK = 16
WORDS = 4
BITS = 6
# Dimensions below this size are read whole: an index would not pay.
INDEX_BYTES = 64 * 1024 * 1024

WORD_COLUMNS = [f"w{i}" for i in range(WORDS)]


def _masks(key: Column) -> list[Column]:
    """The bits of a key within its block, as one number per word."""
    spread = F.xxhash64(key, F.lit(1))
    places = [F.shiftrightunsigned(spread, 8 * i).bitwiseAND(255) for i in range(BITS)]
    out = []
    for word in range(WORDS):
        mask = F.lit(0).cast("long")
        for place in places:
            # The bit, if it lies in this word.
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
            mask = mask.bitwiseOR(F.when(F.floor(place / 64) == word, bit).otherwise(F.lit(0).cast("long")))
        out.append(mask)
    return out


def filter_blocks(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter of a column: (block, w0..w3); blocks without a key are absent."""
    rows = keys.select(F.pmod(F.xxhash64(column), F.lit(blocks)).alias("block"), *[m.alias(w) for m, w in zip(_masks(F.col(column)), WORD_COLUMNS)])
    return rows.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORD_COLUMNS])


def may_be_known(keys: DataFrame, column: str, filter_table: DataFrame, blocks: int) -> DataFrame:
    """The keys that the filter doesn't rule out: all that were put in, and few others."""
    probe = keys.withColumn("block", F.pmod(F.xxhash64(column), F.lit(blocks)))
    held = F.lit(True)
    for mask, word in zip(_masks(F.col(column)), WORD_COLUMNS):
        held = held & (mask.bitwiseAND(F.col(word)) == mask)
    return probe.join(filter_table, "block").where(held).select(*keys.columns)


def _home(warehouse: Warehouse, name: str, version: str) -> str:
    # The name begins with an underscore, so that readers pass it by.
    return f"{warehouse.home(name)}/_index/{version}"


def write_index(warehouse: Warehouse, name: str) -> None:
    """Index the current version of a dimension."""
    key, version = DIMENSIONS[name].key, warehouse.version(name)
    home, table = _home(warehouse, name, version), warehouse.table(name)
    ranges = table.select(key, "id", F.col("_metadata.file_path").alias("file")).groupBy("file").agg(
        F.min(key).alias("lo"), F.max(key).alias("hi"), F.max("id").cast("long").alias("largest"), F.count("*").alias("n")
    )
    ranges.write.mode("overwrite").parquet(f"{home}/ranges")
    count = table.count()
    blocks = max(1, -(-count // KEYS_PER_BLOCK))
    filter_blocks(table, key, blocks).withColumn("blocks", F.lit(blocks).cast("long")).write.mode("overwrite").parquet(f"{home}/filter")


@dataclass(frozen=True)
class Narrowed:
    """The files of one dimension that a load has to read, how many there are, and the largest id of those left out."""

    files: list[str]
    of: int
    largest: int | None


def narrowed(warehouse: Warehouse, name: str, keys: DataFrame) -> Narrowed:
    """The files of a dimension that may hold one of ``keys`` (``key``): a list no longer than the table's own file index."""
    spark = warehouse.spark
    files = warehouse.table(name).inputFiles()
    home = _home(warehouse, name, warehouse.version(name))
    if not existing(spark, [f"{home}/filter/_SUCCESS"]):
        return Narrowed(files, len(files), None)
    ranges = spark.read.schema("file string, lo string, hi string, largest bigint, n bigint").parquet(f"{home}/ranges")
    # Files of one folder, known by their names.
    ranges = ranges.withColumn("file", F.substring_index("file", "/", -1))
    indexed = {r.file: r.largest for r in ranges.select("file", "largest").collect()}
    blocks_of = spark.read.schema(", ".join(["block bigint"] + [f"{w} bigint" for w in WORD_COLUMNS] + ["blocks bigint"])).parquet(f"{home}/filter")
    first = blocks_of.select("blocks").first()
    hit: set[str] = set()
    if first:
        maybe = may_be_known(keys.select("key"), "key", blocks_of.drop("blocks"), first.blocks)
        # One row per file of the dimension, so its size is that of a file index.
        within = (F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi"))
        hit = {r.file for r in maybe.join(F.broadcast(ranges), within).select("file").distinct().collect()}
    names = {f: f.rsplit("/", 1)[-1] for f in files}
    kept = [f for f in files if names[f] not in indexed or names[f] in hit]
    left_out = [n for f, n in indexed.items() if f not in hit]
    return Narrowed(kept, len(files), max(left_out, default=None))


def narrowed_dimensions(warehouse: Warehouse, keys: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(dim, key, id) of the files that may hold one of the load's ``keys`` (dim, key), and the largest id of the rest by dimension."""

    def of(name: str) -> Narrowed:
        return narrowed(warehouse, name, keys.where(F.col("dim") == name))

    found = dict(zip(DIMENSIONS, run_together([functools.partial(of, name) for name in DIMENSIONS])))
    tables = {name: warehouse.files_of(name, n.files) for name, n in found.items()}
    return dimension_keys(tables), {name: n.largest for name, n in found.items() if n.largest is not None}
