"""Shared working space for staging tables."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

# Tasks that list many folders or files. Spark's own bound is 10,000: a task for each of them.
LISTING_TASKS = 64
# Files renamed at the same time.
RENAMERS = 16


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Settings of the session that hold meanwhile."""
    before = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def few_listing_tasks(spark: SparkSession):
    """What is listed meanwhile takes few tasks of many paths each; a smaller bound of the session stays."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    return settings(spark, {name: str(min(LISTING_TASKS, int(spark.conf.get(name))))})


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; the setting wins over a folder that was set
    on the context.

    Only a local session without that setting (tests) gets a temporary folder of its own; on a
    cluster a missing setting is an error, because executors do not share a local disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weblake-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared working folder."""
    return f"{scratch_root(spark).rstrip('/')}/weblake/{label}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back, so that later uses neither recompute nor renumber it."""
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Drop a staging folder that is no longer read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard_matching(spark: SparkSession, pattern: str) -> None:
    """Drop the folders that match a pattern."""
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(target) or []:
        files.delete(status.getPath(), True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme and authority, as listings give it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[str]:
    """A fresh path under the shared working folder that is discarded in any case."""
    path = scratch_path(spark, label)
    try:
        yield path
    finally:
        discard(spark, path)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        return []
    return [s.getPath().getName() for s in files.listStatus(target) if s.isDirectory()]


def existing(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """The paths (or patterns) that match something now; looked up side by side."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        target = path_of(path)
        found = target.getFileSystem(conf).globStatus(target)
        return found is not None and len(found) > 0

    paths = list(paths)
    with ThreadPoolExecutor(max_workers=16) as pool:
        return [p for p, ok in zip(paths, pool.map(there, paths)) if ok]


def file_name(uri: str) -> str:
    """A file's path as Hadoop takes it, from the encoded form that ``_metadata`` gives."""
    return unquote(uri)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Rename a folder or file; an error if that fails."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(old).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.rename(path_of(old), path_of(new)):
        raise OSError(f"cannot rename {old} to {new}")


def rename_all(spark: SparkSession, pairs: Iterable[tuple[str, str]]) -> int:
    """:func:`rename` of many (old, new) side by side, into folders that are made first; returns how many.

    Pairs are taken a batch at a time, so the list is never held whole.
    """
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()

    def move(pair: tuple[str, str]) -> None:
        old = path_of(pair[0])
        if not old.getFileSystem(conf).rename(old, path_of(pair[1])):
            raise OSError(f"cannot rename {pair[0]} to {pair[1]}")

    moved = 0
    with ThreadPoolExecutor(max_workers=RENAMERS) as pool:
        for batch in itertools.batched(pairs, 1000):
            for folder in {new.rsplit("/", 1)[0] for _, new in batch}:
                target = path_of(folder)
                target.getFileSystem(conf).mkdirs(target)
            moved += len(list(pool.map(move, batch)))
    return moved


def run_together(jobs: Iterable[Callable[[], object]]) -> list:
    """Submit independent Spark actions side by side, so that small ones share the cluster."""
    jobs = list(jobs)
    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]
