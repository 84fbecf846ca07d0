"""What the operators of this subpackage share: input rows, word splitting and hashing, staging."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weblake.session import scratch_path, stage_table

# Rows of an Arrow batch that are turned into Python objects together.
SLICE_ROWS = 256
# Entries of a worker's memo of words. Beyond it words are computed each time; results are the same.
MEMO_WORDS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder and read back, so that later uses don't compute it again."""
    return stage_table(df, scratch_path(df.sparkSession, label))


def texts_of(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id and text alone; a null text is an empty one. Other columns, whatever their names, go.

    ``carry``: columns to keep as they are, in a struct ``carried``.
    """
    kept = [F.struct(*carry).alias("carried")] if carry else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *kept)


def keyed_texts(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``texts_of`` for operators that join by doc_id.

    A row without doc_id is no document and takes no part. Of rows that repeat a doc_id, the one with
    the smallest text counts.
    """
    texts = texts_of(docs, carry).where("doc_id is not null")
    if not texts.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return texts
    rest = [c for c in texts.columns if c != "doc_id"]
    return texts.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", "r.*")


def held_out(doc_id: str, modulus: int):
    """Whether crc32 of the doc_id as text leaves the remainder 0; null ids do not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == 0, F.lit(False))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_weblake_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="weblake-ship-")) / "weblake.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._weblake_shipped = True


# An Arrow batch holds at most so many rows, and texts of about so many bytes, or one row.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors, and with batches of bounded size.

    The bounds are settings of the session; smaller ones that it has already stay.
    """
    spark = df.sparkSession
    ship(spark)
    for name, most in BATCH_LIMITS.items():
        now = spark.conf.get(name).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    return df.mapInArrow(run, schema)


# A worker process serves one operator after another; it keeps the memo of the last one only.
_MEMOS: list[dict] = []


def hold(memo: dict) -> dict:
    """``memo``, after what other operators remembered in this worker is gone."""
    for other in _MEMOS:
        if other is not memo:
            other.clear()
    if not any(m is memo for m in _MEMOS):
        _MEMOS.append(memo)
    return memo


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """``map_batches`` over slices: ``make()`` runs once a task and returns columns -> columns.

    A struct ``carried`` in ``df`` goes through untouched; then a slice must give a row for each of its rows.
    """
    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    carries = "carried" in df.columns
    if carries:
        fields.add(df.schema["carried"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                out = step({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names) if n != "carried"})
                made = pa.RecordBatch.from_pydict(out, schema=arrow)
                if carries:
                    made = made.append_column(part.schema.field("carried"), part.column("carried"))
                yield made

    return map_batches(df, run, fields)


def words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: bytes.split() parts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split()


ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def lower_words(text: str) -> list[bytes]:
    """``words`` with A-Z in lower case and no other letter changed."""
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()


class WordHashes(dict):
    """Word -> 64-bit xxh3 hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = h
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


# One memo for each Python worker.
HASHES = WordHashes()

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words, by their order."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = h[:n].copy()
    for i in range(1, width):
        out *= _MULTIPLIER
        out += h[i : i + n]
    return mix(out)
