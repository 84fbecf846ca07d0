"""Raw access-log files: gzip or plain text whose columns are named by a header in each file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.functions import log_date, mask_field
from weblake.schema import CDN_FIELDS, COMMENT_MARK, FIELDS_MARK, RAW_COLUMNS
from weblake.session import few_listing_tasks, stage_table

# A per-file header table of up to this many bytes is broadcast; beyond it the rows are joined by file,
# spread over SALTS tasks per file.
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32
# Files older than this against the newest one seen are ignored by a stream: a thousand years, so none.
MAX_FILE_AGE = "365000d"

POSITION = ["block_start", "pos"]


def read_lines(spark: SparkSession, *paths: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """The lines of log files with their origin. Files that vanish meanwhile are skipped."""
    reader = (
        spark.read.option("ignoreMissingFiles", "true")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
    )
    with few_listing_tasks(spark):
        lines = reader.text(list(paths))
    return _with_origin(lines)


def stream_lines(
    spark: SparkSession,
    path: str,
    max_files: int = 1000,
    glob: str = "*",
    clean_source: str = "off",
    archive_dir: str | None = None,
) -> DataFrame:
    """As :func:`read_lines`, for files as they arrive. ``clean_source`` retires consumed files."""
    reader = (
        spark.readStream.option("maxFilesPerTrigger", max_files)
        .option("ignoreMissingFiles", "true")
        .option("pathGlobFilter", glob)
        .option("cleanSource", clean_source)
        .option("maxFileAge", MAX_FILE_AGE)
    )
    if archive_dir:
        reader = reader.option("sourceArchiveDir", archive_dir)
    return _with_origin(reader.text(path))


def _with_origin(text: DataFrame) -> DataFrame:
    return text.select(
        "value",
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_size").alias("src_bytes"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def with_position(lines: DataFrame) -> DataFrame:
    """Add ``pos``: (block_start, pos) orders the lines of a file as they stand in it."""
    return lines.withColumn("pos", F.monotonically_increasing_id())


def file_headers(lines: DataFrame) -> DataFrame:
    """(src_file, header): the first header of each file that has one, from the header lines alone."""
    headers = with_position(lines).where(F.startswith("value", F.lit(FIELDS_MARK)))
    return headers.groupBy("src_file").agg(F.min_by("value", F.struct(*POSITION)).alias("header"))


def is_data_line() -> Column:
    return ~F.startswith("value", F.lit(COMMENT_MARK)) & (F.col("value") != "")


def parse_files(lines: DataFrame, staging: str, fields: Sequence[str] | None = None):
    """A function that turns (any part of) ``lines`` into masked columns; see :func:`masked_rows`.

    Rows of a file without a header are rejected. With ``fields`` the layout is declared: the
    declaration stands for the header of files that have none, a file that declares another layout
    fails the job, and one scan is enough, which suits streams. Without it, every file's own header is
    looked up first, which costs one more scan; ``staging`` keeps what was found and is the caller's.
    """
    if fields is not None:
        declared = FIELDS_MARK + "".join(f" {f}" for f in fields)
        return lambda part: _declared_rows(with_position(part), list(fields), declared)
    headers = stage_table(file_headers(lines), staging)
    measured = _header_bytes(headers)
    layouts = [row.header for row in headers.select("header").distinct().limit(2).collect()]
    if len(layouts) == 1:
        return lambda part: _one_layout_rows(_with_header(with_position(part), headers, measured), layouts[0].split(" ")[1:], "header")
    return lambda part: _own_layout_rows(with_position(part), headers, measured)


def _with_header(rows: DataFrame, headers: DataFrame, header_bytes: int) -> DataFrame:
    """``rows`` with the columns of their file's row in ``headers``, null where it has none."""
    if header_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(headers), "src_file", "left")
    spread = headers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod("pos", F.lit(SALTS)).cast("int"))
    return rows.join(spread, ["src_file", "salt"], "left").drop("salt")


def _header_bytes(headers: DataFrame) -> int:
    # A row holds the file's name, the slots and what a hash table adds.
    size = F.octet_length("src_file") + 4 * len(CDN_FIELDS) + 128
    return headers.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first().bytes


def _declared_rows(lines: DataFrame, fields: list[str], declared: str) -> DataFrame:
    differs = F.startswith("value", F.lit(FIELDS_MARK)) & (F.col("value") != declared)
    checked = lines.withColumn(
        "value",
        F.when(differs, F.raise_error(F.concat(F.lit("undeclared layout in "), F.col("src_file")))).otherwise(
            F.col("value")
        ),
    )
    return _one_layout_rows(checked, fields)


def _one_layout_rows(lines: DataFrame, fields: list[str], header: str | None = None) -> DataFrame:
    """Rows of files that share a layout; ``header``: a column that is null for files without one."""
    data = lines.where(is_data_line()).withColumn("parts", F.split("value", "\t"))
    whole = F.size("parts") == len(fields)
    has_header = F.col(header).isNotNull() if header else F.lit(True)
    if fields == CDN_FIELDS:
        return masked_rows(data, whole, has_header)
    slots = [fields.index(f) if f in fields else None for f in CDN_FIELDS]
    in_order = [F.lit(None).cast("string") if i is None else F.get("parts", F.lit(i)) for i in slots]
    return masked_rows(data.withColumn("_whole", whole).withColumn("parts", F.array(*in_order)), F.col("_whole"), has_header)


def _own_layout_rows(lines: DataFrame, headers: DataFrame, header_bytes: int) -> DataFrame:
    parts = F.split("header", " ")
    # A header has the mark at least, so the length is never negative.
    names = F.slice(parts, F.lit(2), F.size(parts) - 1)
    slots = headers.select(
        "src_file",
        F.size(names).alias("n_fields"),
        F.array(*[F.array_position(names, field).cast("int") - 1 for field in CDN_FIELDS]).alias("slots"),
    )
    data = lines.where(is_data_line()).withColumn("parts", F.split("value", "\t"))
    data = _with_header(data, slots, header_bytes)
    # The slot of a field the header lacks is -1, which F.get reads as null.
    in_order = F.array(*[F.get("parts", F.get("slots", F.lit(i))) for i in range(len(CDN_FIELDS))])
    data = data.withColumn("_whole", F.size("parts") == F.col("n_fields")).withColumn("parts", in_order)
    return masked_rows(data, F.col("_whole"), F.col("n_fields").isNotNull())


def masked_rows(data: DataFrame, whole: Column, has_header: Column) -> DataFrame:
    """The fields with addresses truncated, the record's own date, and why a row is rejected.

    ``data`` has the 33 fields in CDN order as the array ``parts``. They stay one array until
    :func:`spread_fields`: checks, shuffle and numbering then handle a few columns instead of 33,
    in methods small enough to be compiled. A rejected row keeps its origin only: no field of it,
    and so no address, is carried on.
    """
    masked = {c: RAW_COLUMNS.index(c) for c in ("c_ip", "forwarded_for")}
    rows = data.withColumns(
        {
            "_whole": whole,
            "_has_header": has_header,
            "_day": log_date(F.get("parts", F.lit(RAW_COLUMNS.index("date")))),
            **{c: mask_field(F.get("parts", F.lit(i))) for c, i in masked.items()},
        }
    )
    reject = (
        F.when(~F.col("_has_header"), "no_header")
        .when(~F.col("_whole"), "field_count")
        .when(F.col("c_ip").isNull() | F.col("forwarded_for").isNull(), "bad_address")
        .when(F.col("_day").isNull(), "bad_date")
    )
    rows = rows.withColumn("reject", reject)
    kept = F.col("reject").isNull()
    runs, start = [], 0
    for c, i in masked.items():
        runs += [F.slice("parts", start + 1, i - start), F.array(c)]
        start = i + 1
    fields = F.concat(*runs, F.slice("parts", start + 1, len(RAW_COLUMNS) - start))
    return rows.select(
        "src_file",
        *POSITION,
        F.when(kept, fields).alias("fields"),
        "reject",
        F.when(kept, F.col("_day")).alias("log_date"),
    )


def spread_fields(rows: DataFrame) -> DataFrame:
    """The array of fields as one column each."""
    columns = [f"get(fields, {i}) as {c}" for i, c in enumerate(RAW_COLUMNS)]
    return rows.selectExpr(*[c for c in rows.columns if c != "fields"], *columns)
