"""Column layouts, types and limits of the raw, masked, stage and star tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The 33 fields of the public CDN access-log format in file order, each with the
# column it is staged under, its type, and (for text) its limit in bytes.
RAW_FIELDS = [
    ("date", "date", "date", None),
    ("time", "time", "string", None),
    ("x-edge-location", "edge_location", "string", 256),
    ("sc-bytes", "sc_bytes", "bigint", None),
    ("c-ip", "c_ip", "string", 256),
    ("cs-method", "cs_method", "string", 256),
    ("cs(Host)", "cs_host", "string", 256),
    ("cs-uri-stem", "cs_uri_stem", "string", 2048),
    ("sc-status", "status", "smallint", None),
    ("cs(Referer)", "referer", "string", 2048),
    ("cs(User-Agent)", "user_agent", "string", 2048),
    ("cs-uri-query", "cs_uri_query", "string", 256),
    ("cs(Cookie)", "cs_cookie", "string", 256),
    ("x-edge-result-type", "edge_result_type", "string", 256),
    ("x-edge-request-id", "edge_request_id", "string", 256),
    ("x-host-header", "host_header", "string", 256),
    ("cs-protocol", "cs_protocol", "string", 256),
    ("cs-bytes", "cs_bytes", "bigint", None),
    ("time-taken", "time_taken", "float", None),
    ("x-forwarded-for", "forwarded_for", "string", 256),
    ("ssl-protocol", "ssl_protocol", "string", 256),
    ("ssl-cipher", "ssl_cipher", "string", 256),
    ("x-edge-response-result-type", "edge_response_result_type", "string", 256),
    ("cs-protocol-version", "cs_protocol_version", "string", 256),
    ("fle-status", "fle_status", "string", 256),
    ("fle-encrypted-fields", "fle_encrypted_fields", "string", 256),
    ("c-port", "c_port", "int", None),
    ("time-to-first-byte", "time_to_first_byte", "float", None),
    ("x-edge-detailed-result-type", "edge_detailed_result_type", "string", 256),
    ("sc-content-type", "sc_content_type", "string", 256),
    ("sc-content-len", "sc_content_len", "bigint", None),
    ("sc-range-start", "sc_range_start", "bigint", None),
    ("sc-range-end", "sc_range_end", "bigint", None),
]

# Markers of the log format.
COMMENT_MARK = "#"
FIELDS_MARK = "#Fields:"
NO_VALUE = "-"
ROW_NUMBER_FIELD = "row_num"

CDN_FIELDS = [field for field, _, _, _ in RAW_FIELDS]
RAW_COLUMNS = [column for _, column, _, _ in RAW_FIELDS]
COLUMN_TYPE = {column: kind for _, column, kind, _ in RAW_FIELDS}
BYTE_LIMIT = {column: limit for _, column, _, limit in RAW_FIELDS if limit}

_SPARK_TYPE = {
    "date": T.DateType(),
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "smallint": T.ShortType(),
    "float": T.FloatType(),
}

# The interchange TSV: row number first, then the 33 fields, read by position.
RAW_SCHEMA = T.StructType(
    [T.StructField("seq_num", T.IntegerType())]
    + [T.StructField(column, _SPARK_TYPE[kind]) for _, column, kind, _ in RAW_FIELDS]
)

# The masked layer keeps every field as text. Rejected rows have no date and no payload, only the
# reason; they sit in the null date partition of the same table.
MASKED_SCHEMA = T.StructType(
    [T.StructField("src_file", T.StringType()), T.StructField("row_num", T.IntegerType())]
    + [T.StructField(column, T.StringType()) for column in RAW_COLUMNS]
    + [
        T.StructField("reject", T.StringType()),
        T.StructField("log_date", T.DateType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
MASKED_COLUMNS = MASKED_SCHEMA.fieldNames()


@dataclass(frozen=True)
class Dimension:
    """One dimension table: its name, natural-key column, id type and the stage column it encodes."""

    name: str
    key: str
    id_type: T.DataType
    stage_column: str
    fact_column: str
    limit: int

    @property
    def schema(self) -> T.StructType:
        return T.StructType(
            [T.StructField("id", self.id_type, False), T.StructField(self.key, T.StringType(), False)]
        )


# The five dimension tables.
DIMENSIONS = {
    d.name: d
    for d in [
        Dimension("referer", "url", T.LongType(), "referer", "referer", 2048),
        Dimension("page", "path", T.IntegerType(), "cs_uri_stem", "page", 2048),
        Dimension("edge_location", "code", T.IntegerType(), "edge_location", "edge_location", 256),
        Dimension("user_agent", "user_agent", T.LongType(), "user_agent", "user_agent", 2048),
        Dimension(
            "result_type",
            "result_type",
            T.IntegerType(),
            "edge_response_result_type",
            "edge_response_result_type",
            256,
        ),
    ]
}

# The fact table, in column order; only the referer may be null.
FACT_TABLE = "access_log"
FACT_SCHEMA = T.StructType(
    [
        T.StructField("datetime", T.TimestampNTZType(), False),
        T.StructField("seq_num", T.IntegerType(), False),
        T.StructField("edge_location", T.IntegerType(), False),
        T.StructField("sc_bytes", T.LongType(), False),
        T.StructField("cs_method", T.StringType(), False),
        T.StructField("page", T.IntegerType(), False),
        T.StructField("status", T.ShortType(), False),
        T.StructField("referer", T.LongType(), True),
        T.StructField("user_agent", T.LongType(), False),
        T.StructField("cs_protocol", T.StringType(), False),
        T.StructField("cs_bytes", T.LongType(), False),
        T.StructField("time_taken", T.FloatType(), False),
        T.StructField("edge_response_result_type", T.IntegerType(), False),
        T.StructField("time_to_first_byte", T.FloatType(), False),
    ]
)
FACT_COLUMNS = FACT_SCHEMA.fieldNames()
FACT_NOT_NULL = [f.name for f in FACT_SCHEMA.fields if not f.nullable]
FACT_SORT = ["datetime", "seq_num"]

# The stage holds the fact columns with natural keys still in place of ids.
STAGE_COLUMNS = ["cs_uri_stem" if c == "page" else c for c in FACT_COLUMNS]
STAGE_NOT_NULL = [c for c in STAGE_COLUMNS if c not in ("referer", "user_agent")]
