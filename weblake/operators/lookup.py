"""Join of a large table with a lookup table, safe for hot keys and for lookups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A lookup is broadcast only if its measured size is within this.
BROADCAST_BYTES = 64 * 1024 * 1024

# A key on at least this share of the rows is hot; there can be no more than 1/share of them.
HOT_SHARE = 1 / 1000


def resolve(
    rows: DataFrame,
    column: str,
    lookup: DataFrame,
    out: str,
    lookup_bytes: int,
    total: int,
    limit: int = BROADCAST_BYTES,
    keep_unmatched: bool = False,
) -> DataFrame:
    """Replace ``column`` by the lookup's value under the name ``out``; rows without a match go, or, with
    ``keep_unmatched``, stay with a null.

    ``lookup`` is (key, id, n) with n the rows of ``rows`` per key and ``total`` their sum. Within
    ``limit`` the lookup is broadcast. Beyond it, the at most 1/HOT_SHARE hot keys are broadcast, and
    the rest is joined by shuffle, where rows already matched, and rows without a key, are spread by a
    salt instead of gathering under one key.
    """
    if lookup_bytes <= limit:
        pair = F.broadcast(lookup.select(F.col("key").alias("_key"), F.col("id").alias("_id")))
        kind = "left" if keep_unmatched else "inner"
        joined = rows.join(pair, F.col(column) == F.col("_key"), kind).drop("_key")
    else:
        is_hot = F.col("n") >= max(1.0, total * HOT_SHARE)
        hot = lookup.where(is_hot).select(F.col("key").alias("_hot_key"), F.col("id").alias("_hot_id"))
        cold = lookup.where(~is_hot).select(F.col("key").alias("_cold_key"), F.col("id").alias("_cold_id"))
        marked = rows.join(F.broadcast(hot), F.col(column) == F.col("_hot_key"), "left")
        # These rows have no key left to look up: (null, salt) spreads them and matches nothing.
        matched = F.col("_hot_id").isNotNull() | F.col(column).isNull()
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(4096)).cast("int")
        marked = marked.withColumn("_salt", F.when(matched, salt).otherwise(F.lit(-1)))
        marked = marked.withColumn("_probe", F.when(~matched, F.col(column)))
        cold = cold.withColumn("_cold_salt", F.lit(-1))
        joined = marked.join(
            cold, (F.col("_probe") == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left"
        )
        joined = joined.withColumn("_id", F.coalesce("_hot_id", "_cold_id"))
        joined = joined if keep_unmatched else joined.where(F.col("_id").isNotNull())
        joined = joined.drop("_hot_key", "_hot_id", "_cold_key", "_cold_id", "_salt", "_cold_salt", "_probe")
    kept = [F.col(c) for c in rows.columns if c not in (column, out)]
    return joined.select(*kept, F.col("_id").alias(out))
