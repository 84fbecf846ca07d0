"""Numbering, key assignment and lookups against brute force, with the scale paths forced."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from event_log import masked_view
from weblake.operators.keys import assign_ids, known_keys, new_keys, split_keys, stage_keys
from weblake.operators.lookup import resolve
from weblake.operators.numbering import chunk_of, dense_ids, number_rows
from weblake.operators.quality import duplicate_keys, length_counts, null_counts, orphan_ids
from weblake.plans.load import encode
from weblake.schema import DIMENSIONS, STAGE_COLUMNS


@pytest.mark.parametrize("bits", [0, 2, 5, 20])
def test_number_rows_splits_hot_groups(spark, bits):
    rng = random.Random(bits)
    # One group has half of all rows; positions have gaps.
    rows = [(rng.choice("aaaabcd"), rng.choice([1, 2, None]), pos) for pos in rng.sample(range(5000), 1500)]
    frame = spark.createDataFrame(rows, "g string, d int, pos long").repartition(5)
    frame = frame.withColumn("chunk", chunk_of(F.col("pos"), bits))
    got = {r.pos: r.row_num for r in number_rows(frame, ["g", "d"], ["chunk"], ["pos"]).collect()}
    want, seen = {}, {}
    for g, d, pos in sorted(rows, key=lambda r: r[2]):
        seen[g, d] = seen.get((g, d), 0) + 1
        want[pos] = seen[g, d]
    assert got == want


def test_number_rows_plan_has_one_shuffle_of_the_rows(spark):
    frame = spark.range(100).select(F.lit("a").alias("g"), F.col("id").alias("pos"), F.lit("x").alias("payload"))
    frame = frame.withColumn("chunk", chunk_of(F.col("pos"), 2))
    plan = number_rows(frame, ["g"], ["chunk"], ["pos"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_the_count_before_numbering_makes_no_other_fields(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(hours=i % 48), i % 9, "view", 1.5, '{"k": 3}') for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").repartition(3)
    view = masked_view(events, 4)
    assert view._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1
    want, seen = {}, {}
    for i, ts, user, *_ in rows:
        group = user % 7, ts.date()
        want[i] = seen[group] = seen.get(group, 0) + 1
    got = sorted((r.src_file, r.log_date, r.row_num) for r in view.collect())
    assert got == sorted((f"E{rows[i][2] % 7:02d}.gz", rows[i][1].date(), n) for i, n in want.items())


def test_dense_ids_continue_per_scope(spark):
    rng = random.Random(1)
    keys = sorted({(rng.choice("xxxxyz"), f"k{rng.randrange(10_000):05d}") for _ in range(3000)})
    frame = spark.createDataFrame(keys, "dim string, key string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.dim, r.key): r.id for r in dense_ids(frame, "dim", "key", {"x": 100}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, last = {}, {"x": 100}
    for dim, key in keys:
        last[dim] = last.get(dim, 0) + 1
        want[dim, key] = last[dim]
    assert got == want


def no_dims(spark):
    return spark.createDataFrame([], "dim string, key string, id long")


def test_int_ids_do_not_overflow(spark):
    fresh = spark.createDataFrame([("page", "/a", 1), ("page", "/b", 1)], "dim string, key string, n long")
    dims = spark.createDataFrame([("page", "/old", 2**31 - 2)], "dim string, key string, id long")
    with pytest.raises(Exception, match="no INT id left in page"):
        assign_ids(fresh, dims).collect()


def test_referer_ids_are_long(spark):
    fresh = spark.createDataFrame([("referer", "-", 1)], "dim string, key string, n long")
    dims = spark.createDataFrame([("referer", "x", 2**31)], "dim string, key string, id long")
    assert [r.id for r in assign_ids(fresh, dims).collect()] == [2**31 + 1]


def test_null_keys_survive_the_anti_join(spark):
    keys = spark.createDataFrame([("page", None, 3), ("page", "/a", 1), ("page", "/b", 1)], "dim string, key string, n long")
    dims = spark.createDataFrame([("page", "/a", 1)], "dim string, key string, id long")
    left = new_keys(keys, known_keys(keys, dims))
    assert sorted(r.key or "" for r in left.collect()) == ["", "/b"]


def stage_frame(spark, n=600):
    rng = random.Random(3)
    pick = lambda values: rng.choice(values)
    rows = []
    for i in range(n):
        referer = "-" if rng.random() < 0.4 else f"https://r{rng.randrange(50)}/"
        rows.append(
            (f"2024-01-0{1 + i % 3} 00:00:0{i % 10}", i, pick("ABCD"), i, "GET", f"/p{rng.randrange(80)}", 200, referer,
             f"agent{rng.randrange(30)}", "https", 1, 0.5, pick(["Hit", "Miss"]), 0.25)
        )
    schema = (
        "datetime string, seq_num int, edge_location string, sc_bytes long, cs_method string, cs_uri_stem string, "
        "status int, referer string, user_agent string, cs_protocol string, cs_bytes long, time_taken float, "
        "edge_response_result_type string, time_to_first_byte float"
    )
    frame = spark.createDataFrame(rows, schema)
    return frame.withColumn("datetime", F.col("datetime").cast("timestamp_ntz")).withColumn(
        "log_date", F.to_date("datetime")
    )


def test_encode_gives_the_same_rows_without_broadcast(spark):
    stage = stage_frame(spark)
    keys = split_keys(stage, no_dims(spark))
    small = encode(stage, keys)
    # Nothing may be broadcast by size: hot keys take the broadcast, the rest the salted shuffle.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = encode(stage, keys, broadcast_bytes=0)
        assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert small.count() == 600


def test_resolve_mixes_hot_and_cold_keys(spark):
    rows = spark.createDataFrame(
        [(i, "hot" if i % 3 else ("gone" if i % 2 else f"k{i}")) for i in range(3000)], "i int, k string"
    )
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    ids = counts.where("k != 'gone'").select(F.col("k").alias("key"), F.xxhash64("k").alias("id"), "n")
    want = {(r.i, r.id) for r in rows.join(ids, rows.k == ids.key).select("i", "id").collect()}
    assert len(want) == 2500
    # The threshold is 1 in 1000, so 'hot' goes by broadcast and the single keys by shuffle.
    got = resolve(rows, "k", ids, "id", lookup_bytes=10**9, total=3000)
    assert {(r.i, r.id) for r in got.collect()} == want
    assert got.columns == ["i", "id"]


def test_split_keys_reports_sizes(spark):
    stage = stage_frame(spark)
    first = split_keys(stage, no_dims(spark))
    assert {d: s.rows for d, s in first.sizes.items()} == {d: 600 for d in DIMENSIONS}
    assert all(s.fresh == s.keys for s in first.sizes.values())
    dims = first.table.select("dim", "key", "id")
    again = split_keys(stage, dims)
    assert all(s.fresh == 0 for s in again.sizes.values())
    assert again.table.count() == dims.count()
    assert stage_keys(stage).agg(F.sum("n")).first()[0] == 600 * 5


def test_quality_checks(spark):
    rows = spark.createDataFrame([("é" * 3, None), ("abc", 1), (None, None)], "t string, n int")
    assert [tuple(r) for r in null_counts(rows, ["t", "n"]).orderBy("column_name").collect()] == [("n", 2), ("t", 1)]
    assert [tuple(r) for r in length_counts(rows, {"t": 5}).collect()] == [("t", 1)]
    assert length_counts(rows, {"t": 6}).count() == 0
    dims = spark.createDataFrame([("page", "/a", 1), ("page", "/a", 2), ("page", "/b", 2), ("referer", "/a", 1)], "dim string, key string, id long")
    found = {(r.what, r.value, r.n) for r in duplicate_keys(dims).collect()}
    assert found == {("key", "/a", 2), ("id", "2", 2)}


def test_orphans_ignore_null_references(spark):
    fact = spark.createDataFrame(
        [(1, 1, 1, 1, 1), (1, 1, None, 1, 1), (1, 9, None, 1, 1)],
        "edge_location int, page int, referer long, user_agent long, edge_response_result_type int",
    )
    dims = spark.createDataFrame([(d, "k", 1) for d in DIMENSIONS], "dim string, key string, id long")
    assert [tuple(r) for r in orphan_ids(fact, dims).collect()] == [("page", 9, 1)]


def test_stage_columns_are_the_fact_columns_with_keys():
    assert len(STAGE_COLUMNS) == 14 and "cs_uri_stem" in STAGE_COLUMNS and "page" not in STAGE_COLUMNS
