"""Daily load, reload, quarantine, maintenance and reports on files written by the tests."""

import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from logs import head, row, write
from weblake.operators.quality import duplicate_keys, orphan_ids
from weblake.plans.load import load_affected, load_days, load_previous_day, load_rejects, stage_rows
from weblake.plans.maintain import compact_all, compact_fact, compact_table
from weblake.plans.mask import mask_files
from weblake.plans.reports import daily_page_views, decode_star, result_mix
from weblake.schema import DIMENSIONS, STAGE_COLUMNS
from weblake.sources.masked import as_masked, export_days, read_days_tsv, read_masked
from weblake.warehouse import TABLES, Warehouse

D1, D2 = datetime.date(2022, 11, 1), datetime.date(2022, 11, 2)


@pytest.fixture
def lake(spark, tmp_path):
    """A masked layer fed by ``add`` and a warehouse."""

    class Lake:
        masked_path = str(tmp_path / "masked")
        warehouse = Warehouse(spark, str(tmp_path / "warehouse"))
        batches = 0

        def add(self, *records):
            path = write(tmp_path / "raw" / f"{self.batches}.gz", head() + list(records))
            mask_files(spark, [path], self.masked_path, self.batches)
            self.batches += 1
            return self.masked

        @property
        def masked(self):
            return read_masked(spark, self.masked_path)

    return Lake()


def day(n, date, **values):
    return [row(date=date, time=f"00:{i // 60:02d}:{i % 60:02d}", cs_uri_stem=f"/p{i % 7}", **values) for i in range(n)]


def contents(frame):
    return sorted(map(str, frame.collect()))


def test_loading_a_day_twice_changes_nothing(lake):
    masked = lake.add(*day(20, "2022-11-01"), *day(5, "2022-11-02"))
    assert load_days(lake.warehouse, masked, [D1])
    fact, dims = contents(lake.warehouse.fact()), contents(lake.warehouse.dimensions())
    assert len(fact) == 20
    assert load_days(lake.warehouse, masked, [D1])
    assert (contents(lake.warehouse.fact()), contents(lake.warehouse.dimensions())) == (fact, dims)


def test_append_mode_duplicates_as_a_plain_insert_does(lake):
    masked = lake.add(*day(20, "2022-11-01"))
    load_days(lake.warehouse, masked, [D1])
    load_days(lake.warehouse, masked, [D1], mode="append")
    assert lake.warehouse.fact().count() == 40


def test_a_day_without_records_is_a_no_op(lake):
    masked = lake.add(*day(3, "2022-11-02"))
    assert not load_previous_day(lake.warehouse, masked, "2022-11-02T02:00:00Z")
    assert load_previous_day(lake.warehouse, masked, "2022-11-03T02:00:00Z")
    assert lake.warehouse.fact().count() == 3


def test_ids_stay_when_days_are_added(lake):
    masked = lake.add(*day(10, "2022-11-01"), row(date="2022-11-02", cs_uri_stem="/a-new-page", cs_User_Agent="x"))
    load_days(lake.warehouse, masked, [D1])
    before = {tuple(r) for r in lake.warehouse.dimensions().collect()}
    load_days(lake.warehouse, masked, [D2])
    after = {tuple(r) for r in lake.warehouse.dimensions().collect()}
    assert before < after
    assert after - before == {("page", "/a-new-page", 8)}
    assert duplicate_keys(lake.warehouse.dimensions()).count() == 0
    assert orphan_ids(lake.warehouse.fact(), lake.warehouse.dimensions()).count() == 0


def test_decoding_the_star_gives_the_stage_back(lake):
    masked = lake.add(*day(30, "2022-11-01"), row(date="2022-11-02", c_ip="-"), *day(4, "2022-11-02", sc_status="404"))
    load_days(lake.warehouse, masked)
    stage = stage_rows(masked).select(*STAGE_COLUMNS)
    decoded = decode_star(lake.warehouse.fact(), lake.warehouse.dimensions())
    assert contents(decoded) == contents(stage)
    shuffled = decode_star(lake.warehouse.fact(), lake.warehouse.dimensions(), broadcast_bytes=0)
    assert contents(shuffled) == contents(stage)


def test_absent_referer_and_agent_are_keys_and_absent_numbers_are_null(lake):
    masked = lake.add(row(date="2022-11-01"))
    load_days(lake.warehouse, masked)
    keys = {(r.dim, r.key) for r in lake.warehouse.dimensions().collect()}
    assert {("referer", "-"), ("user_agent", "-")} <= keys
    fact = lake.warehouse.fact().first()
    assert (fact.datetime, fact.seq_num, fact.status, fact.sc_bytes) == (datetime.datetime(2022, 11, 1, 3, 4, 5), 1, 200, 5120)


BAD = {
    "bad value in sc_bytes": {"sc_bytes": "many"},
    "bad value in status": {"sc_status": "99999"},
    "no valid datetime": {"time": "25:00:00"},
    "no cs_uri_stem": {"cs_uri_stem": "-"},
    "no edge_location": {"x_edge_location": "-"},
    "no edge_response_result_type": {"x_edge_response_result_type": "-"},
    "cs_uri_stem is too long": {"cs_uri_stem": "/" + "é" * 1024},
    "cs_method is too long": {"cs_method": "G" * 257},
}


@pytest.mark.parametrize("reason", list(BAD))
def test_misfit_rows(lake, reason):
    masked = lake.add(row(date="2022-11-01"), row(date="2022-11-01", **BAD[reason]))
    assert [r.reason for r in load_rejects(masked).collect()] == [reason]
    with pytest.raises(Exception, match="a row cannot be loaded: row 2 of 2022-11-01 in .*0.gz"):
        load_days(lake.warehouse, masked)
    assert lake.warehouse.fact().count() == 0 and lake.warehouse.dimensions().count() == 0
    load_days(lake.warehouse, masked, on_error="quarantine")
    assert lake.warehouse.fact().count() == 1
    rejects = lake.warehouse.table("load_rejects").collect()
    assert [(r.seq_num, r.reason, r.log_date) for r in rejects] == [(2, reason, D1)]


def test_unused_fields_are_checked_only_when_loads_must_fail(lake):
    masked = lake.add(row(date="2022-11-01", c_port="x"), row(date="2022-11-01"))
    with pytest.raises(Exception, match="cannot be loaded"):
        load_days(lake.warehouse, masked)
    load_days(lake.warehouse, masked, on_error="quarantine")
    assert lake.warehouse.fact().count() == 2


def test_late_files_reload_their_days(lake):
    lake.add(*day(3, "2022-11-01"))
    assert load_affected(lake.warehouse, lake.masked_path) == [D1]
    assert load_affected(lake.warehouse, lake.masked_path) == []
    lake.add(*day(2, "2022-11-01"), *day(1, "2022-11-02"))
    assert load_affected(lake.warehouse, lake.masked_path) == [D1, D2]
    assert lake.warehouse.fact().count() == 6


def test_reloading_clears_days_that_get_no_rows(lake):
    masked = lake.add(*day(2, "2022-11-01"), *day(3, "2022-11-02"))
    load_days(lake.warehouse, masked, on_error="quarantine")
    bad = masked.where(F.col("log_date") == D1).withColumn("status", F.lit("x"))
    load_days(lake.warehouse, bad, on_error="quarantine")
    assert [r.log_date for r in lake.warehouse.fact().collect()] == [D2] * 3
    assert lake.warehouse.table("load_rejects").count() == 2
    load_days(lake.warehouse, masked, [D1])
    assert lake.warehouse.fact().count() == 5
    assert lake.warehouse.table("load_rejects").count() == 0


@pytest.mark.parametrize("limit", [0, 10**9])
def test_decoding_keeps_rows_without_a_referer_and_orphans(lake, limit):
    load_days(lake.warehouse, lake.add(*day(4, "2022-11-01"), row(date="2022-11-01", sc_status="404")))
    fact = lake.warehouse.fact().withColumn("referer", F.when(F.col("status") != 404, F.col("referer")))
    dims = lake.warehouse.dimensions().where("key <> '/p0'")
    rows = decode_star(fact, dims, broadcast_bytes=limit).collect()
    assert sorted((r.status, r.referer, r.cs_uri_stem) for r in rows if r.cs_uri_stem) == [
        (200, "-", "/p1"), (200, "-", "/p2"), (200, "-", "/p3"), (404, None, "/blog/index.html"),
    ]
    assert len(rows) == 5
    assert sorted(map(str, (r.path for r in daily_page_views(fact, lake.warehouse.table("page").where("path <> '/p0'")).collect()))) == [
        "/blog/index.html", "/p1", "/p2", "/p3", "None",
    ]


@pytest.mark.parametrize("number", ["1.5f", "1e2d", " 7 ", "NaN", "0x1", "1_0", ""])
def test_numbers_have_the_shape_a_bulk_load_takes(lake, number):
    masked = lake.add(row(date="2022-11-01", time_taken=number), row(date="2022-11-01", time_taken="-1.5e-3"))
    assert [r.reason for r in load_rejects(masked).collect()] == ["bad value in time_taken"]


def test_tables_are_created_once_and_can_be_queried(spark, lake):
    lake.warehouse.create_tables()
    load_days(lake.warehouse, lake.add(*day(3, "2022-11-01")))
    lake.warehouse.create_tables()
    assert lake.warehouse.fact().count() == 3
    for _ in range(2):
        lake.warehouse.register_tables("weblake_test")
    named = spark.sql(
        "select p.path, count(*) n from weblake_test.access_log a join weblake_test.page p on a.page = p.id group by 1"
    )
    assert {tuple(r) for r in named.collect()} == {("/p0", 1), ("/p1", 1), ("/p2", 1)}
    types = dict(spark.table("weblake_test.access_log").dtypes)
    assert (types["datetime"], types["status"], types["page"], types["referer"], types["time_taken"]) == (
        "timestamp_ntz", "smallint", "int", "bigint", "float",
    )
    spark.sql("drop database weblake_test cascade")


def test_compaction_keeps_rows_and_sorts_files(lake, tmp_path):
    for _ in range(3):
        load_days(lake.warehouse, lake.add(*day(40, "2022-11-01"), *day(10, "2022-11-02")), mode="append")
    fact, dims = contents(lake.warehouse.fact()), contents(lake.warehouse.dimensions())
    folder = tmp_path / "warehouse" / "access_log" / "log_date=2022-11-01"
    files = len(list(folder.glob("*.parquet")))
    other = sorted((tmp_path / "warehouse" / "access_log" / "log_date=2022-11-02").glob("*.parquet"))
    compact_fact(lake.warehouse, [D1])
    assert sorted((tmp_path / "warehouse" / "access_log" / "log_date=2022-11-02").glob("*.parquet")) == other
    assert compact_all(lake.warehouse, [D1, D2]) == {t: "FINISHED" for t in TABLES}
    assert (contents(lake.warehouse.fact()), contents(lake.warehouse.dimensions())) == (fact, dims)
    after = list(folder.glob("*.parquet"))
    assert len(after) < files
    spans = []
    for path in after:
        columns = pq.read_table(path).select(["datetime", "seq_num"]).to_pylist()
        keys = [(c["datetime"], c["seq_num"]) for c in columns]
        assert keys == sorted(keys)
        spans.append((keys[0], keys[-1]))
    spans.sort()
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_a_failed_compaction_is_a_status(lake):
    assert compact_table(lake.warehouse, "page", []) == "FAILED"


def test_a_table_that_cannot_be_compacted_is_an_error_once_the_others_are_done(lake, tmp_path):
    for _ in range(3):
        load_days(lake.warehouse, lake.add(*day(9, "2022-11-01")), mode="append")
    fact, folder = contents(lake.warehouse.fact()), tmp_path / "warehouse" / "access_log" / "log_date=2022-11-01"
    files = len(list(folder.glob("*.parquet")))
    (tmp_path / "warehouse" / "page" / "v=000001" / "part-broken.parquet").write_bytes(b"no table")
    with pytest.raises(RuntimeError, match="^compaction failed: page$"):
        compact_all(lake.warehouse, [D1])
    assert {d: lake.warehouse.version(d) for d in DIMENSIONS} == {d: "v=000001" if d == "page" else "v=000002" for d in DIMENSIONS}
    assert len(list(folder.glob("*.parquet"))) < files
    assert contents(lake.warehouse.fact()) == fact


@pytest.mark.parametrize(
    "query, broken, failed",
    [
        ("compact_fact", "compact_fact", "access_log"),
        ("compact_dims", "compact_dimension", ", ".join(DIMENSIONS)),
        ("unsorted_files", "compact_fact", "access_log"),
    ],
)
def test_a_query_gives_no_rows_of_a_compaction_that_failed(spark, tmp_path, monkeypatch, query, broken, failed):
    rows = [(i, datetime.datetime(2024, 1, 1 + i % 2, i), i, "view", 1.5, f'{{"k": {i}}}') for i in range(9)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(f"weblake.plans.maintain.{broken}", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(RuntimeError, match=f"^compaction failed: {failed}$"):
        entry.queries()[query](spark, str(tmp_path))


def test_a_compaction_that_dies_leaves_the_dimension(lake, monkeypatch):
    load_days(lake.warehouse, lake.add(*day(9, "2022-11-01")))
    before = contents(lake.warehouse.table("page"))
    monkeypatch.setattr("weblake.plans.maintain.rename", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    assert compact_table(lake.warehouse, "page", []) == "FAILED"
    assert contents(lake.warehouse.table("page")) == before
    monkeypatch.undo()
    for _ in range(3):
        reader = lake.warehouse.table("page")
        assert compact_table(lake.warehouse, "page", []) == "FINISHED"
        assert contents(reader) == contents(lake.warehouse.table("page")) == before
    load_days(lake.warehouse, lake.add(row(date="2022-11-02", cs_uri_stem="/new")), [D2])
    assert lake.warehouse.table("page").count() == len(before) + 1


def test_reports(lake):
    masked = lake.add(*day(8, "2022-11-01", sc_bytes="10"), row(date="2022-11-01", sc_status="500", x_edge_response_result_type="Error"))
    load_days(lake.warehouse, masked)
    fact = lake.warehouse.fact()
    views = {(r.path, r.views, r.bytes) for r in daily_page_views(fact, lake.warehouse.table("page")).collect()}
    assert ("/p0", 2, 20) in views and ("/blog/index.html", 1, 5120) in views
    assert {tuple(r) for r in result_mix(fact, lake.warehouse.table("result_type")).collect()} == {("Hit", 200, 8), ("Error", 500, 1)}


def test_tsv_interchange_round_trip(spark, lake, tmp_path):
    lake.add(row(date="2022-11-1", cs_uri_stem='"quoted "x', referer="-"), *day(5, "2022-11-01"), *day(2, "2022-11-02"))
    masked = lake.add(*day(3, "2022-11-01"))
    prefix = str(tmp_path / "tsv")
    for _ in range(2):
        assert export_days(masked, prefix, [D1, D2]) == 3
    files = sorted(str(p.relative_to(prefix)) for p in (tmp_path / "tsv").rglob("*.gz") if not p.name.startswith("."))
    assert files == ["2022/11/01/0.gz", "2022/11/01/1.gz", "2022/11/02/0.gz"]
    raw = read_days_tsv(spark, prefix, [D1])
    assert raw.count() == 9
    first = raw.where("seq_num = 1 and cs_uri_stem like '%quoted%'").first()
    assert (first.cs_uri_stem, first.referer, first.date, first.c_port) == ('"quoted "x', None, D1, 54321)
    load_days(lake.warehouse, as_masked(read_days_tsv(spark, prefix, [D1, D2])))
    assert lake.warehouse.fact().count() == 11
    direct = stage_rows(masked).select(*STAGE_COLUMNS)
    assert contents(decode_star(lake.warehouse.fact(), lake.warehouse.dimensions())) == contents(direct)


def test_tsv_with_a_bad_value_fails(spark, lake, tmp_path):
    prefix = str(tmp_path / "tsv")
    export_days(lake.add(row(date="2022-11-01", sc_bytes="many")), prefix, [D1])
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE|Malformed"):
        read_days_tsv(spark, prefix, [D1]).collect()
