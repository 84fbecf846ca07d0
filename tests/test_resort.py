"""Incremental sort of the fact table and the key index of dimensions."""

import datetime
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logs import head, row, write
from weblake.operators.keys import known_keys
from weblake.plans import key_index, resort
from weblake.plans.key_index import filter_blocks, may_be_known, narrowed, narrowed_dimensions
from weblake.plans.load import load_days
from weblake.plans.maintain import compact_dimension
from weblake.plans.mask import mask_files
from weblake.plans.resort import file_ranges, finish, overlap_groups, sort_overlapping
from weblake.schema import DIMENSIONS
from weblake.sources.masked import read_masked
from weblake.warehouse import Warehouse

D1, D2 = datetime.date(2022, 11, 1), datetime.date(2022, 11, 2)


@pytest.fixture
def lake(spark, tmp_path):
    """A warehouse whose fact table gets one more file per day and ``add``."""

    class Lake:
        warehouse = Warehouse(spark, str(tmp_path / "warehouse"))
        batches = 0

        def add(self, *records):
            masked = str(tmp_path / f"masked{self.batches}")
            mask_files(spark, [write(tmp_path / "raw" / f"{self.batches}.gz", head() + list(records))], masked, 0)
            self.batches += 1
            load_days(self.warehouse, read_masked(spark, masked), mode="append")

        def files(self, day):
            return {p.name for p in (tmp_path / "warehouse" / "access_log" / f"log_date={day}").glob("*.parquet")}

        def spans(self, day):
            out = []
            for p in (tmp_path / "warehouse" / "access_log" / f"log_date={day}").glob("*.parquet"):
                keys = [(r["datetime"], r["seq_num"]) for r in pq.read_table(p).select(["datetime", "seq_num"]).to_pylist()]
                assert keys == sorted(keys)
                out.append((keys[0], keys[-1]))
            return sorted(out)

    return Lake()


def at(*hours, date="2022-11-01", **values):
    return [row(date=date, time=f"{h:02d}:{m:02d}:00", **values) for h in hours for m in (0, 30)]


def contents(frame):
    return sorted(map(str, frame.collect()))


def test_only_overlapping_files_are_rewritten(lake):
    lake.add(*at(0, 1, 2))
    lake.add(*at(3, 4), *at(1, 9, date="2022-11-02"))
    alone = lake.files(D1) | lake.files(D2)
    lake.add(*at(10, 14))
    lake.add(*at(12, 13))
    lake.add(*at(14, 15))
    before, rows = lake.files(D1), contents(lake.warehouse.fact())
    report = sort_overlapping(lake.warehouse, [D1, D2]).collect()
    assert {Path(r.file).name for r in report if not r.rewritten} == alone
    assert sum(r.rewritten for r in report) == 3 and len(report) == 6
    assert contents(lake.warehouse.fact()) == rows
    assert lake.files(D1) & before == alone & lake.files(D1) and lake.files(D2) <= alone
    spans = lake.spans(D1)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    after = lake.files(D1)
    assert not any(r.rewritten for r in sort_overlapping(lake.warehouse, [D1, D2]).collect())
    assert lake.files(D1) == after


def test_groups_chain_and_touching_files_do_not(spark):
    def key(n):
        return (datetime.datetime(2022, 11, 1, n), 0)

    spans = {"a": (0, 2), "b": (1, 5), "c": (4, 6), "d": (6, 7), "e": (8, 9), "f": (8, 8)}
    rows = [(D1, f, 1, 1, key(lo), key(hi)) for f, (lo, hi) in spans.items()]
    kind = "struct<datetime: timestamp_ntz, seq_num: int>"
    ranges = spark.createDataFrame(rows, f"log_date date, file string, bytes bigint, n_rows bigint, lo {kind}, hi {kind}")
    groups = {r.file: (r.group, r.n_files) for r in overlap_groups(ranges).collect()}
    assert groups == {"a": (1, 3), "b": (1, 3), "c": (1, 3), "d": (2, 1), "f": (3, 1), "e": (4, 1)}


@pytest.mark.parametrize("dies_at", ["journal", "first rename", "first deletion"])
def test_a_sort_that_dies_is_finished_or_undone(lake, monkeypatch, dies_at):
    lake.add(*at(0, 5))
    lake.add(*at(2, 3))
    lake.add(*at(8))
    rows, files = contents(lake.warehouse.fact()), lake.files(D1)

    def dies(*_):
        raise OSError("killed")

    with monkeypatch.context() as patch:
        if dies_at == "journal":
            patch.setattr(resort, "_write_journal", dies)
        elif dies_at == "first rename":
            patch.setattr(resort, "rename", dies)
        else:
            original = resort.discard
            patch.setattr(resort, "discard", lambda s, p: dies() if "part-" in p else original(s, p))
        with pytest.raises(OSError, match="killed"):
            sort_overlapping(lake.warehouse, [D1])
    if dies_at == "journal":
        assert lake.files(D1) == files and contents(lake.warehouse.fact()) == rows
    finish(lake.warehouse)
    assert contents(lake.warehouse.fact()) == rows
    sort_overlapping(lake.warehouse, [D1])
    assert contents(lake.warehouse.fact()) == rows
    spans = lake.spans(D1)
    assert len(spans) == 2 and spans[0][1] <= spans[1][0]
    assert file_ranges(lake.warehouse.fact()).count() == 2


def keys_frame(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def test_filter_lets_every_key_through_and_few_others(spark):
    keys = keys_frame(spark, [f"https://ref{i}.example.com/" for i in range(20_000)])
    blocks = 20_000 // key_index.KEYS_PER_BLOCK
    table = filter_blocks(keys, "key", blocks)
    assert may_be_known(keys, "key", table, blocks).count() == 20_000
    others = keys_frame(spark, [f"https://other{i}.example.com/" for i in range(20_000)])
    assert may_be_known(others, "key", table, blocks).count() < 400


def indexed(lake, pages):
    lake.add(*[row(time=f"00:{i // 60:02d}:{i % 60:02d}", cs_uri_stem=p) for i, p in enumerate(pages)])
    compact_dimension(lake.warehouse, "page", file_bytes=2_000, index_bytes=0)


def test_a_load_reads_only_files_that_may_match(spark, lake):
    indexed(lake, [f"/page/{i:04d}" for i in range(600)])
    everything = narrowed(lake.warehouse, "page", keys_frame(spark, [f"/page/{i:04d}" for i in range(600)]))
    assert len(everything.files) == everything.of > 3
    one = narrowed(lake.warehouse, "page", keys_frame(spark, ["/page/0003", "/page/0004", "/new"]))
    assert len(one.files) == 1 and one.largest is not None
    assert narrowed(lake.warehouse, "page", keys_frame(spark, ["/new", "/page/0003x"])).files == []
    # Files that were appended since are not in the index and always read.
    lake.add(row(cs_uri_stem="/later"))
    assert len(narrowed(lake.warehouse, "page", keys_frame(spark, ["/new"])).files) == 1
    ids = [r.id for r in lake.warehouse.table("page").collect()]
    assert len(ids) == len(set(ids)) == 601


@pytest.mark.parametrize("keys_per_block", [16, 100_000])
def test_loads_agree_with_and_without_an_index(spark, lake, monkeypatch, keys_per_block):
    # With all keys in one block the filter passes nearly everything: false positives cost reads, nothing else.
    monkeypatch.setattr(key_index, "KEYS_PER_BLOCK", keys_per_block)
    pages = [f"/page/{i:04d}" for i in range(500)]
    indexed(lake, pages)
    before = {r.path: r.id for r in lake.warehouse.table("page").collect()}
    mixed = [f"/page/{i:04d}" for i in range(490, 510)] + ["/a", "/zzz"]
    stage = spark.createDataFrame([("page", p, 1) for p in mixed], "dim string, key string, n bigint")
    dims, used = narrowed_dimensions(lake.warehouse, stage)
    full = lake.warehouse.dimensions()
    assert contents(known_keys(stage, dims)) == contents(known_keys(stage, full))
    if keys_per_block == 100_000:
        assert may_be_known(stage.select("key"), "key", spark.read.parquet(f"{key_index._home(lake.warehouse, 'page', lake.warehouse.version('page'))}/filter"), 1).count() >= 20
    lake.add(*[row(cs_uri_stem=p) for p in mixed])
    after = {r.path: r.id for r in lake.warehouse.table("page").collect()}
    assert set(after) == set(pages) | set(mixed)
    assert all(after[p] == i for p, i in before.items())
    assert len(set(after.values())) == len(after) and min(after[p] for p in set(mixed) - set(pages)) > max(before.values())
    assert set(used) == {"page"} or dims.where(F.col("dim") == "page").count() == 500
    assert set(DIMENSIONS) >= set(used)


def test_indexes_go_with_their_versions(lake, tmp_path):
    indexed(lake, [f"/page/{i}" for i in range(50)])
    for _ in range(3):
        compact_dimension(lake.warehouse, "page", index_bytes=0)
    home = tmp_path / "warehouse" / "page"
    versions = {p.name for p in home.glob("v=*")}
    assert {p.name for p in (home / "_index").iterdir()} <= versions and lake.warehouse.version("page") in versions
    empty = Warehouse(lake.warehouse.spark, str(tmp_path / "empty"))
    empty.create_tables()
    compact_dimension(empty, "page", index_bytes=0)
    assert narrowed(empty, "page", keys_frame(empty.spark, ["/x"])).files == narrowed(empty, "page", keys_frame(empty.spark, [])).files
