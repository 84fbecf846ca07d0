"""Raw files to the masked layer: goldens, traps, numbering over splits, replay, streaming."""

import datetime
import gzip
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logs import head, row, write
from weblake.plans.maintain import retire_sources, source_status
from weblake.plans.mask import mask_created, mask_files, mask_lines
from weblake.schema import CDN_FIELDS
from weblake.session import scratch_root
from weblake.sources.logfiles import file_headers, read_lines
from weblake.sources.masked import (
    affected_days, commit_batch, compact_masked, has_day, last_batch, read_commits, read_masked, read_rejects,
)
from weblake.streaming.ingest import start_masking

D2, D3 = datetime.date(2022, 11, 2), datetime.date(2022, 11, 3)


def mask(spark, tmp_path, paths, **options):
    out = str(tmp_path / "masked")
    mask_files(spark, paths, out, 0, **options)
    return read_masked(spark, out), read_rejects(spark, out)


def listed(masked, *columns):
    return [tuple(r) for r in masked.orderBy("src_file", "log_date", "row_num").select(*columns).collect()]


def test_golden_two_dates_and_bad_dates(spark, tmp_path):
    records = [("2022-11-02", "203.0.113.7"), ("2022-11-03", "2001:db8:1:2::1"), ("bad", "10.1.2.3"),
               ("2022-11-02", "-"), ("2022-11-3", "10.255.1.2")]
    path = write(tmp_path / "in" / "a.gz", head() + [row(date=d, c_ip=ip) for d, ip in records])
    masked, rejects = mask(spark, tmp_path, [path])
    assert listed(masked, "log_date", "c_ip", "row_num") == [
        (D2, "203.0.0.0", 1), (D2, "-", 2), (D3, "2001:db8::", 1), (D3, "10.0.0.0", 2),
    ]
    assert [r.reject for r in rejects.collect()] == ["bad_date"]
    days = sorted(p.name for p in (tmp_path / "masked").iterdir() if p.is_dir())
    assert days == ["_log", "log_date=2022-11-02", "log_date=2022-11-03", "log_date=__HIVE_DEFAULT_PARTITION__"]


def test_each_file_has_its_own_column_order(spark, tmp_path):
    turned = list(reversed(CDN_FIELDS))
    few = ["time", "date", "c-ip", "x-forwarded-for", "cs-method"]
    write(tmp_path / "in" / "a.gz", head() + [row(c_ip="1.2.3.4")])
    write(tmp_path / "in" / "b.gz", head(turned) + [row(turned, c_ip="5.6.7.8", cs_method="PUT")])
    write(tmp_path / "in" / "c.gz", head(few) + [row(few, c_ip="9.9.9.9", cs_method="HEAD")])
    masked, rejects = mask(spark, tmp_path, [str(tmp_path / "in")])
    assert listed(masked, "c_ip", "cs_method", "time", "status") == [
        ("1.0.0.0", "GET", "03:04:05", "200"), ("5.0.0.0", "PUT", "03:04:05", "200"), ("9.0.0.0", "HEAD", "03:04:05", None),
    ]
    assert rejects.count() == 0


def test_own_layout_join_beyond_the_broadcast_bound(spark, tmp_path, monkeypatch):
    turned = list(reversed(CDN_FIELDS))
    write(tmp_path / "in" / "a.gz", head() + [row(c_ip="1.2.3.4", sc_bytes=str(i)) for i in range(100)])
    write(tmp_path / "in" / "b.gz", head(turned) + [row(turned, c_ip="5.6.7.8")])
    monkeypatch.setattr("weblake.sources.logfiles.BROADCAST_BYTES", 0)
    masked, _ = mask(spark, tmp_path, [str(tmp_path / "in")])
    got = listed(masked, "c_ip", "row_num", "sc_bytes")
    assert got == [("1.0.0.0", i + 1, str(i)) for i in range(100)] + [("5.0.0.0", 1, "5120")]


def test_empty_files_and_headers_without_rows(spark, tmp_path):
    write(tmp_path / "in" / "empty.gz", [])
    write(tmp_path / "in" / "head.gz", head())
    write(tmp_path / "in" / "rows.gz", head() + ["", row(), ""])
    masked, rejects = mask(spark, tmp_path, [str(tmp_path / "in")])
    assert (masked.count(), rejects.count()) == (1, 0)
    headers = {Path(r.src_file).name for r in file_headers(read_lines(spark, str(tmp_path / "in"))).collect()}
    assert headers == {"head.gz", "rows.gz"}


def test_missing_header_rejects_the_files_rows(spark, tmp_path):
    write(tmp_path / "in" / "a.gz", [row(), row()])
    write(tmp_path / "in" / "b.gz", head() + [row()])
    masked, rejects = mask(spark, tmp_path, [str(tmp_path / "in")])
    assert masked.count() == 1
    assert [(r.reject, Path(r.src_file).name) for r in rejects.collect()] == [("no_header", "a.gz")] * 2


def test_only_files_without_header(spark, tmp_path):
    path = write(tmp_path / "in" / "a.gz", [row()])
    masked, rejects = mask(spark, tmp_path, [path])
    assert (masked.count(), [r.reject for r in rejects.collect()]) == (0, ["no_header"])


def test_second_header_in_the_middle_is_no_row(spark, tmp_path):
    path = write(tmp_path / "in" / "a.gz", head() + [row()] + head() + [row()])
    masked, rejects = mask(spark, tmp_path, [path])
    assert (listed(masked, "row_num"), rejects.count()) == ([(1,), (2,)], 0)


def test_short_and_long_rows_are_rejected(spark, tmp_path):
    path = write(tmp_path / "in" / "a.gz", head() + [row() + "\tmore", row(), row().rsplit("\t", 1)[0]])
    masked, rejects = mask(spark, tmp_path, [path])
    assert masked.count() == 1
    assert [r.reject for r in rejects.collect()] == ["field_count"] * 2


def test_rejected_rows_leave_no_field_behind(spark, tmp_path):
    rows = [row(c_ip="198.51.100.999"), row(x_forwarded_for="198.51.100.7, 10.0.0.1"), row(date="bad", c_ip="198.51.100.7"), row(c_ip="")]
    path = write(tmp_path / "in" / "a.gz", head() + rows)
    masked, rejects = mask(spark, tmp_path, [path])
    assert masked.count() == 0
    assert sorted(r.reject for r in rejects.collect()) == ["bad_address", "bad_address", "bad_address", "bad_date"]
    stored = spark.read.parquet(str(tmp_path / "masked")).drop("src_file", "reject", "row_num", "batch_id", "log_date")
    assert all(v is None for r in stored.collect() for v in r)


@pytest.mark.parametrize("bad", [{"c_ip": "1.2.3"}, {"x_forwarded_for": "1.2.3.4, 5.6.7.8"}, {"date": "bad", "c_ip": "?"}])
def test_fail_mode_writes_nothing(spark, tmp_path, bad):
    path = write(tmp_path / "in" / "a.gz", head() + [row(), row(**bad)])
    with pytest.raises(Exception, match="bad_address"):
        mask(spark, tmp_path, [path], on_error="fail")
    written = [p for p in (tmp_path / "masked").rglob("*.parquet") if not p.name.startswith(".") and "_log/claims" not in str(p)]
    assert [p for p in written if "_temporary" not in str(p) and ".spark-staging" not in str(p)] == []


def test_fail_mode_accepts_bad_dates(spark, tmp_path):
    path = write(tmp_path / "in" / "a.gz", head() + [row(), row(date="bad")])
    masked, rejects = mask(spark, tmp_path, [path], on_error="fail")
    assert (masked.count(), rejects.count()) == (1, 1)


def test_quotes_and_crlf(spark, tmp_path):
    path = write(tmp_path / "in" / "a.gz", head() + [row(cs_uri_stem='"quoted'), row()], newline="\r\n")
    masked, rejects = mask(spark, tmp_path, [path])
    assert listed(masked, "cs_uri_stem", "sc_range_end") == [('"quoted', "-"), ("/blog/index.html", "-")]
    assert rejects.count() == 0


def test_declared_layout(spark, tmp_path):
    path = write(tmp_path / "in" / "a.gz", head() + [row(c_ip="1.2.3.4")])
    masked, _ = mask(spark, tmp_path, [path], fields=CDN_FIELDS)
    assert listed(masked, "c_ip", "row_num") == [("1.0.0.0", 1)]
    other = write(tmp_path / "other" / "b.gz", head(CDN_FIELDS[::-1]) + [row(CDN_FIELDS[::-1])])
    with pytest.raises(Exception, match="undeclared layout"):
        mask(spark, tmp_path, [other], fields=CDN_FIELDS)


@pytest.mark.parametrize("whole_file_bytes", [0, 10**9])
def test_row_numbers_over_many_splits(spark, tmp_path, monkeypatch, whole_file_bytes):
    """Uncompressed files of several splits, gzip files and one file that dominates."""
    monkeypatch.setattr("weblake.plans.mask.chunk_of", lambda pos: F.shiftright(pos, 5))
    rng = random.Random(5)
    want = []
    for name, size, packed in [("big.log", 3000, False), ("mid.log", 300, False), ("zip.gz", 700, True), ("tiny.gz", 1, True)]:
        counts, lines = {}, head()
        for i in range(size):
            day = rng.choice(["2022-11-02", "2022-11-02", "2022-11-03", "bad"])
            lines.append(row(date=day, sc_bytes=str(i)))
            if day != "bad":
                counts[day] = counts.get(day, 0) + 1
                want.append((name, day, counts[day], str(i)))
        write(tmp_path / "in" / name, lines, compress=packed)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        lines = read_lines(spark, str(tmp_path / "in"))
        assert lines.rdd.getNumPartitions() > 8
        rows = mask_lines(lines, whole_file_bytes=whole_file_bytes).where("log_date is not null")
        got = [(Path(r.src_file).name, str(r.log_date), r.row_num, r.sc_bytes) for r in rows.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == sorted(want)


def test_size_filter_prunes_files_before_reading(spark, tmp_path):
    for i in range(6):
        write(tmp_path / "in" / f"{i}.gz", head() + [row()])
    lines = read_lines(spark, str(tmp_path / "in"))
    assert lines.where("src_bytes > 1000000").rdd.getNumPartitions() == 0


def test_batches_replay_and_affected_days(spark, tmp_path):
    out = str(tmp_path / "masked")
    one = write(tmp_path / "one" / "a.gz", head() + [row(), row(date="2022-11-03")])
    two = write(tmp_path / "two" / "b.gz", head() + [row()])
    mask_files(spark, [one], out, 0)
    mask_files(spark, [two], out, 1)
    mask_files(spark, [two], out, 1)
    masked, commits = read_masked(spark, out), read_commits(spark, out)
    assert masked.count() == 3
    assert affected_days(commits, -1) == [D2, D3]
    assert affected_days(commits, 0) == [D2]
    assert affected_days(commits, 1) == []
    assert last_batch(commits) == 1
    assert has_day(masked, D3) and not has_day(masked, datetime.date(2022, 11, 4))
    log = [(r.kept, r.rejected, r.days, r.run_batch) for r in commits.orderBy("batch_id").collect()]
    assert log == [(2, 0, [D2, D3], 0), (1, 0, [D2], 1)]


def test_a_batch_id_is_not_used_for_other_sources(spark, tmp_path):
    out = str(tmp_path / "masked")
    one = write(tmp_path / "one" / "a.gz", head() + [row()])
    two = write(tmp_path / "two" / "b.gz", head() + [row(), row()])
    assert mask_files(spark, [one], out, 0) == 0
    with pytest.raises(ValueError, match="other sources"):
        mask_files(spark, [two], out, 0)
    assert read_masked(spark, out).count() == 1
    assert mask_files(spark, [two], out, 0, run="second") == 1
    assert read_masked(spark, out).count() == 3


def test_a_run_that_died_before_its_commit_gets_its_number_back(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "masked")
    one = write(tmp_path / "one" / "a.gz", head() + [row()])
    monkeypatch.setattr("weblake.sources.masked.write_masked", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        mask_files(spark, [one], out, 0)
    monkeypatch.undo()
    assert mask_files(spark, [one], out, 0, run="other") == 1
    assert mask_files(spark, [one], out, 0) == 0
    assert last_batch(read_commits(spark, out)) == 1


def test_two_streams_with_checkpoints_of_their_own(spark, tmp_path):
    out = str(tmp_path / "masked")
    for name in "ab":
        write(tmp_path / name / f"{name}.gz", head() + [row()] * (2 if name == "a" else 3))
        start_masking(spark, str(tmp_path / name), out, str(tmp_path / f"checkpoint-{name}")).awaitTermination()
    assert read_masked(spark, out).count() == 5


def test_a_stream_takes_files_however_old(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "masked"), str(tmp_path / "checkpoint")
    write(source / "new.gz", head() + [row()])
    start_masking(spark, str(source), out, checkpoint).awaitTermination()
    old = write(source / "old.gz", head() + [row()] * 5)
    os.utime(old, (1_500_000_000, 1_500_000_000))
    start_masking(spark, str(source), out, checkpoint).awaitTermination()
    assert read_masked(spark, out).count() == 6


def test_headers_of_any_length(spark, tmp_path):
    wide = [f"f{i}" for i in range(10_000)] + CDN_FIELDS
    write(tmp_path / "in" / "wide.gz", head(wide) + [row(wide, c_ip="1.2.3.4")])
    write(tmp_path / "in" / "turned.gz", head(CDN_FIELDS[::-1]) + [row(CDN_FIELDS[::-1])])
    masked, rejects = mask(spark, tmp_path, [str(tmp_path / "in")])
    assert (masked.count(), rejects.count()) == (2, 0)


@pytest.mark.parametrize("bad", [{"c_ip": "1.2.3"}, {"x_forwarded_for": "?"}])
def test_drop_file_keeps_the_other_files(spark, tmp_path, bad):
    write(tmp_path / "in" / "a.gz", head() + [row(), row(**bad), row(date="bad")])
    write(tmp_path / "in" / "b.gz", head() + [row(), row(date="bad")])
    masked, rejects = mask(spark, tmp_path, [str(tmp_path / "in")], on_error="drop_file")
    assert [Path(r.src_file).name for r in masked.collect()] == ["b.gz"]
    assert sorted((r.reject, Path(r.src_file).name) for r in rejects.collect()) == [("bad_address", "a.gz"), ("bad_date", "b.gz")]
    lines = read_lines(spark, str(tmp_path / "in"))
    status = source_status(lines, read_commits(spark, str(tmp_path / "masked")))
    assert {Path(r.src_file).name: r.done for r in status.collect()} == {"a.gz": False, "b.gz": True}


def test_vanished_paths_are_skipped(spark, tmp_path):
    path, out = write(tmp_path / "in" / "a.gz", head() + [row()]), str(tmp_path / "masked")
    mask_files(spark, [path, str(tmp_path / "in" / "gone.gz")], out, 0)
    mask_files(spark, [str(tmp_path / "gone")], out, 1)
    assert read_masked(spark, out).count() == 1


def test_notified_objects_are_masked(spark, tmp_path):
    for name in "abc":
        write(tmp_path / "raw" / f"{name}.gz", head() + [row()])
    note = '{"Records":[{"eventName":"ObjectCreated:Put","s3":{"bucket":{"name":"logs"},"object":{"key":"%s"}}}]}'
    messages = spark.createDataFrame([(note % k,) for k in ("a.gz", "c.gz", "gone.gz")] + [("no json",)], "body string")
    mask_created(messages, "logs", str(tmp_path / "raw"), str(tmp_path / "masked"), 0)
    assert {Path(r.src_file).name for r in read_masked(spark, str(tmp_path / "masked")).collect()} == {"a.gz", "c.gz"}


def test_closed_batches_are_compacted(spark, tmp_path):
    out = str(tmp_path / "masked")
    for i in range(3):
        mask_files(spark, [write(tmp_path / "in" / f"{i}.gz", head() + [row(), row(date="2022-11-03")])], out, i)
    before = listed(read_masked(spark, out), "src_file", "log_date", "row_num", "batch_id")
    compact_masked(spark, out, D2, [0, 1])
    assert listed(read_masked(spark, out), "src_file", "log_date", "row_num", "batch_id") == before


def test_no_staging_is_left(spark, tmp_path):
    root = Path(scratch_root(spark).removeprefix("file:")) / "weblake"
    before = set(root.iterdir()) if root.exists() else set()
    write(tmp_path / "in" / "a.gz", head() + [row()])
    write(tmp_path / "in" / "b.gz", head(CDN_FIELDS[::-1]) + [row(CDN_FIELDS[::-1])])
    mask(spark, tmp_path, [str(tmp_path / "in")], on_error="drop_file")
    with pytest.raises(Exception, match="bad_address"):
        mask_files(spark, [write(tmp_path / "in" / "c.gz", head() + [row(c_ip="?")])], str(tmp_path / "masked"), 1, on_error="fail")
    assert (set(root.iterdir()) if root.exists() else set()) == before


def test_stream_masks_each_file_once(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "masked"), str(tmp_path / "checkpoint")
    for name in "abc":
        write(source / f"{name}.gz", head() + [row(), row(date="2022-11-03"), row()])
    for _ in range(2):
        start_masking(spark, str(source), out, checkpoint, max_files=2).awaitTermination()
    masked = read_masked(spark, out)
    assert listed(masked, "log_date", "row_num") == [(D2, 1), (D2, 2), (D3, 1)] * 3
    assert last_batch(read_commits(spark, out)) == 1
    write(source / "late.gz", head() + [row()])
    start_masking(spark, str(source), out, checkpoint).awaitTermination()
    assert affected_days(read_commits(spark, out), 1) == [D2]
    assert read_masked(spark, out).count() == 10


def test_stream_archives_consumed_files(spark, tmp_path):
    source, archive = tmp_path / "in", tmp_path / "archive"
    out, checkpoint = str(tmp_path / "masked"), str(tmp_path / "checkpoint")
    for name in ["a.gz", "b.gz"]:
        write(source / name, head() + [row()])
        start_masking(spark, str(source), out, checkpoint, clean_source="archive", archive_dir=str(archive)).awaitTermination()
    # The source archives a file once a later batch is planned.
    assert (source / "b.gz").exists() and not (source / "a.gz").exists()
    assert [p.name for p in archive.rglob("*.gz")] == ["a.gz"]
    assert read_masked(spark, out).count() == 2


def test_retire_only_complete_sources(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "masked")
    write(source / "whole.gz", head() + [row(), row(date="bad")])
    write(source / "half.gz", head() + [row(), row(date="2022-11-03")])
    lines = read_lines(spark, str(source))
    rows = mask_lines(lines)
    # The second date of half.gz has not arrived.
    commit_batch(rows.where("log_date is null or log_date < '2022-11-03'"), out, "files", 0)
    status = source_status(lines, read_commits(spark, out))
    assert retire_sources(spark, status) == 1
    assert [p.name for p in source.glob("*.gz")] == ["half.gz"]


def test_gzip_is_read_by_extension(spark, tmp_path):
    path = tmp_path / "in" / "a.gz"
    write(path, head() + [row()])
    assert gzip.decompress(path.read_bytes()).startswith(b"#Version")
    assert read_lines(spark, str(path)).count() == 3
