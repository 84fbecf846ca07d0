"""Object notifications."""

import json

import pytest
from logs import head, row, write
from pyspark.sql import functions as F

from weblake.plans.mask import mask_keys
from weblake import session
from weblake.session import rename_all
from weblake.sources import masked
from weblake.sources.logfiles import read_lines
from weblake.sources.masked import read_commits, read_masked, read_message_rejects
from weblake.sources.notices import created_keys, file_listing, finished_sources, manifest, message_rejects, object_events
from weblake.streaming.ingest import start_masking, start_masking_notified, stream_messages


def notice(*entries):
    return json.dumps({"Records": [
        {k: v for k, v in {"eventName": name, "s3": {"bucket": {"name": bucket}, "object": {"key": key}}}.items() if v}
        for name, bucket, key in entries
    ]})


BODIES = [
    notice(("ObjectCreated:Put", "logs", "m/2022/11/01/a.gz"), ("ObjectCreated:Copy", "logs", "m/2022/11/02/a.gz")),
    notice(("ObjectRemoved:Delete", "logs", "m/x.gz"), (None, "logs", "m/y.gz"), ("ObjectCreated:Put", "other", "m/z.gz")),
    notice(("ObjectCreated:Put", "logs", "n/b.gz"), ("ObjectCreated:Put", "logs", "m/2022/11/01/")),
    notice(("ObjectCreated:Put", "logs", "m/2022/11/01/a.gz")),
    '{"Event": "s3:TestEvent"}', "not json", "", "[]", None,
    '{"Records": [{"eventName": "ObjectCreated:Put"}]}',
    '{"Records": [{"eventName": "ObjectCreated:Put", "s3": {"bucket": {"name": "logs"}, "object": {}}}]}',
]


def messages(spark):
    return spark.createDataFrame([(b,) for b in BODIES], "body string")


def test_created_keys(spark):
    keys = sorted(r.object_key for r in created_keys(messages(spark), "logs").collect())
    assert keys == ["m/2022/11/01/", "m/2022/11/01/a.gz", "m/2022/11/02/a.gz", "n/b.gz"]


def test_finished_sources_need_the_prefix_and_a_name(spark):
    assert [r.source_key for r in finished_sources(messages(spark), "logs", "m/").collect()] == ["a.gz"]


def test_events_without_a_name_count_as_other(spark):
    names = [r.event_name for r in object_events(messages(spark)).collect()]
    assert names.count("?") == 1 and len(names) == 10


MORE = [
    *BODIES,
    '{"Records": []}', '{"Records": {"a": 1}}', '{"Records": null}', '{"Records": [1, null, {"eventName": 5}]}',
    '{"Records": [{"eventName": "ObjectCreated:Put", "s3": null}]}',
    '{"Records": [{"eventName": "ObjectCreated:Put", "s3": {"object": {"key": "m/k"}}}]}',
    notice(("ObjectCreated:Put", "logs", "m/x"), ("ObjectCreated:Put", "other", "m/y")),
]


def test_every_skipped_message_has_a_reason(spark):
    rows = spark.createDataFrame([(str(i), b, "extra") for i, b in enumerate(MORE)], "message_id string, body string, entry_name string")
    got = {(int(r.message_id), r.entry): r.reason for r in message_rejects(rows, "logs", "m/").collect()}
    assert got == {
        (1, 0): "other event", (1, 1): "other event", (1, 2): "other bucket", (2, 0): "other prefix",
        (4, None): "no records", (5, None): "not json", (6, None): "not json", (7, None): "no records", (8, None): "no body",
        (9, 0): "no object", (10, 0): "no key", (11, None): "no entries", (12, None): "no records", (13, None): "no records",
        (14, 0): "other event", (14, 1): "other event", (14, 2): "other event", (15, 0): "no object", (16, 0): "no bucket",
        (17, 1): "other bucket",
    }
    assert message_rejects(rows, "logs").columns == ["message_id", "entry_name", "entry", "reason"]


def test_manifest_names_objects_folders_and_nothing_that_vanished(spark, tmp_path):
    for name in ("a.gz", "x/b c%20é.gz", "x/y/part-0", "x/y/part-1", "x/z.gz"):
        (tmp_path / "raw" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw" / name).write_bytes(b"1")
    keys = spark.createDataFrame([(k,) for k in ("a.gz", "a.gz", "x/b c%20é.gz", "x/y", "gone", "z.gz")], "object_key string")
    found = manifest(keys, str(tmp_path / "raw")).collect()
    assert sorted(r.path.split("/raw/")[1] for r in found) == ["a.gz", "x/b c%20é.gz", "x/y/part-0", "x/y/part-1"]


def test_a_million_keys_meet_few_files_by_a_join(spark, tmp_path, monkeypatch):
    for name in ("k7", "k999999", "other"):
        write(tmp_path / "raw" / name, head() + [row()], compress=False)
    keys = spark.range(1_000_000).selectExpr("'k' || id as object_key")
    plan = manifest(keys, str(tmp_path / "raw"))._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "content" not in plan
    out = str(tmp_path / "masked")
    assert mask_keys(keys, str(tmp_path / "raw"), out, "keys") == [0]
    assert sorted(r.src_file.rsplit("/", 1)[1] for r in read_masked(spark, out).collect()) == ["k7", "k999999"]
    assert mask_keys(keys, str(tmp_path / "raw"), out, "other run") == []


def test_many_files_take_several_batches(spark, tmp_path):
    for i in range(9):
        write(tmp_path / "raw" / f"k{i}", head() + [row()], compress=False)
    keys, out = spark.range(9).selectExpr("'k' || id as object_key"), str(tmp_path / "masked")
    assert len(mask_keys(keys, str(tmp_path / "raw"), out, "keys", per_batch=3)) >= 2
    assert read_masked(spark, out).groupBy("src_file").count().where("count = 1").count() == 9


def deliver(spark, folder, *bodies):
    """A new file of the message table."""
    rows = spark.createDataFrame([(f"{abs(hash(b))}", b) for b in bodies], "message_id string, body string")
    rows.coalesce(1).write.mode("append").parquet(str(folder))


def created(*names):
    return notice(*[("ObjectCreated:Put", "logs", n) for n in names])


def start(spark, tmp_path, **options):
    messages = stream_messages(spark, str(tmp_path / "messages"), max_files=1)
    return start_masking_notified(messages, "logs", str(tmp_path / "raw"), str(tmp_path / "masked"), str(tmp_path / "checkpoint"), **options)


def test_stream_masks_redelivered_and_late_notices_once(spark, tmp_path):
    out = str(tmp_path / "masked")
    for name in "abcde":
        write(tmp_path / "raw" / f"{name}.gz", head() + [row(), row()])
    deliver(spark, tmp_path / "messages", created("a.gz", "b.gz"), created("a.gz"), "not json")
    deliver(spark, tmp_path / "messages", created("b.gz", "c.gz", "gone.gz"), "not json", '{"Event": "s3:TestEvent"}')
    start(spark, tmp_path).awaitTermination()
    # Redelivered after a restart; then again when the state has forgotten it (other checkpoint), in another order.
    deliver(spark, tmp_path / "messages", created("c.gz", "d.gz"), created("b.gz"))
    start(spark, tmp_path).awaitTermination()
    messages = stream_messages(spark, str(tmp_path / "messages"))
    again = start_masking_notified(messages, "logs", str(tmp_path / "raw"), out, str(tmp_path / "checkpoint2"))
    again.awaitTermination()
    rows = read_masked(spark, out).groupBy("src_file").count().collect()
    assert {r.src_file.rsplit("/", 1)[1]: r["count"] for r in rows} == {f"{n}.gz": 2 for n in "abcd"}
    reasons = [r.reason for r in read_message_rejects(spark, out).where(~F.col("run").contains("checkpoint2")).collect()]
    assert sorted(reasons) == ["no records", "not json"]


def test_a_killed_batch_is_finished_by_the_next_start(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "masked")
    for name in "abcd":
        write(tmp_path / "raw" / f"{name}.gz", head() + [row(), row(date="2022-11-03")])
    deliver(spark, tmp_path / "messages", created("a.gz", "b.gz", "c.gz", "d.gz"))
    original, calls = masked.write_masked, []

    def dies(rows, path, number, rebalance=True):
        original(rows, path, number, rebalance)
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("killed after the write, before the commit")

    monkeypatch.setattr(masked, "write_masked", dies)
    with pytest.raises(Exception, match="killed"):
        start(spark, tmp_path, per_batch=1).awaitTermination()
    assert 0 < read_commits(spark, out).count() < 4
    monkeypatch.setattr(masked, "write_masked", original)
    start(spark, tmp_path, per_batch=2).awaitTermination()
    rows = read_masked(spark, out).groupBy("src_file", "log_date").count()
    assert rows.count() == 8 and rows.where("count = 1").count() == 8
    assert read_commits(spark, out).count() == 4


def test_a_streams_batch_writes_a_file_for_each_day(spark, tmp_path):
    days = [f"2022-11-0{d}" for d in range(1, 4)]
    for i in range(12):
        write(tmp_path / "raw" / f"{i}.gz", head() + [row(date=d) for d in days])
    deliver(spark, tmp_path / "messages", created(*[f"{i}.gz" for i in range(12)]))
    start(spark, tmp_path).awaitTermination()
    start_masking(spark, str(tmp_path / "raw"), str(tmp_path / "layer"), str(tmp_path / "checkpoint2")).awaitTermination()
    for out in ("masked", "layer"):
        assert read_masked(spark, str(tmp_path / out)).count() == 36
        assert [len(list((tmp_path / out).glob(f"log_date={d}/batch_id=0/*.parquet"))) for d in days] == [1, 1, 1]


def test_many_files_are_listed_by_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "LISTING_TASKS", 3)
    paths = [write(tmp_path / "raw" / f"f{i}" / "part", [row()], compress=False) for i in range(40)]
    context = spark.sparkContext
    context.setJobGroup("listing", "")
    files, lines = file_listing(spark, str(tmp_path / "raw")), read_lines(spark, *paths)
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= 3
    assert files.count() == lines.count() == 40
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"


def test_a_message_batch_without_keys_lists_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "object_key string")
    assert mask_keys(none, str(tmp_path / "absent"), str(tmp_path / "masked"), "keys") == []


def test_files_are_renamed_side_by_side(spark, tmp_path):
    names = [f"a b%20{i}" for i in range(1100)]
    for name in names:
        (tmp_path / name).write_text(name)
    pairs = ((str(tmp_path / n), str(tmp_path / "new" / n[-1] / n)) for n in names)
    assert rename_all(spark, pairs) == 1100
    assert all((tmp_path / "new" / n[-1] / n).read_text() == n and not (tmp_path / n).exists() for n in names)
    with pytest.raises(Exception, match="gone"):
        rename_all(spark, [(str(tmp_path / "gone"), str(tmp_path / "new" / "gone"))])
