"""Scan ingestion and daily movements over many micro-batches: repeats weeks apart, late rows, replays, folding."""

import datetime as dt
import os
import re
import tempfile

import pytest

from stockroom.streaming import scan_stream as ss
from stockroom.streaming.batch_log import BatchLog

SCAN = "row_index long, scan_id string, event_time_stamps string, date string, dataset_id string, item_id string, item_name string, location_id string, event_type string, quantity string"


def scan(row, scan_id, day, quantity="1", dataset="A"):
    return (row, scan_id, f"{day}T10:00:00", day, dataset, "7", f"row {row}", "loc01", "issue", quantity)


def run_files(spark, files, schema, start, per_trigger):
    """Write one file after the other, then let one stream work the backlog off."""
    folder = tempfile.mkdtemp(prefix="stockroom-feed-")
    for k, rows in enumerate(files):
        path = os.path.join(folder, f"{k:03d}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        part = next(f for f in os.listdir(path) if f.startswith("part-"))
        os.utime(os.path.join(path, part), (1_700_000_000 + k, 1_700_000_000 + k))
    q = start(spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder + "/*"))
    q.awaitTermination()
    assert q.exception() is None


def test_backlog_in_batches_repeats_weeks_apart_and_folds(spark):
    days = [str(dt.date(2024, 1, 1) + dt.timedelta(5 * k)) for k in range(20)]
    # every file: its own scan twice, the first file's scan again, a bad row, another dataset's row
    files = [[scan(2, f"s{k}", d), scan(3, f"s{k}", d, "9"), scan(4, "s0", d, "5"), scan(5, f"b{k}", d, "x"), scan(6, f"o{k}", d, dataset="B")] for k, d in enumerate(days)]
    sink = ss.ScanSink(tempfile.mkdtemp(prefix="stockroom-test-"), buckets=8, fold_every=4)
    run_files(spark, files, SCAN, lambda src: ss.scan_stream(spark, src, sink, "A"), per_trigger=2)
    won = sorted((r.scan_id, r.ingest_seq.batch, r.ingest_seq.row, r.quantity, str(r.date)) for r in sink.read_fact(spark).collect())
    # two files in a batch share row numbers: the smaller row number wins in a batch, whole rows stay together
    assert won == sorted((f"s{k}", k // 2, 2, 1.0, d) for k, d in enumerate(days))
    metrics = {r.batch_id: r for r in sink.read_metrics(spark).collect()}
    assert sorted(metrics) == list(range(10))
    assert [metrics[k].inserted for k in range(10)] == [2] * 10 and [metrics[k].inserted_total for k in range(10)] == [2 * k + 2 for k in range(10)]
    assert all(m.skipped_duplicates == 4 and m.parse_errors == 2 and m.last_row == 4 for m in metrics.values())
    assert sink.quarantine_log.read(spark).count() == 20
    bases = os.listdir(sink.ledger_log.base)
    assert len(bases) == 1 and len([f for f in os.listdir(sink.ledger) if f.startswith("batch_id")]) < 7
    assert sink.ledger_log.read(spark).select("scan_id").distinct().count() == 20


def test_only_the_asked_buckets_are_opened(spark):
    log = BatchLog(tempfile.mkdtemp(prefix="stockroom-log-"), "id long, bucket int", ("bucket",), every=2)
    for b in range(5):
        log.fold(spark, b)
        log.append(spark.range(b * 40, b * 40 + 40).selectExpr("id", "CAST(id % 8 AS INT) AS bucket"), b)
    part = log.read(spark, where="bucket IN (3)")
    scans = [line for line in part._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line]
    assert len(scans) == 2 and all(re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = 3", line) for line in scans)
    assert sorted(r.id for r in part.collect()) == [i for i in range(200) if i % 8 == 3]
    assert log.read(spark, before=3).count() == 120 and log.read(spark).count() == 200


def test_a_fold_that_was_cut_off_changes_nothing(spark):
    log = BatchLog(tempfile.mkdtemp(prefix="stockroom-log-"), "id long", every=2)
    for b in range(3):
        log.append(spark.range(b, b + 1), b)
    torn = os.path.join(log.base, "upto=1")
    spark.range(100).write.parquet(torn)
    os.remove(os.path.join(torn, "_SUCCESS"))
    assert sorted(r.id for r in log.read(spark).collect()) == [0, 1, 2]
    assert log.fold(spark, 3) and sorted(r.id for r in log.read(spark).collect()) == [0, 1, 2]
    log.append(spark.range(3, 4), 3)
    log.append(spark.range(3, 4), 3)  # replay
    assert sorted(r.id for r in log.read(spark).collect()) == [0, 1, 2, 3]


def test_scan_batch_replayed_after_its_ledger_was_written(spark):
    sink = ss.ScanSink(tempfile.mkdtemp(prefix="stockroom-test-"), buckets=4, fold_every=1)
    batches = [[scan(2, "a", "2024-01-01")], [scan(2, "a", "2024-02-01", "8"), scan(3, "b", "2024-02-01")], []]
    for k, rows in enumerate(batches):
        for _ in range(2):
            ss.process_scan_batch(spark, spark.createDataFrame(rows, SCAN), k, sink, "A")
    assert sorted((r.scan_id, r.quantity) for r in sink.read_fact(spark).collect()) == [("a", 1.0), ("b", 1.0)]
    got = {r.batch_id: (r.inserted, r.skipped_duplicates, r.inserted_total, r.last_row) for r in sink.read_metrics(spark).collect()}
    assert got == {0: (1, 0, 1, 2), 1: (1, 1, 2, 3), 2: (0, 0, 2, 3)}


@pytest.mark.parametrize("per_trigger", [1, 2])
def test_late_days_count(spark, per_trigger):
    rows = [(dt.datetime(2024, 1, 20, 23, 30), "LOC01", "ISSUE", 3.0), (dt.datetime(2024, 1, 1, 0, 5), "LOC01", "ISSUE", 4.0), (dt.datetime(2024, 1, 10), "LOC01", "ISSUE", 5.0)]
    rows += [(dt.datetime(2024, 1, 20), "LOC01", "ISSUE", 1.0), (dt.datetime(2024, 1, 19), "LOC01", "ISSUE", 2.0)]
    sink = ss.MovementSink(tempfile.mkdtemp(prefix="stockroom-test-"), fold_every=2)
    schema = "event_ts timestamp_ntz, location_id string, event_type string, quantity double"
    run_files(spark, [[r] for r in rows], schema, lambda src: ss.run_movement_daily(spark, src, sink), per_trigger)
    got = {str(r.day): r.qty for r in sink.daily.read(spark).collect()}
    assert got == {"2024-01-20": 4.0, "2024-01-01": 4.0, "2024-01-10": 5.0, "2024-01-19": 2.0}
    arrivals = sink.arrivals.read(spark).collect()
    assert sum(r.rows for r in arrivals) == 5 and sum(r.late_rows for r in arrivals) == (2 if per_trigger == 1 else 1)


def test_append_of_a_batch_without_new_ids_gives_no_rows(spark, tmp_path):
    """All ids stand in the ledger: nothing is written, and what is read has the fact's columns and no rows."""
    from stockroom.plans.catalog import REGISTRY

    rows = [(n * 8000 + 1, dt.datetime(2024, 1, day), 7, "click", 2.0, "") for n, day in enumerate((2, 20))]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = REGISTRY["scan_append"](spark, str(tmp_path))
    assert got.columns[0] == "scan_row" and got.count() == 0


def test_rules_are_run_once_and_their_outcome_is_read(spark):
    from stockroom.sources import scans

    good = (2, "a", "2024-01-02T10:00:00", "2024-01-02", "ds", "7", "item", "LOC01", "ISSUE", "3")
    tagged = scans.scan_tag(spark.createDataFrame([good, (3, *good[1:9], "x")], SCAN), "ds")
    assert [r._error for r in tagged.orderBy("row_index").collect()] == [None, "quantity must be numeric"]
    marked = tagged.drop("_error").selectExpr("*", "if(row_index = 2, 'marked', NULL) AS _error")
    valid, quarantine, skipped = scans.scan_split(marked)
    assert [(r.row_index, r.error) for r in quarantine.collect()] == [(2, "marked")]
    assert [r.row_index for r in valid.collect()] == [3] and skipped.count() == 0
