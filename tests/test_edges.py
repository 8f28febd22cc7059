"""Edge tables: one literal row per trap (FIXTURES.md section 4)."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockroom.functions import normalize as N
from stockroom.operators import forecast as fc
from stockroom.operators import policy, stock
from stockroom.operators.prefix_sum import running_sum_desc
from stockroom.operators.scope import Scope, period_days
from stockroom.operators.snapshot import latest_snapshot
from stockroom.sources import csv_load, scans
from stockroom.streaming.scan_stream import ScanSink, process_scan_batch

RAW_SCHEMA = (
    "dataset_id string, date date, location_id string, item_id bigint, item_name string, event_ts timestamp_ntz, "
    "closing_qty double, min_qty double, ingest_seq bigint"
)


def _datasets(spark):
    return spark.createDataFrame(
        [("d1", dt.datetime(2024, 1, 1), True), ("d0", dt.datetime(2023, 1, 1), True)],
        "dataset_id string, imported_at timestamp_ntz, is_active boolean",
    )


def test_norm_location_prefix_cast(spark):
    df = spark.createDataFrame([(" loc01 ",), ("LOC",), ("WH-A",), ("LOC12abc",), (None,), ("loc-3",)], "x string")
    got = [r[0] for r in df.select(N.norm_location("x")).collect()]
    assert got == [1, 0, 0, 12, None, -3]
    assert df.select(N.location_label(F.lit(7))).first()[0] == "LOC07"


def test_snapshot_last_insert_wins_and_codes(spark):
    d, ts = dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 8, 0)
    rows = [
        ("d1", d, "LOC01", 1, "a", ts, 5.0, 1.0, 1),
        ("d1", d, " loc01 ", 1, "a", ts, 7.0, 1.0, 2),   # same date and time, inserted later: wins
        ("d1", d, "LOC", 2, "b", ts, None, 0.0, 3),      # no digits -> location 0, NULL balance
        ("d1", d, "WH-A", 3, "c", ts, 0.0, -1.0, 4),     # location 0 as well
        ("d1", d, "", 4, "d", ts, 9.0, 0.0, 5),          # blank location: excluded
        ("d1", d, None, 5, "e", ts, 9.0, 0.0, 6),        # NULL location: excluded
        ("d1", d, "LOC02", 6, "f", ts, -1.0, -1.0, 7),   # negative stock
        ("d0", d, "LOC02", 7, "g", ts, 1.0, 0.0, 8),     # other dataset: excluded
    ]
    raw = spark.createDataFrame(rows, RAW_SCHEMA)
    snap = latest_snapshot(raw, _datasets(spark))
    got = {(r.item_id, r.location_id): r.closing_qty for r in snap.collect()}
    assert got == {(1, 1): 7.0, (2, 0): None, (3, 0): 0.0, (6, 2): -1.0}
    st = stock.stock_status(snap).first()
    # in: closing > min (1,1), (3,0) 0 > -1, (6,2) -1 > -1? no; out: closing == 0 -> (2,0) NULL->0 and (3,0)
    assert (st.in_stock, st.low_stock, st.out_stock) == (2, 0, 2)
    detail = {r.item_id: r.stock_status for r in stock.stock_status_detail(
        latest_snapshot(raw, _datasets(spark), by="code")).collect()}
    assert detail[6] == "Out of Stock" and detail[1] == "In Stock"


def test_expiry_dates_and_null_first(spark):
    df = spark.createDataFrame([(None,), ("bad",), (" 2024-01-31 extra",), ("2024-02-30",)], "x string")
    assert [r[0] for r in df.select(N.expiry_date("x")).collect()] == [None, None, dt.date(2024, 1, 31), None]


def test_abc_all_zero_and_exact_boundaries(spark):
    zero = spark.createDataFrame([(1, 1, "a", 0.0), (2, 2, "b", 0.0)],
                                 "item_id long, storage_item_id long, item_name string, annual_qty double")
    zero = zero.withColumn("annual_value", F.lit(0).cast("decimal(18,2)"))
    out = policy.abc_classify(zero).collect()
    assert {r.abc_class for r in out} == {"A"} and {r.cumulative_share_pct for r in out} == {0.0}
    vals = [(1, 80.0), (2, 15.0), (3, 5.0)]  # running shares exactly 0.8, 0.95, 1.0
    df = spark.createDataFrame([(i, i, f"n{i}", 1.0, v) for i, v in vals],
                               "item_id long, storage_item_id long, item_name string, annual_qty double, v double")
    df = df.withColumn("annual_value", F.col("v").cast("decimal(18,2)")).drop("v")
    got = {r.item_id: r.abc_class for r in policy.abc_classify(df).collect()}
    assert got == {1: "A", 2: "B", 3: "C"}


def test_prefix_sum_buckets_equal_single_window_with_hot_value(spark):
    # a third of the rows share one value: the cut rows split it by id
    n = 3000
    df = spark.range(n).select(
        F.col("id").alias("item_id"),
        F.when(F.col("id") % 3 == 0, F.lit(50)).otherwise(F.col("id") % 97).cast("decimal(18,2)").alias("v"),
    )
    whole = Window.orderBy(F.col("v").desc(), F.col("item_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = df.withColumn("run", F.sum("v").over(whole))
    bucketed = running_sum_desc(df, "v", "item_id", "run", ranges=16)
    a = {r.item_id: r.run for r in plain.collect()}
    b = {r.item_id: r.run for r in bucketed.collect()}
    assert a == b


def test_policy_guards(spark):
    pairs = spark.createDataFrame(
        [(1, 1, 2.0, 10.0, 5.0), (2, 1, 2.0, 10.0, 5.0), (3, 1, 0.0, 10.0, 5.0)],
        "item_id long, location_id long, avg_usage_per_day double, unit_cost double, closing_qty double",
    )
    e = {r.item_id: r for r in policy.eoq(pairs, 50.0, F.when(F.col("item_id") == 1, 0.0).otherwise(-1.0)).collect()}
    assert e[1].holding_cost == pytest.approx(2.0)  # rate <= 0 -> 0.2
    assert e[3].eoq == 0.0 and e[3].orders_per_year == 0.0 and e[3].cycle_time_days == 0.0
    z = spark.range(1).select(policy.z_value(F.lit("97.5")).alias("a"), policy.z_value(F.lit("80")).alias("b")).first()
    assert (z.a, z.b) == (1.96, 1.65)
    r = policy.rop(pairs.withColumn("storage_item_id", F.col("item_id")), F.lit(1.5), safety_stock_qty=F.lit(2.0))
    got = {x.item_id: x.status for x in r.collect()}
    assert got[1] == "REORDER NOW"  # closing 5 == 2 * 1.5 + 2
    assert period_days("2024-01-10", "2024-01-01") == 0 and period_days("2024-02-28", "2024-03-01") == 3
    assert period_days("bad", "2024-01-01") == 0


def test_waste_spine_reversed_range_keeps_start_day(spark):
    from stockroom.operators.expiry import waste_daily_dense

    ev = spark.createDataFrame([], "event_ts timestamp_ntz, event_type string, item_id long, location_id long, "
                                   "quantity double, unit_cost_aed double")
    it = spark.createDataFrame([], "item_id long")
    out = waste_daily_dense(ev, it, Scope(start="2024-03-05", end="2024-03-01")).collect()
    assert [(r.day, r.qty) for r in out] == [(dt.date(2024, 3, 5), 0.0)]


SCAN_COLS = ["scan_id", "event_time_stamps", "date", "dataset_id", "item_id", "item_name", "location_id",
             "event_type", "quantity"]


def _scan_df(spark, rows):
    return spark.createDataFrame(
        [(i + 2, *r) for i, r in enumerate(rows)], ", ".join(["row_index long"] + [f"{c} string" for c in SCAN_COLS])
    )


def test_scan_rules_first_error_wins(spark):
    ok = ["s1", "2024-01-05T10:00:00", "2024-01-05", "A", "12.7", "x", "loc01", "receipt", "3"]

    def with_(**kw):
        r = list(ok)
        for k, v in kw.items():
            r[SCAN_COLS.index(k)] = v
        return r

    rows = [
        ok,
        with_(scan_id=""),
        with_(event_time_stamps="", date=""),              # two rules: the first one is reported
        with_(dataset_id="B", item_id="zz"),               # other dataset: skipped silently
        with_(dataset_id="B", scan_id=""),                 # other dataset but no scan id: error
        with_(event_type="MOVE"),
        with_(event_time_stamps="yesterday"),
        with_(date="2024-13-01"),
        with_(item_id="inf"),
        with_(item_id="nan"),
        with_(quantity="abc"),
        with_(scan_id="s2", date="2024-01-06"),
    ]
    valid, quar, skipped = scans.scan_validate(scans.scan_header_check(_scan_df(spark, rows)), "A")
    errors = {r.row_index: r.error for r in quar.collect()}
    assert errors == {
        3: "scan_id is required", 4: "event_time_stamps is required", 6: "scan_id is required",
        7: scans.EVENT_TYPE_MESSAGE, 8: "event_time_stamps must be ISO-like datetime", 9: "date must be YYYY-MM-DD",
        10: "item_id must be numeric", 11: "item_id must be numeric", 12: "quantity must be numeric",
    }
    assert [r.row_index for r in skipped.collect()] == [5]
    v = {r.row_index: r for r in valid.collect()}
    assert v[2].item_id == 12 and v[2].location_id == "LOC01" and v[2].event_type == "RECEIPT"
    with pytest.raises(ValueError, match="Missing required headers: quantity"):
        scans.scan_header_check(_scan_df(spark, [ok]).drop("quantity"))


def test_scan_dedupe_in_batch_and_ledger(spark):
    base = ["2024-01-05T10:00:00", "2024-01-05", "A", "1", "x", "LOC01", "ISSUE", "1"]
    rows = [["s1", *base], ["s1", *base], ["s2", *base], ["s3", *base]]
    valid, _, _ = scans.scan_validate(_scan_df(spark, rows), "A")
    ledger = spark.createDataFrame([("s3",)], "scan_id string")
    new, dups = scans.scan_dedupe(valid, ledger)
    assert sorted((r.scan_id, r.row_index) for r in new.collect()) == [("s1", 2), ("s2", 4)]
    assert dups.count() == 2


def test_micro_batch_replay_is_idempotent(spark):
    base = ["2024-01-05T10:00:00", "2024-01-05", "A", "1", "x", "LOC01", "ISSUE", "1"]
    batch = _scan_df(spark, [["s1", *base], ["s2", *base]])
    sink = ScanSink(tempfile.mkdtemp(prefix="stockroom-test-"))
    process_scan_batch(spark, batch, 0, sink, "A")
    process_scan_batch(spark, batch, 0, sink, "A")  # replay of the same batch id
    assert spark.read.parquet(sink.fact).count() == 2
    process_scan_batch(spark, batch, 1, sink, "A")  # same scans again in a new batch: all duplicates
    assert spark.read.parquet(sink.fact).count() == 2
    m = {r.batch_id: (r.inserted, r.skipped_duplicates) for r in spark.read.parquet(sink.metrics).collect()}
    assert m == {0: (2, 0), 1: (0, 2)}


def test_csv_parsing_traps(spark):
    df = spark.createDataFrame([(" 1,234.50 ",), ("null",), ("",), ("x1",)], "x string")
    assert [r[0] for r in df.select(N.parse_number("x")).collect()] == [1234.5, None, None, None]
    dates = spark.createDataFrame([("03/04/2024",), ("12/31/2024",), ("2024-01-05",), ("2024-01-05T23:30:00Z",),
                                   ("31/02/2024",)], "x string")
    got = [r[0] for r in dates.select(N.parse_date_multi("x")).collect()]
    assert got == [dt.date(2024, 4, 3), dt.date(2024, 12, 31), dt.date(2024, 1, 5), dt.date(2024, 1, 5), None]


def test_csv_preamble_and_last_write_wins(spark):
    d = tempfile.mkdtemp(prefix="stockroom-csv-")
    header = ",".join(csv_load.CLOSING_BALANCE_COLUMNS)
    body = [
        "Report title",
        "Period Start,01/01/2024",
        "",
        header,
        'ORG1,SUB1,ITM1,2.5,10,"1,000.00",31/01/2024,01/01/2024',
        'ORG1,SUB1,ITM1,2.5,12,"1,200.00",31/01/2024,01/01/2024',   # same key: replaces the row
        ',SUB2,ITM2,1,null,5,31/01/2024,01/01/2024',                   # blank org -> UNKNOWN
        'ORG1,SUB3,ITM3,1,1,1,,01/01/2024',                            # no end date: skipped
    ]
    with open(os.path.join(d, "cb.csv"), "w", encoding="utf-8") as f:
        f.write("﻿" + "\n".join(body) + "\n")
    lines = csv_load.read_lines(spark, d)
    out = {(r.org_code, r.item_number): (r.closing_qty, r.inventory_value)
           for r in csv_load.latest_balances(csv_load.load_closing_balance(lines)).collect()}
    assert out == {("ORG1", "ITM1"): (12.0, 1200.0), ("UNKNOWN", "ITM2"): (None, 5.0)}
    per = csv_load.preamble_period(lines).first()
    assert per.period_start == dt.date(2024, 1, 1) and per.period_end is None


def test_forecast_month_rules(spark):
    # item 1: 7 months (skipped), item 2: 8 months with a gap month, constant demand
    rows = []
    for m in range(1, 8):
        rows.append((1, dt.date(2024, m, 10), 5.0))
    for m in [1, 2, 3, 5, 6, 7, 8, 9]:
        rows.append((2, dt.date(2023, m, 10), 4.0))
    load = spark.createDataFrame(rows, "item_id long, date date, issues_qty double").select(
        "date", "item_id", "issues_qty", F.lit(0.0).alias("receipts_qty"),
        F.when(F.month("date") == 5, F.lit(30.0)).otherwise(F.lit(10.0)).alias("closing_qty"),
        F.lit(1.0).alias("avg_usage"),
    )
    frame = fc.fc_calendar(fc.fc_smooth_target(fc.fc_gap_fill(fc.fc_monthly(load))))
    f2 = {r.month_end: r for r in frame.filter("item_id = 2").collect()}
    assert len(f2) == 9 and f2[dt.date(2023, 4, 30)].issues_qty == 0.0
    assert f2[dt.date(2023, 4, 30)].closing_qty == pytest.approx(20.0)  # halfway between 10 and 30
    split = fc.fc_split(fc.fc_lags(frame, "target_nosmooth"))
    assert {r.item_id for r in split.collect()} == {2}
    preds = fc.native_predictions(frame).filter("target = 'target_nosmooth'")
    metrics = {r.model: r for r in fc.fc_metrics(preds).collect()}
    naive = [(r.actual, r.prediction) for r in preds.collect() if r.model == "naive_last"]
    errors, sizes = (sum(abs(y - x) for y, x in naive), sum(abs(y) for y, _ in naive))
    assert naive and metrics["naive_last"].mae == pytest.approx(errors / len(naive))
    assert metrics["naive_last"].wape == pytest.approx(100 * errors / (sizes + 1e-8))
    best = fc.fc_select(fc.fc_metrics(preds)).collect()
    assert len(best) == 1


def test_snapshot_carry_balance(spark):
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    ts1, ts2 = dt.datetime(2024, 1, 1, 9), dt.datetime(2024, 1, 2, 9)
    rows = [
        ("d1", d1, "LOC01", 1, "a", ts1, 8.0, 1.0, 1),
        ("d1", d2, "LOC01", 1, "a", ts2, None, None, 2),  # a scan row carries no balance
    ]
    raw = spark.createDataFrame(rows, RAW_SCHEMA)
    plain = latest_snapshot(raw, _datasets(spark)).first()
    carried = latest_snapshot(raw, _datasets(spark), carry_balance=True).first()
    assert plain.closing_qty is None and carried.closing_qty == 8.0 and carried.date == d2


def test_risk_cells_flat_and_nested_agree(spark):
    from stockroom.operators import risk

    latest = spark.createDataFrame(
        [("R1", "a", 4.0, 4.0, 1.0), ("R2", "b", 4.0, 4.0, 2.0), ("R3", "c", 1.0, 2.0, 3.0),
         ("R4", " ", 3.0, 3.0, 4.0), ("R5", "e", 0.0, 3.0, 5.0)],
        "risk_id string, title string, probability double, impact double, cost double",
    )
    flat = {(r.probability, r.impact): (r.label, r.n_risks) for r in risk.risk_matrix_cells(latest).collect()}
    nested = {(r.probability, r.impact): (r.label, r.n_risks, [x.risk_id for x in r.risks])
              for r in risk.risk_matrix_cells_nested(latest).collect()}
    assert flat == {(4.0, 4.0): ("2 risks", 2), (1.0, 2.0): ("R3", 1)}
    assert nested == {(4.0, 4.0): ("2 risks", 2, ["R1", "R2"]), (1.0, 2.0): ("R3", 1, ["R3"])}
    zones = {(r.probability, r.impact): r.zone for r in risk.risk_zone(risk.risk_matrix_cells(latest)).collect()}
    assert zones == {(4.0, 4.0): "High", (1.0, 2.0): "Low"}


def test_adhoc_sql_keeps_the_users_limit(spark):
    from stockroom.operators.scope import adhoc_scoped_sql

    raw = spark.range(1000).selectExpr("'d1' AS dataset_id", "id AS item_id")
    datasets = spark.createDataFrame([("d1", True, dt.datetime(2024, 1, 1))], "dataset_id string, is_active boolean, imported_at timestamp_ntz")
    assert adhoc_scoped_sql(spark, "SELECT * FROM raw_inventory_v LIMIT 500", raw, datasets).count() == 500
    assert adhoc_scoped_sql(spark, "SELECT * FROM raw_inventory_v", raw, datasets).count() == 1000


def test_money_below_a_cent_counts(spark):
    from stockroom.operators.movement import money_sum

    assert spark.range(1000).select(F.lit(0.004).alias("c")).agg(money_sum(F.col("c"))).first()[0] == 4.0


def test_stored_fact_prunes_datasets_and_months(spark):
    from stockroom.sources import fact_store

    rows = [(d, dt.date(2024, m, 3), "LOC01", k, float(k), "x") for d in ("d1", "d0") for m in range(1, 7) for k in range(4)]
    raw = spark.createDataFrame([*rows, ("d1", None, "LOC01", 9, 1.0, "x")], "dataset_id string, date date, location_id string, item_id bigint, quantity double, event_type string")
    path = tempfile.mkdtemp(prefix="stockroom-fact-")
    fact_store.write_fact(raw, path, files=2)
    again = raw.where("dataset_id = 'd0' AND item_id < 2")
    fact_store.write_fact(again, path)  # a dataset that is loaded again replaces its months, others stay
    fact = fact_store.read_fact(spark, path, raw.schema)
    assert {r.dataset_id: r["count"] for r in fact.groupBy("dataset_id").count().collect()} == {"d1": 25, "d0": 12}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    out = fact_store.active_rows(fact, _datasets(spark), Scope(start="2024-02-03", end="2024-04-02"))
    assert sorted((str(r.date), r.item_id) for r in out.collect()) == [(f"2024-0{m}-03", k) for m in (2, 3) for k in range(4)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    pruned = scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "subquery" in pruned.lower() and "month" in pruned
    files = {r[0].split("dataset_id=")[1].split("/part")[0] for r in out.select(F.input_file_name()).distinct().collect()}
    assert files == {"d1/month=202402", "d1/month=202403"}
    assert fact_store.active_rows(fact, _datasets(spark)).count() == 25
