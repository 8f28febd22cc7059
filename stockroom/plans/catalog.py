"""Registered queries: key -> (spark, sf_dir) -> DataFrame.

parquet files and applies one operator over the whole tables; the scope is the default
one (day range = min/max event day), so no query runs on a subset.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.functions import normalize as N
from stockroom.operators import expiry, movement, policy, scope as sc, stock
from stockroom.operators.snapshot import latest_snapshot
from stockroom.plans.context import Model
from stockroom.sources import driver_tables as dtab, fact_store
from stockroom.session import materialize, passing

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(key: str):
    def deco(fn):
        REGISTRY[key] = fn
        return fn

    return deco


# ---------------------------------------------------------------- 2.1 scope and filters


@register("active_dataset")
def q_active_dataset(spark, sf_dir):
    m = Model(spark, sf_dir)
    # the dataset row joined to the fact: the number of fact rows it scopes
    act = sc.active_dataset(m.datasets)
    return m.raw.join(F.broadcast(act), "dataset_id", "inner").groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("fact_rows")
    )


@register("active_dataset_fallback")
def q_active_dataset_fallback(spark, sf_dir):
    m = Model(spark, sf_dir)
    none_active = m.datasets.withColumn("is_active", F.lit(False))
    return sc.active_dataset_fallback(none_active, m.raw)


@register("default_range")
def q_default_range(spark, sf_dir):
    return sc.default_range(Model(spark, sf_dir).events)


@register("filter_events")
def q_filter_events(spark, sf_dir):
    m = Model(spark, sf_dir)
    s = m.scope(location=2)
    return sc.filter_events(m.events, s).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity")
    )


@register("filter_items")
def q_filter_items(spark, sf_dir):
    m = Model(spark, sf_dir)
    return sc.filter_items(m.items, sc.Scope(location=3)).select("item_id", "item_name", "location_id", "current_qty")


@register("filter_raw")
def q_filter_raw(spark, sf_dir):
    m = Model(spark, sf_dir)
    r = sc.filter_raw(m.raw, sc.Scope(location=4))
    return r.groupBy("location_id").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@register("norm_location")
def q_norm_location(spark, sf_dir):
    r = Model(spark, sf_dir).raw
    return r.groupBy(
        F.col("location_id").alias("location_raw"),
        N.norm_location("location_id").alias("location_id"),
        N.location_label(N.norm_location("location_id")).alias("location_label"),
        N.location_code("location_id").alias("location_code"),
    ).agg(F.count(F.lit(1)).alias("n"))


@register("norm_event_type")
def q_norm_event_type(spark, sf_dir):
    r = Model(spark, sf_dir).raw
    return r.groupBy(N.norm_event_type("event_type").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@register("filter_options_items")
def q_filter_options_items(spark, sf_dir):
    m = Model(spark, sf_dir)
    return sc.filter_options_items(m.raw, m.datasets)


@register("filter_options_locations")
def q_filter_options_locations(spark, sf_dir):
    return sc.filter_options_locations(Model(spark, sf_dir).locations)


@register("filter_options_range")
def q_filter_options_range(spark, sf_dir):
    return sc.filter_options_range(Model(spark, sf_dir).events)


@register("filter_options_range_active")
def q_filter_options_range_active(spark, sf_dir):
    m = Model(spark, sf_dir)
    return sc.filter_options_range_active(_stored_fact(spark, sf_dir), m.datasets)


@register("meta_items")
def q_meta_items(spark, sf_dir):
    m = Model(spark, sf_dir)
    return sc.meta_items(m.raw, m.datasets)


def forecast_config(m: Model) -> tuple[DataFrame, DataFrame]:
    """Forecast item list (critical parts) and per-item cutoffs, both derived from the part table."""
    part = m.driver("part")
    cfg = part.filter(F.col("p_size") > 45).select(F.col("p_partkey").alias("item_id"))
    cut = part.filter(F.col("p_size") > 48).select(
        F.col("p_partkey").alias("item_id"), F.lit("2000-01-01").cast("date").alias("cutoff_date")
    )
    return cfg, cut


@register("forecast_items")
def q_forecast_items(spark, sf_dir):
    m = Model(spark, sf_dir)
    cfg, cut = forecast_config(m)
    return sc.forecast_items(m.raw, m.datasets, cfg, cut)


def _stored_fact(spark, sf_dir) -> DataFrame:
    rows = dtab.raw_versions(spark, sf_dir)
    path = policy.scratch_path(spark, "fact-store")
    fact_store.write_fact(rows, path)
    return fact_store.read_fact(spark, path, rows.schema)


@register("stored_active_fact")
def q_stored_active_fact(spark, sf_dir):
    """The active dataset's movements of a year and a half, from the stored fact of three loads."""
    m = Model(spark, sf_dir)
    rows = fact_store.active_rows(_stored_fact(spark, sf_dir), m.datasets, sc.Scope(start="1997-01-15", end="1998-06-30"))
    return rows.groupBy("dataset_id", "location_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@register("stored_datasets")
def q_stored_datasets(spark, sf_dir):
    """Rows and quantity of each stored load, by year."""
    f = _stored_fact(spark, sf_dir)
    return f.groupBy("dataset_id", F.floor(F.col("month") / 100).cast("int").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@register("adhoc_scoped_sql")
def q_adhoc_scoped_sql(spark, sf_dir):
    m = Model(spark, sf_dir)
    sql = (
        "SELECT location_id, event_type, count(*) AS n, sum(quantity) AS quantity "
        "FROM raw_inventory_v GROUP BY location_id, event_type"
    )
    return sc.adhoc_scoped_sql(spark, sql, m.raw, m.datasets)


# ---------------------------------------------------------------- 2.3 latest-snapshot KPIs


def _snap(m: Model, **kw) -> DataFrame:
    return latest_snapshot(m.raw, m.datasets, **kw)


@register("latest_snapshot")
def q_latest_snapshot(spark, sf_dir):
    s = _snap(Model(spark, sf_dir))
    return s.select("item_id", "location_id", "date", "event_ts", "closing_qty", "min_qty", "max_qty", "issues_qty")


@register("inventory_summary")
def q_inventory_summary(spark, sf_dir):
    return stock.inventory_summary(_snap(Model(spark, sf_dir)))


@register("availability")
def q_availability(spark, sf_dir):
    return stock.availability(_snap(Model(spark, sf_dir)))


@register("reorder_risk")
def q_reorder_risk(spark, sf_dir):
    m = Model(spark, sf_dir)
    return stock.reorder_risk(_snap(m, scope=m.scope(), date_filter=True))


@register("stock_status")
def q_stock_status(spark, sf_dir):
    return stock.stock_status(_snap(Model(spark, sf_dir)))


@register("stock_by_location")
def q_stock_by_location(spark, sf_dir):
    return stock.stock_by_location(_snap(Model(spark, sf_dir)))


@register("qty_by_location")
def q_qty_by_location(spark, sf_dir):
    return stock.qty_by_location(_snap(Model(spark, sf_dir)))


@register("stock_scope")
def q_stock_scope(spark, sf_dir):
    return stock.stock_scope(_snap(Model(spark, sf_dir)))


@register("stock_status_detail")
def q_stock_status_detail(spark, sf_dir):
    m = Model(spark, sf_dir)
    return stock.stock_status_detail(_snap(m, scope=m.scope(), by="code", date_filter=True))


@register("stockout_by_category")
def q_stockout_by_category(spark, sf_dir):
    m = Model(spark, sf_dir)
    return stock.stockout_by_category(m.items, m.categories)


@register("reorder_risk_by_item")
def q_reorder_risk_by_item(spark, sf_dir):
    return stock.reorder_risk_by_item(_snap(Model(spark, sf_dir)))


@register("min_max_compliance")
def q_min_max_compliance(spark, sf_dir):
    return stock.min_max_compliance(_snap(Model(spark, sf_dir)))


@register("turnover_by_item")
def q_turnover_by_item(spark, sf_dir):
    return stock.turnover_by_item(_snap(Model(spark, sf_dir)))


@register("top_reorder_gap")
def q_top_reorder_gap(spark, sf_dir):
    return stock.top_reorder_gap(_snap(Model(spark, sf_dir)))


@register("top_expiry_lots")
def q_top_expiry_lots(spark, sf_dir):
    m = Model(spark, sf_dir)
    snap = _snap(m, row_filter=stock.lot_rows_filter())
    return stock.top_expiry_lots(snap, F.lit(m.scope().as_of).cast("date"))


@register("total_stock_qty")
def q_total_stock_qty(spark, sf_dir):
    return stock.total_stock_qty(Model(spark, sf_dir).items)


@register("stock_dashboard")
def q_stock_dashboard(spark, sf_dir):
    return stock.stock_dashboard(_snap(Model(spark, sf_dir)))


# ---------------------------------------------------------------- 2.4 movement, consumption, expiry


@register("movement_totals")
def q_movement_totals(spark, sf_dir):
    m = Model(spark, sf_dir)
    return movement.movement_totals(m.raw, m.datasets, m.scope())


@register("net_movement")
def q_net_movement(spark, sf_dir):
    m = Model(spark, sf_dir)
    return movement.net_movement(movement.movement_totals(m.raw, m.datasets, m.scope()))


@register("movement_by_location")
def q_movement_by_location(spark, sf_dir):
    m = Model(spark, sf_dir)
    return movement.movement_by_location(m.locations, m.raw, m.datasets, m.scope())


@register("event_feed")
def q_event_feed(spark, sf_dir):
    m = Model(spark, sf_dir)
    return movement.event_feed(m.raw, m.datasets, m.scope())


@register("event_feed_facets")
def q_event_feed_facets(spark, sf_dir):
    m = Model(spark, sf_dir)
    return movement.event_feed_facets(movement.event_feed(m.raw, m.datasets, m.scope()))


@register("consumption_totals")
def q_consumption_totals(spark, sf_dir):
    m = Model(spark, sf_dir)
    return movement.consumption_totals(m.events, m.items, m.scope())


@register("consumption_daily_by_location")
def q_consumption_daily_by_location(spark, sf_dir):
    m = Model(spark, sf_dir)
    return movement.consumption_daily_by_location(m.raw, m.datasets, m.scope())


@register("consumption_daily_pivot")
def q_consumption_daily_pivot(spark, sf_dir):
    m = Model(spark, sf_dir)
    daily = movement.consumption_daily_by_location(m.raw, m.datasets, m.scope())
    return movement.consumption_daily_pivot(daily)


@register("cost_per_unit_by_location")
def q_cost_per_unit_by_location(spark, sf_dir):
    m = Model(spark, sf_dir)
    return movement.cost_per_unit_by_location(m.raw, m.datasets, m.scope())


@register("top_items_by_qty")
def q_top_items_by_qty(spark, sf_dir):
    m = Model(spark, sf_dir)
    return movement.top_items_by_qty(m.raw, m.datasets, m.scope())


@register("top_items_by_value")
def q_top_items_by_value(spark, sf_dir):
    m = Model(spark, sf_dir)
    return movement.top_items_by_value(m.raw, m.datasets, m.scope())


@register("expired_totals")
def q_expired_totals(spark, sf_dir):
    m = Model(spark, sf_dir)
    return expiry.expired_totals(m.events, m.items, m.scope())


@register("expiring_soon")
def q_expiring_soon(spark, sf_dir):
    m = Model(spark, sf_dir)
    return expiry.expiring_soon(m.lots, m.items, m.scope())


@register("expiring_by_category")
def q_expiring_by_category(spark, sf_dir):
    m = Model(spark, sf_dir)
    return expiry.expiring_by_category(m.lots, m.items, m.categories, m.scope())


@register("waste_daily_dense")
def q_waste_daily_dense(spark, sf_dir):
    m = Model(spark, sf_dir)
    return expiry.waste_daily_dense(m.events, m.items, m.scope())


@register("waste_by_location")
def q_waste_by_location(spark, sf_dir):
    m = Model(spark, sf_dir)
    return expiry.waste_by_location(m.raw, m.datasets, m.scope())


@register("waste_by_item")
def q_waste_by_item(spark, sf_dir):
    m = Model(spark, sf_dir)
    return expiry.waste_by_item(m.raw, m.datasets, m.scope())


@register("waste_trend")
def q_waste_trend(spark, sf_dir):
    m = Model(spark, sf_dir)
    return expiry.waste_trend(m.raw, m.datasets, m.scope())


@register("expiring_60d_rows")
def q_expiring_60d_rows(spark, sf_dir):
    m = Model(spark, sf_dir)
    return expiry.expiring_60d_rows(m.raw, m.datasets, m.scope())


# ---------------------------------------------------------------- 2.5 inventory policies
from stockroom.operators import policy  # noqa: E402

ORDERING_COST = 75.0
HOLDING_RATE = 0.25
SERVICE_LEVEL = "97.5"


def _abc_lines(m: Model) -> DataFrame:
    return policy.abc_classify(policy.abc_input(m.raw, m.datasets, m.items, m.scope()))


@register("abc_input")
def q_abc_input(spark, sf_dir):
    m = Model(spark, sf_dir)
    a = policy.abc_input(m.raw, m.datasets, m.items, m.scope())
    return a.withColumn("annual_value", F.col("annual_value").cast("double"))


@register("abc_classify")
def q_abc_classify(spark, sf_dir):
    return _abc_lines(Model(spark, sf_dir))


@register("abc_snapshot_write")
def q_abc_snapshot_write(spark, sf_dir):
    m = Model(spark, sf_dir)
    base = policy.scratch_path(spark, "abc")
    sid = policy.abc_snapshot_write(_abc_lines(m), base, m.scope())
    lines = spark.read.parquet(f"{base}/lines").filter(F.col("snapshot_id") == sid)
    return lines.groupBy("snapshot_id", "abc_class").agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("annual_value"), 2).alias("annual_value")
    )


@register("abc_snapshot_read")
def q_abc_snapshot_read(spark, sf_dir):
    m = Model(spark, sf_dir)
    base = policy.scratch_path(spark, "abc")
    policy.abc_snapshot_write(_abc_lines(m), base, m.scope())
    return policy.abc_snapshot_read(spark, base, m.raw, m.datasets, m.items)


@register("abc_kpis")
def q_abc_kpis(spark, sf_dir):
    return policy.abc_kpis(_abc_lines(Model(spark, sf_dir)))


def _policy_pairs(m: Model) -> DataFrame:
    return policy.policy_latest_in_period(m.raw, m.datasets, m.scope())


@register("policy_latest_in_period")
def q_policy_latest_in_period(spark, sf_dir):
    return _policy_pairs(Model(spark, sf_dir))


@register("policy_item_match")
def q_policy_item_match(spark, sf_dir):
    m = Model(spark, sf_dir)
    return policy.policy_item_match(_policy_pairs(m), m.items).select("item_id", "location_id", "item_name", "storage_item_id")


def _round6(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("eoq")
def q_eoq(spark, sf_dir):
    m = Model(spark, sf_dir)
    e = policy.eoq(policy.policy_item_match(_policy_pairs(m), m.items), ORDERING_COST, HOLDING_RATE)
    e = e.select("item_id", "location_id", "storage_item_id", "annual_demand_qty", "holding_cost", "eoq",
                 "orders_per_year", "cycle_time_days")
    return _round6(e, ["annual_demand_qty", "holding_cost", "eoq", "orders_per_year", "cycle_time_days"])


def _moments(m: Model) -> DataFrame:
    return policy.daily_demand_moments(m.raw, m.datasets, m.scope())


@register("daily_demand_dense")
def q_daily_demand_dense(spark, sf_dir):
    return _round6(_moments(Model(spark, sf_dir)), ["mean_daily_qty", "demand_std_dev"])


def _with_safety(m: Model) -> DataFrame:
    """Pairs with their policy inputs and safety stock, from one pass over the fact."""
    return policy.safety_stock(policy.policy_inputs(m.raw, m.datasets, m.scope()), F.col("restock_lead_time"), SERVICE_LEVEL)


@register("safety_stock")
def q_safety_stock(spark, sf_dir):
    s = _with_safety(Model(spark, sf_dir)).select(
        "item_id", "location_id", "demand_std_dev", "service_level_z", "lead_time_days", "safety_stock"
    )
    return _round6(s, ["demand_std_dev", "safety_stock"])


def _logged_rop(m: Model, path: str) -> DataFrame:
    """Save the safety stock of every matched pair and compute reorder points from what is saved."""
    # the pairs are saved and feed the ROP: written once, read twice
    matched = materialize(policy.policy_item_match(_with_safety(m), m.items), "policy-pairs")
    policy.policy_log_write(matched.withColumn("item_id", F.col("storage_item_id")), path, "safety_stock", m.scope())
    pairs = matched.drop("lead_time_days", "service_level_z", "safety_stock")
    return policy.rop(pairs, F.col("restock_lead_time"), saved_safety=policy.policy_log_read(m.spark, path, "safety_stock"))


@register("rop")
def q_rop(spark, sf_dir):
    r = _logged_rop(Model(spark, sf_dir), policy.scratch_path(spark, "policy-log"))
    r = r.select("item_id", "location_id", "storage_item_id", "daily_demand_avg", "lead_time_days",
                 "safety_stock_qty", "rop", "current_stock", "status")
    return _round6(r, ["safety_stock_qty", "rop"])


def _log_rows(spark, path: str, kind: str) -> DataFrame:
    return policy.policy_log_read(spark, path, kind).select("policy", "item_id", "location_id", *policy.LOG_COLUMNS[kind], "review_date", "notes")


@register("policy_log_write")
def q_policy_log_write(spark, sf_dir):
    m = Model(spark, sf_dir)
    path = policy.scratch_path(spark, "policy-log")
    e = policy.eoq(policy.policy_item_match(_policy_pairs(m), m.items), ORDERING_COST, HOLDING_RATE)
    e = e.withColumn("item_id", F.col("storage_item_id")).withColumn("lead_time_days", F.col("restock_lead_time"))
    policy.policy_log_write(e, path, "eoq", m.scope(), HOLDING_RATE)
    return _round6(_log_rows(spark, path, "eoq"), ["annual_demand_qty", "holding_cost"])


@register("policy_log_safety_stock")
def q_policy_log_safety_stock(spark, sf_dir):
    path = policy.scratch_path(spark, "policy-log")
    _logged_rop(Model(spark, sf_dir), path)
    return _round6(_log_rows(spark, path, "safety_stock"), ["demand_std_dev"])


@register("policy_log_rop")
def q_policy_log_rop(spark, sf_dir):
    m = Model(spark, sf_dir)
    path = policy.scratch_path(spark, "policy-log")
    policy.policy_log_write(_logged_rop(m, path).withColumn("item_id", F.col("storage_item_id")), path, "rop", m.scope())
    return _round6(_log_rows(spark, path, "rop"), ["safety_stock_qty"])


@register("period_days")
def q_period_days(spark, sf_dir):
    r = Model(spark, sf_dir).raw
    g = r.groupBy(F.col("item_id").alias("item_id")).agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    return g.select(
        "item_id", "first_day", "last_day",
        policy.period_days_col(F.col("first_day"), F.col("last_day")).alias("period_days"),
        policy.period_days_col(F.col("last_day"), F.col("first_day")).alias("reversed_days"),
    )


# ---------------------------------------------------------------- 2.6 risk, supplier, warehouse
from stockroom.operators import risk, warehouse  # noqa: E402


def _latest_risk(m: Model) -> DataFrame:
    return risk.latest_risk(m.risk, m.datasets)


@register("latest_risk")
def q_latest_risk(spark, sf_dir):
    return _latest_risk(Model(spark, sf_dir))


@register("risk_matrix")
def q_risk_matrix(spark, sf_dir):
    return risk.risk_matrix(_latest_risk(Model(spark, sf_dir)))


@register("risk_matrix_cells")
def q_risk_matrix_cells(spark, sf_dir):
    return risk.risk_matrix_cells(_latest_risk(Model(spark, sf_dir)))


@register("risk_zone")
def q_risk_zone(spark, sf_dir):
    return risk.risk_zone(risk.risk_matrix_cells(_latest_risk(Model(spark, sf_dir))))


@register("risk_cost_exposure")
def q_risk_cost_exposure(spark, sf_dir):
    return risk.risk_cost_exposure(_latest_risk(Model(spark, sf_dir)))


@register("risks_by_category")
def q_risks_by_category(spark, sf_dir):
    return risk.risks_by_category(_latest_risk(Model(spark, sf_dir)))


@register("procurement_kpis")
def q_procurement_kpis(spark, sf_dir):
    m = Model(spark, sf_dir)
    return risk.procurement_kpis(_latest_risk(m), risk.supplier_scores(m.vendor_kpis, m.datasets))


@register("supplier_scores")
def q_supplier_scores(spark, sf_dir):
    m = Model(spark, sf_dir)
    return risk.supplier_scores(m.vendor_kpis, m.datasets)


@register("supplier_order_kpis")
def q_supplier_order_kpis(spark, sf_dir):
    return risk.supplier_order_kpis(Model(spark, sf_dir).order_sheet)


@register("latest_space")
def q_latest_space(spark, sf_dir):
    m = Model(spark, sf_dir)
    return warehouse.latest_space(m.space, m.locations)


@register("space_status")
def q_space_status(spark, sf_dir):
    m = Model(spark, sf_dir)
    return warehouse.latest_space(m.space, m.locations).select("location_id", "utilization_pct", "status")


@register("space_remaining")
def q_space_remaining(spark, sf_dir):
    m = Model(spark, sf_dir)
    return warehouse.latest_space(m.space, m.locations).select(
        "location_id", "remaining", "occupied_pallets", "remaining_pallets"
    )


@register("labor_daily")
def q_labor_daily(spark, sf_dir):
    return warehouse.labor_daily(Model(spark, sf_dir).labor)


@register("labor_overall")
def q_labor_overall(spark, sf_dir):
    return warehouse.labor_overall(Model(spark, sf_dir).labor)


@register("labor_top_staff")
def q_labor_top_staff(spark, sf_dir):
    return warehouse.labor_top_staff(Model(spark, sf_dir).staff)


# ---------------------------------------------------------------- 2.2 scan ingestion, 2.9 streaming
from stockroom.sources import driver_tables as dtab, scans  # noqa: E402
from stockroom.streaming import scan_stream as ss  # noqa: E402

LEDGER_BEFORE = "2024-01-08"


def _scan_batch(m: Model):
    rows = scans.scan_header_check(m.scans)
    valid, quarantine, skipped = scans.scan_validate(rows, dtab.ACTIVE_DATASET)
    ledger = valid.filter(F.col("date") < F.lit(LEDGER_BEFORE).cast("date")).select("scan_id")
    new, dups = scans.scan_dedupe(valid, ledger)
    return rows, valid, quarantine, new


@register("scan_header_check")
def q_scan_header_check(spark, sf_dir):
    m = Model(spark, sf_dir)
    messy = m.scans.toDF(*[f"  {c.upper()} " if c != "row_index" else c for c in m.scans.columns])
    return scans.scan_header_check(messy)


@register("scan_validate")
def q_scan_validate(spark, sf_dir):
    return _scan_batch(Model(spark, sf_dir))[1]


@register("scan_quarantine")
def q_scan_quarantine(spark, sf_dir):
    return _scan_batch(Model(spark, sf_dir))[2]


@register("scan_dedupe")
def q_scan_dedupe(spark, sf_dir):
    return _scan_batch(Model(spark, sf_dir))[3]


@register("scan_explode_qty")
def q_scan_explode_qty(spark, sf_dir):
    return scans.scan_explode_qty(_scan_batch(Model(spark, sf_dir))[3])


_FACT_COLS = ["scan_row", "event_ts", "date", "dataset_id", "item_id", "item_name", "location_id", "event_type",
              "quantity", "receipts_qty", "issues_qty"]


def _read_fact(spark, sink: ss.ScanSink) -> DataFrame:
    return sink.read_fact(spark).withColumn("scan_row", F.col("ingest_seq.row")).select(*_FACT_COLS)


@register("scan_append")
def q_scan_append(spark, sf_dir):
    m = Model(spark, sf_dir)
    sink = ss.ScanSink(policy.scratch_path(spark, "scan-append"))
    scans.scan_append(_scan_batch(m)[3], sink.fact, sink.ledger, batch_id=0)
    return _read_fact(spark, sink)


@register("ingest_metrics")
def q_ingest_metrics(spark, sf_dir):
    rows, valid, quarantine, new = _scan_batch(Model(spark, sf_dir))
    return scans.ingest_metrics(0, valid, new, quarantine, rows).drop("synced_at")


def _arrivals(spark, table: DataFrame, slices: list, base: str, start) -> None:
    """Let a table arrive in ``slices`` (conditions): each is added to a landing folder, and the stream that ``start``
    makes of the folder is started anew from its checkpoint and runs until it has read all."""
    landing = os.path.join(base, "landing")
    for condition in slices:
        table.where(condition).write.mode("append").parquet(landing)
        q = start(spark.readStream.schema(table.schema).parquet(landing))
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))


def _run_scan_stream(spark, sf_dir) -> ss.ScanSink:
    """The events of January 2024 week by week; ids come back weeks later."""
    sink = ss.ScanSink(policy.scratch_path(spark, "scan-stream"))
    weeks = [F.lit(d).cast("date") for d in ("2024-01-08", "2024-01-15", "2024-01-22")]
    day = F.to_date("ts")
    slices = [day < weeks[0], (day >= weeks[0]) & (day < weeks[1]), (day >= weeks[1]) & (day < weeks[2]), (day >= weeks[2]) | day.isNull()]
    _arrivals(spark, dtab.table(spark, sf_dir, "events"), slices, sink.base, lambda src: ss.scan_stream(spark, dtab.scan_rows_from_events(src), sink, dtab.ACTIVE_DATASET))
    return sink


@register("scan_stream")
def q_scan_stream(spark, sf_dir):
    return _read_fact(spark, _run_scan_stream(spark, sf_dir))


@register("scan_stream_quarantine")
def q_scan_stream_quarantine(spark, sf_dir):
    return _run_scan_stream(spark, sf_dir).quarantine_log.read(spark)


@register("scan_stream_metrics")
def q_scan_stream_metrics(spark, sf_dir):
    return _run_scan_stream(spark, sf_dir).read_metrics(spark).drop("synced_at")


@register("scan_stream_dedupe")
def q_scan_stream_dedupe(spark, sf_dir):
    """The whole winning row of each scan id and the batch that brought it."""
    rows = _run_scan_stream(spark, sf_dir).read_fact(spark)
    return rows.select("scan_id", F.col("ingest_seq.batch").alias("batch_id"), F.col("ingest_seq.row").alias("scan_row"), *_FACT_COLS[1:])


def _run_movement_stream(spark, sf_dir) -> ss.MovementSink:
    """Lineitems by return flag, one after the other: each flag brings days that earlier ones have passed."""
    base = policy.scratch_path(spark, "movement-daily")
    sink = ss.MovementSink(base)
    flag = F.col("l_returnflag")
    slices = [flag == "A", flag == "N", ~flag.isin("A", "N") | flag.isNull()]
    _arrivals(spark, dtab.table(spark, sf_dir, "lineitem"), slices, base, lambda src: ss.run_movement_daily(spark, dtab.movements_from_lineitem(src), sink))
    return sink


@register("stream_movement_daily")
def q_stream_movement_daily(spark, sf_dir):
    return _run_movement_stream(spark, sf_dir).daily.read(spark)


@register("stream_movement_late")
def q_stream_movement_late(spark, sf_dir):
    return _run_movement_stream(spark, sf_dir).arrivals.read(spark).withColumnRenamed("batch", "batch_id")


# ---------------------------------------------------------------- 2.7 forecasting
from stockroom.operators import forecast as fc  # noqa: E402
from stockroom.operators import forecast_run as fr  # noqa: E402


def _fc_load(m: Model) -> DataFrame:
    _cfg, cut = forecast_config(m)
    return fc.fc_load(m.raw, m.datasets, cut)


def _fc_frame(m: Model, keep: bool = False) -> DataFrame:
    f = fc.fc_calendar(fc.fc_smooth_target(fc.fc_gap_fill(_fc_monthly(m))))
    return materialize(f, "forecast-frame") if keep else f


def _fc_monthly(m: Model) -> DataFrame:
    return fc.fc_monthly(_fc_load(m), m.n_facts)


def _r6(df: DataFrame) -> DataFrame:
    dbl = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return _round6(df, dbl)


def _fc_run(m: Model):
    """Native candidates end to end: frame, test predictions, metrics, best, 3-step forecast."""
    frame = _fc_frame(m, keep=True)
    months = frame.count()
    preds = materialize(fc.native_predictions(fc.by_item(frame, months)))
    metrics = fc.fc_metrics(fc.by_item(preds, preds.count()))
    best = materialize(fc.fc_select(metrics))
    future = fc.fc_recursive(best, fc.by_item(frame, months))
    return frame, preds, metrics, best, future


def _daily_run(m: Model):
    """The daily job: the configured items with all candidates, as (frame, predictions, metrics, best, future)."""
    cfg, cut = forecast_config(m)
    frame = materialize(fc.fc_frame(m.raw, m.datasets, cut, cfg, m.n_facts), "forecast-frame")
    return frame, *fr.fc_run(frame, lambda df: materialize(df, "forecast-run"))


def _published(m: Model) -> DataFrame:
    frame, preds, _metrics, best, future = _fc_run(m)
    as_of = m.scope().as_of
    path = fc.publish_path(policy.scratch_path(m.spark, "forecast"))
    return fc.fc_publish(frame, preds, best, future, dtab.ACTIVE_DATASET, as_of, f"{as_of} 02:00:00", path)


@register("fc_load")
def q_fc_load(spark, sf_dir):
    return _fc_load(Model(spark, sf_dir))


@register("fc_monthly")
def q_fc_monthly(spark, sf_dir):
    return _r6(_fc_monthly(Model(spark, sf_dir)))


@register("fc_gap_fill")
def q_fc_gap_fill(spark, sf_dir):
    return _r6(fc.fc_gap_fill(_fc_monthly(Model(spark, sf_dir))))


@register("fc_smooth_target")
def q_fc_smooth_target(spark, sf_dir):
    f = fc.fc_smooth_target(fc.fc_gap_fill(_fc_monthly(Model(spark, sf_dir))))
    return _r6(f.select("item_id", "month_end", "target_nosmooth", "target_smooth"))


@register("fc_calendar")
def q_fc_calendar(spark, sf_dir):
    f = _fc_frame(Model(spark, sf_dir))
    return _r6(f.select("item_id", "month_end", "trend", "month", "quarter", "month_sin", "month_cos"))


@register("fc_lags")
def q_fc_lags(spark, sf_dir):
    f = fc.fc_lags(_fc_frame(Model(spark, sf_dir)), "target_nosmooth")
    return _r6(f.select("item_id", "month_end", "lag_1", "lag_2", "lag_3", "rolling_mean_2", "rolling_std_2",
                        "rolling_min_2", "rolling_max_2", "rolling_mean_3", "rolling_std_3", "diff_1"))


@register("fc_split")
def q_fc_split(spark, sf_dir):
    f = fc.fc_split(_fc_frame(Model(spark, sf_dir)))
    return f.select("item_id", "month_end", "trend", "n_months", "test_size", "is_test")


@register("fc_train_predict")
def q_fc_train_predict(spark, sf_dir):
    return _daily_run(Model(spark, sf_dir))[1]


@register("fc_seasonal_trend")
def q_fc_seasonal_trend(spark, sf_dir):
    """The piecewise trend with yearly season on the held-out months of every item, to a thousandth of a unit."""
    p = fr.holdout_predictions(fr.fc_series(_fc_frame(Model(spark, sf_dir))), [fr.TREND_MODEL], deal=False)
    return p.withColumn("prediction", F.round("prediction", 3)).withColumn("actual", F.round("actual", 6))


@register("fc_run_metrics")
def q_fc_run_metrics(spark, sf_dir):
    return _r6(_daily_run(Model(spark, sf_dir))[2])


@register("fc_run_select")
def q_fc_run_select(spark, sf_dir):
    return _r6(_daily_run(Model(spark, sf_dir))[3])


@register("fc_run_forecast")
def q_fc_run_forecast(spark, sf_dir):
    return _daily_run(Model(spark, sf_dir))[4]


@register("fc_run_publish")
def q_fc_run_publish(spark, sf_dir):
    m = Model(spark, sf_dir)
    frame, preds, _metrics, best, future = _daily_run(m)
    as_of = m.scope().as_of
    path = fc.publish_path(policy.scratch_path(spark, "forecast"))
    return _r6(fc.fc_publish(frame, preds, best, future, dtab.ACTIVE_DATASET, as_of, f"{as_of} 02:00:00", path))


@register("fc_metrics")
def q_fc_metrics(spark, sf_dir):
    return _r6(fc.fc_metrics(fc.native_predictions(_fc_frame(Model(spark, sf_dir)))))


@register("fc_select")
def q_fc_select(spark, sf_dir):
    return _r6(fc.fc_select(fc.fc_metrics(fc.native_predictions(_fc_frame(Model(spark, sf_dir))))))


@register("fc_recursive")
def q_fc_recursive(spark, sf_dir):
    return _fc_run(Model(spark, sf_dir))[4]


@register("fc_publish")
def q_fc_publish(spark, sf_dir):
    return _r6(_published(Model(spark, sf_dir)))


@register("fc_latest_run")
def q_fc_latest_run(spark, sf_dir):
    return fc.fc_latest_run(_published(Model(spark, sf_dir)), dtab.ACTIVE_DATASET)


@register("fc_actuals")
def q_fc_actuals(spark, sf_dir):
    return fc.fc_actuals(_fc_load(Model(spark, sf_dir)))


def _points(m: Model):
    pub = _published(m)
    latest = fc.fc_latest_run(pub, dtab.ACTIVE_DATASET)
    return pub, latest, fc.fc_points(pub, latest, dtab.ACTIVE_DATASET)


@register("fc_points")
def q_fc_points(spark, sf_dir):
    return _r6(_points(Model(spark, sf_dir))[2])


@register("fc_date_info")
def q_fc_date_info(spark, sf_dir):
    m = Model(spark, sf_dir)
    pub, latest, _ = _points(m)
    return fc.fc_date_info(_fc_load(m), pub, latest)


@register("fc_run_summary")
def q_fc_run_summary(spark, sf_dir):
    pub, latest, _ = _points(Model(spark, sf_dir))
    return _r6(fc.fc_run_summary(pub, latest))


def _chart(m: Model) -> DataFrame:
    return fc.fc_chart(fc.fc_actuals(_fc_load(m)), _points(m)[2])


@register("fc_chart")
def q_fc_chart(spark, sf_dir):
    return _r6(_chart(Model(spark, sf_dir)))


@register("fc_chart_dense")
def q_fc_chart_dense(spark, sf_dir):
    return _r6(fc.fc_chart_dense(_chart(Model(spark, sf_dir))))


# ---------------------------------------------------------------- 2.2 report (CSV) loading
from stockroom.functions.normalize import parse_date_multi, parse_number  # noqa: E402
from stockroom.sources import csv_load as cl  # noqa: E402
from stockroom.sources import registry as rg  # noqa: E402

def _lines(spark, report: DataFrame) -> DataFrame:
    """A report written as text files and read again; files go by their names."""
    path = os.path.join(policy.scratch_path(spark, "report"), "files")
    dtab.write_report(report, path)
    lines = cl.read_lines(spark, path)
    return lines.withColumn("source_file", F.regexp_extract("source_file", "source_file=([^/]+)", 1))


def _read_in(load, report: DataFrame) -> DataFrame:
    """The parsed rows of a report, written once; its files and the steps of its parsing are gone after that."""
    with passing(report.sparkSession):
        return materialize(load(_lines(report.sparkSession, report)), "report-rows", keep=True)


def _drop_pos(df: DataFrame) -> DataFrame:
    return df.drop("source_file", "line_no")


def _loaded(rows: DataFrame, facts) -> DataFrame:
    """What a first load of one report stores: ``facts`` of its rows, with the ids that the load hands out."""
    rows = materialize(rows, "report-rows")
    return _drop_pos(rg.with_ids(facts(rows), rg.register(rg.Registry(), [rows])))


@register("csv_with_preamble")
def q_csv_with_preamble(spark, sf_dir):
    r = cl.csv_with_preamble(_lines(spark, dtab.closing_balance_report(spark, sf_dir)), cl.CLOSING_BALANCE_COLUMNS, ["Notes"])
    return r.select("source_file", "Subinventory Name", "Item Name", "Start Date", "Costed Onhand Quantity", "Notes")


@register("preamble_period")
def q_preamble_period(spark, sf_dir):
    lines = dtab.opening_receipts_issues_report(spark, sf_dir).unionByName(dtab.closing_balance_report(spark, sf_dir))
    return cl.preamble_period(_lines(spark, lines))


@register("parse_number")
def q_parse_number(spark, sf_dir):
    li = dtab.table(spark, sf_dir, "lineitem")
    text = (
        F.when(F.col("l_linenumber") == 1, F.lit(" "))
        .when(F.col("l_linenumber") == 2, F.lit("null"))
        .when(F.col("l_linenumber") == 3, F.lit("n/a"))
        .otherwise(F.format_number("l_extendedprice", 2))
    )
    return li.select("l_orderkey", "l_linenumber", "l_partkey", parse_number(text).alias("value"))


@register("parse_date_multi")
def q_parse_date_multi(spark, sf_dir):
    li = dtab.table(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    text = (
        F.when(F.col("l_linenumber") == 7, F.lit("bad"))
        .when(F.col("l_linenumber") % 4 == 0, F.date_format(day, "dd/MM/yyyy"))
        .when(F.col("l_linenumber") % 4 == 1, F.date_format(day, "MM/dd/yyyy"))
        .when(F.col("l_linenumber") % 4 == 2, F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:30:00Z")))
    )
    return li.select("l_orderkey", "l_linenumber", "l_partkey", parse_date_multi(text).alias("value"))


@register("dim_upsert")
def q_dim_upsert(spark, sf_dir):
    """Locations after a second load: the first one's keep their ids, new ones go on from there."""
    first = _read_in(cl.load_closing_balance, dtab.closing_balance_report(spark, sf_dir))
    second = _read_in(cl.load_min_max, dtab.min_max_report(spark, sf_dir))
    registry = rg.register(rg.register(rg.Registry(), [first]), [second])
    return registry.locations.join(registry.organizations, "org_id")


def _whole_load(spark, sf_dir) -> rg.Registry:
    reports = [
        (cl.load_categories, dtab.categories_report),
        (cl.load_item_types, dtab.item_types_report),
        (cl.load_closing_balance, dtab.closing_balance_report),
        (partial(cl.load_opening_receipts_issues, org="MAIN_ORG"), dtab.opening_receipts_issues_report),
        (cl.load_min_max, dtab.min_max_report),
        (cl.load_consumption, dtab.consumption_report),
        (cl.load_expiry_waste, dtab.expiry_report),
    ]
    return rg.register(rg.Registry(), [_read_in(load, report(spark, sf_dir)) for load, report in reports])


@register("dim_fill_missing")
def q_dim_fill_missing(spark, sf_dir):
    """The item master after all reports."""
    return _whole_load(spark, sf_dir).items


@register("load_categories")
def q_load_categories(spark, sf_dir):
    return rg.register(rg.Registry(), [cl.load_categories(_lines(spark, dtab.categories_report(spark, sf_dir)))]).categories


@register("load_item_types")
def q_load_item_types(spark, sf_dir):
    return rg.register(rg.Registry(), [cl.load_item_types(_lines(spark, dtab.item_types_report(spark, sf_dir)))]).item_types


@register("load_closing_balance")
def q_load_closing_balance(spark, sf_dir):
    return _loaded(cl.load_closing_balance(_lines(spark, dtab.closing_balance_report(spark, sf_dir))), cl.latest_balances)


def _ori(spark, sf_dir) -> DataFrame:
    return cl.load_opening_receipts_issues(_lines(spark, dtab.opening_receipts_issues_report(spark, sf_dir)), org="MAIN_ORG")


@register("load_opening_receipts_issues")
def q_load_opening_receipts_issues(spark, sf_dir):
    return _loaded(_ori(spark, sf_dir), cl.latest_balances)


@register("unpivot_movements")
def q_unpivot_movements(spark, sf_dir):
    return _loaded(_ori(spark, sf_dir), cl.unpivot_movements)


@register("load_min_max")
def q_load_min_max(spark, sf_dir):
    """The stored levels of a first delivery (half of the files) after the whole report has come in."""
    rows = materialize(cl.load_min_max(_lines(spark, dtab.min_max_report(spark, sf_dir))), "report-rows")
    registry = rg.register(rg.Registry(), [rows])
    stored = materialize(rg.with_ids(cl.latest_min_max(rows.where("source_file < 'min_max-32'")), registry), "levels")
    return _drop_pos(cl.merge_min_max(stored, rg.with_ids(cl.latest_min_max(rows), registry)))


@register("load_consumption")
def q_load_consumption(spark, sf_dir):
    return _loaded(cl.load_consumption(_lines(spark, dtab.consumption_report(spark, sf_dir))), lambda r: r.where(cl.has_item_and_location()))


@register("load_expiry_waste")
def q_load_expiry_waste(spark, sf_dir):
    return _loaded(cl.load_expiry_waste(_lines(spark, dtab.expiry_report(spark, sf_dir))), lambda r: r.where(cl.has_item_and_location()))


@register("classify_waste")
def q_classify_waste(spark, sf_dir):
    return _loaded(cl.load_expiry_waste(_lines(spark, dtab.expiry_report(spark, sf_dir))), cl.classify_waste)


@register("export_event_feed")
def q_export_event_feed(spark, sf_dir):
    m = Model(spark, sf_dir)
    path = policy.scratch_path(spark, "event-feed-csv")
    cl.export_event_feed(movement.event_feed(m.raw, m.datasets, m.scope(), full=True), path)
    schema = "`Type` string, `Item ID` bigint, `Location` string, `Quantity` double, `Timestamp` string"
    return spark.read.option("header", True).schema(schema).csv(path)
