"""Independent SQL oracle (DuckDB dialect) for the registered queries.

The model tables are re-derived from the driver tables as CTEs, written directly from the
mapping documented in ``stockroom.sources.driver_tables`` (not generated from the Spark
plans). ``ORACLE[key]`` is the full statement for ``catalog.REGISTRY[key]``.
"""

from __future__ import annotations

AS_OF = "DATE '1998-06-01'"

# name -> (dependencies, body)
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, deps: tuple[str, ...] = ()) -> None:
    _CTES[name] = (deps, body.strip())


def with_(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS (\n{_CTES[n][1]}\n)" for n in order]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


EVENT_TYPE = "CASE l_returnflag WHEN 'A' THEN 'RECEIPT' WHEN 'N' THEN 'ISSUE' ELSE 'ADJUSTMENT_WASTE' END"
LOC_INT = "CAST(REPLACE(UPPER(location_id), 'LOC', '') AS BIGINT)"
NEWEST = "date DESC, event_ts DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC, k5 DESC"

cte("raw_inventory", f"""
SELECT 'ds_active' AS dataset_id, CAST(l_shipdate AS DATE) AS date,
  'LOC' || CAST(l_suppkey % 4 + 1 AS VARCHAR) AS location_id,
  l_partkey AS item_id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS item_name, l_shipdate AS event_ts,
  {EVENT_TYPE} AS event_type,
  l_quantity AS quantity,
  CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0.0 END AS receipts_qty,
  CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0.0 END AS issues_qty,
  CAST((l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 61 - 5 AS DOUBLE) AS closing_qty,
  CAST(p_size % 20 AS DOUBLE) AS min_qty, CAST(p_size % 20 + 25 AS DOUBLE) AS max_qty,
  l_extendedprice AS inventory_value, p_retailprice AS unit_cost,
  CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0.0 END AS annual_consumption_value,
  CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity / 10 END AS avg_usage_per_day,
  CAST(l_linenumber AS DOUBLE) AS restock_lead_time,
  CASE WHEN l_discount = 0 THEN NULL ELSE CAST(l_orderkey % 40 AS DOUBLE) END AS current_stock_avg,
  CAST(l_orderkey % 41 AS DOUBLE) AS current_stock_avg_rounded,
  CASE WHEN l_linenumber = 1 THEN '' ELSE 'LOT' || CAST(l_orderkey % 500 AS VARCHAR) END AS lot_number,
  CASE WHEN l_linenumber = 7 THEN 'n/a'
       ELSE CAST(CAST(l_shipdate AS DATE) + CAST(l_orderkey % 120 AS INTEGER) AS VARCHAR) END AS lot_expiry,
  l_orderkey AS k1, l_linenumber AS k2, l_suppkey AS k3, l_quantity AS k4, l_extendedprice AS k5
FROM lineitem JOIN part ON p_partkey = l_partkey""")

cte("datasets", """
SELECT * FROM (VALUES
  ('ds_prev', 'previous load', 'prev.csv', TIMESTAMP '2024-01-01 00:00:00', TRUE),
  ('ds_active', 'current load', 'current.csv', TIMESTAMP '2024-02-01 00:00:00', TRUE),
  ('ds_archived', 'archived load', 'archived.csv', TIMESTAMP '2024-03-01 00:00:00', FALSE)
) t(dataset_id, dataset_name, source_file, imported_at, is_active)""")

cte("active_dataset", "SELECT dataset_id FROM datasets WHERE is_active ORDER BY imported_at DESC LIMIT 1", ("datasets",))

cte("raw_active", "SELECT * FROM raw_inventory WHERE dataset_id = (SELECT dataset_id FROM active_dataset)",
    ("raw_inventory", "active_dataset"))

cte("inventory_events", f"""
SELECT l_shipdate AS event_ts, {EVENT_TYPE} AS event_type, l_partkey AS item_id,
  l_suppkey % 4 + 1 AS location_id,
  CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE -l_quantity END AS quantity,
  p_retailprice AS unit_cost_aed
FROM lineitem JOIN part ON p_partkey = l_partkey""")

cte("rng", "SELECT MIN(CAST(event_ts AS DATE)) AS start_d, MAX(CAST(event_ts AS DATE)) AS end_d FROM inventory_events",
    ("inventory_events",))

cte("items", """
SELECT p_partkey AS item_id, 'ITM' || CAST(p_partkey AS VARCHAR) AS item_code,
  UPPER(p_name) || ' ' || CAST(p_partkey AS VARCHAR) AS item_name,
  p_type AS category_id, p_partkey % 5 + 1 AS location_id,
  CAST(p_size % 20 AS BIGINT) AS min_qty, CAST(p_size % 20 + 25 AS BIGINT) AS max_qty,
  p_partkey % 7 AS current_qty, p_retailprice AS unit_cost_aed, p_size > 45 AS is_critical
FROM part""")

cte("categories", """
SELECT category_id, UPPER(SUBSTR(LOWER(category_id), 1, 1)) || SUBSTR(LOWER(category_id), 2) AS category_name
FROM (SELECT DISTINCT p_type AS category_id FROM part)""")

cte("locations", """
SELECT location_id, printf('LOC%02d', location_id) AS location_code,
  'Warehouse ' || CAST(location_id AS VARCHAR) AS location_name
FROM (SELECT DISTINCT s_suppkey % 5 + 1 AS location_id FROM supplier)""")

cte("item_lots", """
SELECT l_partkey AS item_id, 'LOT' || CAST(l_orderkey % 500 AS VARCHAR) AS lot_number,
  CAST(l_shipdate AS DATE) + CAST(l_orderkey % 120 AS INTEGER) AS expiry_date,
  CAST(l_quantity AS BIGINT) AS qty_on_hand
FROM lineitem""")

cte("snap", f"""
SELECT * FROM (
  SELECT r.* EXCLUDE (location_id), {LOC_INT} AS location_id,
    ROW_NUMBER() OVER (PARTITION BY item_id, {LOC_INT} ORDER BY {NEWEST}) AS rn
  FROM raw_active r WHERE TRIM(COALESCE(location_id, '')) <> '') z
WHERE rn = 1""", ("raw_active",))

cte("snap_in_range", f"""
SELECT * FROM (
  SELECT r.* EXCLUDE (location_id), {LOC_INT} AS location_id,
    ROW_NUMBER() OVER (PARTITION BY item_id, {LOC_INT} ORDER BY {NEWEST}) AS rn
  FROM raw_active r WHERE TRIM(COALESCE(location_id, '')) <> ''
    AND date BETWEEN (SELECT start_d FROM rng) AND (SELECT end_d FROM rng)) z
WHERE rn = 1""", ("raw_active", "rng"))

cte("snap_code_in_range", f"""
SELECT * FROM (
  SELECT r.* EXCLUDE (location_id), UPPER(TRIM(location_id)) AS location_id,
    ROW_NUMBER() OVER (PARTITION BY item_id, UPPER(TRIM(location_id)) ORDER BY {NEWEST}) AS rn
  FROM raw_active r WHERE TRIM(COALESCE(location_id, '')) <> ''
    AND date BETWEEN (SELECT start_d FROM rng) AND (SELECT end_d FROM rng)) z
WHERE rn = 1""", ("raw_active", "rng"))

cte("snap_lots", f"""
SELECT * FROM (
  SELECT r.* EXCLUDE (location_id), {LOC_INT} AS location_id,
    ROW_NUMBER() OVER (PARTITION BY item_id, {LOC_INT} ORDER BY {NEWEST}) AS rn
  FROM raw_active r WHERE TRIM(COALESCE(location_id, '')) <> ''
    AND TRIM(COALESCE(lot_number, '')) <> '' AND TRIM(COALESCE(lot_expiry, '')) <> '') z
WHERE rn = 1""", ("raw_active",))

IN_RANGE_TS = "CAST(event_ts AS DATE) BETWEEN (SELECT start_d FROM rng) AND (SELECT end_d FROM rng)"
IN_RANGE_DAY = "date BETWEEN (SELECT start_d FROM rng) AND (SELECT end_d FROM rng)"
CL = "COALESCE(closing_qty, 0)"
MN = "COALESCE(min_qty, 0)"
MX = "COALESCE(max_qty, 0)"


def cnt(cond: str) -> str:
    return f"CAST(COALESCE(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END), 0) AS BIGINT)"


def pct(num: str, den: str) -> str:
    return f"CASE WHEN {den} = 0 THEN 0 ELSE CAST(FLOOR({num} / {den} * 100 + 0.5) AS BIGINT) END"


def money_sum(x: str) -> str:
    return f"CAST(COALESCE(SUM(CAST({x} AS DECIMAL(18,2))), 0) AS DOUBLE)"


RECEIPT = "CASE WHEN UPPER(TRIM(COALESCE(event_type, ''))) = 'RECEIPT' THEN COALESCE(quantity, 0) ELSE 0.0 END"
ISSUE = "CASE WHEN UPPER(TRIM(COALESCE(event_type, ''))) = 'ISSUE' THEN ABS(COALESCE(quantity, 0)) ELSE 0.0 END"
IS_WASTE = "LOWER(TRIM(COALESCE(event_type, ''))) = 'adjustment_waste'"

ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- 2.1 scope and filters
ORACLE["active_dataset"] = with_("""
SELECT dataset_id, COUNT(*) AS fact_rows FROM raw_inventory
WHERE dataset_id = (SELECT dataset_id FROM active_dataset) GROUP BY dataset_id""", "raw_inventory", "active_dataset")

ORACLE["active_dataset_fallback"] = with_("""
SELECT dataset_id FROM (
  SELECT dataset_id, MAX(event_ts) AS last_ts FROM raw_inventory
  WHERE TRIM(COALESCE(dataset_id, '')) <> '' GROUP BY dataset_id
  ORDER BY last_ts DESC NULLS LAST, dataset_id LIMIT 1)""", "raw_inventory")

ORACLE["default_range"] = with_('SELECT start_d AS start, end_d AS "end" FROM rng', "rng")

ORACLE["filter_events"] = with_(f"""
SELECT event_type, COUNT(*) AS n, SUM(quantity) AS quantity FROM inventory_events
WHERE location_id = 2 AND {IN_RANGE_TS} GROUP BY event_type""", "inventory_events", "rng")

ORACLE["filter_items"] = with_(
    "SELECT item_id, item_name, location_id, current_qty FROM items WHERE location_id = 3", "items")

ORACLE["filter_raw"] = with_(f"""
SELECT location_id, COUNT(*) AS n, SUM(quantity) AS quantity FROM raw_inventory
WHERE {LOC_INT} = 4 GROUP BY location_id""", "raw_inventory")

ORACLE["norm_location"] = with_(f"""
SELECT location_raw, location_id, printf('LOC%02d', location_id) AS location_label, location_code, COUNT(*) AS n
FROM (SELECT location_id AS location_raw, {LOC_INT} AS location_id, UPPER(TRIM(location_id)) AS location_code
      FROM raw_inventory)
GROUP BY location_raw, location_id, location_code""", "raw_inventory")

ORACLE["norm_event_type"] = with_("""
SELECT UPPER(TRIM(COALESCE(event_type, ''))) AS event_type, COUNT(*) AS n FROM raw_inventory GROUP BY 1""",
                                  "raw_inventory")

ORACLE["filter_options_items"] = with_(f"""
SELECT id, name FROM (
  SELECT item_id AS id, TRIM(COALESCE(item_name, '')) AS name,
    ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY {NEWEST}) AS rn
  FROM raw_active WHERE item_id IS NOT NULL) WHERE rn = 1""", "raw_active")

ORACLE["filter_options_locations"] = with_(
    "SELECT location_id AS id, location_name AS name FROM locations", "locations")

ORACLE["filter_options_range"] = with_(
    "SELECT start_d AS min_end, end_d AS max_end FROM rng", "rng")

ORACLE["meta_items"] = with_("""
SELECT DISTINCT item_id AS id, TRIM(item_name) AS name FROM raw_active
WHERE item_id IS NOT NULL AND TRIM(COALESCE(item_name, '')) <> ''""", "raw_active")

ORACLE["forecast_items"] = with_("""
SELECT DISTINCT item_id AS id, TRIM(COALESCE(item_name, '')) AS name FROM raw_active
WHERE item_id IS NOT NULL AND COALESCE(issues_qty, 0) > 0
  AND item_id IN (SELECT p_partkey FROM part WHERE p_size > 45)
  AND NOT (item_id IN (SELECT p_partkey FROM part WHERE p_size > 48) AND date >= DATE '2000-01-01')""",
                                 "raw_active")

ORACLE["adhoc_scoped_sql"] = with_("""
SELECT location_id, event_type, COUNT(*) AS n, SUM(quantity) AS quantity
FROM raw_active GROUP BY location_id, event_type""", "raw_active")

cte("raw_versions", """
SELECT 'ds_active' AS dataset_id, location_id, event_type, CAST(date AS DATE) AS date, quantity FROM raw_active
UNION ALL SELECT 'ds_prev', location_id, event_type, CAST(date AS DATE), quantity + 1 FROM raw_active WHERE date < DATE '1998-01-01'
UNION ALL SELECT 'ds_archived', location_id, event_type, CAST(date AS DATE), quantity FROM raw_active WHERE receipts_qty > 0""", ("raw_active",))
ORACLE["filter_options_range_active"] = with_("SELECT MIN(date) AS min_date, MAX(date) AS max_date FROM raw_versions WHERE dataset_id = 'ds_active'", "raw_versions")
ORACLE["stored_active_fact"] = with_("""
SELECT dataset_id, location_id, event_type, COUNT(*) AS n, SUM(quantity) AS quantity, MIN(date) AS first_day, MAX(date) AS last_day
FROM raw_versions WHERE dataset_id = 'ds_active' AND date BETWEEN DATE '1997-01-15' AND DATE '1998-06-30' GROUP BY ALL""", "raw_versions")
ORACLE["stored_datasets"] = with_("""
SELECT dataset_id, CAST(year(date) AS INTEGER) AS year, COUNT(*) AS n, SUM(quantity) AS quantity FROM raw_versions GROUP BY 1, 2""", "raw_versions")

# ---------------------------------------------------------------- 2.3 snapshot KPIs
ORACLE["latest_snapshot"] = with_("""
SELECT item_id, location_id, date, event_ts, closing_qty, min_qty, max_qty, issues_qty FROM snap""", "snap")

ORACLE["inventory_summary"] = with_("""
SELECT COUNT(*) AS items, COUNT(DISTINCT location_id) AS locations, COUNT(DISTINCT item_id) AS categories
FROM snap""", "snap")

ORACLE["availability"] = with_(f"""
SELECT available_items, total_items, {pct('available_items', 'total_items')} AS percent
FROM (SELECT {cnt(CL + ' > 0')} AS available_items, COUNT(*) AS total_items FROM snap)""", "snap")

ORACLE["reorder_risk"] = with_(f"""
SELECT reorder_risk_items, total_rows, {pct('reorder_risk_items', 'total_rows')} AS percent
FROM (SELECT {cnt(CL + ' <= ' + MN)} AS reorder_risk_items, COUNT(*) AS total_rows FROM snap_in_range)""",
                               "snap_in_range")

IN_STOCK = f"{CL} > {MN}"
LOW_STOCK = f"{CL} > 0 AND {CL} <= {MN}"
OUT_STOCK = f"{CL} = 0"

ORACLE["stock_status"] = with_(f"""
SELECT {cnt(IN_STOCK)} AS in_stock, {cnt(LOW_STOCK)} AS low_stock, {cnt(OUT_STOCK)} AS out_stock FROM snap""", "snap")

ORACLE["stock_by_location"] = with_(f"""
SELECT location_id, printf('LOC%02d', location_id) AS location, COUNT(*) AS total_items,
  {cnt(IN_STOCK)} AS in_stock, {cnt(LOW_STOCK)} AS low_stock, {cnt(OUT_STOCK)} AS out_stock
FROM snap GROUP BY location_id""", "snap")

ORACLE["qty_by_location"] = with_("""
SELECT location_id, printf('LOC%02d', location_id) AS location,
  COALESCE(ROUND(SUM(closing_qty), 0), 0) AS total_current_qty
FROM snap GROUP BY location_id""", "snap")

ORACLE["stock_scope"] = with_("SELECT COUNT(*) AS total_items FROM snap", "snap")

ORACLE["stock_status_detail"] = with_(f"""
SELECT item_id, location_id, {CL} AS closing_qty, {MN} AS min_qty, date,
  CASE WHEN {CL} <= 0 THEN 'Out of Stock' WHEN {CL} <= {MN} THEN 'Low Stock' ELSE 'In Stock' END AS stock_status,
  CASE WHEN {CL} = 0 THEN 0.1 ELSE {CL} END AS display_closing_qty
FROM snap_code_in_range""", "snap_code_in_range")

ORACLE["stockout_by_category"] = with_("""
SELECT c.category_name AS category, COUNT(*) AS count
FROM items i JOIN categories c ON c.category_id = i.category_id
WHERE i.current_qty = 0 GROUP BY c.category_name""", "items", "categories")

ORACLE["reorder_risk_by_item"] = with_(f"""
SELECT item_id, item_name, count, total_rows,
  ROUND(CAST(count AS DOUBLE) * 100.0 / CAST(total_rows AS DOUBLE), 0) AS risk_percentage
FROM (
  SELECT item_id, item_name,
    CAST(SUM(CASE WHEN avg_usage_per_day IS NOT NULL AND restock_lead_time IS NOT NULL
                   AND {CL} <= avg_usage_per_day * restock_lead_time THEN 1
                  WHEN {CL} <= {MN} THEN 1 ELSE 0 END) AS BIGINT) AS count,
    COUNT(*) AS total_rows
  FROM snap GROUP BY item_id, item_name)
WHERE count > 0""", "snap")

_BELOW, _ABOVE = f"{CL} < {MN}", f"{CL} > {MX}"
ORACLE["min_max_compliance"] = with_(f"""
SELECT below_min, above_max, within_range,
  {pct('below_min', '(below_min + above_max + within_range)')} AS below_min_pct,
  {pct('above_max', '(below_min + above_max + within_range)')} AS above_max_pct,
  {pct('within_range', '(below_min + above_max + within_range)')} AS within_range_pct
FROM (SELECT {cnt(_BELOW)} AS below_min, {cnt(_ABOVE)} AS above_max,
             {cnt('NOT (' + _BELOW + ') AND NOT (' + _ABOVE + ')')} AS within_range FROM snap)""", "snap")

ORACLE["turnover_by_item"] = with_("""
SELECT item_id,
  COALESCE(NULLIF(TRIM(name), ''), 'Item ' || CAST(item_id AS VARCHAR)) AS item_name,
  COALESCE(total_issues, 0) AS total_issues,
  COALESCE(avg_stock, 0) AS avg_stock,
  CASE WHEN avg_stock IS NULL OR avg_stock = 0 THEN 0.0 ELSE total_issues / avg_stock END AS turnover
FROM (
  SELECT item_id, MAX(item_name) AS name, SUM(COALESCE(issues_qty, 0)) AS total_issues,
    AVG(CASE WHEN current_stock_avg IS NOT NULL THEN current_stock_avg ELSE current_stock_avg_rounded END) AS avg_stock
  FROM snap GROUP BY item_id)""", "snap")

ORACLE["top_reorder_gap"] = with_(f"""
SELECT item_id, item, location_id, closing_qty, min_qty, gap,
  CASE WHEN closing_qty > min_qty OR gap < 0 THEN 'Safe'
       WHEN closing_qty = min_qty OR gap = 0 THEN 'At Threshold' ELSE 'Shortage' END AS status
FROM (
  SELECT item_id, item_name AS item, location_id, {CL} AS closing_qty, {MN} AS min_qty,
    ROUND({MN} - {CL}, 0) AS gap
  FROM snap WHERE {CL} <= {MN}
  ORDER BY gap DESC, closing_qty ASC, item_id, location_id LIMIT 10)""", "snap")

ORACLE["top_expiry_lots"] = with_(f"""
SELECT item_id, location_id, item, lot_number, expiry_date, days_left, qty, value,
  CASE WHEN expiry_date IS NULL THEN '-' WHEN days_left <= 30 THEN 'High'
       WHEN days_left <= 60 THEN 'Medium' ELSE 'Low' END AS risk_level,
  CASE WHEN expiry_date IS NULL THEN '-' WHEN days_left < 0 THEN 'Expired - urgent handling'
       WHEN days_left <= 30 THEN 'Use immediately' WHEN days_left <= 60 THEN 'Monitor' ELSE 'OK' END AS action
FROM (
  SELECT item_id, location_id, item_name AS item, lot_number, expiry_date,
    CAST(expiry_date - {AS_OF} AS INTEGER) AS days_left,
    ROUND({CL}, 0) AS qty,
    ROUND(COALESCE(inventory_value, closing_qty * COALESCE(unit_cost, 0), 0), 2) AS value
  FROM (SELECT *, TRY_CAST(SUBSTR(TRIM(lot_expiry), 1, 10) AS DATE) AS expiry_date FROM snap_lots)
  ORDER BY days_left ASC NULLS FIRST, item_id, location_id LIMIT 10)""", "snap_lots")

ORACLE["total_stock_qty"] = with_("SELECT CAST(COALESCE(SUM(current_qty), 0) AS BIGINT) AS total_qty FROM items",
                                  "items")

ORACLE["stock_dashboard"] = with_(f"""
SELECT *, {pct('available_items', 'items')} AS availability_pct FROM (
  SELECT COUNT(*) AS items, COUNT(DISTINCT location_id) AS locations, COUNT(DISTINCT item_id) AS categories,
    {cnt(CL + ' > 0')} AS available_items, {cnt(IN_STOCK)} AS in_stock, {cnt(LOW_STOCK)} AS low_stock,
    {cnt(OUT_STOCK)} AS out_stock, {cnt(_BELOW)} AS below_min, {cnt(_ABOVE)} AS above_max,
    {cnt('NOT (' + _BELOW + ') AND NOT (' + _ABOVE + ')')} AS within_range
  FROM snap)""", "snap")

# ---------------------------------------------------------------- 2.4 movement, consumption, expiry
ORACLE["movement_totals"] = with_(f"""
SELECT receipts, issues, receipts - issues AS net_movement FROM (
  SELECT COALESCE(SUM({RECEIPT}), 0) AS receipts, COALESCE(SUM({ISSUE}), 0) AS issues
  FROM raw_active WHERE {IN_RANGE_TS})""", "raw_active", "rng")

ORACLE["net_movement"] = with_(f"""
SELECT COALESCE(SUM({RECEIPT}), 0) - COALESCE(SUM({ISSUE}), 0) AS net_movement
FROM raw_active WHERE {IN_RANGE_TS}""", "raw_active", "rng")

ORACLE["movement_by_location"] = with_(f"""
SELECT l.location_id, l.location_name AS location,
  COALESCE(a.rec, 0) AS receipts, COALESCE(a.iss, 0) AS issues, COALESCE(a.rec, 0) - COALESCE(a.iss, 0) AS net_movement
FROM locations l LEFT JOIN (
  SELECT {LOC_INT} AS loc, SUM({RECEIPT}) AS rec, SUM({ISSUE}) AS iss
  FROM raw_active WHERE {IN_RANGE_TS} GROUP BY 1) a ON a.loc = l.location_id""",
                                       "locations", "raw_active", "rng")

_FEED = f"""
SELECT UPPER(TRIM(COALESCE(event_type, ''))) AS type, COALESCE(quantity, 0) AS quantity,
  event_ts AS "timestamp", item_id, UPPER(TRIM(location_id)) AS location
FROM raw_active WHERE {IN_RANGE_TS}
ORDER BY event_ts DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC, k5 DESC LIMIT 50"""
ORACLE["event_feed"] = with_(_FEED, "raw_active", "rng")

ORACLE["event_feed_facets"] = with_(f"""
SELECT DISTINCT 'location' AS facet, location AS value FROM ({_FEED})
UNION
SELECT DISTINCT 'item_id' AS facet, CAST(item_id AS VARCHAR) AS value FROM ({_FEED})""", "raw_active", "rng")

ORACLE["consumption_totals"] = with_(f"""
SELECT COALESCE(SUM(ABS(e.quantity)), 0) AS total_qty, {money_sum('ABS(e.quantity) * e.unit_cost_aed')} AS total_cost
FROM inventory_events e JOIN items i ON i.item_id = e.item_id
WHERE e.event_type = 'ISSUE' AND CAST(e.event_ts AS DATE) BETWEEN (SELECT start_d FROM rng) AND (SELECT end_d FROM rng)""",
                                     "inventory_events", "items", "rng")

_DAILY = f"""
SELECT date, UPPER(TRIM(location_id)) AS location_id, COALESCE(SUM(COALESCE(issues_qty, 0)), 0) AS qty
FROM raw_active WHERE TRIM(COALESCE(location_id, '')) <> '' AND {IN_RANGE_DAY}
GROUP BY date, UPPER(TRIM(location_id))"""
ORACLE["consumption_daily_by_location"] = with_(_DAILY, "raw_active", "rng")

ORACLE["consumption_daily_pivot"] = with_(f"""
SELECT date,
  COALESCE(SUM(CASE WHEN location_id = 'LOC1' THEN qty END), 0) AS LOC1,
  COALESCE(SUM(CASE WHEN location_id = 'LOC2' THEN qty END), 0) AS LOC2,
  COALESCE(SUM(CASE WHEN location_id = 'LOC3' THEN qty END), 0) AS LOC3,
  COALESCE(SUM(CASE WHEN location_id = 'LOC4' THEN qty END), 0) AS LOC4
FROM ({_DAILY}) GROUP BY date""", "raw_active", "rng")

ORACLE["cost_per_unit_by_location"] = with_(f"""
SELECT location, total_value, total_issues,
  CASE WHEN total_issues = 0 THEN 0.0 ELSE total_value / total_issues END AS avg_cost_per_unit
FROM (
  SELECT UPPER(TRIM(location_id)) AS location, {money_sum('COALESCE(inventory_value, 0)')} AS total_value,
    COALESCE(SUM(COALESCE(issues_qty, 0)), 0) AS total_issues
  FROM raw_active WHERE TRIM(COALESCE(location_id, '')) <> '' AND {IN_RANGE_DAY}
  GROUP BY 1)""", "raw_active", "rng")

ORACLE["top_items_by_qty"] = with_(f"""
SELECT item_id, item_name AS item, COALESCE(SUM(COALESCE(issues_qty, 0)), 0) AS qty
FROM raw_active WHERE TRIM(COALESCE(item_name, '')) <> '' AND {IN_RANGE_DAY}
GROUP BY item_id, item_name ORDER BY qty DESC, item_id, item LIMIT 10""", "raw_active", "rng")

ORACLE["top_items_by_value"] = with_(f"""
SELECT item_id, item_name AS item, {money_sum('COALESCE(inventory_value, 0)')} AS value
FROM raw_active WHERE TRIM(COALESCE(item_name, '')) <> '' AND {IN_RANGE_DAY}
GROUP BY item_id, item_name ORDER BY value DESC, item_id, item LIMIT 10""", "raw_active", "rng")

_WASTE_EV = """
FROM inventory_events e JOIN items i ON i.item_id = e.item_id
WHERE e.event_type = 'ADJUSTMENT_WASTE'
  AND CAST(e.event_ts AS DATE) BETWEEN (SELECT start_d FROM rng) AND (SELECT end_d FROM rng)"""

ORACLE["expired_totals"] = with_(f"""
SELECT COALESCE(SUM(ABS(e.quantity)), 0) AS expired_qty, {money_sum('ABS(e.quantity) * e.unit_cost_aed')} AS expired_value
{_WASTE_EV}""", "inventory_events", "items", "rng")

_EXPIRING = """
FROM item_lots l JOIN items i ON i.item_id = l.item_id
WHERE l.expiry_date >= (SELECT end_d FROM rng) AND l.expiry_date <= (SELECT end_d FROM rng) + 30"""

ORACLE["expiring_soon"] = with_(f"""
SELECT CAST(COALESCE(SUM(l.qty_on_hand), 0) AS BIGINT) AS expiring_soon_qty,
  {money_sum('l.qty_on_hand * i.unit_cost_aed')} AS expiring_soon_value
{_EXPIRING}""", "item_lots", "items", "rng")

ORACLE["expiring_by_category"] = with_(f"""
SELECT category, qty FROM (
  SELECT c.category_id, c.category_name AS category, CAST(COALESCE(SUM(l.qty_on_hand), 0) AS BIGINT) AS qty
  {_EXPIRING.replace('WHERE', 'JOIN categories c ON c.category_id = i.category_id WHERE')}
  GROUP BY c.category_id, c.category_name ORDER BY qty DESC, category LIMIT 10)""",
                                       "item_lots", "items", "categories", "rng")

ORACLE["waste_daily_dense"] = with_(f"""
SELECT d.day, COALESCE(w.qty, 0) AS qty FROM (
  SELECT CAST(UNNEST(generate_series(CAST(start_d AS TIMESTAMP), CAST(GREATEST(start_d, end_d) AS TIMESTAMP),
                                     INTERVAL 1 DAY)) AS DATE) AS day FROM rng) d
LEFT JOIN (SELECT CAST(e.event_ts AS DATE) AS day, SUM(ABS(e.quantity)) AS qty {_WASTE_EV} GROUP BY 1) w
  ON w.day = d.day""", "inventory_events", "items", "rng")

ORACLE["waste_by_location"] = with_(f"""
SELECT UPPER(TRIM(COALESCE(location_id, ''))) AS location_id, COALESCE(SUM(COALESCE(quantity, 0)), 0) AS waste_quantity
FROM raw_active WHERE {IS_WASTE} AND {IN_RANGE_TS} AND TRIM(COALESCE(location_id, '')) <> ''
GROUP BY 1""", "raw_active", "rng")

ORACLE["waste_by_item"] = with_(f"""
SELECT item_id, item_name,
  CASE WHEN TRIM(COALESCE(item_name, '')) <> '' THEN item_name ELSE 'Item ' || CAST(item_id AS VARCHAR) END AS item_label,
  waste_quantity
FROM (
  SELECT item_id, item_name, COALESCE(SUM(COALESCE(quantity, 0)), 0) AS waste_quantity
  FROM raw_active WHERE {IS_WASTE} AND {IN_RANGE_TS}
  GROUP BY item_id, item_name ORDER BY waste_quantity DESC, item_id, item_name LIMIT 15)""", "raw_active", "rng")

ORACLE["waste_trend"] = with_(f"""
SELECT CAST(event_ts AS DATE) AS event_date, COALESCE(SUM(COALESCE(quantity, 0)), 0) AS waste_quantity
FROM raw_active WHERE {IS_WASTE} AND {IN_RANGE_TS} AND event_ts IS NOT NULL GROUP BY 1""", "raw_active", "rng")

ORACLE["expiring_60d_rows"] = with_(f"""
SELECT COUNT(*) AS lot_count FROM (
  SELECT TRY_CAST(SUBSTR(TRIM(lot_expiry), 1, 10) AS DATE) AS x FROM raw_active)
WHERE x IS NOT NULL AND x >= {AS_OF} AND x <= {AS_OF} + 60""", "raw_active")

# ---------------------------------------------------------------- 2.5 policies
cte("abc_input", f"""
SELECT g.item_id, s.storage_item_id, g.item_name, COALESCE(g.annual_qty, 0) AS annual_qty,
  COALESCE(g.annual_value, 0) AS annual_value
FROM (
  SELECT LOWER(TRIM(item_name)) AS name_key,
    MIN(CASE WHEN item_id IS NOT NULL THEN item_id END) AS item_id,
    MIN(CASE WHEN item_id IS NOT NULL THEN TRIM(item_name) END) AS item_name,
    SUM(CASE WHEN {IN_RANGE_DAY} THEN COALESCE(issues_qty, 0) END) AS annual_qty,
    SUM(CASE WHEN {IN_RANGE_DAY} THEN CAST(COALESCE(annual_consumption_value, 0) AS DECIMAL(18,2)) END) AS annual_value
  FROM raw_active WHERE TRIM(COALESCE(item_name, '')) <> '' GROUP BY 1) g
JOIN (SELECT LOWER(TRIM(item_name)) AS name_key, MIN(item_id) AS storage_item_id FROM items GROUP BY 1) s
  ON s.name_key = g.name_key
WHERE g.item_id IS NOT NULL""", ("raw_active", "items", "rng"))


def _classify(src: str) -> str:
    return f"""
SELECT * EXCLUDE (running, total, cum),
  ROUND(cum, 6) AS cumulative_share_pct,
  CASE WHEN cum <= 0.8 THEN 'A' WHEN cum <= 0.95 THEN 'B' ELSE 'C' END AS abc_class
FROM (
  SELECT * EXCLUDE (annual_qty, annual_value), ROUND(annual_qty, 4) AS annual_qty,
    ROUND(CAST(annual_value AS DOUBLE), 4) AS annual_value,
    CASE WHEN CAST(total AS DOUBLE) > 0 THEN ROUND(CAST(annual_value AS DOUBLE) / CAST(total AS DOUBLE), 6) ELSE 0.0 END
      AS value_share_pct,
    CASE WHEN CAST(total AS DOUBLE) > 0 THEN CAST(running AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0.0 END AS cum
  FROM (
    SELECT *, SUM(annual_value) OVER (ORDER BY annual_value DESC, item_id ASC
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running,
      SUM(annual_value) OVER () AS total
    FROM ({src})))"""


cte("abc_lines", _classify("SELECT * FROM abc_input"), ("abc_input",))

ORACLE["abc_input"] = with_(
    "SELECT item_id, storage_item_id, item_name, annual_qty, CAST(annual_value AS DOUBLE) AS annual_value FROM abc_input",
    "abc_input")

ORACLE["abc_classify"] = with_("SELECT * FROM abc_lines", "abc_lines")

ORACLE["abc_snapshot_write"] = with_("""
SELECT 1 AS snapshot_id, abc_class, COUNT(*) AS n_lines, ROUND(SUM(annual_value), 2) AS annual_value
FROM abc_lines GROUP BY abc_class""", "abc_lines")

ORACLE["abc_snapshot_read"] = with_(_classify("""
SELECT COALESCE(m.m_item_id, l.storage_item_id) AS item_id,
  COALESCE(m.m_item_name, i.item_name, CAST(l.storage_item_id AS VARCHAR)) AS item_name,
  SUM(l.annual_qty) AS annual_qty, SUM(CAST(l.annual_value AS DECIMAL(18,2))) AS annual_value
FROM abc_lines l
LEFT JOIN items i ON i.item_id = l.storage_item_id
LEFT JOIN (SELECT LOWER(TRIM(item_name)) AS name_key, MIN(item_id) AS m_item_id, MIN(TRIM(item_name)) AS m_item_name
           FROM raw_active WHERE TRIM(COALESCE(item_name, '')) <> '' AND item_id IS NOT NULL GROUP BY 1) m
  ON m.name_key = LOWER(TRIM(i.item_name))
GROUP BY 1, 2"""), "abc_lines", "items", "raw_active")

ORACLE["abc_kpis"] = with_("""
SELECT CAST(tv AS DOUBLE) AS total_annual_value, total_items,
  CASE WHEN tv > 0 THEN ROUND(CAST(av AS DOUBLE) / CAST(tv AS DOUBLE), 6) ELSE 0.0 END AS class_a_value_pct
FROM (SELECT COALESCE(SUM(CAST(annual_value AS DECIMAL(28,4))), 0) AS tv, COUNT(*) AS total_items,
        COALESCE(SUM(CASE WHEN abc_class = 'A' THEN CAST(annual_value AS DECIMAL(28,4)) END), 0) AS av
      FROM abc_lines)""", "abc_lines")

cte("policy_pairs", """
SELECT item_id, location_id, TRIM(item_name) AS item_name,
  COALESCE(avg_usage_per_day, 0) AS avg_usage_per_day, COALESCE(restock_lead_time, 0) AS restock_lead_time,
  COALESCE(min_qty, 0) AS min_qty, COALESCE(closing_qty, 0) AS closing_qty, COALESCE(unit_cost, 0) AS unit_cost
FROM snap_in_range""", ("snap_in_range",))

cte("policy_matched", """
SELECT p.*, m.storage_item_id FROM policy_pairs p
JOIN (SELECT LOWER(TRIM(item_name)) AS k, location_id AS loc, MIN(item_id) AS storage_item_id
      FROM items GROUP BY 1, 2) m
  ON m.k = LOWER(TRIM(p.item_name)) AND m.loc = p.location_id""", ("policy_pairs", "items"))

cte("policy_eoq", """
SELECT *, CASE WHEN orders_per_year > 0 THEN 365 / orders_per_year ELSE 0.0 END AS cycle_time_days FROM (
  SELECT *, CASE WHEN eoq > 0 THEN annual_demand_qty / eoq ELSE 0.0 END AS orders_per_year FROM (
    SELECT *, CASE WHEN annual_demand_qty > 0 AND ordering_cost > 0 AND holding_cost > 0
                   THEN SQRT(2 * annual_demand_qty * ordering_cost / holding_cost) ELSE 0.0 END AS eoq
    FROM (SELECT *, avg_usage_per_day * 365 AS annual_demand_qty, CAST(75.0 AS DOUBLE) AS ordering_cost,
            unit_cost * 0.25 AS holding_cost FROM policy_matched)))""", ("policy_matched",))

ORACLE["policy_latest_in_period"] = with_("SELECT * FROM policy_pairs", "policy_pairs")

ORACLE["policy_item_match"] = with_(
    "SELECT item_id, location_id, item_name, storage_item_id FROM policy_matched", "policy_matched")

ORACLE["eoq"] = with_("""
SELECT item_id, location_id, storage_item_id, ROUND(annual_demand_qty, 6) AS annual_demand_qty,
  ROUND(holding_cost, 6) AS holding_cost, ROUND(eoq, 6) AS eoq, ROUND(orders_per_year, 6) AS orders_per_year,
  ROUND(cycle_time_days, 6) AS cycle_time_days
FROM policy_eoq""", "policy_eoq")

# brute force: the zero-filled (pair x day) series, then population moments
cte("demand_stats", f"""
SELECT item_id, location_id, CAST(COUNT(*) AS BIGINT) AS days, CAST(COUNT(d.x) AS BIGINT) AS demand_days,
  SUM(COALESCE(d.x, 0)) AS total_qty, AVG(COALESCE(d.x, 0)) AS mean_daily_qty,
  STDDEV_POP(COALESCE(d.x, 0)) AS demand_std_dev
FROM (SELECT DISTINCT item_id, {LOC_INT} AS location_id FROM raw_active
      WHERE TRIM(COALESCE(location_id, '')) <> '' AND {IN_RANGE_DAY}) p
CROSS JOIN (SELECT CAST(UNNEST(generate_series(CAST(start_d AS TIMESTAMP), CAST(GREATEST(start_d, end_d) AS TIMESTAMP),
                                               INTERVAL 1 DAY)) AS DATE) AS day FROM rng) s
LEFT JOIN (SELECT item_id AS i, {LOC_INT} AS l, date, SUM(COALESCE(issues_qty, 0)) AS x FROM raw_active
           WHERE TRIM(COALESCE(location_id, '')) <> '' AND {IN_RANGE_DAY} GROUP BY 1, 2, 3) d
  ON d.i = p.item_id AND d.l = p.location_id AND d.date = s.day
GROUP BY item_id, location_id""", ("raw_active", "rng"))

ORACLE["daily_demand_dense"] = with_("""
SELECT item_id, location_id, days, demand_days, total_qty, ROUND(mean_daily_qty, 6) AS mean_daily_qty,
  ROUND(demand_std_dev, 6) AS demand_std_dev FROM demand_stats""", "demand_stats")

cte("safety", """
SELECT d.item_id, d.location_id, d.demand_std_dev, 1.96 AS service_level_z, p.restock_lead_time AS lead_time_days,
  1.96 * d.demand_std_dev * SQRT(GREATEST(p.restock_lead_time, 0)) AS safety_stock
FROM demand_stats d JOIN policy_pairs p ON p.item_id = d.item_id AND p.location_id = d.location_id""",
    ("demand_stats", "policy_pairs"))

ORACLE["safety_stock"] = with_("""
SELECT item_id, location_id, ROUND(demand_std_dev, 6) AS demand_std_dev, service_level_z, lead_time_days,
  ROUND(safety_stock, 6) AS safety_stock FROM safety""", "safety")

ORACLE["rop"] = with_("""
SELECT item_id, location_id, storage_item_id, daily_demand_avg, lead_time_days, ROUND(ss, 6) AS safety_stock_qty,
  ROUND(rop, 6) AS rop, current_stock, CASE WHEN current_stock <= rop THEN 'REORDER NOW' ELSE 'Stock OK' END AS status
FROM (
  SELECT m.item_id, m.location_id, m.storage_item_id, m.avg_usage_per_day AS daily_demand_avg,
    m.restock_lead_time AS lead_time_days, COALESCE(s.safety_stock, 0) AS ss,
    m.avg_usage_per_day * m.restock_lead_time + COALESCE(s.safety_stock, 0) AS rop, m.closing_qty AS current_stock
  FROM policy_matched m LEFT JOIN safety s ON s.item_id = m.item_id AND s.location_id = m.location_id)""",
                      "policy_matched", "safety")

_NOTE = "'period=' || CAST((SELECT start_d FROM rng) AS VARCHAR) || '..' || CAST((SELECT end_d FROM rng) AS VARCHAR)"
ORACLE["policy_log_write"] = with_(f"""
SELECT 'eoq' AS policy, storage_item_id AS item_id, location_id, ROUND(annual_demand_qty, 6) AS annual_demand_qty,
  ordering_cost, ROUND(holding_cost, 6) AS holding_cost, restock_lead_time AS lead_time_days,
  {AS_OF} AS review_date, {_NOTE} || ';holding_rate=0.25' AS notes
FROM policy_eoq""", "policy_eoq", "rng")
ORACLE["policy_log_safety_stock"] = with_(f"""
SELECT 'safety_stock' AS policy, m.storage_item_id AS item_id, m.location_id, ROUND(demand_std_dev, 6) AS demand_std_dev,
  lead_time_days, service_level_z, {AS_OF} AS review_date, {_NOTE} AS notes
FROM policy_matched m JOIN safety s ON s.item_id = m.item_id AND s.location_id = m.location_id""", "policy_matched", "safety", "rng")
ORACLE["policy_log_rop"] = with_(f"""
SELECT 'rop' AS policy, m.storage_item_id AS item_id, m.location_id, m.avg_usage_per_day AS daily_demand_avg,
  m.restock_lead_time AS lead_time_days, ROUND(COALESCE(s.safety_stock, 0), 6) AS safety_stock_qty, {AS_OF} AS review_date, {_NOTE} AS notes
FROM policy_matched m LEFT JOIN safety s ON s.item_id = m.item_id AND s.location_id = m.location_id""", "policy_matched", "safety", "rng")

ORACLE["period_days"] = with_("""
SELECT item_id, first_day, last_day,
  CASE WHEN first_day IS NULL OR last_day IS NULL OR last_day - first_day + 1 <= 0 THEN 0
       ELSE CAST(last_day - first_day + 1 AS INTEGER) END AS period_days,
  CASE WHEN first_day IS NULL OR last_day IS NULL OR first_day - last_day + 1 <= 0 THEN 0
       ELSE CAST(first_day - last_day + 1 AS INTEGER) END AS reversed_days
FROM (SELECT item_id, MIN(date) AS first_day, MAX(date) AS last_day FROM raw_inventory GROUP BY item_id)""",
                              "raw_inventory")

# ---------------------------------------------------------------- 2.6 risk, supplier, warehouse
cte("raw_risk", """
SELECT 'ds_active' AS dataset_id, o_orderkey AS assessment_id, o_custkey % 40 AS risk_id, o_orderdate AS assessment_date,
  CAST(o_orderkey % 6 AS DOUBLE) AS probability_score, CAST(o_custkey % 6 AS DOUBLE) AS impact_score,
  o_totalprice AS estimated_cost_aed, printf('R%03d', o_custkey % 40) AS risk_code,
  CASE WHEN o_custkey % 40 = 0 THEN ' ' ELSE 'Risk ' || CAST(o_custkey % 40 AS VARCHAR) END AS risk_title,
  CASE WHEN o_orderstatus = 'P' THEN NULL
       ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'Delivery' WHEN '2-HIGH' THEN 'Quality'
                                 WHEN '3-MEDIUM' THEN 'Financial' WHEN '4-NOT SPECIFIED' THEN 'Regulatory'
                                 ELSE 'Operational' END END AS risk_category
FROM orders""")

cte("latest_risk", """
SELECT COALESCE(NULLIF(TRIM(risk_code), ''), CAST(CAST(risk_id AS BIGINT) AS VARCHAR)) AS risk_id,
  COALESCE(NULLIF(TRIM(risk_title), ''), 'Unknown Risk') AS title,
  COALESCE(NULLIF(TRIM(risk_category), ''), 'Uncategorized') AS category,
  COALESCE(probability_score, 0) AS probability, COALESCE(impact_score, 0) AS impact,
  COALESCE(estimated_cost_aed, 0) AS cost
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY CAST(risk_id AS BIGINT)
                                  ORDER BY assessment_date DESC, assessment_id DESC) AS rn
      FROM raw_risk WHERE dataset_id = (SELECT dataset_id FROM active_dataset))
WHERE rn = 1""", ("raw_risk", "active_dataset"))

cte("risk_cells", """
SELECT v.probability, v.impact,
  CASE WHEN c.n_risks = 1 THEN v.risk_id ELSE CAST(c.n_risks AS VARCHAR) || ' risks' END AS label,
  c.n_risks, v.risk_id, v.title
FROM (SELECT * FROM latest_risk WHERE TRIM(risk_id) <> '' AND TRIM(title) <> '' AND probability > 0 AND impact > 0) v
JOIN (SELECT probability, impact, COUNT(*) AS n_risks FROM latest_risk
      WHERE TRIM(risk_id) <> '' AND TRIM(title) <> '' AND probability > 0 AND impact > 0 GROUP BY 1, 2) c
  ON c.probability = v.probability AND c.impact = v.impact""", ("latest_risk",))

cte("vendor_kpis", """
SELECT 'ds_active' AS dataset_id, s_name AS supplier, CAST(s_nationkey % 10 + 5 AS DOUBLE) AS lead_time_days_avg,
  CAST(s_suppkey % 100 AS DOUBLE) AS quality_score, CAST((s_suppkey * 7) % 100 AS DOUBLE) AS delivery_score,
  (s_suppkey * 3) % 101 / 100 AS otif, (s_suppkey * 11) % 101 / 100 AS cost_score, s_acctbal AS total_score
FROM supplier""")

cte("supplier_scores", """
SELECT supplier, total_score, quality_score AS quality, delivery_score AS delivery,
  otif * 100 AS otif_pct, cost_score * 100 AS cost_pct
FROM vendor_kpis WHERE dataset_id = (SELECT dataset_id FROM active_dataset)""", ("vendor_kpis", "active_dataset"))

cte("order_sheet", """
SELECT s_name AS vendor_id, CAST(o_orderdate AS DATE) AS order_date, CAST(o_orderdate AS DATE) + 40 AS promised_date,
  CAST(l_shipdate AS DATE) AS actual_date, l_quantity AS ordered_quantity,
  CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE l_quantity - 1 END AS in_full_quantity,
  l_quantity AS receipts_qty, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END AS defective_units
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""")

cte("labor", """
SELECT CAST(ts AS DATE) AS metric_date, user_id % 5 + 1 AS location_id, CAST(event_id % 8 AS DOUBLE) AS labor_hours,
  value AS units_moved
FROM events""")

cte("staff", """
SELECT 'EMP' || CAST(event_id AS VARCHAR) AS supplier_name, value AS total_score,
  CASE WHEN event_type IN ('click', 'view') THEN 'WAREHOUSE_LABOR_TMP' ELSE 'B' END AS grade,
  CASE WHEN event_id % 5 = 0 THEN 'no metrics'
       WHEN event_id % 5 = 1 THEN 'items=' || CAST(event_id % 300 AS VARCHAR)
       ELSE 'total_hours=' || CAST((event_id % 80) / 2 AS VARCHAR) || ';items=' || CAST(event_id % 300 AS VARCHAR) END AS notes
FROM events""")

cte("space", """
SELECT metric_date, location_id, CAST(location_id * 100 AS DOUBLE) AS total_capacity_m3, used AS used_capacity_m3,
  ROUND(used / CAST(location_id * 100 AS DOUBLE) * 100, 2) AS occupancy_pct
FROM (SELECT CAST(l_shipdate AS DATE) AS metric_date, l_suppkey % 4 + 1 AS location_id, SUM(l_quantity) AS used
      FROM lineitem GROUP BY 1, 2)""")

_PALLET = "(CAST(1.2 AS DOUBLE) * CAST(1.0 AS DOUBLE) * CAST(1.5 AS DOUBLE))"
cte("latest_space", f"""
SELECT metric_date, s.location_id, COALESCE(l.location_name, 'Main Warehouse / Central Store') AS location,
  total_capacity_m3 AS capacity, used_capacity_m3 AS used, occupancy_pct AS utilization_pct,
  CASE WHEN occupancy_pct IS NULL OR occupancy_pct <= 85 THEN 'Healthy' WHEN occupancy_pct <= 100 THEN 'Caution'
       ELSE 'Over Capacity' END AS status,
  GREATEST(COALESCE(total_capacity_m3, 0) - COALESCE(used_capacity_m3, 0), 0) AS remaining,
  CAST(FLOOR(COALESCE(used_capacity_m3, 0) / {_PALLET} + 0.5) AS BIGINT) AS occupied_pallets,
  CAST(FLOOR(GREATEST(COALESCE(total_capacity_m3, 0) / {_PALLET} - COALESCE(used_capacity_m3, 0) / {_PALLET}, 0) + 0.5)
       AS BIGINT) AS remaining_pallets
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id ORDER BY metric_date DESC) AS rn FROM space) s
LEFT JOIN locations l ON l.location_id = s.location_id
WHERE rn = 1""", ("space", "locations"))

ORACLE["latest_risk"] = with_("SELECT * FROM latest_risk", "latest_risk")
ORACLE["risk_matrix"] = with_("SELECT risk_id, title, probability, impact FROM latest_risk", "latest_risk")
ORACLE["risk_matrix_cells"] = with_("SELECT * FROM risk_cells", "risk_cells")
ORACLE["risk_zone"] = with_("""
SELECT *, CASE WHEN probability BETWEEN 4 AND 5 AND impact BETWEEN 4 AND 5 THEN 'High'
               WHEN probability BETWEEN 2 AND 4 AND impact BETWEEN 2 AND 4 THEN 'Medium'
               WHEN probability BETWEEN 0 AND 2 AND impact BETWEEN 0 AND 2 THEN 'Low' ELSE 'Mixed' END AS zone
FROM risk_cells""", "risk_cells")
ORACLE["risk_cost_exposure"] = with_("SELECT risk_id, title, cost FROM latest_risk", "latest_risk")
ORACLE["risks_by_category"] = with_("""
SELECT s.category, CAST(COALESCE(c.n, 0) AS BIGINT) AS risk_count
FROM (VALUES (0, 'Delivery'), (1, 'Quality'), (2, 'Financial'), (3, 'Regulatory')) s(pos, category)
LEFT JOIN (SELECT category, COUNT(*) AS n FROM latest_risk GROUP BY 1) c ON c.category = s.category""",
                                    "latest_risk")
ORACLE["procurement_kpis"] = with_("""
SELECT (SELECT ROUND(CAST(SUM(CAST(total_score AS DECIMAL(18,2))) AS DOUBLE) / COUNT(total_score), 6)
        FROM supplier_scores) AS avg_supplier_score,
  (SELECT COUNT(*) FROM latest_risk WHERE probability >= 4 AND impact >= 4) AS high_risk_count,
  (SELECT CAST(SUM(CAST(cost AS DECIMAL(18,2))) AS DOUBLE) FROM latest_risk) AS total_risk_cost""",
                                   "supplier_scores", "latest_risk")
ORACLE["supplier_scores"] = with_("SELECT * FROM supplier_scores", "supplier_scores")
ORACLE["supplier_order_kpis"] = with_("""
SELECT vendor_id AS vendor,
  ROUND(AVG(CASE WHEN actual_date <= promised_date THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 100, 4) AS on_time_pct,
  ROUND(AVG(GREATEST(actual_date - promised_date, 0)), 4) AS avg_days_late,
  ROUND(CASE WHEN SUM(receipts_qty) > 0 THEN SUM(defective_units) / SUM(receipts_qty) ELSE 0.0 END, 6) AS defect_rate,
  ROUND(CASE WHEN SUM(ordered_quantity) > 0 THEN SUM(in_full_quantity) / SUM(ordered_quantity) ELSE 0.0 END, 6)
    AS order_accuracy,
  ROUND(AVG(CASE WHEN actual_date <= promised_date AND in_full_quantity >= ordered_quantity
                 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 100, 4) AS otif_pct,
  ROUND(AVG(actual_date - order_date), 4) AS lead_time_avg
FROM order_sheet GROUP BY vendor_id""", "order_sheet")
ORACLE["latest_space"] = with_("SELECT * FROM latest_space", "latest_space")
ORACLE["space_status"] = with_("SELECT location_id, utilization_pct, status FROM latest_space", "latest_space")
ORACLE["space_remaining"] = with_(
    "SELECT location_id, remaining, occupied_pallets, remaining_pallets FROM latest_space", "latest_space")
ORACLE["labor_daily"] = with_("""
SELECT date, ROUND(u, 2) AS items, ROUND(h, 2) AS hours, ROUND(CASE WHEN h > 0 THEN u / h ELSE 0.0 END, 2) AS rate
FROM (SELECT metric_date AS date, CAST(COALESCE(SUM(CAST(units_moved AS DECIMAL(18,2))), 0) AS DOUBLE) AS u,
        COALESCE(SUM(labor_hours), 0) AS h FROM labor GROUP BY 1)""", "labor")
ORACLE["labor_overall"] = with_("""
SELECT items, hours, CASE WHEN hours > 0 THEN ROUND(items / hours, 2) ELSE 0.0 END AS rate
FROM (SELECT ROUND(CAST(COALESCE(SUM(CAST(units_moved AS DECIMAL(18,2))), 0) AS DOUBLE), 2) AS items,
        ROUND(COALESCE(SUM(labor_hours), 0), 2) AS hours FROM labor)""", "labor")
ORACLE["labor_top_staff"] = with_("""
SELECT supplier_name AS employee_id, ROUND(total_score, 2) AS weighted_rate,
  COALESCE(TRY_CAST(NULLIF(regexp_extract(COALESCE(notes, ''), 'total_hours=([0-9.]+)', 1), '') AS DOUBLE), 0)
    AS total_hours,
  COALESCE(TRY_CAST(NULLIF(regexp_extract(COALESCE(notes, ''), 'items=([0-9.]+)', 1), '') AS DOUBLE), 0)
    AS items_handled
FROM staff WHERE grade = 'WAREHOUSE_LABOR_TMP' ORDER BY total_score DESC, supplier_name LIMIT 10""", "staff")

# ---------------------------------------------------------------- 2.2 / 2.9 scan ingestion and streaming
cte("scan_feed", """
SELECT event_id + 2 AS row_index, CAST(event_id % 8000 AS VARCHAR) AS scan_id,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS event_time_stamps,
  CASE WHEN event_id % 97 = 0 THEN '2024-13-01' ELSE strftime(ts, '%Y-%m-%d') END AS date,
  CASE WHEN user_id % 10 = 0 THEN 'ds_other' ELSE 'ds_active' END AS dataset_id,
  CASE WHEN event_id % 89 = 0 THEN 'x12' ELSE CAST(user_id AS VARCHAR) END AS item_id,
  'item ' || CAST(user_id AS VARCHAR) AS item_name,
  printf('LOC%02d', user_id % 4 + 1) AS location_id,
  CASE event_type WHEN 'click' THEN 'RECEIPT' WHEN 'view' THEN 'ISSUE' WHEN 'purchase' THEN 'adjustment_waste'
                  ELSE UPPER(event_type) END AS event_type,
  CAST(value AS VARCHAR) AS quantity
FROM events""")


def _blank(c: str) -> str:
    return f"TRIM(COALESCE({c}, '')) = ''"


def _not_finite(c: str) -> str:
    return f"(TRY_CAST(TRIM({c}) AS DOUBLE) IS NULL OR NOT isfinite(TRY_CAST(TRIM({c}) AS DOUBLE)))"


cte("scan_checked", f"""
SELECT *, CASE
  WHEN {_blank('scan_id')} THEN 'scan_id is required'
  WHEN {_blank('event_time_stamps')} THEN 'event_time_stamps is required'
  WHEN {_blank('date')} THEN 'date is required'
  WHEN {_blank('dataset_id')} THEN 'dataset_id is required'
  WHEN TRIM(dataset_id) <> 'ds_active' THEN '__other_dataset__'
  WHEN {_blank('item_id')} THEN 'item_id is required'
  WHEN {_blank('item_name')} THEN 'item_name is required'
  WHEN {_blank('location_id')} THEN 'location_id is required'
  WHEN {_blank('event_type')} THEN 'event_type is required'
  WHEN UPPER(TRIM(event_type)) NOT IN ('ADJUSTMENT_WASTE', 'ISSUE', 'RECEIPT')
    THEN 'event_type must be one of [''ADJUSTMENT_WASTE'', ''ISSUE'', ''RECEIPT'']'
  WHEN {_blank('quantity')} THEN 'quantity is required'
  WHEN TRY_CAST(REPLACE(TRIM(event_time_stamps), ' ', 'T') AS TIMESTAMP) IS NULL
    THEN 'event_time_stamps must be ISO-like datetime'
  WHEN TRY_CAST(TRIM(date) AS DATE) IS NULL THEN 'date must be YYYY-MM-DD'
  WHEN {_not_finite('item_id')} THEN 'item_id must be numeric'
  WHEN {_not_finite('quantity')} THEN 'quantity must be numeric'
END AS err
FROM scan_feed""", ("scan_feed",))

cte("scan_valid", """
SELECT TRIM(scan_id) AS scan_id, TRY_CAST(REPLACE(TRIM(event_time_stamps), ' ', 'T') AS TIMESTAMP) AS event_ts,
  TRY_CAST(TRIM(date) AS DATE) AS date, TRIM(dataset_id) AS dataset_id,
  CAST(FLOOR(TRY_CAST(TRIM(item_id) AS DOUBLE)) AS BIGINT) AS item_id, TRIM(item_name) AS item_name,
  UPPER(TRIM(location_id)) AS location_id, UPPER(TRIM(event_type)) AS event_type,
  TRY_CAST(TRIM(quantity) AS DOUBLE) AS quantity,
  CAST(NULL AS VARCHAR) AS lot_number, CAST(NULL AS VARCHAR) AS lot_expiry, CAST(NULL AS VARCHAR) AS reason,
  row_index
FROM scan_checked WHERE err IS NULL""", ("scan_checked",))

cte("scan_quarantine", """
SELECT row_index, err AS error, 'row ' || CAST(row_index AS VARCHAR) || ': ' || err AS message
FROM scan_checked WHERE err IS NOT NULL AND err <> '__other_dataset__'""", ("scan_checked",))

cte("scan_first", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY scan_id ORDER BY row_index) AS rn FROM scan_valid) WHERE rn = 1""",
    ("scan_valid",))

cte("scan_new", """
SELECT * FROM scan_first
WHERE scan_id NOT IN (SELECT scan_id FROM scan_valid WHERE date < DATE '2024-01-08')""", ("scan_first", "scan_valid"))

_QTY = """
  CASE WHEN event_type = 'RECEIPT' THEN quantity ELSE 0.0 END AS receipts_qty,
  CASE WHEN event_type = 'ISSUE' THEN quantity ELSE 0.0 END AS issues_qty"""


def _fact(src: str) -> str:
    return f"""
SELECT row_index AS scan_row, event_ts, date, dataset_id, item_id, item_name, location_id, event_type, quantity,
  {_QTY} FROM {src}"""


def _metrics(new: str) -> str:
    return f"""
SELECT CAST(0 AS BIGINT) AS batch_id, (SELECT COUNT(*) FROM {new}) AS inserted,
  (SELECT COUNT(*) FROM scan_valid) - (SELECT COUNT(*) FROM {new}) AS skipped_duplicates,
  (SELECT COUNT(*) FROM {new}) AS inserted_total,
  (SELECT CAST(COALESCE(MAX(row_index), 1) AS BIGINT) FROM scan_valid) AS last_row,
  (SELECT COUNT(*) FROM scan_quarantine) AS parse_errors"""


ORACLE["scan_header_check"] = with_("""
SELECT row_index, scan_id, event_time_stamps, date, dataset_id, item_id, item_name, location_id, event_type, quantity,
  CAST(NULL AS VARCHAR) AS lot_number, CAST(NULL AS VARCHAR) AS lot_expiry, CAST(NULL AS VARCHAR) AS reason
FROM scan_feed""", "scan_feed")
ORACLE["scan_validate"] = with_("SELECT * FROM scan_valid", "scan_valid")
ORACLE["scan_quarantine"] = with_("SELECT * FROM scan_quarantine", "scan_quarantine")
ORACLE["scan_dedupe"] = with_("SELECT * FROM scan_new", "scan_new")
ORACLE["scan_explode_qty"] = with_(f"SELECT *, {_QTY} FROM scan_new", "scan_new")
ORACLE["scan_append"] = with_(_fact("scan_new"), "scan_new")
ORACLE["ingest_metrics"] = with_(_metrics("scan_new"), "scan_new", "scan_valid", "scan_quarantine")
cte("scan_weeks", """
SELECT v.*, CASE WHEN ts < DATE '2024-01-08' THEN 0 WHEN ts < DATE '2024-01-15' THEN 1 WHEN ts < DATE '2024-01-22' THEN 2 ELSE 3 END AS week
FROM scan_valid v JOIN events e ON e.event_id + 2 = v.row_index""", ("scan_valid",))
cte("scan_winners", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY scan_id ORDER BY week, row_index) AS rn FROM scan_weeks) WHERE rn = 1""", ("scan_weeks",))
cte("scan_week_counts", """
SELECT w.week, (SELECT COUNT(*) FROM scan_winners x WHERE x.week = w.week) AS inserted,
  (SELECT COUNT(*) FROM scan_weeks x WHERE x.week = w.week) AS n_valid, (SELECT MAX(row_index) FROM scan_weeks x WHERE x.week <= w.week AND x.week = w.week) AS last_row,
  (SELECT COUNT(*) FROM scan_quarantine q JOIN events e ON e.event_id + 2 = q.row_index
   WHERE CASE WHEN ts < DATE '2024-01-08' THEN 0 WHEN ts < DATE '2024-01-15' THEN 1 WHEN ts < DATE '2024-01-22' THEN 2 ELSE 3 END = w.week) AS parse_errors
FROM (SELECT unnest([0, 1, 2, 3]) AS week) w""", ("scan_winners", "scan_weeks", "scan_quarantine"))
ORACLE["scan_stream"] = with_(_fact("scan_winners"), "scan_winners")
ORACLE["scan_stream_quarantine"] = with_("SELECT * FROM scan_quarantine", "scan_quarantine")
ORACLE["scan_stream_metrics"] = with_("""
SELECT CAST(week AS BIGINT) AS batch_id, inserted, n_valid - inserted AS skipped_duplicates,
  CAST(SUM(inserted) OVER (ORDER BY week) AS BIGINT) AS inserted_total, CAST(last_row AS BIGINT) AS last_row, parse_errors FROM scan_week_counts""", "scan_week_counts")
ORACLE["scan_stream_dedupe"] = with_(f"""
SELECT scan_id, CAST(week AS BIGINT) AS batch_id, f.* FROM ({_fact("scan_winners")}) f JOIN scan_winners w ON w.row_index = f.scan_row""", "scan_winners")
cte("movement_flags", """
SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS batch_id, CAST(l_shipdate AS TIMESTAMP) AS event_ts FROM lineitem""")
cte("movement_water", """
SELECT batch_id, MAX(MAX(event_ts)) OVER (ORDER BY batch_id) AS high_water FROM movement_flags GROUP BY batch_id""", ("movement_flags",))
ORACLE["stream_movement_late"] = with_("""
SELECT CAST(f.batch_id AS BIGINT) AS batch_id, COUNT(*) AS rows, CAST(COUNT_IF(COALESCE(f.event_ts < p.high_water - INTERVAL 2 DAY, FALSE)) AS BIGINT) AS late_rows, any_value(w.high_water) AS high_water
FROM movement_flags f JOIN movement_water w ON w.batch_id = f.batch_id LEFT JOIN movement_water p ON p.batch_id = f.batch_id - 1
GROUP BY f.batch_id""", "movement_flags", "movement_water")
ORACLE["stream_movement_daily"] = with_(f"""
SELECT CAST(l_shipdate AS DATE) AS day, 'LOC' || CAST(l_suppkey % 4 + 1 AS VARCHAR) AS location_id,
  {EVENT_TYPE} AS event_type, SUM(l_quantity) AS qty
FROM lineitem GROUP BY 1, 2, 3""")

# ---------------------------------------------------------------- 2.7 forecasting
cte("fc_load", """
SELECT date, item_id, COALESCE(issues_qty, 0) AS issues_qty, COALESCE(receipts_qty, 0) AS receipts_qty,
  COALESCE(closing_qty, 0) AS closing_qty, COALESCE(avg_usage_per_day, 0) AS avg_usage
FROM raw_active
WHERE item_id IS NOT NULL AND date IS NOT NULL
  AND NOT (item_id IN (SELECT p_partkey FROM part WHERE p_size > 48) AND date >= DATE '2000-01-01')""",
    ("raw_active",))

cte("fc_m", """
SELECT item_id, last_day(date) AS month_end, SUM(issues_qty) AS issues_qty, SUM(receipts_qty) AS receipts_qty,
  AVG(closing_qty) AS closing_qty, AVG(avg_usage) AS avg_usage
FROM fc_load GROUP BY 1, 2""", ("fc_load",))

cte("fc_monthly", """
SELECT s.item_id, s.month_end, m.issues_qty, m.receipts_qty, m.closing_qty, m.avg_usage
FROM (SELECT item_id, last_day(CAST(UNNEST(generate_series(CAST(date_trunc('month', lo) AS TIMESTAMP),
                                                           CAST(date_trunc('month', hi) AS TIMESTAMP),
                                                           INTERVAL 1 MONTH)) AS DATE)) AS month_end
      FROM (SELECT item_id, MIN(month_end) AS lo, MAX(month_end) AS hi FROM fc_m GROUP BY 1)) s
LEFT JOIN fc_m m ON m.item_id = s.item_id AND m.month_end = s.month_end""", ("fc_m",))

cte("fc_pos", """
SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY month_end) - 1 AS pos FROM fc_monthly""", ("fc_monthly",))

_W_ITEM = "PARTITION BY item_id ORDER BY pos"
cte("fc_nb", f"""
SELECT *,
  MAX(CASE WHEN closing_qty IS NOT NULL THEN pos END)
    OVER ({_W_ITEM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c_pp,
  MIN(CASE WHEN closing_qty IS NOT NULL THEN pos END)
    OVER ({_W_ITEM} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c_np,
  MAX(CASE WHEN avg_usage IS NOT NULL THEN pos END)
    OVER ({_W_ITEM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS u_pp,
  MIN(CASE WHEN avg_usage IS NOT NULL THEN pos END)
    OVER ({_W_ITEM} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS u_np
FROM fc_pos""", ("fc_pos",))


def _interp(col: str, p: str, pp: str, np_: str, a: str, b: str) -> str:
    return f"""CASE WHEN {p}.{col} IS NOT NULL THEN {p}.{col}
       WHEN {p}.{pp} IS NULL AND {p}.{np_} IS NULL THEN 0.0
       WHEN {p}.{pp} IS NULL THEN {b}.{col}
       WHEN {p}.{np_} IS NULL THEN {a}.{col}
       ELSE {a}.{col} + ({b}.{col} - {a}.{col}) / ({p}.{np_} - {p}.{pp}) * ({p}.pos - {p}.{pp}) END"""


cte("fc_gap_fill", f"""
SELECT n.item_id, n.month_end, COALESCE(n.issues_qty, 0) AS issues_qty, COALESCE(n.receipts_qty, 0) AS receipts_qty,
  {_interp('closing_qty', 'n', 'c_pp', 'c_np', 'cp', 'cn')} AS closing_qty,
  {_interp('avg_usage', 'n', 'u_pp', 'u_np', 'up', 'un')} AS avg_usage
FROM fc_nb n
LEFT JOIN fc_pos cp ON cp.item_id = n.item_id AND cp.pos = n.c_pp
LEFT JOIN fc_pos cn ON cn.item_id = n.item_id AND cn.pos = n.c_np
LEFT JOIN fc_pos up ON up.item_id = n.item_id AND up.pos = n.u_pp
LEFT JOIN fc_pos un ON un.item_id = n.item_id AND un.pos = n.u_np""", ("fc_nb", "fc_pos"))

cte("fc_frame", """
SELECT *, issues_qty AS target_nosmooth,
  AVG(issues_qty) OVER (PARTITION BY item_id ORDER BY month_end ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS target_smooth,
  ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY month_end) - 1 AS trend,
  month(month_end) AS month, quarter(month_end) AS quarter,
  sin(2 * pi() * month(month_end) / 12) AS month_sin, cos(2 * pi() * month(month_end) / 12) AS month_cos
FROM fc_gap_fill""", ("fc_gap_fill",))


def _r6(cols: list[str]) -> str:
    # DuckDB's ROUND scales by 10^6 in double and loses digits above ~1e11; a double that
    # large has no digits below 1e-6 anyway, so it is left as is
    # below that, round the shortest decimal text of the double half-up, as Spark's round does
    return ", ".join(
        f"CASE WHEN ABS({c}) >= 1e11 THEN {c} "
        f"ELSE CAST(CAST(ROUND(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38,18)), 6) AS VARCHAR) AS DOUBLE) END AS {c}"
        for c in cols)


def _lags(y: str) -> str:
    w = "PARTITION BY item_id ORDER BY month_end"
    return f"""
SELECT *,
  COALESCE(LAG({y}, 1) OVER ({w}), {y}) AS lag_1,
  COALESCE(LAG({y}, 2) OVER ({w}), LAG({y}, 1) OVER ({w}), {y}) AS lag_2,
  COALESCE(LAG({y}, 3) OVER ({w}), LAG({y}, 2) OVER ({w}), LAG({y}, 1) OVER ({w}), {y}) AS lag_3,
  COALESCE(AVG({y}) OVER ({w} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), LAG({y}, 1) OVER ({w}), {y}) AS rolling_mean_2,
  COALESCE(STDDEV_SAMP({y}) OVER ({w} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS rolling_std_2,
  COALESCE(MIN({y}) OVER ({w} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), LAG({y}, 1) OVER ({w}), {y}) AS rolling_min_2,
  COALESCE(MAX({y}) OVER ({w} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), LAG({y}, 1) OVER ({w}), {y}) AS rolling_max_2,
  COALESCE(AVG({y}) OVER ({w} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), LAG({y}, 1) OVER ({w}), {y}) AS rolling_mean_3,
  COALESCE(STDDEV_SAMP({y}) OVER ({w} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS rolling_std_3,
  COALESCE(LAG({y}, 1) OVER ({w}) - LAG({y}, 2) OVER ({w}), 0) AS diff_1
FROM fc_frame"""


cte("fc_split", """
SELECT *, trend >= n_months - test_size AS is_test FROM (
  SELECT *, GREATEST(3, CAST(FLOOR(n_months * 0.2) AS BIGINT)) AS test_size FROM (
    SELECT *, COUNT(*) OVER (PARTITION BY item_id) AS n_months FROM fc_frame) WHERE n_months >= 8)""", ("fc_frame",))


def _stats(src: str, y: str) -> str:
    return f"""
SELECT item_id, arg_max({y}, month_end) AS last_y, AVG(CASE WHEN rk <= 3 THEN {y} END) AS mean_last_3,
  regr_slope({y}, CAST(trend AS DOUBLE)) AS slope, regr_intercept({y}, CAST(trend AS DOUBLE)) AS intercept,
  MAX(CASE WHEN rk = 1 THEN {y} END) AS y1, MAX(CASE WHEN rk = 2 THEN {y} END) AS y2,
  MAX(CASE WHEN rk = 3 THEN {y} END) AS y3, MAX(trend) AS last_trend, MAX(month_end) AS last_month
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY month_end DESC) AS rk FROM {src}) GROUP BY item_id"""


def _season(src: str, stats: str, y: str) -> str:
    return f"""
SELECT t.item_id, t.month, AVG(t.{y} - (s.intercept + s.slope * t.trend)) AS season
FROM {src} t JOIN {stats} s ON s.item_id = t.item_id GROUP BY 1, 2"""


for _t in ("target_nosmooth", "target_smooth"):
    cte(f"tr_{_t}", f"SELECT * FROM fc_split WHERE NOT is_test", ("fc_split",))
    cte(f"st_{_t}", _stats(f"tr_{_t}", _t), (f"tr_{_t}",))
    cte(f"se_{_t}", _season(f"tr_{_t}", f"st_{_t}", _t), (f"tr_{_t}", f"st_{_t}"))
    _base = f"""(SELECT x.item_id, x.month_end, x.{_t} AS actual, x.trend, s.last_y, s.mean_last_3, s.slope, s.intercept,
                   e.season
                 FROM fc_split x JOIN st_{_t} s ON s.item_id = x.item_id
                 LEFT JOIN se_{_t} e ON e.item_id = x.item_id AND e.month = x.month WHERE x.is_test) b"""
    _models = {
        "naive_last": "last_y",
        "mean_last_3": "mean_last_3",
        "linear_trend": "intercept + slope * trend",
        "seasonal_trend": "intercept + slope * trend + COALESCE(season, 0)",
    }
    cte(f"pr_{_t}", "\nUNION ALL\n".join(
        f"SELECT item_id, month_end, '{_t}' AS target, '{k}' AS model, actual, ROUND(GREATEST({v}, 0), 6) AS prediction "
        f"FROM {_base}"
        for k, v in _models.items()), ("fc_split", f"st_{_t}", f"se_{_t}"))

cte("fc_preds", "SELECT * FROM pr_target_nosmooth UNION ALL SELECT * FROM pr_target_smooth",
    ("pr_target_nosmooth", "pr_target_smooth"))

def _dsum(x: str) -> str:
    """Exact DECIMAL sum, converted to the nearest double via its decimal text."""
    return f"CAST(CAST(SUM(CAST({x} AS DECIMAL(38,12))) AS VARCHAR) AS DOUBLE)"


cte("fc_metrics", f"""
SELECT *, wape - r2 * 10 AS score FROM (
  SELECT item_id, target, model, SQRT(sse / n) AS rmse, sae / n AS mae, sae / (say + 1e-8) * 100 AS wape,
    CASE WHEN n < 2 THEN NULL WHEN sst = 0 THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sse / sst END AS r2
  FROM (
    SELECT item_id, target, model, COUNT(*) AS n,
      {_dsum('e * e')} AS sse, {_dsum('ABS(e)')} AS sae, {_dsum('ABS(actual)')} AS say, {_dsum('dev * dev')} AS sst
    FROM (SELECT *, actual - prediction AS e, actual - AVG(actual) OVER (PARTITION BY item_id, target, model) AS dev
          FROM fc_preds)
    GROUP BY 1, 2, 3))""", ("fc_preds",))

cte("fc_best", """
SELECT * EXCLUDE (rk) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY ROUND(score, 5) ASC NULLS LAST, ROUND(wape, 5) ASC,
    ROUND(r2, 6) DESC NULLS LAST,
    (CASE WHEN target = 'target_nosmooth' THEN 0 ELSE 1 END) * 100
      + CASE model WHEN 'naive_last' THEN 0 WHEN 'mean_last_3' THEN 1 WHEN 'linear_trend' THEN 2
                   WHEN 'seasonal_trend' THEN 3 ELSE 9 END) AS rk
  FROM fc_metrics) WHERE rk = 1""", ("fc_metrics",))


def _step_pred(k: int, h1: str, h2: str, h3: str) -> str:
    t = f"(last_trend + {k})"
    return f"""round_even(GREATEST(CASE model WHEN 'naive_last' THEN {h1}
      WHEN 'mean_last_3' THEN ({h1} + {h2} + {h3}) / 3
      WHEN 'linear_trend' THEN intercept + slope * {t}
      ELSE intercept + slope * {t} + COALESCE(s{k}, 0) END, 0), 0)"""


for _t in ("target_nosmooth", "target_smooth"):
    cte(f"ff_{_t}", f"SELECT f.* FROM fc_frame f WHERE f.item_id IN (SELECT item_id FROM fc_best WHERE target = '{_t}')",
        ("fc_frame", "fc_best"))
    cte(f"fs_{_t}", _stats(f"ff_{_t}", _t), (f"ff_{_t}",))
    cte(f"fz_{_t}", _season(f"ff_{_t}", f"fs_{_t}", _t), (f"ff_{_t}", f"fs_{_t}"))
    cte(f"fq_{_t}", f"""
SELECT b.item_id, b.model, s.slope, s.intercept, s.last_trend, s.y1, COALESCE(s.y2, s.y1) AS h2,
  COALESCE(s.y3, s.y2, s.y1) AS h3,
  last_day(s.last_month + INTERVAL 1 MONTH) AS d1, last_day(s.last_month + INTERVAL 2 MONTH) AS d2,
  last_day(s.last_month + INTERVAL 3 MONTH) AS d3, z1.season AS s1, z2.season AS s2, z3.season AS s3
FROM fc_best b JOIN fs_{_t} s ON s.item_id = b.item_id
LEFT JOIN fz_{_t} z1 ON z1.item_id = b.item_id AND z1.month = month(last_day(s.last_month + INTERVAL 1 MONTH))
LEFT JOIN fz_{_t} z2 ON z2.item_id = b.item_id AND z2.month = month(last_day(s.last_month + INTERVAL 2 MONTH))
LEFT JOIN fz_{_t} z3 ON z3.item_id = b.item_id AND z3.month = month(last_day(s.last_month + INTERVAL 3 MONTH))
WHERE b.target = '{_t}'""", ("fc_best", f"fs_{_t}", f"fz_{_t}"))
    cte(f"fp_{_t}", f"""
SELECT *, {_step_pred(3, 'p2', 'p1', 'y1')} AS p3 FROM (
  SELECT *, {_step_pred(2, 'p1', 'y1', 'h2')} AS p2 FROM (
    SELECT *, {_step_pred(1, 'y1', 'h2', 'h3')} AS p1 FROM fq_{_t}))""", (f"fq_{_t}",))

_REC = "\nUNION ALL\n".join(
    f"SELECT item_id, model, '{t}' AS target, {k} AS step, d{k} AS point_date, p{k} AS demand_qty FROM fp_{t}"
    for t in ("target_nosmooth", "target_smooth") for k in (1, 2, 3))
cte("fc_future", _REC, ("fp_target_nosmooth", "fp_target_smooth"))

cte("fc_published", f"""
SELECT 'ds_active' AS dataset_id, item_id, CAST(0 AS BIGINT) AS location_id, point_date, point_type, demand_qty,
  best_model_name, wape, r2, TIMESTAMP '1998-06-01 02:00:00' AS created_at, 'ds_active:1998-06-01' AS run_id
FROM (
  SELECT f.item_id, f.month_end AS point_date, 'historical' AS point_type, f.issues_qty AS demand_qty,
    b.model AS best_model_name, b.wape, b.r2
  FROM fc_frame f JOIN fc_best b ON b.item_id = f.item_id WHERE f.issues_qty > 0
  UNION ALL
  SELECT p.item_id, p.month_end, 'prediction', p.prediction, b.model, b.wape, b.r2
  FROM fc_preds p JOIN fc_best b ON b.item_id = p.item_id AND b.target = p.target AND b.model = p.model
  WHERE p.prediction > 0
  UNION ALL
  SELECT u.item_id, u.point_date, 'forecast', u.demand_qty, b.model, b.wape, b.r2
  FROM fc_future u JOIN fc_best b ON b.item_id = u.item_id WHERE u.demand_qty > 0)""",
    ("fc_frame", "fc_best", "fc_preds", "fc_future"))

cte("fc_points", """
SELECT item_id, point_date AS date, point_type AS type, demand_qty AS demand FROM fc_published
WHERE point_type IN ('prediction', 'forecast')""", ("fc_published",))

cte("fc_actuals", """
SELECT item_id, last_day(date) AS date, SUM(issues_qty) AS actual FROM fc_load WHERE issues_qty > 0
GROUP BY 1, 2 HAVING SUM(issues_qty) > 0""", ("fc_load",))

cte("fc_chart", """
SELECT COALESCE(a.item_id, p.item_id) AS item_id, COALESCE(a.date, p.date) AS date, a.actual, p.prediction, p.future
FROM fc_actuals a FULL OUTER JOIN (
  SELECT item_id, date, MAX(CASE WHEN type = 'prediction' THEN demand END) AS prediction,
    MAX(CASE WHEN type = 'forecast' THEN demand END) AS future
  FROM fc_points GROUP BY 1, 2) p ON p.item_id = a.item_id AND p.date = a.date""", ("fc_actuals", "fc_points"))

ORACLE["fc_load"] = with_("SELECT * FROM fc_load", "fc_load")
ORACLE["fc_monthly"] = with_(f"""
SELECT item_id, month_end, issues_qty, receipts_qty, {_r6(['closing_qty', 'avg_usage'])} FROM fc_monthly""",
                             "fc_monthly")
ORACLE["fc_gap_fill"] = with_(f"""
SELECT item_id, month_end, issues_qty, receipts_qty, {_r6(['closing_qty', 'avg_usage'])} FROM fc_gap_fill""",
                              "fc_gap_fill")
ORACLE["fc_smooth_target"] = with_("SELECT item_id, month_end, target_nosmooth, ROUND(target_smooth, 6) AS target_smooth "
                                   "FROM fc_frame", "fc_frame")
ORACLE["fc_calendar"] = with_(f"""
SELECT item_id, month_end, trend, month, quarter, {_r6(['month_sin', 'month_cos'])} FROM fc_frame""", "fc_frame")
_LAG_COLS = ["lag_1", "lag_2", "lag_3", "rolling_mean_2", "rolling_std_2", "rolling_min_2", "rolling_max_2",
             "rolling_mean_3", "rolling_std_3", "diff_1"]
ORACLE["fc_lags"] = with_(f"SELECT item_id, month_end, {_r6(_LAG_COLS)} FROM ({_lags('target_nosmooth')})", "fc_frame")
ORACLE["fc_split"] = with_("SELECT item_id, month_end, trend, n_months, test_size, is_test FROM fc_split", "fc_split")
# the trend with bends and yearly season: normal equations summed by month, solved by Gauss-Jordan elimination
_TERMS = 2 + 5 + 2 * 5
_HARMONICS = ", ".join(f"{f}(2 * pi() * {k} * (day / 365.25))" for f in ("sin", "cos") for k in range(1, 6))
_BENDS = ", ".join(f"CASE WHEN {i} <= bends THEN greatest(t - CAST(places[{i}] - day0 AS DOUBLE) / span, 0) ELSE 0 END" for i in range(1, 6))
cte("ct_days", """
SELECT item_id, trend, month_end, is_test, target_nosmooth, target_smooth, n_months - test_size AS known,
  CAST(date_diff('day', DATE '1970-01-01', month_end) AS DOUBLE) AS day FROM fc_split""", ("fc_split",))
cte("ct_item", f"""
SELECT item_id, known, day0, greatest(days[known] - day0, 1) AS span, bends,
  [days[1 + CAST(round_even(i * (floor({0.8} * known) - 1) / bends, 0) AS BIGINT)] for i in range(1, bends + 1)] AS places,
  greatest(top_n, 1e-9) AS scale_nosmooth, greatest(top_s, 1e-9) AS scale_smooth
FROM (SELECT item_id, any_value(known) AS known, greatest(1, least(5, any_value(known) - 2)) AS bends, min(day) AS day0, list(day ORDER BY day) AS days,
        max(CASE WHEN NOT is_test THEN abs(target_nosmooth) END) AS top_n, max(CASE WHEN NOT is_test THEN abs(target_smooth) END) AS top_s
      FROM ct_days GROUP BY item_id)""", ("ct_days",))
cte("ct_terms", f"""
SELECT item_id, month_end, is_test, target_nosmooth, target_smooth, scale_nosmooth, scale_smooth,
  [1.0, t, {_BENDS}, {_HARMONICS}] AS x
FROM (SELECT d.*, i.* EXCLUDE (item_id, known), (d.day - i.day0) / i.span AS t FROM ct_days d JOIN ct_item i USING (item_id))""", ("ct_days", "ct_item"))
cte("ct_sums", f"""
SELECT item_id, i, j, sum(x[i] * CASE WHEN j <= {_TERMS} THEN x[j] WHEN j = {_TERMS + 1} THEN target_nosmooth / scale_nosmooth ELSE target_smooth / scale_smooth END)
  + CASE WHEN i <> j THEN 0 WHEN i <= 2 THEN 0.0001 WHEN i <= 7 THEN 1 ELSE 0.000025 END AS v
FROM ct_terms, (SELECT unnest(range(1, {_TERMS + 1})) AS i), (SELECT unnest(range(1, {_TERMS + 3})) AS j)
WHERE NOT is_test GROUP BY item_id, i, j""", ("ct_terms",))
cte("ct_system", """
SELECT item_id, list(r ORDER BY i) AS m FROM (SELECT item_id, i, list(v ORDER BY j) AS r FROM ct_sums GROUP BY item_id, i) GROUP BY item_id""", ("ct_sums",))
cte("ct_solved", f"""
SELECT item_id, m FROM (
  WITH RECURSIVE step AS (
    SELECT item_id, 1 AS k, m FROM ct_system
    UNION ALL
    SELECT item_id, k + 1, [CASE WHEN i = k THEN [v / m[k][k] for v in m[k]]
      ELSE [m[i][j] - m[i][k] / m[k][k] * m[k][j] for j in range(1, {_TERMS + 3})] END for i in range(1, {_TERMS + 1})]
    FROM step WHERE k <= {_TERMS})
  SELECT * FROM step WHERE k = {_TERMS + 1})""", ("ct_system",))
cte("ct_preds", f"""
SELECT t.item_id, month_end, target, 'changepoint_trend' AS model, CASE WHEN target = 'target_nosmooth' THEN target_nosmooth ELSE target_smooth END AS actual,
  greatest(CASE WHEN target = 'target_nosmooth' THEN scale_nosmooth ELSE scale_smooth END
    * list_sum([x[i] * m[i][CASE WHEN target = 'target_nosmooth' THEN {_TERMS + 1} ELSE {_TERMS + 2} END] for i in range(1, {_TERMS + 1})]), 0) AS prediction
FROM ct_terms t JOIN ct_solved USING (item_id), (SELECT unnest(['target_nosmooth', 'target_smooth']) AS target) WHERE is_test""", ("ct_terms", "ct_solved"))
ORACLE["fc_seasonal_trend"] = with_("""
SELECT item_id, month_end, target, model, ROUND(actual, 6) AS actual, ROUND(ROUND(prediction, 6), 3) AS prediction FROM ct_preds""", "ct_preds")
ORACLE["fc_metrics"] = with_(f"""
SELECT item_id, target, model, {_r6(['rmse', 'mae', 'wape', 'r2', 'score'])} FROM fc_metrics""", "fc_metrics")
ORACLE["fc_select"] = with_(f"""
SELECT item_id, target, model, {_r6(['rmse', 'mae', 'wape', 'r2', 'score'])} FROM fc_best""", "fc_best")
ORACLE["fc_recursive"] = with_("SELECT * FROM fc_future", "fc_future")
ORACLE["fc_publish"] = with_(f"""
SELECT dataset_id, item_id, location_id, point_date, point_type, {_r6(['demand_qty', 'wape', 'r2'])},
  best_model_name, created_at, run_id FROM fc_published""", "fc_published")
ORACLE["fc_latest_run"] = with_("SELECT DISTINCT item_id, run_id FROM fc_published", "fc_published")
ORACLE["fc_actuals"] = with_("SELECT * FROM fc_actuals", "fc_actuals")
ORACLE["fc_points"] = with_("SELECT item_id, date, type, ROUND(demand, 6) AS demand FROM fc_points", "fc_points")
ORACLE["fc_date_info"] = with_("""
SELECT d.item_id, d.raw_data_end_date, d.last_historical_month, f.forecast_start_date
FROM (SELECT item_id, MAX(date) AS raw_data_end_date, MAX(last_day(date)) AS last_historical_month
      FROM fc_load GROUP BY 1) d
LEFT JOIN (SELECT item_id, MIN(point_date) AS forecast_start_date FROM fc_published WHERE point_type = 'forecast'
           GROUP BY 1) f ON f.item_id = d.item_id""", "fc_load", "fc_published")
ORACLE["fc_run_summary"] = with_("""
SELECT item_id, run_id, dataset_id, best_model_name AS model, ROUND(wape, 6) AS wape, ROUND(r2, 6) AS r2,
  MAX(created_at) AS generated_at
FROM fc_published GROUP BY item_id, run_id, dataset_id, best_model_name, wape, r2""", "fc_published")
ORACLE["fc_chart"] = with_(f"SELECT item_id, date, {_r6(['actual', 'prediction', 'future'])} FROM fc_chart", "fc_chart")
ORACLE["fc_chart_dense"] = with_(f"""
SELECT item_id, date, {_r6(['actual', 'prediction', 'future'])},
  future IS NOT NULL AND ROW_NUMBER() OVER (PARTITION BY item_id
                                            ORDER BY CASE WHEN future IS NOT NULL THEN 0 ELSE 1 END, date) <= 3 AS in_table
FROM (
  SELECT s.item_id, s.date, c.actual, c.prediction, c.future
  FROM (SELECT item_id, last_day(CAST(UNNEST(generate_series(CAST(date_trunc('month', lo) AS TIMESTAMP),
                                                             CAST(date_trunc('month', hi) AS TIMESTAMP),
                                                             INTERVAL 1 MONTH)) AS DATE)) AS date
        FROM (SELECT item_id, MIN(date) AS lo, MAX(date) AS hi FROM fc_chart GROUP BY 1)) s
  LEFT JOIN fc_chart c ON c.item_id = s.item_id AND c.date = s.date)""", "fc_chart")

# ---------------------------------------------------------------- 2.2 report (CSV) loading
# Expected parse results, computed directly from the columns the report text was rendered from.
_ORG = "CASE WHEN l_suppkey % 3 = 0 THEN 'UNKNOWN' ELSE 'ORG' || CAST(l_suppkey % 3 AS VARCHAR) END"
_SUB = "'SUB' || CAST(l_suppkey % 4 + 1 AS VARCHAR)"
_ITM = "'ITM' || CAST(l_partkey AS VARCHAR)"
_KDESC = "l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC"
_KASC = "l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice"

ORACLE["csv_with_preamble"] = f"""
SELECT 'closing_balance-' || strftime(l_shipdate, '%Y%m') || '.csv' AS source_file, {_SUB} AS "Subinventory Name", {_ITM} AS "Item Name",
  strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS "Start Date",
  CASE WHEN l_linenumber = 3 THEN 'null' ELSE CAST(l_quantity AS VARCHAR) END AS "Costed Onhand Quantity",
  CASE WHEN l_linenumber = 5 THEN 'checked, "twice"' || chr(10) || 'and signed' ELSE 'ok' END AS "Notes"
FROM lineitem"""

ORACLE["preamble_period"] = """
SELECT DISTINCT 'opening_receipts_issues-' || lpad(CAST(p_partkey % 16 AS VARCHAR), 2, '0') || '.csv' AS source_file,
  DATE '1998-01-01' AS period_start, DATE '1998-12-31' AS period_end FROM part
UNION ALL
SELECT DISTINCT 'closing_balance-' || strftime(l_shipdate, '%Y%m') || '.csv', CAST(NULL AS DATE), CAST(NULL AS DATE) FROM lineitem"""

ORACLE["parse_number"] = """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber IN (1, 2, 3) THEN NULL ELSE l_extendedprice END AS value
FROM lineitem"""

ORACLE["parse_date_multi"] = """
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_linenumber = 7 THEN NULL
       WHEN l_linenumber % 4 = 1 AND day(d) <= 12 THEN make_date(year(d), day(d), month(d))
       ELSE d END AS value
FROM (SELECT *, CAST(l_shipdate AS DATE) AS d FROM lineitem)"""

# a row's place in its report: the file, then the place in the file
def _place(file: str, *keys: str) -> str:
    return f"{{'f': {file}, " + ", ".join(f"'k{i}': {k}" for i, k in enumerate(keys)) + "}"


_LI_KEYS = ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
_BUCKET = "l_partkey % 64"
_NOTHING = "CAST(NULL AS VARCHAR)"

cte("cb_all", f"""
SELECT {_place("CAST(strftime(l_shipdate, '%Y%m') AS BIGINT)", *_LI_KEYS)} AS place,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS period_start, CASE WHEN l_linenumber <> 7 THEN last_day(CAST(l_shipdate AS DATE)) END AS period_end,
  {_ORG} AS org_code, {_SUB} AS location_code, {_ITM} AS item_number,
  CAST(NULL AS DOUBLE) AS opening_qty, CAST(NULL AS DOUBLE) AS receipts_qty, CAST(NULL AS DOUBLE) AS issues_qty,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS closing_qty, l_extendedprice AS inventory_value,
  ROUND(l_discount * 100, 2) AS unit_cost
FROM lineitem""")

cte("mm_all", f"""
SELECT {_place(_BUCKET, *_LI_KEYS)} AS place, {_ORG} AS org_code, {_SUB} AS location_code, {_ITM} AS item_number, 'EA' AS uom_code,
  l_quantity % 10 AS min_qty, l_quantity AS max_qty, 'MINMAX' AS planning_code,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE 'CENTRAL' END AS source_subinventory,
  CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS created_at, CAST(l_shipdate AS DATE) + INTERVAL 1410 MINUTE AS updated_at
FROM lineitem""")

cte("ori_all", f"""
SELECT {_place("p_partkey % 16", "p_partkey", "again")} AS place,
  DATE '1998-01-01' AS period_start, DATE '1998-12-31' AS period_end, 'MAIN_ORG' AS org_code,
  'SUB' || CAST(p_partkey % 4 + 1 AS VARCHAR) AS location_code, 'ITM' || CAST(p_partkey AS VARCHAR) AS item_number,
  p_type AS category_name, CASE WHEN p_partkey % 10 = 0 THEN p_name || chr(10) || 'in two lines' ELSE p_name END AS item_description,
  CASE WHEN p_size % 2 = 0 THEN 'EA' ELSE 'BOX' END AS uom_code,
  CAST(p_size AS DOUBLE) AS opening_qty, CAST(p_partkey % 11 + again AS DOUBLE) AS receipts_qty,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_partkey % 13 AS DOUBLE) END AS issues_qty,
  CAST(p_size + p_partkey % 11 + again - p_partkey % 13 AS DOUBLE) AS closing_qty, CAST(p_size * 100 AS DOUBLE) AS inventory_value,
  p_retailprice AS unit_cost
FROM part, (SELECT unnest([0, 1]) AS again) WHERE again = 0 OR p_partkey % 7 = 0""")

cte("cons_all", f"""
SELECT {_place(_BUCKET, *_LI_KEYS)} AS place, {_ORG} AS org_code, {_SUB} AS location_code, {_ITM} AS item_number,
  'CAT' || CAST(l_partkey % 5 AS VARCHAR) AS category_name,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE 'C' || CAST(l_linenumber AS VARCHAR) END AS item_class,
  'EA' AS uom_code, ROUND(l_discount * 100, 2) AS unit_cost, l_quantity AS quantity, l_extendedprice AS total_cost,
  ['A', 'B', 'C'][l_linenumber % 3 + 1] AS abc_class
FROM lineitem WHERE l_returnflag = 'N'""")

cte("exp_all", f"""
SELECT {_place(_BUCKET, *_LI_KEYS)} AS place, {_ORG} AS org_code,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_shipdate AS DATE) + INTERVAL 1410 MINUTE ELSE CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) END AS event_ts,
  {_ITM} AS item_number, {_SUB} AS location_code, l_quantity AS quantity, 'EA' AS uom_code, ROUND(l_discount * 100, 2) AS unit_cost,
  l_extendedprice AS total_cost,
  CASE l_linenumber % 3 WHEN 0 THEN 'Expired' WHEN 1 THEN 'Damaged - waste' ELSE 'WASTE bin' END AS reason,
  'CAT' || CAST(l_partkey % 5 AS VARCHAR) AS category_name, 'LOT' || CAST(l_orderkey % 500 AS VARCHAR) AS lot_number,
  CAST(l_shipdate AS DATE) + 30 AS lot_expiry
FROM lineitem WHERE l_returnflag = 'R'""")

cte("cat_all", f"""
SELECT {_place("p_partkey % 8", "p_partkey")} AS place, p_type AS category_name,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand || ' ' || lower(p_type) END AS category_description FROM part""")
cte("types_all", f"""SELECT {_place("p_partkey % 8", "p_partkey")} AS place, p_brand AS item_type_name FROM part WHERE p_size % 17 <> 0""")


def _numbered(key: str, id_col: str, rows: str, at: str = "place") -> str:
    """Ids in the order in which keys first stand in ``rows``."""
    return f"SELECT *, ROW_NUMBER() OVER (ORDER BY first_at) AS {id_col} FROM (SELECT {key}, MIN({at}) AS first_at FROM {rows} WHERE {key.split(', ')[-1]} IS NOT NULL GROUP BY {key})"


def _resolved(rows: str, source: str, uom: bool) -> str:
    """``rows`` with the ids that a load of ``source`` alone hands out."""
    unit = f"LEFT JOIN ({_numbered('uom_code', 'uom_id', source)}) u ON u.uom_code = r.uom_code" if uom else ""
    return f"""
SELECT r.* EXCLUDE (place), o.org_id, l.location_id, i.item_id{', u.uom_id' if uom else ''} FROM ({rows}) r
JOIN ({_numbered('org_code', 'org_id', source)}) o ON o.org_code = r.org_code
JOIN ({_numbered('org_code, location_code', 'location_id', source)}) l ON l.org_code = r.org_code AND l.location_code = r.location_code
JOIN ({_numbered('item_number', 'item_id', source)}) i ON i.item_number = r.item_number {unit}"""


def _last(rows: str, key: str) -> str:
    return f"SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY place DESC) AS rn FROM {rows}) WHERE rn = 1"


_BALANCE = "period_start, period_end, org_code, location_code, item_number"

# two loads, one after the other: places begin with the number of the load
cte("two_loads", """
SELECT {'n': 0, 'f': place.f, 'a': place.k0, 'b': place.k1, 'c': place.k2, 'd': place.k3, 'e': place.k4} AS place, org_code, location_code FROM cb_all
UNION ALL
SELECT {'n': 1, 'f': place.f, 'a': place.k0, 'b': place.k1, 'c': place.k2, 'd': place.k3, 'e': place.k4}, org_code, location_code FROM mm_all""", ("cb_all", "mm_all"))
ORACLE["dim_upsert"] = with_(f"""
SELECT org_code, location_code, org_id, location_id FROM ({_numbered('org_code, location_code', 'location_id', 'two_loads')}) l
JOIN ({_numbered('org_code', 'org_id', 'two_loads')}) o USING (org_code)""", "two_loads")


def _master(n: int, src: str, keys: int, **columns: str) -> str:
    """A report's rows in the columns of the item master, placed in the whole load."""
    ks = [f"CAST(place.k{i} AS DOUBLE)" if i < keys else "CAST(0 AS DOUBLE)" for i in range(5)]
    names = ("item_number", "item_description", "category_name", "item_class", "uom_code")
    at = "{'n': " + str(n) + ", 'f': CAST(place.f AS BIGINT), " + ", ".join(f"'k{i}': {k}" for i, k in enumerate(ks)) + "}"
    return f"SELECT {at} AS place, " + ", ".join(f"{columns.get(c, _NOTHING)} AS {c}" for c in names) + f" FROM {src}"


cte("master_rows", "\nUNION ALL\n".join([
    _master(0, "cat_all", 1, category_name="category_name"),
    _master(2, "cb_all", 5, item_number="item_number"),
    _master(3, "ori_all", 2, item_number="item_number", item_description="item_description", category_name="category_name", uom_code="uom_code"),
    _master(4, "mm_all", 5, item_number="item_number", uom_code="uom_code"),
    _master(5, "cons_all", 5, item_number="item_number", category_name="category_name", item_class="item_class", uom_code="uom_code"),
    _master(6, "exp_all", 5, item_number="item_number", category_name="category_name", uom_code="uom_code"),
]), ("cat_all", "cb_all", "ori_all", "mm_all", "cons_all", "exp_all"))
ORACLE["dim_fill_missing"] = with_(f"""
SELECT m.item_number, i.item_id, m.item_description, c.category_id, m.item_class, u.uom_id, CAST(NULL AS BIGINT) AS item_type_id
FROM (SELECT item_number, arg_min(item_description, place) FILTER (WHERE item_description IS NOT NULL) AS item_description,
        arg_min(category_name, place) FILTER (WHERE category_name IS NOT NULL) AS category_name,
        arg_min(item_class, place) FILTER (WHERE item_class IS NOT NULL) AS item_class, arg_min(uom_code, place) FILTER (WHERE uom_code IS NOT NULL) AS uom_code
      FROM master_rows WHERE item_number IS NOT NULL GROUP BY item_number) m
JOIN ({_numbered('item_number', 'item_id', 'master_rows')}) i ON i.item_number = m.item_number
LEFT JOIN ({_numbered('category_name', 'category_id', 'master_rows')}) c ON c.category_name = m.category_name
LEFT JOIN ({_numbered('uom_code', 'uom_id', 'master_rows')}) u ON u.uom_code = m.uom_code""", "master_rows")

ORACLE["load_categories"] = with_(f"""
SELECT n.category_name, category_id, category_description FROM ({_numbered('category_name', 'category_id', 'cat_all')}) n
JOIN (SELECT category_name, arg_min(category_description, place) FILTER (WHERE category_description IS NOT NULL) AS category_description
      FROM cat_all GROUP BY category_name) d ON d.category_name = n.category_name""", "cat_all")
ORACLE["load_item_types"] = with_(f"SELECT item_type_name, item_type_id FROM ({_numbered('item_type_name', 'item_type_id', 'types_all')})", "types_all")
ORACLE["load_closing_balance"] = with_(_resolved(_last("cb_all WHERE period_end IS NOT NULL", _BALANCE), "cb_all", False), "cb_all")
ORACLE["load_opening_receipts_issues"] = with_(_resolved(_last("ori_all", _BALANCE), "ori_all", True), "ori_all")
ORACLE["unpivot_movements"] = with_(_resolved("""
SELECT place, org_code, location_code, item_number, uom_code, event_type, quantity, unit_cost, CAST(NULL AS DOUBLE) AS total_cost,
  CAST(CASE WHEN event_type = 'OPENING' THEN period_start ELSE period_end END AS TIMESTAMP) AS event_ts, TRUE AS is_aggregate
FROM (SELECT *, 'OPENING' AS event_type, opening_qty AS quantity FROM ori_all
      UNION ALL SELECT *, 'RECEIPT', receipts_qty FROM ori_all
      UNION ALL SELECT *, 'ISSUE', issues_qty FROM ori_all)
WHERE quantity IS NOT NULL AND quantity <> 0""", "ori_all", True), "ori_all")
ORACLE["load_min_max"] = with_(_resolved(_last("mm_all", "org_code, location_code, item_number"), "mm_all", True), "mm_all")
ORACLE["load_consumption"] = with_(_resolved("SELECT * FROM cons_all", "cons_all", True), "cons_all")
ORACLE["load_expiry_waste"] = with_(_resolved("SELECT * FROM exp_all", "exp_all", True), "exp_all")
ORACLE["classify_waste"] = with_(_resolved("""
SELECT place, org_code, location_code, item_number, uom_code,
  CASE WHEN lower(COALESCE(reason, '')) LIKE '%waste%' THEN 'WASTE' ELSE 'EXPIRE' END AS event_type,
  quantity, unit_cost, total_cost, event_ts, FALSE AS is_aggregate
FROM exp_all""", "exp_all", True), "exp_all")
ORACLE["export_event_feed"] = with_(f"""
SELECT UPPER(TRIM(COALESCE(event_type, ''))) AS "Type", item_id AS "Item ID", UPPER(TRIM(location_id)) AS "Location",
  ABS(COALESCE(quantity, 0)) AS "Quantity", strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS "Timestamp"
FROM raw_active WHERE {IN_RANGE_TS}""", "raw_active", "rng")
