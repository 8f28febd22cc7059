"""Adapters from the driver's TPC-H-like parquet tables to the inventory model tables.

Every model table is a lazy DataFrame over the given parquet files, so the work of every
operator grows with the input. The mapping (which driver column plays which inventory
role) is fixed here and mirrored, independently, by the SQL oracle in
``stockroom.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.functions.normalize import literal_rows

# The fact table carries ``ingest_seq``, an orderable struct standing in for SQLite's rowid
# ("last inserted wins"): (orderkey, linenumber, suppkey, quantity, extendedprice) is unique
# per lineitem row.

ACTIVE_DATASET = "ds_active"

# explicit schemas of the driver tables (no inference pass over file footers)
_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
_TABLES = list(_SCHEMAS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in _SCHEMAS:
        raise ValueError(f"unknown driver table {name!r}")
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _event_type_from_flag(flag: Column) -> Column:
    return (
        F.when(flag == "A", F.lit("RECEIPT"))
        .when(flag == "N", F.lit("ISSUE"))
        .otherwise(F.lit("ADJUSTMENT_WASTE"))
    )


def raw_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table ``raw_inventory_v``: one row per dated item x location observation."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    j = li.join(part, li.l_partkey == part.p_partkey, "inner")
    ship_day = F.to_date("l_shipdate")
    ret = F.col("l_returnflag")
    closing = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_partkey")) % 61 - 5
    return j.select(
        F.lit(ACTIVE_DATASET).alias("dataset_id"),
        ship_day.alias("date"),
        F.concat(F.lit("LOC"), (F.col("l_suppkey") % 4 + 1).cast("string")).alias("location_id"),
        F.col("l_partkey").alias("item_id"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("item_name"),
        F.col("l_shipdate").alias("event_ts"),
        _event_type_from_flag(ret).alias("event_type"),
        F.col("l_quantity").alias("quantity"),
        F.when(ret == "A", F.col("l_quantity")).otherwise(F.lit(0.0)).alias("receipts_qty"),
        F.when(ret == "N", F.col("l_quantity")).otherwise(F.lit(0.0)).alias("issues_qty"),
        closing.cast("double").alias("closing_qty"),
        (F.col("p_size") % 20).cast("double").alias("min_qty"),
        (F.col("p_size") % 20 + 25).cast("double").alias("max_qty"),
        F.col("l_extendedprice").alias("inventory_value"),
        F.col("p_retailprice").alias("unit_cost"),
        F.when(ret == "N", F.col("l_extendedprice")).otherwise(F.lit(0.0)).alias("annual_consumption_value"),
        F.when(F.col("l_tax") == 0, F.lit(None).cast("double"))
        .otherwise(F.col("l_quantity") / 10)
        .alias("avg_usage_per_day"),
        F.col("l_linenumber").cast("double").alias("restock_lead_time"),
        F.when(F.col("l_discount") == 0, F.lit(None).cast("double"))
        .otherwise((F.col("l_orderkey") % 40).cast("double"))
        .alias("current_stock_avg"),
        (F.col("l_orderkey") % 41).cast("double").alias("current_stock_avg_rounded"),
        F.when(F.col("l_linenumber") == 1, F.lit(""))
        .otherwise(F.concat(F.lit("LOT"), (F.col("l_orderkey") % 500).cast("string")))
        .alias("lot_number"),
        F.when(F.col("l_linenumber") == 7, F.lit("n/a"))
        .otherwise(F.date_add(ship_day, (F.col("l_orderkey") % 120).cast("int")).cast("string"))
        .alias("lot_expiry"),
        F.struct(
            F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_suppkey").alias("k3"),
            F.col("l_quantity").alias("k4"), F.col("l_extendedprice").alias("k5"),
        ).alias("ingest_seq"),
    )


def raw_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact with all three loads: the active one, an earlier one that ends with 1997 and counted one more of
    everything, and an archived one of receipts only."""
    raw = raw_inventory(spark, sf_dir)
    earlier = raw.where(F.col("date") < F.lit("1998-01-01").cast("date")).withColumn("dataset_id", F.lit("ds_prev")).withColumn("quantity", F.col("quantity") + 1)
    archived = raw.where(F.col("receipts_qty") > 0).withColumn("dataset_id", F.lit("ds_archived"))
    return raw.unionByName(earlier).unionByName(archived)


def datasets(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """Dataset versions: two active loads (the newer one wins) and a newer inactive one."""
    return literal_rows(
        spark,
        [
            ("ds_prev", "previous load", "prev.csv", "2024-01-01 00:00:00", True),
            (ACTIVE_DATASET, "current load", "current.csv", "2024-02-01 00:00:00", True),
            ("ds_archived", "archived load", "archived.csv", "2024-03-01 00:00:00", False),
        ],
        ["dataset_id", "dataset_name", "source_file", "imported_at", "is_active"],
    ).withColumn("imported_at", F.to_timestamp_ntz("imported_at"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location dimension from the supplier table: ids 1..5 (5 holds no fact rows)."""
    sup = table(spark, sf_dir, "supplier")
    loc = sup.select((F.col("s_suppkey") % 5 + 1).alias("location_id")).distinct()
    return loc.select(
        "location_id",
        F.format_string("LOC%02d", "location_id").alias("location_code"),
        F.concat(F.lit("Warehouse "), F.col("location_id").cast("string")).alias("location_name"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item master from the part table."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("item_id"),
        F.concat(F.lit("ITM"), F.col("p_partkey").cast("string")).alias("item_code"),
        F.concat_ws(" ", F.upper("p_name"), F.col("p_partkey").cast("string")).alias("item_name"),
        F.col("p_type").alias("category_id"),
        (F.col("p_partkey") % 5 + 1).alias("location_id"),
        (F.col("p_size") % 20).cast("bigint").alias("min_qty"),
        (F.col("p_size") % 20 + 25).cast("bigint").alias("max_qty"),
        (F.col("p_partkey") % 7).alias("current_qty"),
        F.col("p_retailprice").alias("unit_cost_aed"),
        (F.col("p_size") > 45).alias("is_critical"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_type").alias("category_id")).distinct().select(
        "category_id",
        F.concat(F.upper(F.substring(F.lower("category_id"), 1, 1)), F.expr("substr(lower(category_id), 2)")).alias(
            "category_name"
        ),
    )


def inventory_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed movement events: ISSUE and waste quantities are negative."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    j = li.join(part, li.l_partkey == part.p_partkey, "inner")
    et = _event_type_from_flag(F.col("l_returnflag"))
    return j.select(
        F.col("l_shipdate").alias("event_ts"),
        et.alias("event_type"),
        F.col("l_partkey").alias("item_id"),
        (F.col("l_suppkey") % 4 + 1).alias("location_id"),
        F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(-F.col("l_quantity")).alias("quantity"),
        F.col("p_retailprice").alias("unit_cost_aed"),
    )


def item_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("item_id"),
        F.concat(F.lit("LOT"), (F.col("l_orderkey") % 500).cast("string")).alias("lot_number"),
        F.date_add(F.to_date("l_shipdate"), (F.col("l_orderkey") % 120).cast("int")).alias("expiry_date"),
        F.col("l_quantity").cast("bigint").alias("qty_on_hand"),
    )


def raw_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk assessments from orders: 40 risks, scores 0..5 (0 = invalid)."""
    o = table(spark, sf_dir, "orders")
    rid = F.col("o_custkey") % 40
    # fixed values: priority -> risk category (the fifth falls outside the shown list)
    cat = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Delivery"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("Quality"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("Financial"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("Regulatory"))
        .otherwise(F.lit("Operational"))
    )
    return o.select(
        F.lit(ACTIVE_DATASET).alias("dataset_id"),
        F.col("o_orderkey").alias("assessment_id"),
        rid.alias("risk_id"),
        F.col("o_orderdate").alias("assessment_date"),
        (F.col("o_orderkey") % 6).cast("double").alias("probability_score"),
        (F.col("o_custkey") % 6).cast("double").alias("impact_score"),
        F.col("o_totalprice").alias("estimated_cost_aed"),
        F.format_string("R%03d", rid).alias("risk_code"),
        F.when(rid == 0, F.lit(" ")).otherwise(F.concat(F.lit("Risk "), rid.cast("string"))).alias("risk_title"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string")).otherwise(cat).alias("risk_category"),
    )


def vendor_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored supplier KPI rows (one per supplier) from the supplier table."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.lit(ACTIVE_DATASET).alias("dataset_id"),
        F.col("s_name").alias("supplier"),
        (F.col("s_nationkey") % 10 + 5).cast("double").alias("lead_time_days_avg"),
        (F.col("s_suppkey") % 100).cast("double").alias("quality_score"),
        ((F.col("s_suppkey") * 7) % 100).cast("double").alias("delivery_score"),
        ((F.col("s_suppkey") * 3) % 101 / 100).alias("otif"),
        ((F.col("s_suppkey") * 11) % 101 / 100).alias("cost_score"),
        F.col("s_acctbal").alias("total_score"),
    )


def order_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    s = table(spark, sf_dir, "supplier")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.select(
        F.col("s_name").alias("vendor_id"),
        F.to_date("o_orderdate").alias("order_date"),
        F.date_add(F.to_date("o_orderdate"), 40).alias("promised_date"),
        F.to_date("l_shipdate").alias("actual_date"),
        F.col("l_quantity").alias("ordered_quantity"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))
        .otherwise(F.col("l_quantity") - 1)
        .alias("in_full_quantity"),
        F.col("l_quantity").alias("receipts_qty"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(F.lit(0.0)).alias("defective_units"),
    )


def labor_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.to_date("ts").alias("metric_date"),
        (F.col("user_id") % 5 + 1).alias("location_id"),
        (F.col("event_id") % 8).cast("double").alias("labor_hours"),
        F.col("value").alias("units_moved"),
    )


def staff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows; staff rows carry the labor grade tag and ``k=v`` notes."""
    e = table(spark, sf_dir, "events")
    staff = F.col("event_type").isin("click", "view")
    notes = (
        F.when(F.col("event_id") % 5 == 0, F.lit("no metrics"))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit("items="), (F.col("event_id") % 300).cast("string")))
        .otherwise(
            F.concat(
                F.lit("total_hours="), ((F.col("event_id") % 80) / 2).cast("string"),
                F.lit(";items="), (F.col("event_id") % 300).cast("string"),
            )
        )
    )
    return e.select(
        F.concat(F.lit("EMP"), F.col("event_id").cast("string")).alias("supplier_name"),
        F.col("value").alias("total_score"),
        F.when(staff, F.lit("WAREHOUSE_LABOR_TMP")).otherwise(F.lit("B")).alias("grade"),
        notes.alias("notes"),
    )


def space_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily space use per location: used = shipped quantity that day."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.to_date("l_shipdate").alias("metric_date"), (F.col("l_suppkey") % 4 + 1).alias("location_id")).agg(
        F.sum("l_quantity").alias("used_capacity_m3")
    )
    cap = (F.col("location_id") * 100).cast("double")
    return g.select(
        "metric_date",
        "location_id",
        cap.alias("total_capacity_m3"),
        "used_capacity_m3",
        F.round(F.col("used_capacity_m3") / cap * 100, 2).alias("occupancy_pct"),
    )


def scan_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreadsheet-like scan rows (all strings) from the events table, with sheet row index."""
    return scan_rows_from_events(table(spark, sf_dir, "events"))


def scan_rows_from_events(e: DataFrame) -> DataFrame:
    """Events -> scan sheet rows; works on a batch or a streaming DataFrame."""
    et = (
        F.when(F.col("event_type") == "click", F.lit("RECEIPT"))
        .when(F.col("event_type") == "view", F.lit("ISSUE"))
        .when(F.col("event_type") == "purchase", F.lit("adjustment_waste"))
        .otherwise(F.upper("event_type"))
    )
    return e.select(
        (F.col("event_id") + 2).alias("row_index"),
        (F.col("event_id") % 8000).cast("string").alias("scan_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("event_time_stamps"),
        F.when(F.col("event_id") % 97 == 0, F.lit("2024-13-01"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
        .alias("date"),
        F.when(F.col("user_id") % 10 == 0, F.lit("ds_other")).otherwise(F.lit(ACTIVE_DATASET)).alias("dataset_id"),
        F.when(F.col("event_id") % 89 == 0, F.lit("x12"))
        .otherwise(F.col("user_id").cast("string"))
        .alias("item_id"),
        F.concat(F.lit("item "), F.col("user_id").cast("string")).alias("item_name"),
        F.format_string("LOC%02d", F.col("user_id") % 4 + 1).alias("location_id"),
        et.alias("event_type"),
        F.col("value").cast("string").alias("quantity"),
    )


def movements_from_lineitem(li: DataFrame) -> DataFrame:
    """Lineitem rows as (event_ts, location code, event type, quantity); batch or streaming."""
    return li.select(
        F.col("l_shipdate").alias("event_ts"),
        F.concat(F.lit("LOC"), (F.col("l_suppkey") % 4 + 1).cast("string")).alias("location_id"),
        _event_type_from_flag(F.col("l_returnflag")).alias("event_type"),
        F.col("l_quantity").alias("quantity"),
    )


# ---------------------------------------------------------------- report files rendered as CSV lines
# Each report is a DataFrame of (source_file, line_no, value); line_no is an orderable struct (section, row key) so
# preamble < header < data. ``write_report`` makes files of it. Reports come in several files (by month, or by item).

_POS = "struct<s:int,k1:bigint,k2:int,k3:bigint,k4:double,k5:double>"


def _pos(section: int, k1=None, k2=None, k3=None, k4=None, k5=None) -> Column:
    z = lambda v, t: (v if v is not None else F.lit(0)).cast(t)
    return F.struct(
        F.lit(section).alias("s"), z(k1, "bigint").alias("k1"), z(k2, "int").alias("k2"), z(k3, "bigint").alias("k3"),
        z(k4, "double").alias("k4"), z(k5, "double").alias("k5"),
    )


def _report(body: DataFrame, *sections: list[str]) -> DataFrame:
    """``body`` (source_file, line_no, value) with the lines of ``sections`` before it in each file."""
    out = body
    for n, texts in enumerate(sections):
        files = body.select("source_file").distinct().select("source_file", F.posexplode(F.array(*map(F.lit, texts))).alias("i", "value"))
        out = out.unionByName(files.select("source_file", _pos(n, F.col("i")).alias("line_no"), "value"))
    return out


def write_report(report: DataFrame, path: str) -> None:
    """One text file per source_file, lines in order, in a folder ``source_file=<name>``."""
    lines = report.repartition("source_file").sortWithinPartitions("source_file", "line_no")
    lines.select("source_file", "value").write.partitionBy("source_file").text(path)


def _file(name: str, part: Column) -> Column:
    return F.concat(F.lit(f"{name}-"), part, F.lit(".csv"))


def _by_item(name: str, files: int = 64, col: str = "l_partkey") -> Column:
    return _file(name, F.lpad((F.col(col) % files).cast("string"), 2, "0")).alias("source_file")


def _li_pos(section: int) -> Column:
    return _pos(section, F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_quantity"),
                F.col("l_extendedprice"))


def _org() -> Column:
    return F.when(F.col("l_suppkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("ORG"), (F.col("l_suppkey") % 3).cast("string")))


def _sub() -> Column:
    return F.concat(F.lit("SUB"), (F.col("l_suppkey") % 4 + 1).cast("string"))


def _itm(col: str = "l_partkey") -> Column:
    return F.concat(F.lit("ITM"), F.col(col).cast("string"))


def _q(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _dmy(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def categories_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    desc = F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.concat_ws(" ", "p_brand", F.lower("p_type")))
    body = p.select(_by_item("categories", 8, "p_partkey"), _pos(1, F.col("p_partkey")).alias("line_no"), F.concat_ws(",", "p_type", desc).alias("value"))
    return _report(body, ["\ufeffCategory Name,Category Description"])


def item_types_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    first = F.when(F.col("p_size") % 17 == 0, F.lit(" ")).otherwise(F.col("p_brand"))
    body = p.select(_by_item("item_types", 8, "p_partkey"), _pos(1, F.col("p_partkey")).alias("line_no"), F.concat_ws(",", first, "p_name").alias("value"))
    return _report(body, ["Item Type,Example"])


def closing_balance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    cells = [
        _org(), _sub(), _itm(),
        F.format_number(F.col("l_discount") * 100, 2),
        F.when(F.col("l_linenumber") == 3, F.lit("null")).otherwise(F.col("l_quantity").cast("string")),
        _q(F.format_number("l_extendedprice", 2)),
        F.date_format(F.trunc(day, "MM"), "yyyy-MM-dd"),
        F.when(F.col("l_linenumber") == 7, F.lit("")).otherwise(_dmy(F.last_day(day))),
        F.when(F.col("l_linenumber") == 5, F.lit('"checked, ""twice""\nand signed"')).otherwise(F.lit("ok")),
    ]
    body = li.select(_file("closing_balance", F.date_format(day, "yyyyMM")).alias("source_file"), _li_pos(2).alias("line_no"),
                     F.concat_ws(",", *cells).alias("value"))
    return _report(body, ["Quantity on hand - closing balance", "Generated,01/06/1998", ""], [
        "Inventory Organization Code,Subinventory Name,Item Name,Unit Cost,Costed Onhand Quantity,"
        "Costed Onhand Amount,Start Date,End Date,Notes"])


def opening_receipts_issues_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per part; some descriptions hold a line break, and every seventh part has a second line that replaces
    the balance of the first."""
    p = table(spark, sf_dir, "part")
    again = F.when(F.col("p_partkey") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    p = p.withColumn("again", F.explode(again))
    rec, iss = F.col("p_partkey") % 11 + F.col("again"), F.col("p_partkey") % 13
    name = F.when(F.col("p_partkey") % 10 == 0, _q(F.concat(F.col("p_name"), F.lit("\nin two lines")))).otherwise(F.col("p_name"))
    cells = [
        F.concat(F.lit("SUB"), (F.col("p_partkey") % 4 + 1).cast("string")), F.col("p_type"), _itm("p_partkey"),
        name, F.when(F.col("p_size") % 2 == 0, F.lit("EA")).otherwise(F.lit("BOX")),
        _q(F.format_number("p_retailprice", 2)), F.col("p_size").cast("string"), rec.cast("string"),
        F.when(iss == 0, F.lit("null")).otherwise(iss.cast("string")),
        (F.col("p_size") + rec - iss).cast("string"), (F.col("p_size") * 100).cast("string"),
    ]
    body = p.select(_by_item("opening_receipts_issues", 16, "p_partkey"), _pos(2, F.col("p_partkey"), F.col("again")).alias("line_no"),
                    F.concat_ws(",", *cells).alias("value"))
    return _report(body, ["Opening stock, receipts and issues", "Period Start,01/01/1998", "Period End,12/31/1998", ""], [
        "Valuation Unit,Category,Item,Description,UOM,Unit Cost,Opening Quantity,Receipts,Issues,Closing Quantity,"
        "Inventory Value"])


def min_max_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    cells = [
        _org(), _sub(), _itm(), F.lit("EA"), (F.col("l_quantity") % 10).cast("string"), F.col("l_quantity").cast("string"),
        F.lit("MINMAX"), F.when(F.col("l_linenumber") == 2, F.lit("")).otherwise(F.lit("CENTRAL")),
        _dmy(day), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T23:30:00Z")),
    ]
    body = li.select(_by_item("min_max"), _li_pos(1).alias("line_no"),
                     F.concat_ws(",", *cells).alias("value"))
    return _report(body, [
        "ORGANIZATION_CODE,DESTINATION,ITEM_NUMBER,MINMAX_QUANTITY_UOM,MIN_MINMAX_QUANTITY,MAX_MINMAX_QUANTITY,"
        "INVENTORY_PLANNING_CODE,SOURCE_SUBINVENTORY,CREATION_DATE,LAST_UPDATE_DATE"])


def consumption_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "N")
    cells = [
        _org(), _sub(), _itm(), F.concat(F.lit("CAT"), (F.col("l_partkey") % 5).cast("string")),
        F.when(F.col("l_linenumber") == 1, F.lit("")).otherwise(F.concat(F.lit("C"), F.col("l_linenumber").cast("string"))),
        F.lit("EA"), F.format_number(F.col("l_discount") * 100, 2), F.col("l_quantity").cast("string"),
        _q(F.format_number("l_extendedprice", 2)),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("l_linenumber") % 3 + 1).cast("int")),
    ]
    body = li.select(_by_item("consumption"), _li_pos(1).alias("line_no"),
                     F.concat_ws(",", *cells).alias("value"))
    return _report(body, [
        "ORGANIZATION_CODE,Location,ITEM_NUMBER,CATEGORY,ITEM_CLASS,PRIMARY_UOM_CODE,UNIT_COST,QUANTITY,COST,ABCCLASS"])


def expiry_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    day = F.to_date("l_shipdate")
    reason = (
        F.when(F.col("l_linenumber") % 3 == 0, F.lit("Expired"))
        .when(F.col("l_linenumber") % 3 == 1, F.lit("Damaged - waste"))
        .otherwise(F.lit("WASTE bin"))
    )
    cells = [
        _org(), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 23:30:00"))).otherwise(_dmy(day)), _itm(), _sub(), F.col("l_quantity").cast("string"), F.lit("EA"),
        F.format_number(F.col("l_discount") * 100, 2), _q(F.format_number("l_extendedprice", 2)), reason,
        F.concat(F.lit("CAT"), (F.col("l_partkey") % 5).cast("string")),
        F.concat(F.lit("LOT"), (F.col("l_orderkey") % 500).cast("string")), _dmy(F.date_add(day, 30)),
    ]
    body = li.select(_by_item("expiry"), _li_pos(1).alias("line_no"),
                     F.concat_ws(",", *cells).alias("value"))
    return _report(body, [
        "Source,Txn Date,Item,Location,Quantity,UOM,Unit Cost,Value,Reason,Category,Lot Number,Lot Expiry Date"])
