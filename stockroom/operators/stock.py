"""Stock KPIs over the latest snapshot (see ``snapshot.latest_snapshot``).

Every KPI is one aggregate over the snapshot; ``stock_dashboard`` computes the one-row
KPIs in a single pass so the snapshot is shuffled once for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.functions.normalize import expiry_date, is_blank, js_round, location_label
from stockroom.operators.scope import Scope, filter_items


def _closing() -> Column:
    return F.coalesce(F.col("closing_qty"), F.lit(0.0))


def _min() -> Column:
    return F.coalesce(F.col("min_qty"), F.lit(0.0))


def _max() -> Column:
    return F.coalesce(F.col("max_qty"), F.lit(0.0))


def _count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def _pct(num: Column, den: Column) -> Column:
    """``Math.round(num / den * 100)``, 0 when den is 0."""
    return F.when(den == 0, F.lit(0).cast("bigint")).otherwise(js_round(num / den * 100))


def _in_stock() -> Column:
    return _closing() > _min()


def _low_stock() -> Column:
    return (_closing() > 0) & (_closing() <= _min())


def _out_stock() -> Column:
    return _closing() == 0


def inventory_summary(snap: DataFrame) -> DataFrame:
    """Pairs, distinct locations, distinct items (named ``categories`` as in the source)."""
    return snap.agg(
        F.count(F.lit(1)).alias("items"),
        F.countDistinct("location_id").alias("locations"),
        F.countDistinct("item_id").alias("categories"),
    )


def availability(snap: DataFrame) -> DataFrame:
    """Pairs with a positive balance and their share (JS rounding)."""
    a = snap.agg(_count_if(_closing() > 0).alias("available_items"), F.count(F.lit(1)).alias("total_items"))
    return a.withColumn("percent", _pct(F.col("available_items"), F.col("total_items")))


def reorder_risk(snap_in_range: DataFrame) -> DataFrame:
    """S3: pairs at or below min, on a snapshot taken within the date filter."""
    a = snap_in_range.agg(_count_if(_closing() <= _min()).alias("reorder_risk_items"), F.count(F.lit(1)).alias("total_rows"))
    return a.withColumn("percent", _pct(F.col("reorder_risk_items"), F.col("total_rows")))


def stock_status(snap: DataFrame) -> DataFrame:
    """In (> min), low (0 < q <= min), out (= 0); negatives are in none of them."""
    return snap.agg(
        _count_if(_in_stock()).alias("in_stock"),
        _count_if(_low_stock()).alias("low_stock"),
        _count_if(_out_stock()).alias("out_stock"),
    )


def stock_by_location(snap: DataFrame) -> DataFrame:
    """S4 per numeric location, with its 'LOCnn' label; out desc, low desc."""
    g = snap.groupBy("location_id").agg(
        F.count(F.lit(1)).alias("total_items"),
        _count_if(_in_stock()).alias("in_stock"),
        _count_if(_low_stock()).alias("low_stock"),
        _count_if(_out_stock()).alias("out_stock"),
    )
    return g.select(
        "location_id", location_label("location_id").alias("location"), "total_items", "in_stock", "low_stock", "out_stock"
    ).orderBy(F.col("out_stock").desc(), F.col("low_stock").desc(), "location_id")


def qty_by_location(snap: DataFrame) -> DataFrame:
    """Rounded sum of balances per location (NULL balances ignored)."""
    g = snap.groupBy("location_id").agg(F.coalesce(F.round(F.sum("closing_qty"), 0), F.lit(0.0)).alias("total_current_qty"))
    return g.select("location_id", location_label("location_id").alias("location"), "total_current_qty").orderBy(
        F.col("total_current_qty").desc(), "location_id"
    )


def stock_scope(snap: DataFrame) -> DataFrame:
    """Number of pairs."""
    return snap.agg(F.count(F.lit(1)).alias("total_items"))


def stock_status_detail(snap_code_in_range: DataFrame) -> DataFrame:
    """Per pair label (<= 0 Out, <= min Low, else In) and a display quantity (0 -> 0.1)."""
    c = _closing()
    status = (
        F.when(c <= 0, F.lit("Out of Stock")).when(c <= _min(), F.lit("Low Stock")).otherwise(F.lit("In Stock"))
    )
    return snap_code_in_range.select(
        "item_id",
        "location_id",
        c.alias("closing_qty"),
        _min().alias("min_qty"),
        F.col("date"),
        status.alias("stock_status"),
        F.when(c == 0, F.lit(0.1)).otherwise(c).alias("display_closing_qty"),
    ).orderBy("item_id", "location_id")


def stockout_by_category(items: DataFrame, categories: DataFrame, scope: Scope | None = None) -> DataFrame:
    """Items with zero stock per category name."""
    it = filter_items(items, scope or Scope()).filter(F.col("current_qty") == 0)
    j = it.join(categories, "category_id", "inner")
    return j.groupBy(F.col("category_name").alias("category")).agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.col("count").desc(), "category"
    )


def reorder_risk_by_item(snap: DataFrame) -> DataFrame:
    """Pairs at risk (cover below usage x lead time, or at/below min) per item."""
    c = _closing()
    cover = F.col("avg_usage_per_day").isNotNull() & F.col("restock_lead_time").isNotNull() & (
        c <= F.col("avg_usage_per_day") * F.col("restock_lead_time")
    )
    at_risk = F.when(cover, 1).when(c <= _min(), 1).otherwise(0)
    g = snap.groupBy("item_id", "item_name").agg(
        F.sum(at_risk).cast("bigint").alias("count"), F.count(F.lit(1)).alias("total_rows")
    )
    return (
        g.filter(F.col("count") > 0)
        .withColumn("risk_percentage", F.round(F.col("count") * 100.0 / F.col("total_rows"), 0))
        .orderBy(F.col("count").desc(), "item_name", "item_id")
    )


def min_max_compliance(snap: DataFrame) -> DataFrame:
    """Below min / above max / within (both counted if min > max); JS-rounded shares."""
    c = _closing()
    below, above = c < _min(), c > _max()
    a = snap.agg(
        _count_if(below).alias("below_min"),
        _count_if(above).alias("above_max"),
        _count_if(~below & ~above).alias("within_range"),
    )
    total = F.col("below_min") + F.col("above_max") + F.col("within_range")
    return a.select(
        "*",
        _pct(F.col("below_min"), total).alias("below_min_pct"),
        _pct(F.col("above_max"), total).alias("above_max_pct"),
        _pct(F.col("within_range"), total).alias("within_range_pct"),
    )


def turnover_by_item(snap: DataFrame) -> DataFrame:
    """Sum of issues on the latest rows / average stock, per item (0 when no stock)."""
    stock = F.when(F.col("current_stock_avg").isNotNull(), F.col("current_stock_avg")).otherwise(
        F.col("current_stock_avg_rounded")
    )
    g = snap.groupBy("item_id").agg(
        F.max("item_name").alias("_name"),
        F.sum(F.coalesce(F.col("issues_qty"), F.lit(0.0))).alias("total_issues"),
        F.avg(stock).alias("_avg"),
    )
    name = F.coalesce(F.nullif(F.trim("_name"), F.lit("")), F.concat(F.lit("Item "), F.col("item_id").cast("string")))
    turnover = F.when(F.col("_avg").isNull() | (F.col("_avg") == 0), F.lit(0.0)).otherwise(
        F.col("total_issues") / F.col("_avg")
    )
    return g.select(
        "item_id",
        name.alias("item_name"),
        F.coalesce("total_issues", F.lit(0.0)).alias("total_issues"),
        F.coalesce("_avg", F.lit(0.0)).alias("avg_stock"),
        turnover.alias("turnover"),
    ).orderBy(F.col("turnover").desc(), "item_id")


def top_reorder_gap(snap: DataFrame, k: int = 10) -> DataFrame:
    """Pairs at/below min by gap desc, balance asc (then item, location); top k with status."""
    c, m = _closing(), _min()
    gap = F.round(m - c, 0)
    status = (
        F.when((c > m) | (F.col("gap") < 0), F.lit("Safe"))
        .when((c == m) | (F.col("gap") == 0), F.lit("At Threshold"))
        .otherwise(F.lit("Shortage"))
    )
    top = (
        snap.filter(c <= m)
        .select("item_id", F.col("item_name").alias("item"), "location_id", c.alias("closing_qty"), m.alias("min_qty"), gap.alias("gap"))
        .orderBy(F.col("gap").desc(), F.col("closing_qty").asc(), "item_id", "location_id")
        .limit(k)
    )
    return top.withColumn("status", status)


def lot_rows_filter() -> Column:
    """Rows that carry a lot: non-blank lot number and expiry text."""
    return ~is_blank("lot_number") & ~is_blank("lot_expiry")


def top_expiry_lots(lot_snap: DataFrame, as_of: Column, k: int = 10) -> DataFrame:
    """Latest lot row per pair; days left, value, risk level and action; NULL expiry first."""
    exp = expiry_date("lot_expiry")
    days = F.datediff(exp, as_of)
    value = F.coalesce(F.col("inventory_value"), F.col("closing_qty") * F.coalesce(F.col("unit_cost"), F.lit(0.0)), F.lit(0.0))
    d = F.col("days_left")
    risk = (
        F.when(F.col("expiry_date").isNull(), F.lit("-")).when(d <= 30, F.lit("High")).when(d <= 60, F.lit("Medium")).otherwise(F.lit("Low"))
    )
    action = (
        F.when(F.col("expiry_date").isNull(), F.lit("-"))
        .when(d < 0, F.lit("Expired - urgent handling"))
        .when(d <= 30, F.lit("Use immediately"))
        .when(d <= 60, F.lit("Monitor"))
        .otherwise(F.lit("OK"))
    )
    top = (
        lot_snap.select(
            "item_id",
            "location_id",
            F.col("item_name").alias("item"),
            "lot_number",
            exp.alias("expiry_date"),
            days.alias("days_left"),
            F.round(_closing(), 0).alias("qty"),
            F.round(value, 2).alias("value"),
        )
        .orderBy(F.col("days_left").asc_nulls_first(), "item_id", "location_id")
        .limit(k)
    )
    return top.withColumn("risk_level", risk).withColumn("action", action)


def total_stock_qty(items: DataFrame, scope: Scope | None = None) -> DataFrame:
    """Sum of the item master's current quantity."""
    return filter_items(items, scope or Scope()).agg(
        F.coalesce(F.sum("current_qty"), F.lit(0)).cast("bigint").alias("total_qty")
    )


def stock_dashboard(snap: DataFrame) -> DataFrame:
    """S1, S2, S4, S7 and S11 in one aggregate over the snapshot."""
    c = _closing()
    below, above = c < _min(), c > _max()
    a = snap.agg(
        F.count(F.lit(1)).alias("items"),
        F.countDistinct("location_id").alias("locations"),
        F.countDistinct("item_id").alias("categories"),
        _count_if(c > 0).alias("available_items"),
        _count_if(_in_stock()).alias("in_stock"),
        _count_if(_low_stock()).alias("low_stock"),
        _count_if(_out_stock()).alias("out_stock"),
        _count_if(below).alias("below_min"),
        _count_if(above).alias("above_max"),
        _count_if(~below & ~above).alias("within_range"),
    )
    return a.withColumn("availability_pct", _pct(F.col("available_items"), F.col("items")))
