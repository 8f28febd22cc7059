"""Expiry and waste reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.functions.normalize import expiry_date, is_blank, location_code
from stockroom.operators.movement import money_sum
from stockroom.operators.scope import Scope, filter_events, filter_raw, in_active_dataset

WASTE = "ADJUSTMENT_WASTE"


def _waste_events(events: DataFrame, items: DataFrame, scope: Scope) -> DataFrame:
    e = filter_events(events, scope).filter(F.col("event_type") == WASTE)
    return e.join(items.select("item_id"), "item_id", "inner")


def expired_totals(events: DataFrame, items: DataFrame, scope: Scope) -> DataFrame:
    """Absolute waste quantity and value from start 00:00:00 to end 23:59:59."""
    j = _waste_events(events, items, scope)
    return j.agg(
        F.coalesce(F.sum(F.abs("quantity")), F.lit(0.0)).alias("expired_qty"),
        money_sum(F.abs("quantity") * F.col("unit_cost_aed")).alias("expired_value"),
    )


def _lots_expiring(lots: DataFrame, items: DataFrame, scope: Scope, days: int) -> DataFrame:
    ref = F.lit(scope.end).cast("date")
    lo = lots.filter((F.col("expiry_date") >= ref) & (F.col("expiry_date") <= F.date_add(ref, days)))
    it = items.select("item_id", F.col("location_id").alias("item_location"), "unit_cost_aed", "category_id")
    j = lo.join(it, "item_id", "inner")
    if scope.location:
        j = j.filter(F.col("item_location") == scope.location)
    if scope.item:
        j = j.filter(F.col("item_id") == scope.item)
    return j


def expiring_soon(lots: DataFrame, items: DataFrame, scope: Scope, days: int = 30) -> DataFrame:
    """Lots expiring in [end, end + days]: on-hand quantity and value."""
    j = _lots_expiring(lots, items, scope, days)
    return j.agg(
        F.coalesce(F.sum("qty_on_hand"), F.lit(0)).cast("bigint").alias("expiring_soon_qty"),
        money_sum(F.col("qty_on_hand") * F.col("unit_cost_aed")).alias("expiring_soon_value"),
    )


def expiring_by_category(lots: DataFrame, items: DataFrame, categories: DataFrame, scope: Scope,
                         days: int = 30, k: int = 10) -> DataFrame:
    """E2 quantity per category, top k."""
    j = _lots_expiring(lots, items, scope, days).join(categories, "category_id", "inner")
    g = j.groupBy("category_id", F.col("category_name").alias("category")).agg(
        F.coalesce(F.sum("qty_on_hand"), F.lit(0)).cast("bigint").alias("qty")
    )
    return g.orderBy(F.col("qty").desc(), "category").limit(k).drop("category_id")


def waste_daily_dense(events: DataFrame, items: DataFrame, scope: Scope) -> DataFrame:
    """Waste per day on a zero-filled day spine from start to end.

    The spine always holds the start day, even for a reversed range (as a recursive CTE
    would). It has one row per calendar day, so its size is bounded by the range, not the
    data; the waste side is aggregated to one row per day before the join.
    """
    spark = events.sparkSession
    start = F.lit(scope.start).cast("date")
    spine = spark.range(1).select(
        F.explode(F.sequence(start, F.greatest(start, F.lit(scope.end).cast("date")), F.expr("INTERVAL 1 DAY"))).alias("day")
    )
    w = (
        _waste_events(events, items, scope)
        .groupBy(F.to_date("event_ts").alias("day"))
        .agg(F.sum(F.abs("quantity")).alias("_qty"))
    )
    return spine.join(w, "day", "left").select("day", F.coalesce("_qty", F.lit(0.0)).alias("qty")).orderBy("day")


def _waste_raw(raw: DataFrame, datasets: DataFrame, scope: Scope) -> DataFrame:
    r = in_active_dataset(raw, datasets).filter(F.lower(F.trim(F.coalesce("event_type", F.lit("")))) == "adjustment_waste")
    return filter_raw(r, scope, day_col="event_ts")


def waste_by_location(raw: DataFrame, datasets: DataFrame, scope: Scope) -> DataFrame:
    """E5: waste quantity per location code."""
    r = _waste_raw(raw, datasets, scope).filter(~is_blank("location_id"))
    return (
        r.groupBy(location_code(F.coalesce("location_id", F.lit(""))).alias("location_id"))
        .agg(F.coalesce(F.sum(F.coalesce("quantity", F.lit(0.0))), F.lit(0.0)).alias("waste_quantity"))
        .orderBy(F.col("waste_quantity").desc(), "location_id")
    )


def waste_by_item(raw: DataFrame, datasets: DataFrame, scope: Scope, k: int = 15) -> DataFrame:
    """Top k items by waste; label falls back to 'Item <id>'."""
    r = _waste_raw(raw, datasets, scope)
    g = r.groupBy(F.col("item_id").cast("bigint").alias("item_id"), "item_name").agg(
        F.coalesce(F.sum(F.coalesce("quantity", F.lit(0.0))), F.lit(0.0)).alias("waste_quantity")
    )
    top = g.orderBy(F.col("waste_quantity").desc(), "item_id", "item_name").limit(k)
    label = F.when(F.trim(F.coalesce("item_name", F.lit(""))) != "", F.col("item_name")).otherwise(
        F.concat(F.lit("Item "), F.col("item_id").cast("string"))
    )
    return top.select("item_id", "item_name", label.alias("item_label"), "waste_quantity")


def waste_trend(raw: DataFrame, datasets: DataFrame, scope: Scope) -> DataFrame:
    """Waste per event day (days without waste are absent)."""
    r = _waste_raw(raw, datasets, scope).filter(F.col("event_ts").isNotNull())
    return (
        r.groupBy(F.to_date("event_ts").alias("event_date"))
        .agg(F.coalesce(F.sum(F.coalesce("quantity", F.lit(0.0))), F.lit(0.0)).alias("waste_quantity"))
        .orderBy("event_date")
    )


def expiring_60d_rows(raw: DataFrame, datasets: DataFrame, scope: Scope, days: int = 60) -> DataFrame:
    """Fact rows (not distinct lots) whose lot expiry is in [as_of, as_of + days]."""
    as_of = scope.as_of_col()
    exp = expiry_date("lot_expiry")
    r = filter_raw(in_active_dataset(raw, datasets), scope).filter(
        exp.isNotNull() & (exp >= as_of) & (exp <= F.date_add(as_of, days))
    )
    return r.agg(F.count(F.lit(1)).alias("lot_count"))

