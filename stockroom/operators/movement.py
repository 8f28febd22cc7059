"""M1-M5 movement and C1-C6 consumption reports over the fact and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.functions.normalize import is_blank, location_code, norm_event_type, norm_location
from stockroom.operators.scope import Scope, day_between, filter_events, filter_raw, in_active_dataset
from stockroom.session import materialize


def money(col: Column) -> Column:
    """Monetary amounts are summed as DECIMAL so totals do not depend on partition order."""
    return col.cast("decimal(38,6)")


def money_sum(col: Column) -> Column:
    return F.coalesce(F.sum(money(col)), F.lit(0).cast("decimal(28,2)")).cast("double")


def _receipt_qty() -> Column:
    return F.when(norm_event_type("event_type") == "RECEIPT", F.coalesce("quantity", F.lit(0.0))).otherwise(F.lit(0.0))


def _issue_qty() -> Column:
    return F.when(norm_event_type("event_type") == "ISSUE", F.abs(F.coalesce("quantity", F.lit(0.0)))).otherwise(F.lit(0.0))


def _scoped_raw(raw: DataFrame, datasets: DataFrame, scope: Scope, day_col: str | None) -> DataFrame:
    return filter_raw(in_active_dataset(raw, datasets), scope, day_col=day_col)


def movement_totals(raw: DataFrame, datasets: DataFrame, scope: Scope) -> DataFrame:
    """M1 + M2: receipts, issues (absolute) and net movement in the event-time range."""
    r = _scoped_raw(raw, datasets, scope, "event_ts")
    a = r.agg(
        F.coalesce(F.sum(_receipt_qty()), F.lit(0.0)).alias("receipts"),
        F.coalesce(F.sum(_issue_qty()), F.lit(0.0)).alias("issues"),
    )
    return a.withColumn("net_movement", F.col("receipts") - F.col("issues"))


def net_movement(totals: DataFrame) -> DataFrame:
    """M2: receipts - issues of an M1 result."""
    return totals.select((F.col("receipts") - F.col("issues")).alias("net_movement"))


def movement_by_location(locations: DataFrame, raw: DataFrame, datasets: DataFrame, scope: Scope) -> DataFrame:
    """M3: M1 per location; every location is kept (zeros when it has no rows).

    The fact is aggregated to one row per location code *before* the join, so the join
    sees (#locations) rows on both sides however large the fact is.
    """
    r = _scoped_raw(raw, datasets, Scope(start=scope.start, end=scope.end, item=scope.item), "event_ts")
    per_loc = r.groupBy(norm_location("location_id").alias("_loc")).agg(
        F.sum(_receipt_qty()).alias("_rec"), F.sum(_issue_qty()).alias("_iss")
    )
    locs = locations if not scope.location else locations.filter(F.col("location_id") == scope.location)
    j = locs.join(per_loc, locs.location_id == per_loc._loc, "left")
    rec, iss = F.coalesce("_rec", F.lit(0.0)), F.coalesce("_iss", F.lit(0.0))
    return j.select(
        "location_id",
        F.col("location_name").alias("location"),
        rec.alias("receipts"),
        iss.alias("issues"),
        (rec - iss).alias("net_movement"),
    ).orderBy(F.col("receipts").desc(), "location_id")


def event_feed(
    raw: DataFrame,
    datasets: DataFrame,
    scope: Scope,
    event_type: str | None = None,
    event_location: str | None = None,
    event_item: int | None = None,
    full: bool = False,
    k: int = 50,
) -> DataFrame:
    """M4: normalized events newest first; the newest ``k`` unless ``full``."""
    r = _scoped_raw(raw, datasets, scope, "event_ts")
    if event_type:
        r = r.filter(norm_event_type("event_type") == event_type.strip().upper())
    if event_location:
        r = r.filter(location_code("location_id") == event_location.strip().upper())
    if event_item:
        r = r.filter(F.col("item_id").cast("bigint") == event_item)
    out = r.select(
        norm_event_type("event_type").alias("type"),
        F.coalesce("quantity", F.lit(0.0)).alias("quantity"),
        F.col("event_ts").alias("timestamp"),
        F.col("item_id").cast("bigint").alias("item_id"),
        location_code("location_id").alias("location"),
        "ingest_seq",
    ).orderBy(F.col("timestamp").desc(), F.col("ingest_seq").desc())
    if not full:
        out = out.limit(k)
    return out.drop("ingest_seq")


def event_feed_facets(feed: DataFrame) -> DataFrame:
    """M5: distinct locations and item ids of a feed (item ids in numeric order)."""
    locs = feed.select(F.lit("location").alias("facet"), F.col("location").alias("value"), F.lit(None).cast("bigint").alias("_n"))
    its = feed.select(F.lit("item_id").alias("facet"), F.col("item_id").cast("string").alias("value"), F.col("item_id").alias("_n"))
    return locs.union(its).distinct().orderBy("facet", "_n", "value").drop("_n")


def consumption_totals(events: DataFrame, items: DataFrame, scope: Scope) -> DataFrame:
    """Absolute ISSUE quantity and its cost, events joined to the item master."""
    e = filter_events(events, scope).filter(F.col("event_type") == "ISSUE")
    j = e.join(items.select("item_id"), "item_id", "inner")
    return j.agg(
        F.coalesce(F.sum(F.abs("quantity")), F.lit(0.0)).alias("total_qty"),
        money_sum(F.abs("quantity") * F.col("unit_cost_aed")).alias("total_cost"),
    )


def consumption_daily_by_location(raw: DataFrame, datasets: DataFrame, scope: Scope) -> DataFrame:
    """Issues per (day, location code)."""
    r = _scoped_raw(raw, datasets, scope, "date").filter(~is_blank("location_id"))
    return (
        r.groupBy(F.col("date"), location_code("location_id").alias("location_id"))
        .agg(F.coalesce(F.sum(F.coalesce("issues_qty", F.lit(0.0))), F.lit(0.0)).alias("qty"))
        .orderBy("date", "location_id")
    )


def consumption_daily_pivot(daily: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """C2 with one column per location code (0 where a day has no rows for it). Without ``codes`` the daily sums are
    written first, so that the codes are read from them and the fact is read once."""
    if codes is None:
        daily = materialize(daily, "daily-consumption")
        codes = sorted(r.location_id for r in daily.select("location_id").distinct().where("location_id IS NOT NULL").collect())
    p = daily.groupBy("date").pivot("location_id", codes).agg(F.sum("qty"))
    cols = [c for c in p.columns if c != "date"]
    return p.select("date", *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in cols]).orderBy("date")


def cost_per_unit_by_location(raw: DataFrame, datasets: DataFrame, scope: Scope) -> DataFrame:
    """C4: inventory value / issues per location code (0 without issues)."""
    r = _scoped_raw(raw, datasets, scope, "date").filter(~is_blank("location_id"))
    g = r.groupBy(location_code("location_id").alias("location")).agg(
        money_sum(F.coalesce("inventory_value", F.lit(0.0))).alias("total_value"),
        F.coalesce(F.sum(F.coalesce("issues_qty", F.lit(0.0))), F.lit(0.0)).alias("total_issues"),
    )
    avg = F.when(F.col("total_issues") == 0, F.lit(0.0)).otherwise(F.col("total_value") / F.col("total_issues"))
    return g.withColumn("avg_cost_per_unit", avg).orderBy(F.col("avg_cost_per_unit").desc(), "location")


def _top_items(raw: DataFrame, datasets: DataFrame, scope: Scope, measure: Column, name: str, k: int) -> DataFrame:
    r = _scoped_raw(raw, datasets, scope, "date").filter(~is_blank("item_name"))
    g = r.groupBy(F.col("item_id").cast("bigint").alias("item_id"), F.col("item_name").alias("item")).agg(measure.alias(name))
    return g.orderBy(F.col(name).desc(), "item_id", "item").limit(k)


def top_items_by_qty(raw: DataFrame, datasets: DataFrame, scope: Scope, k: int = 10) -> DataFrame:
    """Top items by issued quantity (ties by item id)."""
    return _top_items(raw, datasets, scope, F.coalesce(F.sum(F.coalesce("issues_qty", F.lit(0.0))), F.lit(0.0)), "qty", k)


def top_items_by_value(raw: DataFrame, datasets: DataFrame, scope: Scope, k: int = 10) -> DataFrame:
    """Top items by inventory value."""
    return _top_items(raw, datasets, scope, money_sum(F.coalesce("inventory_value", F.lit(0.0))), "value", k)


__all__ = [
    "money", "money_sum", "movement_totals", "net_movement", "movement_by_location", "event_feed",
    "event_feed_facets", "consumption_totals", "consumption_daily_by_location", "consumption_daily_pivot",
    "cost_per_unit_by_location", "top_items_by_qty", "top_items_by_value", "day_between",
]
