"""Scope and filter operators (active dataset, default range, filters, filter options)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockroom.functions.normalize import is_blank, literal_rows, norm_location


@dataclass(frozen=True)
class Scope:
    """Request filters: inclusive day range, numeric location and item, and the 'today' date."""

    start: str | None = None
    end: str | None = None
    location: int | None = None
    item: int | None = None
    as_of: str | None = None

    @property
    def has_range(self) -> bool:
        return bool(self.start) and bool(self.end)

    def as_of_col(self) -> Column:
        return F.lit(self.as_of).cast("date") if self.as_of else F.current_date()


def active_dataset(datasets: DataFrame) -> DataFrame:
    """A1: newest active dataset by import time (1 row at most)."""
    return (
        datasets.filter(F.col("is_active"))
        .orderBy(F.col("imported_at").desc(), F.col("dataset_id").desc())
        .limit(1)
        .select("dataset_id")
    )


def active_dataset_fallback(datasets: DataFrame, raw: DataFrame) -> DataFrame:
    """A2: the active dataset, or if none is active, the one with the newest event time."""
    act = active_dataset(datasets).withColumn("priority", F.lit(0))
    newest = (
        raw.filter(~is_blank("dataset_id"))
        .groupBy("dataset_id")
        .agg(F.max("event_ts").alias("last_ts"))
        .orderBy(F.col("last_ts").desc_nulls_last(), F.col("dataset_id"))
        .limit(1)
        .select("dataset_id", F.lit(1).alias("priority"))
    )
    return act.unionByName(newest).orderBy("priority").limit(1).select("dataset_id")


def in_active_dataset(raw: DataFrame, datasets: DataFrame) -> DataFrame:
    """Keep the rows of the active dataset: a semi join against a 1-row side (limit 1 bounds it)."""
    return raw.join(F.broadcast(active_dataset(datasets)), "dataset_id", "left_semi")


def default_range(events: DataFrame, scope: Scope | None = None) -> DataFrame:
    """A3: if start or end is missing, both become the min/max event day."""
    scope = scope or Scope()
    if scope.has_range:
        return literal_rows(events.sparkSession, [(scope.start, scope.end)], ["start", "end"]).select(
            F.to_date("start").alias("start"), F.to_date("end").alias("end")
        )
    day = F.to_date("event_ts")
    return events.agg(F.min(day).alias("start"), F.max(day).alias("end"))


def resolve_scope(events: DataFrame, scope: Scope | None = None) -> Scope:
    """Driver-side resolution of the default range (one tiny aggregate row)."""
    scope = scope or Scope()
    if scope.has_range:
        return scope
    row = default_range(events, scope).first()
    if row is None or row["start"] is None:
        return replace(scope, start=None, end=None)
    return replace(scope, start=row["start"].isoformat(), end=row["end"].isoformat())


def day_between(col: Column, scope: Scope) -> Column:
    return col.between(F.lit(scope.start).cast("date"), F.lit(scope.end).cast("date"))


def ts_in_days(ts: Column, scope: Scope) -> Column:
    """``substr(ts, 1, 10) BETWEEN start AND end`` as a plain range on the timestamp, so the
    predicate reaches the parquet reader (row-group min/max pruning)."""
    lo = F.lit(scope.start).cast("date").cast("timestamp_ntz")
    hi = F.date_add(F.lit(scope.end).cast("date"), 1).cast("timestamp_ntz")
    return (ts >= lo) & (ts < hi)


def filter_events(events: DataFrame, scope: Scope) -> DataFrame:
    """A4: inclusive day range + location + item on the signed event table."""
    cond = F.lit(True)
    if scope.has_range:
        cond = cond & ts_in_days(F.col("event_ts"), scope)
    if scope.location:
        cond = cond & (F.col("location_id") == scope.location)
    if scope.item:
        cond = cond & (F.col("item_id") == scope.item)
    return events.filter(cond)


def filter_items(items: DataFrame, scope: Scope) -> DataFrame:
    """A5: location + item on the item master."""
    cond = F.lit(True)
    if scope.location:
        cond = cond & (F.col("location_id") == scope.location)
    if scope.item:
        cond = cond & (F.col("item_id") == scope.item)
    return items.filter(cond)


def filter_raw(raw: DataFrame, scope: Scope, day_col: str | None = None) -> DataFrame:
    """Normalized location code + item (+ optional day range on ``day_col``) on the fact."""
    cond = F.lit(True)
    if day_col and scope.has_range:
        cond = cond & (day_between(F.col(day_col), scope) if day_col == "date" else ts_in_days(F.col(day_col), scope))
    if scope.location:
        cond = cond & (norm_location("location_id") == scope.location)
    if scope.item:
        cond = cond & (F.col("item_id").cast("bigint") == scope.item)
    return raw.filter(cond)


def filter_options_items(raw: DataFrame, datasets: DataFrame) -> DataFrame:
    """Name on the newest row per item id in the active dataset (one aggregate, no sort)."""
    r = in_active_dataset(raw, datasets).filter(~is_blank("item_id"))
    newest = F.max_by(F.trim(F.coalesce("item_name", F.lit(""))), F.struct("date", "event_ts", "ingest_seq"))
    return r.groupBy(F.col("item_id").cast("bigint").alias("id")).agg(newest.alias("name"))


def filter_options_locations(locations: DataFrame) -> DataFrame:
    """A10: locations sorted by name."""
    return locations.select(F.col("location_id").alias("id"), F.col("location_name").alias("name")).orderBy("name", "id")


def filter_options_range(events: DataFrame) -> DataFrame:
    """min/max event day."""
    day = F.to_date("event_ts")
    return events.agg(F.min(day).alias("min_end"), F.max(day).alias("max_end"))


def filter_options_range_active(fact: DataFrame, datasets: DataFrame) -> DataFrame:
    """A11 on the fact: first and last business day of the active dataset (NULLs if it has no rows)."""
    rows = fact.where(F.col("dataset_id") == active_dataset(datasets).scalar())
    return rows.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def meta_items(raw: DataFrame, datasets: DataFrame) -> DataFrame:
    """Distinct (id, trimmed name), non-blank, active dataset."""
    r = in_active_dataset(raw, datasets).filter(~is_blank("item_name") & F.col("item_id").isNotNull())
    return r.select(F.col("item_id").cast("bigint").alias("id"), F.trim("item_name").alias("name")).distinct()


def forecast_items(raw: DataFrame, datasets: DataFrame, item_cfg: DataFrame, cutoffs: DataFrame | None = None) -> DataFrame:
    """Configured items with issues_qty > 0 in the active dataset, before their cutoff."""
    r = in_active_dataset(raw, datasets).filter(F.coalesce("issues_qty", F.lit(0)) > 0)
    r = r.join(item_cfg.select(F.col("item_id").alias("_cfg_item")), F.col("item_id") == F.col("_cfg_item"), "left_semi")
    if cutoffs is not None:
        c = cutoffs.select(F.col("item_id").alias("_cut_item"), F.col("cutoff_date"))
        r = r.join(c, F.col("item_id") == F.col("_cut_item"), "left").filter(
            F.col("cutoff_date").isNull() | (F.col("date") < F.col("cutoff_date"))
        )
    return r.filter(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("bigint").alias("id"), F.trim(F.coalesce("item_name", F.lit(""))).alias("name")
    ).distinct()


def adhoc_scoped_sql(spark: SparkSession, sql: str, raw: DataFrame, datasets: DataFrame,
                     view_name: str = "raw_inventory_v", limit: int | None = None) -> DataFrame:
    """Run a user SELECT where the fact view resolves to the active dataset only.

    The view is a temp view of the pre-filtered DataFrame, so Catalyst pushes the dataset
    filter under whatever the user wrote. ``limit`` caps the result only where a caller asks
    for it; a LIMIT the user wrote is never cut.
    """
    in_active_dataset(raw, datasets).createOrReplaceTempView(view_name)
    out = spark.sql(sql)
    return out if limit is None else out.limit(limit)


def period_days(start: str | None, end: str | None) -> int:
    """Inclusive day count; invalid or reversed -> 0."""
    try:
        s = dt.date.fromisoformat(str(start)[:10])
        e = dt.date.fromisoformat(str(end)[:10])
    except (TypeError, ValueError):
        return 0
    n = (e - s).days + 1
    return n if n > 0 else 0


__all__ = [
    "Scope", "active_dataset", "active_dataset_fallback", "in_active_dataset", "default_range",
    "resolve_scope", "filter_events", "filter_items", "filter_raw", "filter_options_items",
    "filter_options_locations", "filter_options_range", "meta_items", "forecast_items",
    "adhoc_scoped_sql", "period_days", "day_between", "Window",
]
