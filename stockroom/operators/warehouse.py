"""Warehouse space and labor productivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockroom.functions.normalize import js_round

# fixed value: one pallet is 1.2 m x 1.0 m x 1.5 m
PALLET_VOLUME_M3 = 1.2 * 1.0 * 1.5


def space_status(util):
    """<= 85 Healthy, <= 100 Caution, else Over Capacity; no metric -> Healthy."""
    return (
        F.when(util.isNull() | (util <= 85), F.lit("Healthy"))
        .when(util <= 100, F.lit("Caution"))
        .otherwise(F.lit("Over Capacity"))
    )


def latest_space(space: DataFrame, locations: DataFrame) -> DataFrame:
    """W1 + W2 + W3: newest space metric per location with name, status, remaining volume and pallets."""
    w = Window.partitionBy("location_id").orderBy(F.col("metric_date").desc())
    last = space.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    j = last.join(locations.select("location_id", "location_name"), "location_id", "left")
    cap, used = F.coalesce("total_capacity_m3", F.lit(0.0)), F.coalesce("used_capacity_m3", F.lit(0.0))
    remaining = F.greatest(cap - used, F.lit(0.0))
    rem_pallets = F.greatest(cap / PALLET_VOLUME_M3 - used / PALLET_VOLUME_M3, F.lit(0.0))
    return j.select(
        "metric_date",
        "location_id",
        F.coalesce("location_name", F.lit("Main Warehouse / Central Store")).alias("location"),
        F.col("total_capacity_m3").alias("capacity"),
        F.col("used_capacity_m3").alias("used"),
        F.col("occupancy_pct").alias("utilization_pct"),
        space_status(F.col("occupancy_pct")).alias("status"),
        remaining.alias("remaining"),
        js_round(used / PALLET_VOLUME_M3).alias("occupied_pallets"),
        js_round(rem_pallets).alias("remaining_pallets"),
    )


def labor_daily(labor: DataFrame) -> DataFrame:
    """Units, hours and units/hour per day (2 dp; 0 without hours)."""
    g = labor.groupBy(F.col("metric_date").alias("date")).agg(
        F.coalesce(F.sum(F.col("units_moved").cast("decimal(38,6)")), F.lit(0)).cast("double").alias("_u"),
        F.coalesce(F.sum("labor_hours"), F.lit(0.0)).alias("_h"),
    )
    return g.select(
        "date",
        F.round("_u", 2).alias("items"),
        F.round("_h", 2).alias("hours"),
        F.round(F.when(F.col("_h") > 0, F.col("_u") / F.col("_h")).otherwise(F.lit(0.0)), 2).alias("rate"),
    ).orderBy("date")


def labor_overall(labor: DataFrame) -> DataFrame:
    """Totals; the rate is computed from the rounded totals."""
    a = labor.agg(
        F.round(F.coalesce(F.sum(F.col("units_moved").cast("decimal(38,6)")), F.lit(0)).cast("double"), 2).alias("items"),
        F.round(F.coalesce(F.sum("labor_hours"), F.lit(0.0)), 2).alias("hours"),
    )
    return a.withColumn("rate", F.when(F.col("hours") > 0, F.round(F.col("items") / F.col("hours"), 2)).otherwise(F.lit(0.0)))


def labor_top_staff(scores: DataFrame, k: int = 10) -> DataFrame:
    """Top k staff rows by score; hours and items parsed from ``k=v`` notes (0 if absent)."""
    staff = scores.filter(F.col("grade") == "WAREHOUSE_LABOR_TMP")
    top = staff.orderBy(F.col("total_score").desc(), "supplier_name").limit(k)

    def grab(key: str):
        v = F.regexp_extract(F.coalesce("notes", F.lit("")), key + r"=([0-9.]+)", 1)
        return F.coalesce(F.nullif(v, F.lit("")).try_cast("double"), F.lit(0.0))

    return top.select(
        F.col("supplier_name").alias("employee_id"),
        F.round("total_score", 2).alias("weighted_rate"),
        grab("total_hours").alias("total_hours"),
        grab("items").alias("items_handled"),
    )
