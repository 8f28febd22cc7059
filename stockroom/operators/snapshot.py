"""The latest row per (item, location) of the active dataset.

One ``row_number`` window over the (item, location) hash partitioning. Catalyst turns the
``rn == 1`` filter into a ``WindowGroupLimit`` that runs *before* the shuffle as well, so a
hot pair that holds a third of all rows still ships at most one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockroom.functions.normalize import is_blank, location_code, norm_location
from stockroom.operators.scope import Scope, filter_raw, in_active_dataset


def latest_order() -> list[Column]:
    """Newest first: business date, then event time, then insertion order."""
    return [F.col("date").desc(), F.col("event_ts").desc(), F.col("ingest_seq").desc()]


def latest_snapshot(
    raw: DataFrame,
    datasets: DataFrame,
    scope: Scope | None = None,
    by: str = "int",
    date_filter: bool = False,
    carry_balance: bool = False,
    row_filter: Column | None = None,
) -> DataFrame:
    """Last row per pair.

    ``by='int'`` keys locations by their numeric code ('LOC07' -> 7), ``by='code'`` by
    ``UPPER(TRIM(code))``. ``date_filter`` applies the scope's day range on ``date`` before
    picking the last row (S3/S8 do, the other KPIs do not). ``carry_balance`` replaces a
    NULL closing balance (scan rows carry none) by the pair's last non-NULL balance.
    """
    scope = scope or Scope()
    r = in_active_dataset(raw, datasets).filter(~is_blank("location_id"))
    if row_filter is not None:
        r = r.filter(row_filter)
    r = filter_raw(r, scope, day_col="date" if date_filter else None)
    key = norm_location("location_id") if by == "int" else location_code("location_id")
    r = r.withColumn("location_raw", F.col("location_id")).withColumn("location_id", key).withColumn(
        "item_id", F.col("item_id").cast("bigint")
    )
    pair = Window.partitionBy("item_id", "location_id")
    snap = r.withColumn("_rn", F.row_number().over(pair.orderBy(*latest_order()))).filter(F.col("_rn") == 1).drop("_rn")
    if carry_balance:
        last_known = (
            r.filter(F.col("closing_qty").isNotNull())
            .groupBy("item_id", "location_id")
            .agg(F.max_by("closing_qty", F.struct("date", "event_ts", "ingest_seq")).alias("_carried"))
        )
        snap = (
            snap.join(last_known, ["item_id", "location_id"], "left")
            .withColumn("closing_qty", F.coalesce("closing_qty", "_carried"))
            .drop("_carried")
        )
    return snap
