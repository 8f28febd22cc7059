"""ABC classification, EOQ, safety stock and reorder point for all pairs at once.

The source application answers one item x location per request; here every policy is a
DataFrame over all pairs, with the per-request inputs (ordering cost, holding rate, lead
time, service level) as columns or keyword defaults.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockroom.functions.normalize import is_blank, literal_rows
from stockroom.operators.prefix_sum import running_sum_desc
from stockroom.operators.scope import Scope, day_between, in_active_dataset, period_days
from stockroom.operators.snapshot import latest_snapshot
from stockroom.session import path_exists, scratch_path  # noqa: F401

# fixed values: service level (percent, as text) -> z score; anything else -> 1.65
Z_BY_SERVICE_LEVEL = {"90": 1.28, "95": 1.65, "97.5": 1.96, "99": 2.33}
DEFAULT_Z = 1.65
DEFAULT_HOLDING_RATE = 0.2


def _name_key(col: str = "item_name") -> Column:
    return F.lower(F.trim(F.col(col)))


# ---------------------------------------------------------------- ABC


def abc_input(raw: DataFrame, datasets: DataFrame, items: DataFrame, scope: Scope) -> DataFrame:
    """Per lower-trimmed name: lowest id, smallest name, period issues and consumption value.

    Name map and period sums come from ONE aggregate over the fact (conditional sums),
    so the fact is shuffled once; the item master is reduced to one row per name first.
    """
    r = in_active_dataset(raw, datasets).filter(~is_blank("item_name"))
    in_period = day_between(F.col("date"), scope)
    has_id = ~is_blank("item_id")
    g = r.groupBy(_name_key().alias("name_key")).agg(
        F.min(F.when(has_id, F.col("item_id").cast("bigint"))).alias("item_id"),
        F.min(F.when(has_id, F.trim("item_name"))).alias("item_name"),
        F.sum(F.when(in_period, F.coalesce("issues_qty", F.lit(0.0)))).alias("annual_qty"),
        F.sum(F.when(in_period, F.coalesce("annual_consumption_value", F.lit(0.0)).cast("decimal(38,6)"))).alias(
            "annual_value"
        ),
    ).filter(F.col("item_id").isNotNull())
    storage = items.groupBy(_name_key().alias("name_key")).agg(F.min("item_id").alias("storage_item_id"))
    j = g.join(storage, "name_key", "inner")
    return j.select(
        "item_id",
        "storage_item_id",
        "item_name",
        F.coalesce("annual_qty", F.lit(0.0)).alias("annual_qty"),
        F.coalesce("annual_value", F.lit(0).cast("decimal(28,2)")).alias("annual_value"),
    )


def abc_classify(df: DataFrame) -> DataFrame:
    """Value share, running share (value desc, item id asc) and class A <= 0.8 < B <= 0.95 < C.

    ``annual_value`` should be DECIMAL; the running sum is the two-level prefix sum.
    """
    total = df.agg(F.sum("annual_value").alias("_total"))
    ran = running_sum_desc(df, "annual_value", "item_id", "_running")
    j = ran.crossJoin(F.broadcast(total))  # one row: the global total
    t = F.col("_total").cast("double")
    share = F.when(t > 0, F.col("annual_value").cast("double") / t).otherwise(F.lit(0.0))
    cum = F.when(t > 0, F.col("_running").cast("double") / t).otherwise(F.lit(0.0))
    out = j.select(
        *[c for c in df.columns if c not in ("annual_qty", "annual_value")],
        F.round(F.col("annual_qty"), 4).alias("annual_qty"),
        F.round(F.col("annual_value").cast("double"), 4).alias("annual_value"),
        F.round(share, 6).alias("value_share_pct"),
        F.round(cum, 6).alias("cumulative_share_pct"),
        F.when(cum <= 0.8, F.lit("A")).when(cum <= 0.95, F.lit("B")).otherwise(F.lit("C")).alias("abc_class"),
    )
    return out


def abc_kpis(lines: DataFrame) -> DataFrame:
    """P5: total value, item count and class-A share of value."""
    v = F.col("annual_value").cast("decimal(28,4)")
    a = lines.agg(
        F.coalesce(F.sum(v), F.lit(0)).alias("_tv"),
        F.count(F.lit(1)).alias("total_items"),
        F.coalesce(F.sum(F.when(F.col("abc_class") == "A", v)), F.lit(0)).alias("_av"),
    )
    tv = F.col("_tv").cast("double")
    return a.select(
        tv.alias("total_annual_value"),
        "total_items",
        F.when(tv > 0, F.round(F.col("_av").cast("double") / tv, 6)).otherwise(F.lit(0.0)).alias("class_a_value_pct"),
    )


def abc_snapshot_write(lines: DataFrame, base_path: str, scope: Scope, snapshot_id: int | None = None) -> int:
    """Write the lines (keyed by master item id) under ``snapshot_id=<n>``, then the header.

    Lines first, header last: a reader only sees snapshots whose header exists, so a
    failed write leaves no visible partial snapshot. A retried write overwrites the
    same partition (dynamic partition overwrite), so it is idempotent.
    """
    spark = lines.sparkSession
    headers_path = os.path.join(base_path, "headers")
    if snapshot_id is None:
        last = spark.read.parquet(headers_path).agg(F.max("snapshot_id")).first()[0] if path_exists(spark, headers_path) else None
        snapshot_id = (last or 0) + 1
    out = lines.select(
        F.col("storage_item_id").alias("item_id"),
        F.col("annual_value").cast("double").alias("annual_value"),
        F.col("annual_qty").cast("double").alias("annual_qty"),
        "value_share_pct",
        "cumulative_share_pct",
        "abc_class",
        F.lit(snapshot_id).alias("snapshot_id"),
    )
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_id")
        .parquet(os.path.join(base_path, "lines"))
    )
    header = literal_rows(
        spark, [(int(snapshot_id), scope.as_of, scope.start, scope.end, "Generated from ISSUE events")],
        ["snapshot_id", "snapshot_date", "period_start", "period_end", "notes"],
    ).select(F.col("snapshot_id").cast("int"), *[F.col(c).cast("string") for c in
                                                  ["snapshot_date", "period_start", "period_end", "notes"]])
    header.write.mode("append").parquet(headers_path)
    return snapshot_id


def abc_snapshot_read(
    spark, base_path: str, raw: DataFrame, datasets: DataFrame, items: DataFrame, snapshot_id: int | None = None
) -> DataFrame:
    """Lines of the newest (or given) snapshot regrouped by display item, reclassified.

    Display item = lowest fact id with the same lower-trimmed name as the master item
    (the source matches names exactly here but lower-trimmed in P1; ours uses
    lower-trimmed in both)."""
    headers = spark.read.parquet(os.path.join(base_path, "headers"))
    if snapshot_id is None:
        snapshot_id = headers.agg(F.max("snapshot_id")).first()[0]
    lines = spark.read.parquet(os.path.join(base_path, "lines")).filter(F.col("snapshot_id") == snapshot_id)
    r = in_active_dataset(raw, datasets).filter(~is_blank("item_name") & ~is_blank("item_id"))
    name_map = r.groupBy(_name_key().alias("name_key")).agg(
        F.min(F.col("item_id").cast("bigint")).alias("m_item_id"), F.min(F.trim("item_name")).alias("m_item_name")
    )
    it = items.select(F.col("item_id").alias("i_item_id"), F.col("item_name").alias("i_item_name"), _name_key().alias("name_key"))
    j = lines.join(it, lines.item_id == it.i_item_id, "left").join(name_map, "name_key", "left")
    disp_id = F.coalesce("m_item_id", "item_id")
    disp_name = F.coalesce("m_item_name", "i_item_name", F.col("item_id").cast("string"))
    g = j.groupBy(disp_id.alias("item_id"), disp_name.alias("item_name")).agg(
        F.sum(F.col("annual_qty")).alias("annual_qty"),
        F.sum(F.col("annual_value").cast("decimal(38,6)")).alias("annual_value"),
    )
    return abc_classify(g)


# ---------------------------------------------------------------- EOQ / safety stock / ROP


def policy_latest_in_period(raw: DataFrame, datasets: DataFrame, scope: Scope) -> DataFrame:
    """Last row per pair inside [start, end], with the policy inputs (NULLs as 0)."""
    s = latest_snapshot(raw, datasets, scope=scope, date_filter=True)
    return s.select(
        "item_id",
        "location_id",
        F.trim("item_name").alias("item_name"),
        F.coalesce("avg_usage_per_day", F.lit(0.0)).alias("avg_usage_per_day"),
        F.coalesce("restock_lead_time", F.lit(0.0)).alias("restock_lead_time"),
        F.coalesce("min_qty", F.lit(0.0)).alias("min_qty"),
        F.coalesce("closing_qty", F.lit(0.0)).alias("closing_qty"),
        F.coalesce("unit_cost", F.lit(0.0)).alias("unit_cost"),
    )


def policy_item_match(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Lowest master id with the same lower-trimmed name and location; unmatched pairs drop."""
    m = items.groupBy(_name_key().alias("_key"), F.col("location_id").alias("_loc")).agg(
        F.min("item_id").alias("storage_item_id")
    )
    p = pairs.withColumn("_key", _name_key())
    j = p.join(m, (p._key == m._key) & (p.location_id == m._loc), "inner")
    return j.drop("_key", "_loc")


def eoq(pairs: DataFrame, ordering_cost: float | Column = 0.0, holding_rate: float | Column = DEFAULT_HOLDING_RATE) -> DataFrame:
    """Annual demand, holding cost, EOQ = sqrt(2 D S / H) (0 unless all > 0), orders, cycle."""
    s = F.lit(ordering_cost) if not isinstance(ordering_cost, Column) else ordering_cost
    rate = F.lit(holding_rate) if not isinstance(holding_rate, Column) else holding_rate
    d = F.col("avg_usage_per_day") * 365
    h = F.col("unit_cost") * F.when(rate > 0, rate).otherwise(F.lit(DEFAULT_HOLDING_RATE))
    out = pairs.withColumn("annual_demand_qty", d).withColumn("ordering_cost", s.cast("double")).withColumn(
        "holding_cost", h
    )
    D, S, H = F.col("annual_demand_qty"), F.col("ordering_cost"), F.col("holding_cost")
    q = F.when((D > 0) & (S > 0) & (H > 0), F.sqrt(2 * D * S / H)).otherwise(F.lit(0.0))
    out = out.withColumn("eoq", q)
    orders = F.when(F.col("eoq") > 0, D / F.col("eoq")).otherwise(F.lit(0.0))
    out = out.withColumn("orders_per_year", orders)
    return out.withColumn(
        "cycle_time_days", F.when(F.col("orders_per_year") > 0, 365 / F.col("orders_per_year")).otherwise(F.lit(0.0))
    )


def policy_inputs(raw: DataFrame, datasets: DataFrame, scope: Scope) -> DataFrame:
    """P6 and P9 in one pass over the fact: per pair of item and location the last row's policy inputs in [start, end]
    (NULLs as 0) and the moments of the daily demand.

    The fact is reduced to one row per pair and day first (map-side, so a pair that holds a third of all rows ships its
    days only), with the day's demand and its last row; pairs are then made of days. The dense (pair x day) frame is not
    materialized: the zero days of the period are added analytically. mean = sum / n, variance = (sum over demand days
    of (x - mean)^2 + (n - k) * mean^2) / n, with n = days in the period and k = demand days, which is the population
    variance of the zero-filled daily series.
    """
    from stockroom.functions.normalize import norm_location

    n = period_days(scope.start, scope.end)
    r = in_active_dataset(raw, datasets).filter(~is_blank("location_id") & day_between(F.col("date"), scope))
    values = ["item_name", "avg_usage_per_day", "restock_lead_time", "min_qty", "closing_qty", "unit_cost"]
    daily = r.groupBy(F.col("item_id").cast("bigint").alias("item_id"), norm_location("location_id").alias("location_id"), "date").agg(
        F.sum(F.coalesce("issues_qty", F.lit(0.0))).alias("x"),
        F.max(F.struct("event_ts", "ingest_seq", *values)).alias("_last"),
    )
    mean = F.sum("x").over(Window.partitionBy("item_id", "location_id")) / F.lit(float(n))
    dev = daily.withColumn("_mean", mean).withColumn("_d2", (F.col("x") - F.col("_mean")) ** 2)
    g = dev.groupBy("item_id", "location_id").agg(
        F.sum("x").alias("total_qty"),
        F.count(F.lit(1)).alias("demand_days"),
        F.first("_mean").alias("mean_daily_qty"),
        F.sum("_d2").alias("_ss"),
        F.max_by("_last", "date").alias("_last"),
    )
    var = (F.col("_ss") + (F.lit(n) - F.col("demand_days")) * F.col("mean_daily_qty") ** 2) / F.lit(float(n))
    return g.select(
        "item_id",
        "location_id",
        F.trim("_last.item_name").alias("item_name"),
        *[F.coalesce(f"_last.{c}", F.lit(0.0)).alias(c) for c in values[1:]],
        F.lit(n).cast("bigint").alias("days"),
        "demand_days",
        "total_qty",
        "mean_daily_qty",
        F.sqrt(F.greatest(var, F.lit(0.0))).alias("demand_std_dev"),
    )


def daily_demand_moments(raw: DataFrame, datasets: DataFrame, scope: Scope) -> DataFrame:
    """The moments of the daily demand of each pair, without materializing its zero days."""
    return policy_inputs(raw, datasets, scope).select("item_id", "location_id", "days", "demand_days", "total_qty", "mean_daily_qty", "demand_std_dev")


def daily_demand_dense(raw: DataFrame, datasets: DataFrame, scope: Scope, pairs: DataFrame) -> DataFrame:
    """P9 (explicit form): one row per pair and day of the period, zero-filled.

    Output size is pairs x days by definition; prefer ``daily_demand_moments`` when
    only the statistics are needed.
    """
    from stockroom.functions.normalize import norm_location

    start, end = F.lit(scope.start).cast("date"), F.lit(scope.end).cast("date")
    spine = pairs.select("item_id", "location_id").distinct().select(
        "item_id", "location_id", F.explode(F.sequence(start, F.greatest(start, end), F.expr("INTERVAL 1 DAY"))).alias("day")
    )
    r = in_active_dataset(raw, datasets).filter(day_between(F.col("date"), scope))
    daily = r.groupBy(
        F.col("item_id").cast("bigint").alias("item_id"), norm_location("location_id").alias("location_id"),
        F.col("date").alias("day"),
    ).agg(F.sum(F.coalesce("issues_qty", F.lit(0.0))).alias("_q"))
    return spine.join(daily, ["item_id", "location_id", "day"], "left").select(
        "item_id", "location_id", "day", F.coalesce("_q", F.lit(0.0)).alias("daily_qty")
    )


def z_value(service_level: Column) -> Column:
    """Service level text -> z (1.65 when unknown)."""
    m = F.create_map(*[x for k, v in Z_BY_SERVICE_LEVEL.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[service_level.cast("string")], F.lit(DEFAULT_Z))


def safety_stock(moments: DataFrame, lead_time: Column, service_level: Column | str = "95") -> DataFrame:
    """P10: SS = z * sigma * sqrt(max(L, 0)), sigma = population sd of the daily demand."""
    sl = F.lit(service_level) if isinstance(service_level, str) else service_level
    out = moments.withColumn("lead_time_days", lead_time.cast("double")).withColumn("service_level_z", z_value(sl))
    return out.withColumn(
        "safety_stock",
        F.col("service_level_z") * F.col("demand_std_dev") * F.sqrt(F.greatest(F.col("lead_time_days"), F.lit(0.0))),
    )


def rop(pairs: DataFrame, lead_time: Column, saved_safety: DataFrame | None = None,
        safety_stock_qty: Column | None = None) -> DataFrame:
    """ROP = usage x lead time + SS; SS given, else newest saved parameters, else 0.

    Saved parameters are looked up by the master id (``storage_item_id``) under which
    they were saved (the source looks them up by the raw id, which never matches).
    """
    out = pairs.withColumn("lead_time_days", lead_time.cast("double"))
    if safety_stock_qty is not None:
        out = out.withColumn("safety_stock_qty", safety_stock_qty.cast("double"))
    elif saved_safety is not None:
        w = Window.partitionBy("item_id", "location_id").orderBy(F.col("review_date").desc(), F.col("param_id").desc())
        newest = (
            saved_safety.withColumn("_rn", F.row_number().over(w))
            .filter("_rn = 1")
            .select(
                F.col("item_id").alias("_sid"),
                F.col("location_id").alias("_sloc"),
                (F.col("service_level_z") * F.col("demand_std_dev")
                 * F.sqrt(F.greatest(F.col("lead_time_days"), F.lit(0.0)))).alias("_saved_ss"),
            )
        )
        out = out.join(newest, (out.storage_item_id == newest._sid) & (out.location_id == newest._sloc), "left")
        out = out.withColumn("safety_stock_qty", F.coalesce("_saved_ss", F.lit(0.0))).drop("_sid", "_sloc", "_saved_ss")
    else:
        out = out.withColumn("safety_stock_qty", F.lit(0.0))
    out = out.withColumn("daily_demand_avg", F.col("avg_usage_per_day"))
    out = out.withColumn("rop", F.col("daily_demand_avg") * F.col("lead_time_days") + F.col("safety_stock_qty"))
    return out.withColumn("current_stock", F.col("closing_qty")).withColumn(
        "status", F.when(F.col("current_stock") <= F.col("rop"), F.lit("REORDER NOW")).otherwise(F.lit("Stock OK"))
    )


# fixed values: the columns that each kind of saved parameters has
LOG_COLUMNS = {
    "eoq": ["annual_demand_qty", "ordering_cost", "holding_cost", "lead_time_days"],
    "safety_stock": ["demand_std_dev", "lead_time_days", "service_level_z"],
    "rop": ["daily_demand_avg", "lead_time_days", "safety_stock_qty"],
}


def policy_log_write(params: DataFrame, path: str, kind: str, scope: Scope, holding_rate: float | None = None) -> None:
    """Append computed parameters of one kind (``LOG_COLUMNS``) with review date and period note, under the master
    id of the item. EOQ notes name the holding rate as it was asked for."""
    note = f"period={scope.start}..{scope.end}" + (f";holding_rate={holding_rate}" if kind == "eoq" else "")
    out = params.select(
        "item_id", "location_id", *LOG_COLUMNS[kind], F.lit(scope.as_of).cast("date").alias("review_date"), F.lit(note).alias("notes"),
        F.lit(kind).alias("policy"),
    )
    out.write.mode("append").partitionBy("policy").parquet(path)


def policy_log_read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The saved parameters of one kind, each with ``param_id``: later writes have larger ones."""
    rows = spark.read.parquet(os.path.join(path, f"policy={kind}"))
    return rows.withColumn("policy", F.lit(kind)).withColumn("param_id", F.unix_micros("_metadata.file_modification_time"))


def period_days_col(start: Column, end: Column) -> Column:
    """P13 as a column: inclusive day count, 0 when either side is NULL or reversed."""
    d = F.datediff(end, start) + 1
    return F.when(start.isNull() | end.isNull() | (d <= 0), F.lit(0)).otherwise(d)
