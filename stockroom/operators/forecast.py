"""Monthly demand forecasting for every item at once.

The monthly frame is keyed by (item_id, month_end); every feature is a window over
``partitionBy(item_id).orderBy(month_end)``, so one item's frame is bounded by its
number of months (not by its number of fact rows: the monthly aggregate is a map-side
combined ``groupBy``). Native baselines are column expressions over per-item train
statistics; models that are fitted on an item's months are in ``forecast_run``.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockroom.operators.scope import in_active_dataset

# fixed values: the targets and features of the models, in the order in which candidates are tried and columns stand
TARGETS = ["target_nosmooth", "target_smooth"]
NATIVE_MODELS = ["naive_last", "mean_last_3", "linear_trend", "seasonal_trend"]
#: Fitted on each item's own months, in ``forecast_run``.
FITTED_MODELS = ["changepoint_trend", "ridge", "random_forest", "boosted", "boosted_l1"]
FEATURES = [
    "trend", "month", "quarter", "month_sin", "month_cos", "receipts_qty", "closing_qty", "avg_usage",
    "lag_1", "lag_2", "lag_3", "rolling_mean_2", "rolling_std_2", "rolling_min_2", "rolling_max_2",
    "rolling_mean_3", "rolling_std_3", "diff_1",
]
MIN_MONTHS = 8
HORIZON = 3
METRIC_DECIMAL = "decimal(38,12)"
#: Rows (of the fact, or of months) that a task takes when they are dealt by item.
TASK_ROWS = 1 << 18


def _by_item() -> Window:
    return Window.partitionBy("item_id").orderBy("month_end")


def by_item(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt by item over as many tasks as ``rows`` rows ask for. Months of few distinct values take little room
    in a shuffle and much in a sort, so Spark's own merging of partitions by their bytes would give a task too many."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // TASK_ROWS)), "item_id")


# ---------------------------------------------------------------- F1-F7 frame and features


def fc_load(raw: DataFrame, datasets: DataFrame, cutoffs: DataFrame | None = None,
            item_list: DataFrame | None = None) -> DataFrame:
    """active rows (NULL quantities as 0), dated and with an item, before the item's cutoff."""
    r = in_active_dataset(raw, datasets).filter(F.col("item_id").isNotNull() & F.col("date").isNotNull())
    r = r.withColumn("item_id", F.col("item_id").cast("bigint"))
    if item_list is not None:
        r = r.join(item_list.select(F.col("item_id").cast("bigint").alias("item_id")), "item_id", "left_semi")
    if cutoffs is not None:
        c = cutoffs.select(F.col("item_id").cast("bigint").alias("item_id"), "cutoff_date")
        r = r.join(c, "item_id", "left").filter(F.col("cutoff_date").isNull() | (F.col("date") < F.col("cutoff_date")))
    return r.select(
        "date",
        "item_id",
        F.coalesce("issues_qty", F.lit(0.0)).alias("issues_qty"),
        F.coalesce("receipts_qty", F.lit(0.0)).alias("receipts_qty"),
        F.coalesce("closing_qty", F.lit(0.0)).alias("closing_qty"),
        F.coalesce("avg_usage_per_day", F.lit(0.0)).alias("avg_usage"),
    )


def fc_monthly(load: DataFrame, rows: int | None = None) -> DataFrame:
    """month-end sums and means on a dense month spine from each item's first to last month. ``rows`` is about how
    many rows ``load`` has (counted if not given); the months are dealt by item, and stay so through F3-F7."""
    m = load.groupBy("item_id", F.last_day("date").alias("month_end")).agg(
        F.sum("issues_qty").alias("issues_qty"),
        F.sum("receipts_qty").alias("receipts_qty"),
        F.avg("closing_qty").alias("closing_qty"),
        F.avg("avg_usage").alias("avg_usage"),
    ).filter(F.col("month_end").isNotNull())
    m = by_item(m, load.count() if rows is None else rows)
    # each month with the empty ones that follow it
    first, after = F.trunc("month_end", "MM"), F.trunc(F.lead("month_end").over(_by_item()), "MM")
    m = m.withColumn("_until", F.coalesce(F.add_months(after, -1), first))
    values = [F.when(F.col("_gap") == 0, F.col(c)).alias(c) for c in ("issues_qty", "receipts_qty", "closing_qty", "avg_usage")]
    spine = m.select("*", F.posexplode(F.sequence(first, F.col("_until"), F.expr("INTERVAL 1 MONTH"))).alias("_gap", "_m"))
    return spine.select("item_id", F.last_day("_m").alias("month_end"), *values)


def _interpolated(col: str) -> Column:
    """Linear interpolation by position from the neighbour columns added by ``fc_gap_fill``;
    leading gaps take the first value, trailing the last, all-NULL -> 0."""
    prev, nxt = F.col(f"_prev_{col}"), F.col(f"_next_{col}")
    slope = (nxt["v"] - prev["v"]) / (nxt["p"] - prev["p"])
    return (
        F.when(F.col(col).isNotNull(), F.col(col))
        .when(prev.isNull() & nxt.isNull(), F.lit(0.0))
        .when(prev.isNull(), nxt["v"])
        .when(nxt.isNull(), prev["v"])
        .otherwise(prev["v"] + slope * (F.col("_pos") - prev["p"]))
    )


def fc_gap_fill(monthly: DataFrame) -> DataFrame:
    """sums -> 0; means interpolated linearly by position (ends held).

    The position and, per column, the last known (position, value) before and after each
    month are computed once as columns: running frames forwards and backwards (a frame
    reaching to the partition end would be re-evaluated for every row).
    """
    w = _by_item()
    back = Window.partitionBy("item_id").orderBy(F.col("month_end").desc())
    upto = Window.unboundedPreceding, Window.currentRow
    m = monthly.select("*", (F.row_number().over(w) - 1).alias("_pos"))
    neighbours = []
    for c in ("closing_qty", "avg_usage"):
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(c).alias("v")))
        neighbours.append(F.last(known, ignorenulls=True).over(w.rowsBetween(*upto)).alias(f"_prev_{c}"))
        neighbours.append(F.last(known, ignorenulls=True).over(back.rowsBetween(*upto)).alias(f"_next_{c}"))
    m = m.select("*", *neighbours)
    return m.select(
        "item_id",
        "month_end",
        F.coalesce("issues_qty", F.lit(0.0)).alias("issues_qty"),
        F.coalesce("receipts_qty", F.lit(0.0)).alias("receipts_qty"),
        _interpolated("closing_qty").alias("closing_qty"),
        _interpolated("avg_usage").alias("avg_usage"),
    )


def fc_smooth_target(filled: DataFrame) -> DataFrame:
    """raw target and its 2-month trailing mean (at least one month)."""
    w = _by_item().rowsBetween(-1, Window.currentRow)
    return filled.select(
        "*", F.col("issues_qty").alias("target_nosmooth"), F.avg("issues_qty").over(w).alias("target_smooth")
    )


def fc_calendar(df: DataFrame) -> DataFrame:
    """trend index, month, quarter and the month's position on the unit circle."""
    month = F.month("month_end")
    return df.select(
        "*",
        (F.row_number().over(_by_item()) - 1).cast("bigint").alias("trend"),
        month.alias("month"),
        F.quarter("month_end").alias("quarter"),
        F.sin(F.lit(2 * math.pi) * month / 12).alias("month_sin"),
        F.cos(F.lit(2 * math.pi) * month / 12).alias("month_cos"),
    )


def fc_frame(raw: DataFrame, datasets: DataFrame, cutoffs: DataFrame | None = None,
             item_list: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """F1-F5 in one plan: the per-item monthly base frame."""
    return fc_calendar(fc_smooth_target(fc_gap_fill(fc_monthly(fc_load(raw, datasets, cutoffs, item_list), rows))))


def fc_lags(frame: DataFrame, target: str, parity_diff: bool = False) -> DataFrame:
    """lags 1-3 (chained fill) and rolling stats over the previous rows.

    ``diff_1`` is y(t-1) - y(t-2) by default; ``parity_diff=True`` gives y(t) - y(t-1),
    which contains the target itself (a leak in the source's training features).
    """
    w = _by_item()
    y = F.col(target)
    l1, l2, l3 = F.lag(y, 1).over(w), F.lag(y, 2).over(w), F.lag(y, 3).over(w)
    lag_1 = F.coalesce(l1, y)
    p2, p3 = w.rowsBetween(-2, -1), w.rowsBetween(-3, -1)
    diff = (y - l1) if parity_diff else (l1 - l2)
    return frame.select(
        "*",
        lag_1.alias("lag_1"),
        F.coalesce(l2, lag_1).alias("lag_2"),
        F.coalesce(l3, l2, lag_1).alias("lag_3"),
        F.coalesce(F.avg(y).over(p2), lag_1).alias("rolling_mean_2"),
        F.coalesce(F.stddev_samp(y).over(p2), F.lit(0.0)).alias("rolling_std_2"),
        F.coalesce(F.min(y).over(p2), lag_1).alias("rolling_min_2"),
        F.coalesce(F.max(y).over(p2), lag_1).alias("rolling_max_2"),
        F.coalesce(F.avg(y).over(p3), lag_1).alias("rolling_mean_3"),
        F.coalesce(F.stddev_samp(y).over(p3), F.lit(0.0)).alias("rolling_std_3"),
        F.coalesce(diff, F.lit(0.0)).alias("diff_1"),
    )


def fc_split(frame: DataFrame, min_months: int = MIN_MONTHS) -> DataFrame:
    """items with at least ``min_months`` months; the last max(3, int(0.2 n)) months are the test set."""
    n = F.count(F.lit(1)).over(Window.partitionBy("item_id"))
    out = frame.select("*", n.alias("n_months")).filter(F.col("n_months") >= min_months)
    test_size = F.greatest(F.lit(3), F.floor(F.col("n_months") * 0.2).cast("bigint"))
    return out.select("*", test_size.alias("test_size"), (F.col("trend") >= F.col("n_months") - test_size).alias("is_test"))


# ---------------------------------------------------------------- F8/F9 models


def native_predictions(frame: DataFrame) -> DataFrame:
    """F8/F9 (native part): the four baselines for every test month of every item, for both targets at once.

    Statistics of the training months of an (item, target) and of its calendar months are windows without an order,
    in one sort of the frame as it is dealt by item; the mean residual of a calendar month is its mean less the trend
    at its mean position.
    """
    both = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in TARGETS])
    long = fc_split(frame).select("item_id", "month_end", "trend", "month", "n_months", "test_size", "is_test", F.inline(both))
    months, whole = Window.partitionBy("item_id", "target", "month"), Window.partitionBy("item_id", "target")
    t = F.col("trend").cast("double")
    train = lambda x: F.when(~F.col("is_test"), x)
    long = long.select("*", F.avg(train(F.col("y"))).over(months).alias("_my"), F.avg(train(t)).over(months).alias("_mt"))
    j = long.select(
        "*",
        F.max_by("y", train(F.col("month_end"))).over(whole).alias("last_y"),
        F.avg(train(F.when(F.col("trend") >= F.col("n_months") - F.col("test_size") - 3, F.col("y")))).over(whole).alias("mean_last_3"),
        F.regr_slope(train(F.col("y")), t).over(whole).alias("slope"),
        F.regr_intercept(train(F.col("y")), t).over(whole).alias("intercept"),
    ).filter("is_test")
    trend_fit = F.col("intercept") + F.col("slope") * F.col("trend")
    season = F.col("_my") - (F.col("intercept") + F.col("slope") * F.col("_mt"))
    preds = {
        "naive_last": F.col("last_y"),
        "mean_last_3": F.col("mean_last_3"),
        "linear_trend": trend_fit,
        "seasonal_trend": trend_fit + F.coalesce(season, F.lit(0.0)),
    }
    arr = F.array(*[F.struct(F.lit(k).alias("model"), v.alias("prediction")) for k, v in preds.items()])
    return j.select("item_id", "month_end", "target", F.col("y").alias("actual"), F.explode(arr).alias("p")).select(
        "item_id", "month_end", "target", F.col("p.model").alias("model"), "actual",
        # demand to a millionth of a unit: the fitted coefficients differ in the last bits
        # between summation orders, the rounded prediction does not
        F.round(F.greatest(F.col("p.prediction"), F.lit(0.0)), 6).alias("prediction"),
    )


# ---------------------------------------------------------------- F10/F11 metrics and selection


def fc_metrics(preds: DataFrame) -> DataFrame:
    """RMSE, MAE, WAPE %, R2 (constant actuals: 1 if exact else 0), score = WAPE - 10 R2.

    Two passes per (item, target, model): the mean of the actuals (a window over the
    group's test months, at most a few rows), then the sums of squares.
    """
    grp = Window.partitionBy("item_id", "target", "model")
    e = F.col("actual") - F.col("prediction")
    d = preds.withColumn("_dev", F.col("actual") - F.avg("actual").over(grp))

    def exact_sum(x: Column) -> Column:
        # per-row terms rounded to 1e-12 and summed as DECIMAL: the total does not depend
        # on the order in which partitions deliver the rows
        return F.sum(x.cast(METRIC_DECIMAL)).cast("double")

    g = d.groupBy("item_id", "target", "model").agg(
        F.count(F.lit(1)).alias("n"),
        exact_sum(e * e).alias("_sse"),
        exact_sum(F.abs(e)).alias("_sae"),
        exact_sum(F.abs("actual")).alias("_say"),
        exact_sum(F.col("_dev") * F.col("_dev")).alias("_sst"),
    )
    r2 = (
        F.when(F.col("n") < 2, F.lit(None).cast("double"))
        .when(F.col("_sst") == 0, F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(1 - F.col("_sse") / F.col("_sst"))
    )
    out = g.select(
        "item_id", "target", "model",
        F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
        (F.col("_sae") / F.col("n")).alias("mae"),
        (F.col("_sae") / (F.col("_say") + F.lit(1e-8)) * 100).alias("wape"),
        r2.alias("r2"),
    )
    return out.withColumn("score", F.col("wape") - F.col("r2") * 10)


def candidate_no(target: Column, model: Column) -> Column:
    """Evaluation order: targets in order, then models in order (first candidate wins ties)."""
    models = NATIVE_MODELS + FITTED_MODELS
    t = F.when(target == TARGETS[0], 0).otherwise(1)
    m = F.coalesce(*[F.when(model == k, F.lit(i)) for i, k in enumerate(models)], F.lit(len(models)))
    return t * 100 + m


def fc_select(metrics: DataFrame) -> DataFrame:
    """per item the lowest score; near ties (5 dp) -> lower WAPE -> higher R2 (6 dp) -> first candidate."""
    w = Window.partitionBy("item_id").orderBy(
        F.round("score", 5).asc_nulls_last(), F.round("wape", 5).asc(), F.round("r2", 6).desc_nulls_last(),
        candidate_no(F.col("target"), F.col("model")),
    )
    return metrics.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1).drop("_rk")


# ---------------------------------------------------------------- F12 recursive forecast


def fc_recursive(best: DataFrame, frame: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """F12 for the native models: refit on all months, then ``horizon`` steps where each
    prediction (>= 0, banker's-rounded) is appended to the history before the next step.

    The state is one row per item (last three target values, trend, last month, fitted
    coefficients, mean residual of the trend per calendar month) of the target that won; each step is a
    column transform on it, so the plan has ``horizon`` projections regardless of the number of items.
    """
    chosen = best.filter(F.col("target").isin(TARGETS)).select("item_id", "model", "target")
    f = frame.join(chosen, "item_id")
    f = f.withColumn("y", F.when(F.col("target") == TARGETS[0], F.col(TARGETS[0])).otherwise(F.col(TARGETS[1])))
    key = ["item_id", "model", "target"]
    whole, t = Window.partitionBy(*key), F.col("trend").cast("double")
    f = f.select(
        *key, "month", "month_end", "trend", "y", F.regr_slope("y", t).over(whole).alias("slope"), F.regr_intercept("y", t).over(whole).alias("intercept"),
        F.row_number().over(whole.orderBy(F.col("month_end").desc())).alias("_rk"),
    )
    resid = F.col("y") - (F.col("intercept") + F.col("slope") * F.col("trend"))
    same = ["slope", "intercept", "last_trend", "last_month", "_y1", "_y2", "_y3"]
    months = f.groupBy(*key, "month").agg(
        F.avg(resid).alias("season"), F.max("slope").alias("slope"), F.max("intercept").alias("intercept"),
        F.max("trend").alias("last_trend"), F.max("month_end").alias("last_month"),
        *[F.max(F.when(F.col("_rk") == k, F.col("y"))).alias(f"_y{k}") for k in (1, 2, 3)],
    )
    st = months.groupBy(*key).agg(*[F.max(c).alias(c) for c in same], F.map_from_entries(F.collect_list(F.struct("month", "season"))).alias("_season"))
    # history holders: h1 = newest; lags fall back to the newest available value
    st = st.withColumn("h1", F.col("_y1")).withColumn("h2", F.coalesce("_y2", "_y1")).withColumn("h3", F.coalesce("_y3", "_y2", "_y1"))
    for step in range(1, horizon + 1):
        month_end = F.last_day(F.add_months(F.col("last_month"), step))
        trend_fit = F.col("intercept") + F.col("slope") * (F.col("last_trend") + step)
        s = F.coalesce(F.element_at(F.col("_season"), F.month(month_end)), F.lit(0.0))
        pred = (
            F.when(F.col("model") == "naive_last", F.col("h1"))
            .when(F.col("model") == "mean_last_3", (F.col("h1") + F.col("h2") + F.col("h3")) / 3)
            .when(F.col("model") == "linear_trend", trend_fit)
            .when(F.col("model") == "seasonal_trend", trend_fit + s)
            .otherwise(F.raise_error(F.concat(F.lit("no recursive form of model "), F.coalesce("model", F.lit("null")))).cast("double"))
        )
        st = st.withColumn(f"_p{step}", F.bround(F.greatest(pred, F.lit(0.0)), 0)).withColumn(
            f"_d{step}", month_end
        )
        st = st.withColumn("h3", F.col("h2")).withColumn("h2", F.col("h1")).withColumn("h1", F.col(f"_p{step}"))
    steps = F.array(*[F.struct(F.col(f"_d{k}").alias("point_date"), F.col(f"_p{k}").alias("demand_qty"),
                               F.lit(k).alias("step")) for k in range(1, horizon + 1)])
    return st.select(*key, F.explode(steps).alias("s")).select(
        "item_id", "model", "target", "s.step", "s.point_date", "s.demand_qty"
    )


# ---------------------------------------------------------------- F13-F20 publish and read back


def fc_publish(frame: DataFrame, preds: DataFrame, best: DataFrame, future: DataFrame, dataset_id: str,
               run_day: str, created_at: str, path: str | None = None) -> DataFrame:
    """historical (monthly issues > 0), prediction (best model's test months > 0) and
    forecast (> 0) rows; written under ``run_id=<dataset>:<day>`` with dynamic partition
    overwrite, so re-running a day replaces that run only."""
    run_id = f"{dataset_id}:{run_day}"
    b = best.select("item_id", F.col("model").alias("best_model_name"), "target", "wape", "r2")
    hist = frame.join(b, "item_id").select(
        "item_id", F.col("month_end").alias("point_date"), F.lit("historical").alias("point_type"),
        F.col("issues_qty").alias("demand_qty"), "best_model_name", "wape", "r2",
    ).filter(F.col("demand_qty") > 0)
    pred = preds.join(b.withColumnRenamed("best_model_name", "model"), ["item_id", "target", "model"]).select(
        "item_id", F.col("month_end").alias("point_date"), F.lit("prediction").alias("point_type"),
        F.col("prediction").alias("demand_qty"), F.col("model").alias("best_model_name"), "wape", "r2",
    ).filter(F.col("demand_qty") > 0)
    fut = future.join(b.drop("target"), "item_id").select(
        "item_id", "point_date", F.lit("forecast").alias("point_type"), "demand_qty", "best_model_name", "wape", "r2",
    ).filter(F.col("demand_qty") > 0)
    rows = hist.unionByName(pred).unionByName(fut).select(
        F.lit(dataset_id).alias("dataset_id"), "item_id", F.lit(0).cast("bigint").alias("location_id"), "point_date",
        "point_type", "demand_qty", "best_model_name", "wape", "r2",
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"), F.lit(run_id).alias("run_id"),
    )
    if path is None:
        return rows
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    return rows.sparkSession.read.parquet(path)


def fc_latest_run(results: DataFrame, dataset_id: str) -> DataFrame:
    """newest run per item (created_at desc, run_id desc)."""
    r = results.filter((F.col("dataset_id") == dataset_id) & (F.col("location_id") == 0))
    g = r.groupBy("item_id").agg(F.max(F.struct("created_at", "run_id")).alias("_k"))
    return g.select("item_id", F.col("_k.run_id").alias("run_id"))


def fc_actuals(load: DataFrame) -> DataFrame:
    """month-end sums of positive issues (cutoff already applied by ``fc_load``)."""
    g = load.filter(F.col("issues_qty") > 0).groupBy("item_id", F.last_day("date").alias("date")).agg(
        F.sum("issues_qty").alias("actual")
    )
    return g.filter(F.col("actual") > 0)


def fc_points(results: DataFrame, latest: DataFrame, dataset_id: str) -> DataFrame:
    """F16: prediction and forecast points of each item's latest run."""
    r = results.filter((F.col("dataset_id") == dataset_id) & (F.col("location_id") == 0)).filter(
        F.col("point_type").isin("prediction", "forecast")
    )
    return r.join(latest, ["item_id", "run_id"], "left_semi").select(
        "item_id", F.col("point_date").alias("date"), F.col("point_type").alias("type"), F.col("demand_qty").alias("demand")
    )


def fc_date_info(load: DataFrame, results: DataFrame, latest: DataFrame) -> DataFrame:
    """last raw date, last month end and first forecast date per item."""
    d = load.groupBy("item_id").agg(
        F.max("date").alias("raw_data_end_date"), F.max(F.last_day("date")).alias("last_historical_month")
    )
    f = (
        results.filter(F.col("point_type") == "forecast")
        .join(latest, ["item_id", "run_id"], "left_semi")
        .groupBy("item_id")
        .agg(F.min("point_date").alias("forecast_start_date"))
    )
    return d.join(f, "item_id", "left")


def fc_run_summary(results: DataFrame, latest: DataFrame) -> DataFrame:
    """model, WAPE, R2 and generation time of each item's latest run."""
    r = results.join(latest, ["item_id", "run_id"], "left_semi")
    return r.groupBy("item_id", "run_id", "dataset_id", F.col("best_model_name").alias("model"), "wape", "r2").agg(
        F.max("created_at").alias("generated_at")
    )


def fc_chart(actuals: DataFrame, points: DataFrame) -> DataFrame:
    """actual, prediction and future per (item, date) as a full outer merge."""
    p = points.groupBy("item_id", "date").agg(
        F.max(F.when(F.col("type") == "prediction", F.col("demand"))).alias("prediction"),
        F.max(F.when(F.col("type") == "forecast", F.col("demand"))).alias("future"),
    )
    return actuals.join(p, ["item_id", "date"], "full_outer").select("item_id", "date", "actual", "prediction", "future")


def fc_chart_dense(chart: DataFrame, table_rows: int = 3) -> DataFrame:
    """every month end between an item's first and last chart date (NULL rows filled in);
    ``in_table`` marks the first ``table_rows`` future months shown as a table."""
    b = chart.groupBy("item_id").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    spine = b.select(
        "item_id", F.explode(F.sequence(F.trunc("_lo", "MM"), F.trunc("_hi", "MM"), F.expr("INTERVAL 1 MONTH"))).alias("_m")
    ).select("item_id", F.last_day("_m").alias("date"))
    dense = spine.join(chart, ["item_id", "date"], "left")
    w = Window.partitionBy("item_id").orderBy(F.when(F.col("future").isNotNull(), 0).otherwise(1), "date")
    return dense.withColumn(
        "in_table", F.col("future").isNotNull() & (F.row_number().over(w) <= table_rows)
    )


def publish_path(base: str) -> str:
    return os.path.join(base, "forecast_results")
