"""R1-R7 risk reports and V1-V2 supplier scorecards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockroom.functions.normalize import literal_rows
from stockroom.operators.scope import in_active_dataset

# fixed values: categories shown in the category chart, in display order
SHOWN_CATEGORIES = ["Delivery", "Quality", "Financial", "Regulatory"]


def _text_or(col: str, fallback) -> F.Column:
    return F.coalesce(F.nullif(F.trim(F.col(col)), F.lit("")), fallback)


def latest_risk(raw_risk: DataFrame, datasets: DataFrame) -> DataFrame:
    """Newest assessment per risk id (ties: later assessment row wins), text fallbacks."""
    r = in_active_dataset(raw_risk, datasets)
    rid = F.col("risk_id").cast("bigint")
    w = Window.partitionBy(rid).orderBy(F.col("assessment_date").desc(), F.col("assessment_id").desc())
    last = r.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
    return last.select(
        _text_or("risk_code", rid.cast("string")).alias("risk_id"),
        _text_or("risk_title", F.lit("Unknown Risk")).alias("title"),
        _text_or("risk_category", F.lit("Uncategorized")).alias("category"),
        F.coalesce("probability_score", F.lit(0.0)).alias("probability"),
        F.coalesce("impact_score", F.lit(0.0)).alias("impact"),
        F.coalesce("estimated_cost_aed", F.lit(0.0)).alias("cost"),
    )


def risk_matrix(latest: DataFrame) -> DataFrame:
    """R2: (risk, probability, impact) points."""
    return latest.select("risk_id", "title", "probability", "impact")


def _valid_points(latest: DataFrame) -> DataFrame:
    return latest.filter(
        (F.trim("risk_id") != "") & (F.trim("title") != "") & (F.col("probability") > 0) & (F.col("impact") > 0)
    )


def risk_matrix_cells(latest: DataFrame) -> DataFrame:
    """R3 (flat form): one row per valid risk with its cell's size and label.

    A cell label is the risk id when the cell holds one risk, else '<n> risks'. Cell sizes
    are a partial aggregate (one row per distinct score pair) joined back, so no cell's
    risks are ever gathered into one task or one array.
    """
    v = _valid_points(latest)
    sizes = v.groupBy("probability", "impact").agg(F.count(F.lit(1)).alias("n_risks"))
    j = v.join(sizes, ["probability", "impact"])
    label = F.when(F.col("n_risks") == 1, F.col("risk_id")).otherwise(
        F.concat(F.col("n_risks").cast("string"), F.lit(" risks"))
    )
    return j.select("probability", "impact", label.alias("label"), "n_risks", "risk_id", "title")


def risk_matrix_cells_nested(latest: DataFrame) -> DataFrame:
    """R3 (nested form, for display of small registers): the cell's risks as a sorted array."""
    v = _valid_points(latest)
    g = v.groupBy("probability", "impact").agg(
        F.count(F.lit(1)).alias("n_risks"),
        F.sort_array(F.collect_list(F.struct("risk_id", "title", "probability", "impact"))).alias("risks"),
    )
    label = F.when(F.col("n_risks") == 1, F.col("risks")[0]["risk_id"]).otherwise(
        F.concat(F.col("n_risks").cast("string"), F.lit(" risks"))
    )
    return g.select("probability", "impact", label.alias("label"), "n_risks", "risks")


def risk_zone(cells: DataFrame) -> DataFrame:
    """High when both axes in [4, 5], Medium in [2, 4], Low in [0, 2] (checked in that order)."""
    p, i = F.col("probability"), F.col("impact")
    zone = (
        F.when(p.between(4, 5) & i.between(4, 5), F.lit("High"))
        .when(p.between(2, 4) & i.between(2, 4), F.lit("Medium"))
        .when(p.between(0, 2) & i.between(0, 2), F.lit("Low"))
        .otherwise(F.lit("Mixed"))
    )
    return cells.withColumn("zone", zone)


def risk_cost_exposure(latest: DataFrame) -> DataFrame:
    """Cost per risk, highest first."""
    return latest.select("risk_id", "title", "cost").orderBy(F.col("cost").desc(), "risk_id")


def risks_by_category(latest: DataFrame) -> DataFrame:
    """Counts for the fixed category list (0 when absent); other categories are not shown."""
    spark = latest.sparkSession
    shown = literal_rows(spark, [(k, c) for k, c in enumerate(SHOWN_CATEGORIES)], ["pos", "category"])
    counts = latest.groupBy("category").agg(F.count(F.lit(1)).alias("_n"))
    return (
        shown.join(counts, "category", "left")
        .select("pos", "category", F.coalesce("_n", F.lit(0)).cast("bigint").alias("risk_count"))
        .orderBy("pos")
        .drop("pos")
    )


def procurement_kpis(latest: DataFrame, supplier_scores: DataFrame) -> DataFrame:
    """Average supplier score, risks with p >= 4 and i >= 4, total risk cost (NULL when empty)."""
    s = supplier_scores.agg(
        (F.sum(F.col("total_score").cast("decimal(38,6)")).cast("double") / F.count("total_score")).alias("_avg")
    ).select(F.round("_avg", 6).alias("avg_supplier_score"))
    r = latest.agg(
        F.count_if((F.col("probability") >= 4) & (F.col("impact") >= 4)).alias("high_risk_count"),
        F.sum(F.col("cost").cast("decimal(38,6)")).cast("double").alias("total_risk_cost"),
    )
    return s.crossJoin(r)  # two one-row aggregates


def supplier_scores(vendor_kpis: DataFrame, datasets: DataFrame) -> DataFrame:
    """V1: stored scores per supplier; OTIF and cost score shown as percentages."""
    v = in_active_dataset(vendor_kpis, datasets)
    return v.select(
        "supplier",
        "total_score",
        F.col("quality_score").alias("quality"),
        F.col("delivery_score").alias("delivery"),
        (F.col("otif") * 100).alias("otif_pct"),
        (F.col("cost_score") * 100).alias("cost_pct"),
    )


def supplier_order_kpis(orders: DataFrame) -> DataFrame:
    """V2: per vendor on-time rate, days late, defect rate, order accuracy, OTIF and lead time."""
    on_time = F.col("actual_date") <= F.col("promised_date")
    in_full = F.col("in_full_quantity") >= F.col("ordered_quantity")
    late = F.greatest(F.datediff("actual_date", "promised_date"), F.lit(0))
    g = orders.groupBy(F.col("vendor_id").alias("vendor")).agg(
        F.avg(F.when(on_time, 1.0).otherwise(0.0)).alias("_ot"),
        F.avg(late).alias("_late"),
        F.sum("defective_units").alias("_def"),
        F.sum("receipts_qty").alias("_rec"),
        F.sum("in_full_quantity").alias("_inf"),
        F.sum("ordered_quantity").alias("_ord"),
        F.avg(F.when(on_time & in_full, 1.0).otherwise(0.0)).alias("_otif"),
        F.avg(F.datediff("actual_date", "order_date")).alias("_lead"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return g.select(
        "vendor",
        F.round(F.col("_ot") * 100, 4).alias("on_time_pct"),
        F.round("_late", 4).alias("avg_days_late"),
        F.round(ratio("_def", "_rec"), 6).alias("defect_rate"),
        F.round(ratio("_inf", "_ord"), 6).alias("order_accuracy"),
        F.round(F.col("_otif") * 100, 4).alias("otif_pct"),
        F.round("_lead", 4).alias("lead_time_avg"),
    )
