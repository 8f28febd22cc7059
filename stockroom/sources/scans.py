"""Scan-feed ingestion as DataFrame transforms (batch; reused per micro-batch by T1-T5).

Validation is one ``coalesce(when(rule_1, msg_1), when(rule_2, msg_2), ...)`` column, so
the first failing rule wins exactly as in a sequential row check, with no Python per row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# fixed values: header names, event types and error messages of the scan sheet
REQUIRED_HEADERS = [
    "scan_id", "event_time_stamps", "date", "dataset_id", "item_id", "item_name", "location_id", "event_type",
    "quantity",
]
OPTIONAL_HEADERS = ["lot_number", "lot_expiry", "reason"]
ALLOWED_EVENT_TYPES = ["ADJUSTMENT_WASTE", "ISSUE", "RECEIPT"]
EVENT_TYPE_MESSAGE = "event_type must be one of ['ADJUSTMENT_WASTE', 'ISSUE', 'RECEIPT']"

SKIP = "__other_dataset__"


def scan_header_check(df: DataFrame) -> DataFrame:
    """trim/lower-case the header names; raise listing the missing required ones."""
    renamed = df.toDF(*[c.strip().lower() for c in df.columns])
    missing = [h for h in REQUIRED_HEADERS if h not in renamed.columns]
    if missing:
        raise ValueError(f"Missing required headers: {', '.join(missing)}")
    for opt in OPTIONAL_HEADERS:
        if opt not in renamed.columns:
            renamed = renamed.withColumn(opt, F.lit(None).cast("string"))
    return renamed


def _v(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _is_finite_number(s: Column) -> Column:
    d = s.try_cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))


def scan_error(active_dataset: str) -> Column:
    """First failing rule (message), ``SKIP`` for other-dataset rows, NULL when valid."""
    ts = F.regexp_replace(_v("event_time_stamps"), " ", "T")
    rules: list[tuple[Column, str]] = [
        (_v("scan_id") == "", "scan_id is required"),
        (_v("event_time_stamps") == "", "event_time_stamps is required"),
        (_v("date") == "", "date is required"),
        (_v("dataset_id") == "", "dataset_id is required"),
        (_v("dataset_id") != active_dataset, SKIP),
        (_v("item_id") == "", "item_id is required"),
        (_v("item_name") == "", "item_name is required"),
        (_v("location_id") == "", "location_id is required"),
        (_v("event_type") == "", "event_type is required"),
        (~F.upper(_v("event_type")).isin(*ALLOWED_EVENT_TYPES), EVENT_TYPE_MESSAGE),
        (_v("quantity") == "", "quantity is required"),
        (F.try_to_timestamp(ts).isNull(), "event_time_stamps must be ISO-like datetime"),
        (_scan_date().isNull(), "date must be YYYY-MM-DD"),
        (~_is_finite_number(_v("item_id")), "item_id must be numeric"),
        (~_is_finite_number(_v("quantity")), "quantity must be numeric"),
    ]
    return F.coalesce(*[F.when(cond, F.lit(msg)) for cond, msg in rules])


def _scan_date():
    """A plain date, or the day of an ISO date-time."""
    timed = F.when(_v("date").rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d"), F.try_to_timestamp(F.regexp_replace(_v("date"), " ", "T")))
    return F.coalesce(F.try_to_date(_v("date"), "yyyy-MM-dd"), F.to_date(timed))


def scan_tag(df: DataFrame, active_dataset: str) -> DataFrame:
    """The rows with their first failing rule (``_error``) and, if they lack them, empty optional columns."""
    for opt in OPTIONAL_HEADERS:
        if opt not in df.columns:
            df = df.withColumn(opt, F.lit(None).cast("string"))
    return df.withColumn("_error", scan_error(active_dataset))


def scan_validate(df: DataFrame, active_dataset: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """I2 + I3: (valid rows, quarantine rows, other-dataset rows)."""
    return scan_split(scan_tag(df, active_dataset))


def scan_split(tagged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """I3 on rows of ``scan_tag``: (valid rows, quarantine rows, other-dataset rows).

    Valid rows are typed: item_id truncated to an integer, location and event type
    upper-cased, blank optional fields NULL. Quarantine rows are ``row <n>: <error>``.
    Non-finite numbers (inf, NaN) are quarantined (the source crashes on an infinite id
    and accepts a NaN quantity).
    """
    valid = tagged.filter(F.col("_error").isNull()).select(
        _v("scan_id").alias("scan_id"),
        F.try_to_timestamp(F.regexp_replace(_v("event_time_stamps"), " ", "T")).cast("timestamp_ntz").alias("event_ts"),
        _scan_date().alias("date"),
        _v("dataset_id").alias("dataset_id"),
        _v("item_id").try_cast("double").cast("bigint").alias("item_id"),
        _v("item_name").alias("item_name"),
        F.upper(_v("location_id")).alias("location_id"),
        F.upper(_v("event_type")).alias("event_type"),
        _v("quantity").try_cast("double").alias("quantity"),
        *[F.nullif(_v(c), F.lit("")).alias(c) for c in OPTIONAL_HEADERS],
        "row_index",
    )
    bad = tagged.filter(F.col("_error").isNotNull() & (F.col("_error") != SKIP))
    quarantine = bad.select(
        "row_index",
        F.col("_error").alias("error"),
        F.concat(F.lit("row "), F.col("row_index").cast("string"), F.lit(": "), F.col("_error")).alias("message"),
    )
    skipped = tagged.filter(F.col("_error") == SKIP).select("row_index", _v("scan_id").alias("scan_id"))
    return valid, quarantine, skipped


def scan_dedupe(valid: DataFrame, ledger: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """I4: first row per scan_id (sheet order) that is not in the ledger; returns (new, duplicates).

    The in-batch cut is ``row_number() == 1`` (a map-side ``WindowGroupLimit`` pre-cut,
    so a hot scan id costs one row per map task); the ledger check is an anti join.
    """
    w = Window.partitionBy("scan_id").orderBy("row_index")
    ranked = valid.withColumn("_rn", F.row_number().over(w))
    first = ranked.filter(F.col("_rn") == 1).drop("_rn")
    new = first if ledger is None else first.join(ledger.select("scan_id").distinct(), "scan_id", "left_anti")
    # the others: later rows of an id, and first rows of ids that the ledger knows (row numbers are unique in a sheet only)
    dups = ranked.filter(F.col("_rn") > 1).drop("_rn")
    if ledger is not None:
        dups = dups.unionByName(first.join(ledger.select("scan_id").distinct(), "scan_id", "left_semi"))
    return new, dups


def scan_explode_qty(new: DataFrame) -> DataFrame:
    """RECEIPT -> receipts_qty, ISSUE -> issues_qty, else 0 / 0."""
    return new.withColumn(
        "receipts_qty", F.when(F.col("event_type") == "RECEIPT", F.col("quantity")).otherwise(F.lit(0.0))
    ).withColumn("issues_qty", F.when(F.col("event_type") == "ISSUE", F.col("quantity")).otherwise(F.lit(0.0)))


def to_fact_rows(new: DataFrame, batch_id: int) -> DataFrame:
    """Scan rows in the fact-table layout; ``ingest_seq`` = (batch, sheet row) keeps insert order."""
    return scan_explode_qty(new).select(
        "dataset_id", "date", "location_id", "item_id", "item_name", "event_ts", "event_type", "quantity",
        "receipts_qty", "issues_qty", "reason", "lot_number", "lot_expiry",
        F.struct(F.lit(batch_id).cast("bigint").alias("batch"), F.col("row_index").alias("row")).alias("ingest_seq"),
        "scan_id",
        F.lit(batch_id).cast("bigint").alias("batch_id"),
    )


def scan_append(new: DataFrame, fact_path: str, ledger_path: str, batch_id: int, synced_at: str | None = None) -> None:
    """Append fact rows and ledger ids for one batch.

    Both go to the ``batch_id=<n>`` partition with dynamic partition overwrite, so a
    replayed batch rewrites its own partition instead of appending twice.
    """
    synced_at = synced_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat()
    fact = to_fact_rows(new, batch_id)
    fact.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(fact_path)
    ledger = new.select(
        "scan_id", F.lit(synced_at).alias("ingested_at"), F.lit(batch_id).cast("bigint").alias("batch_id")
    )
    ledger.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(
        ledger_path
    )


def read_ledger(spark, ledger_path: str, before_batch: int | None = None) -> DataFrame | None:
    """Ledger ids, excluding the batch being (re)written so a replay is not deduped against itself."""
    from stockroom.session import path_exists

    if not path_exists(spark, ledger_path):
        return None
    led = spark.read.parquet(ledger_path)
    if before_batch is not None:
        led = led.filter(F.col("batch_id") < before_batch)
    return led


def ingest_metrics(batch_id: int, valid: DataFrame, new: DataFrame, quarantine: DataFrame, raw: DataFrame,
                   inserted_before: int = 0, synced_at: str | None = None) -> DataFrame:
    """One metrics row per batch: inserted, skipped duplicates, running total, last sheet row,
    parse errors, sync time. All counts come from one aggregate per input."""
    synced_at = synced_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat()
    n_new = new.agg(F.count(F.lit(1)).alias("inserted"))
    n_valid = valid.agg(F.count(F.lit(1)).alias("_valid"), F.max("row_index").alias("last_row"))
    n_bad = quarantine.agg(F.count(F.lit(1)).alias("parse_errors"))
    m = n_new.crossJoin(n_valid).crossJoin(n_bad)  # one-row aggregates
    return m.select(
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        "inserted",
        (F.col("_valid") - F.col("inserted")).alias("skipped_duplicates"),
        (F.col("inserted") + F.lit(inserted_before)).alias("inserted_total"),
        F.coalesce(F.col("last_row"), F.lit(1)).cast("bigint").alias("last_row"),
        "parse_errors",
        F.lit(synced_at).alias("synced_at"),
    )
