"""The scan feed and daily movements as Structured Streaming queries.

T1-T4 run the batch ingestion functions of ``stockroom.sources.scans`` inside ``foreachBatch``. Which scan ids have been
seen is a table without an end (exact: the first row of an id wins for ever), kept in buckets of the id's hash: a batch
opens the buckets of its own ids and no others. Counts are observed while the rows are written. T5 adds each batch's
sums by day to a log that is summed when read, so a row may come as late as it likes; rows that come late are counted.
All tables are ``BatchLog``s: a replayed micro-batch rewrites its own rows, and batches are folded together from time to
time. Bound the size of a batch with ``maxFilesPerTrigger`` on the source.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stockroom.sources import scans
from stockroom.streaming.batch_log import BatchLog

LEDGER = "scan_id string, ingested_at string, bucket int"
METRICS = "inserted bigint, skipped_duplicates bigint, inserted_total bigint, last_row bigint, parse_errors bigint, synced_at string"
MOVEMENT = "day date, location_id string, event_type string, qty double"
ARRIVAL = "rows bigint, late_rows bigint, high_water timestamp_ntz"
#: Folders that the ledger's ids are dealt over, and batches after which a table is folded.
BUCKETS, FOLD_EVERY = 64, 20


class ScanSink:
    """The ingestion tables under one base folder. ``fact``, ``ledger``, ``quarantine`` and ``metrics`` are the folders
    of rows that are not folded yet; read through the logs."""

    def __init__(self, base: str, buckets: int = BUCKETS, fold_every: int = FOLD_EVERY):
        self.base, self.buckets = base, buckets
        fact = "dataset_id string, date date, location_id string, item_id bigint, item_name string, event_ts timestamp_ntz, event_type string, quantity double, receipts_qty double, issues_qty double, reason string, lot_number string, lot_expiry string, ingest_seq struct<batch:bigint,row:bigint>, scan_id string"
        self.fact_log = BatchLog(os.path.join(base, "fact"), fact, every=fold_every)
        self.ledger_log = BatchLog(os.path.join(base, "ledger"), LEDGER, ("bucket",), every=fold_every)
        self.quarantine_log = BatchLog(os.path.join(base, "quarantine"), "row_index bigint, error string, message string", every=fold_every)
        self.metrics_log = BatchLog(os.path.join(base, "metrics"), METRICS + ", batch bigint", every=fold_every)
        self.fact, self.ledger, self.quarantine, self.metrics = (x.log for x in (self.fact_log, self.ledger_log, self.quarantine_log, self.metrics_log))
        self.checkpoint = os.path.join(base, "_checkpoint")

    def read_fact(self, spark: SparkSession) -> DataFrame:
        return self.fact_log.read(spark)

    def read_metrics(self, spark: SparkSession) -> DataFrame:
        return self.metrics_log.read(spark).withColumnRenamed("batch", "batch_id")


def first_scans(spark: SparkSession, valid: DataFrame, batch_id: int, sink: ScanSink) -> DataFrame:
    """The first row of each scan id that no earlier batch has had. Of the ledger only the buckets that the batch's
    ids fall to are read (at most ``buckets`` numbers come to the driver)."""
    bucket = F.pmod(F.xxhash64("scan_id"), F.lit(sink.buckets)).cast("int")
    keyed = valid.withColumn("bucket", bucket)
    own = sorted(r.bucket for r in keyed.select("bucket").distinct().collect())
    ledger = sink.ledger_log.read(spark, before=batch_id, where=f"bucket IN ({', '.join(map(str, own)) or 'NULL'})")
    return scans.scan_dedupe(keyed, ledger)[0]


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat()


def process_scan_batch(spark: SparkSession, batch: DataFrame, batch_id: int, sink: ScanSink, active_dataset: str) -> None:
    """One micro-batch: validate, keep first scans, append fact, ledger and quarantine, and a row of metrics whose
    counts are taken as the rows are written (T4); totals go on from the row of the batch before."""
    logs = (sink.fact_log, sink.ledger_log, sink.quarantine_log, sink.metrics_log)
    for log in logs:
        log.fold(spark, batch_id)
    # the rules are run once a row; what is valid and what is not reads the outcome
    rows = scans.scan_tag(scans.scan_header_check(batch), active_dataset).persist()
    good, bad, fresh = Observation(), Observation(), Observation()
    synced_at = _now()
    try:
        valid, quarantine, _skipped = scans.scan_split(rows)
        valid = valid.observe(good, F.count(F.lit(1)).alias("n"), F.max("row_index").alias("last"))
        new = first_scans(spark, valid, batch_id, sink).observe(fresh, F.count(F.lit(1)).alias("n")).persist()
        try:
            sink.fact_log.append(scans.to_fact_rows(new, batch_id).drop("batch_id"), batch_id)
            sink.ledger_log.append(new.select("scan_id", F.lit(synced_at).alias("ingested_at"), "bucket"), batch_id)
        finally:
            new.unpersist()
        sink.quarantine_log.append(quarantine.observe(bad, F.count(F.lit(1)).alias("n")), batch_id)
    finally:
        rows.unpersist()
    before = sink.metrics_log.last(spark, batch_id)
    last = before.first() if before is not None else None
    n_valid, n_new = good.get["n"], fresh.get["n"]
    row = (n_new, n_valid - n_new, n_new + (last.inserted_total if last else 0), good.get["last"] or (last.last_row if last else 1), bad.get["n"], synced_at, batch_id)
    sink.metrics_log.append(spark.createDataFrame([row], sink.metrics_log.schema), batch_id)


def scan_stream(spark: SparkSession, source: DataFrame, sink: ScanSink, active_dataset: str,
                available_now: bool = True, processing_time: str = "3 seconds") -> StreamingQuery:
    """Continuous scan ingestion (T2 exact dedupe, T3 quarantine, T4 metrics inside)."""
    w = source.writeStream.foreachBatch(
        lambda df, bid: process_scan_batch(spark, df, bid, sink, active_dataset)
    ).option("checkpointLocation", sink.checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


class MovementSink:
    """T5's tables: sums by day, location and type that every batch adds to, and what each batch brought."""

    def __init__(self, base: str, fold_every: int = FOLD_EVERY):
        def summed(df: DataFrame) -> DataFrame:
            return df.groupBy("day", "location_id", "event_type").agg(F.sum("qty").alias("qty"))

        self.daily = BatchLog(os.path.join(base, "daily"), MOVEMENT, combine=summed, every=fold_every)
        self.arrivals = BatchLog(os.path.join(base, "arrivals"), ARRIVAL + ", batch bigint", every=fold_every)
        self.checkpoint = os.path.join(base, "_checkpoint")


def process_movement_batch(spark: SparkSession, batch: DataFrame, batch_id: int, sink: MovementSink, delay: str) -> None:
    """Add one batch's sums; count the rows that are older than ``delay`` before the newest event of earlier batches."""
    for log in (sink.daily, sink.arrivals):
        log.fold(spark, batch_id)
    before = sink.arrivals.last(spark, batch_id)
    last = before.first() if before is not None else None
    high_water = F.lit(last.high_water if last else None).cast("timestamp_ntz")
    event_ts = F.col("event_ts").cast("timestamp_ntz")
    late = F.coalesce(event_ts < high_water - F.expr(f"INTERVAL {delay}"), F.lit(False))
    seen = Observation()
    watched = batch.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(late).alias("late"), F.max(event_ts).alias("newest"))
    sums = watched.groupBy(F.to_date("event_ts").alias("day"), "location_id", "event_type").agg(F.sum("quantity").cast("double").alias("qty"))
    sink.daily.append(sums, batch_id)
    newest = max((x for x in (seen.get["newest"], last and last.high_water) if x is not None), default=None)
    sink.arrivals.append(spark.createDataFrame([(seen.get["n"], seen.get["late"], newest, batch_id)], sink.arrivals.schema), batch_id)


def run_movement_daily(spark: SparkSession, movements: DataFrame, sink: MovementSink, delay: str = "2 days",
                       available_now: bool = True) -> StreamingQuery:
    """T5: running daily quantity per (location, event type); no row is too late to count."""
    w = movements.writeStream.foreachBatch(lambda df, bid: process_movement_batch(spark, df, bid, sink, delay)).option("checkpointLocation", sink.checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="3 seconds")
    return w.start()
