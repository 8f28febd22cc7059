"""Per-run model tables for the registered queries: (spark, sf_dir) -> lazy DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from stockroom.operators.scope import Scope, resolve_scope
from stockroom.sources import driver_tables as dt

# fixed 'today' for expiry horizons, so results are reproducible
AS_OF = "1998-06-01"


class Model:
    """Lazily built model tables over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def driver(self, name: str) -> DataFrame:
        return dt.table(self.spark, self.sf_dir, name)

    @cached_property
    def n_facts(self) -> int:
        """Rows of the table that the fact is made of, from the files' footers: what tasks are sized by."""
        return self.driver("lineitem").count()

    @cached_property
    def raw(self) -> DataFrame:
        return dt.raw_inventory(self.spark, self.sf_dir)

    @cached_property
    def datasets(self) -> DataFrame:
        return dt.datasets(self.spark, self.sf_dir)

    @cached_property
    def locations(self) -> DataFrame:
        return dt.locations(self.spark, self.sf_dir)

    @cached_property
    def items(self) -> DataFrame:
        return dt.items(self.spark, self.sf_dir)

    @cached_property
    def categories(self) -> DataFrame:
        return dt.categories(self.spark, self.sf_dir)

    @cached_property
    def events(self) -> DataFrame:
        return dt.inventory_events(self.spark, self.sf_dir)

    @cached_property
    def lots(self) -> DataFrame:
        return dt.item_lots(self.spark, self.sf_dir)

    @cached_property
    def risk(self) -> DataFrame:
        return dt.raw_risk(self.spark, self.sf_dir)

    @cached_property
    def vendor_kpis(self) -> DataFrame:
        return dt.vendor_kpis(self.spark, self.sf_dir)

    @cached_property
    def order_sheet(self) -> DataFrame:
        return dt.order_sheet(self.spark, self.sf_dir)

    @cached_property
    def labor(self) -> DataFrame:
        return dt.labor_metrics(self.spark, self.sf_dir)

    @cached_property
    def staff(self) -> DataFrame:
        return dt.staff_scores(self.spark, self.sf_dir)

    @cached_property
    def space(self) -> DataFrame:
        return dt.space_metrics(self.spark, self.sf_dir)

    @cached_property
    def scans(self) -> DataFrame:
        return dt.scan_feed(self.spark, self.sf_dir)

    def scope(self, **kw) -> Scope:
        """The request scope with the default day range resolved from the event table
        (resolved once per query: every operator of one request sees the same range)."""
        kw.setdefault("as_of", AS_OF)
        key = tuple(sorted(kw.items()))
        cache = self.__dict__.setdefault("_scopes", {})
        if key not in cache:
            cache[key] = resolve_scope(self.events, Scope(**kw))
        return cache[key]
