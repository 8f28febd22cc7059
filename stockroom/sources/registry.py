"""Ids of organizations, units, categories, item types, locations and items, handed out once and kept.

A registry is a set of stored tables. Keys that come in are reduced to one row each (with the place where they first
stand), looked up, and only new ones get a number: the present maximum plus their place among the new ones, in the order
in which the load meets them. Numbers are given by ranges of that order, not in one task, and nothing that is stored
changes but attributes that were empty.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.operators.prefix_sum import numbered
from stockroom.session import materialize

#: Attributes of the item master.
ITEM_ATTRIBUTES = ["item_description", "category_id", "item_class", "uom_id", "item_type_id"]


def _filled(c: str) -> Column:
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def dim_upsert(existing: DataFrame | None, incoming: DataFrame, key: list[str], id_col: str, seq: str = "load_seq") -> DataFrame:
    """The stored rows as they are, and the new keys numbered after the largest stored id in order of ``seq``."""
    present = F.col(key[0]).isNotNull()
    for k in key[1:]:
        present = present & F.col(k).isNotNull()
    keys = incoming.where(present).groupBy(*key).agg(F.min(seq).alias("_seq"))
    if existing is None:
        return numbered(keys, [F.col("_seq"), *map(F.col, key)], id_col).drop("_seq")
    new = keys.join(existing.select(*key), key, "left_anti")
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    new = numbered(new, [F.col("_seq"), *map(F.col, key)], id_col).crossJoin(F.broadcast(top))  # one row
    return existing.unionByName(new.withColumn(id_col, F.col(id_col) + F.col("_top")).drop("_seq", "_top"), allowMissingColumns=True)


def dim_fill_missing(existing: DataFrame | None, incoming: DataFrame, key: list[str], attrs: list[str], seq: str = "load_seq") -> DataFrame:
    """Per key, the first non-empty value of each attribute in load order. A stored value that is not empty stays,
    and so do stored columns that are not named."""
    firsts = incoming.groupBy(*key).agg(*[F.min_by(F.col(a), F.when(_filled(a).isNotNull(), F.col(seq))).alias(a) for a in attrs])
    if existing is None:
        return firsts
    new = firsts.select(*[F.col(k).alias(f"_key_{k}") for k in key], *[F.col(a).alias(f"_new_{a}") for a in attrs])
    on = F.lit(True)
    for k in key:
        on = on & (F.col(k) == F.col(f"_key_{k}"))
    j = existing.join(new, on, "full_outer")
    filled = {k: F.coalesce(F.col(k), F.col(f"_key_{k}")) for k in key}
    filled |= {a: F.when(_filled(a).isNotNull(), F.col(a)).otherwise(F.col(f"_new_{a}")) if a in existing.columns else F.col(f"_new_{a}") for a in attrs}
    names = [*existing.columns, *[a for a in attrs if a not in existing.columns]]
    return j.select(*[filled.get(c, F.col(c)).alias(c) for c in names])


@dataclass
class Registry:
    """The stored dimension tables."""

    organizations: DataFrame | None = None  # org_id, org_code
    uoms: DataFrame | None = None  # uom_id, uom_code
    categories: DataFrame | None = None  # category_id, category_name, category_description
    item_types: DataFrame | None = None  # item_type_id, item_type_name
    locations: DataFrame | None = None  # location_id, org_id, location_code
    items: DataFrame | None = None  # item_id, item_number, ITEM_ATTRIBUTES

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: df for f in fields(self) if (df := getattr(self, f.name)) is not None}


def _seq(report: int) -> Column:
    """Place of a row in the load: reports in their order, then files by name, then lines."""
    return F.struct(F.lit(report).alias("report"), "source_file", "line_no").alias("load_seq")


def _keys(reports: list[DataFrame], columns: list[str]) -> DataFrame:
    """The named columns of all reports (missing ones NULL) with their place in the load."""
    out = None
    for n, df in enumerate(reports):
        own = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns], _seq(n))
        out = own if out is None else out.unionByName(own)
    return out


def register(stored: Registry, reports: list[DataFrame]) -> Registry:
    """The registry after a load of ``reports`` (parsed rows, in load order: any of the loaders' outputs). Each table
    is written once; rows whose facts are left out register their keys as well."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        return materialize(df, f"registry-{name}")

    out = Registry()
    out.organizations = kept(dim_upsert(stored.organizations, _keys(reports, ["org_code"]), ["org_code"], "org_id"), "organizations")
    out.uoms = kept(dim_upsert(stored.uoms, _keys(reports, ["uom_code"]), ["uom_code"], "uom_id"), "uoms")
    out.item_types = kept(dim_upsert(stored.item_types, _keys(reports, ["item_type_name"]), ["item_type_name"], "item_type_id"), "item-types")
    # a category counts where it stands in a category list or beside an item
    named = _keys(reports, ["category_name", "category_description", "item_number", "org_code"]).where("org_code IS NULL OR item_number IS NOT NULL")
    named = named.where("category_name IS NOT NULL")
    categories = dim_upsert(stored.categories, named, ["category_name"], "category_id")
    if "category_description" not in categories.columns:
        categories = categories.withColumn("category_description", F.lit(None).cast("string"))
    out.categories = kept(dim_fill_missing(categories, named, ["category_name"], ["category_description"]), "categories")
    places = _keys(reports, ["org_code", "location_code"]).join(out.organizations, "org_code")
    out.locations = kept(dim_upsert(stored.locations, places, ["org_id", "location_code"], "location_id"), "locations")
    seen = _keys(reports, ["item_number", "item_description", "category_name", "item_class", "uom_code", "item_type_name"]).where("item_number IS NOT NULL")
    seen = seen.join(out.categories.select("category_name", "category_id"), "category_name", "left")
    seen = seen.join(out.uoms, "uom_code", "left").join(out.item_types, "item_type_name", "left")
    items = dim_upsert(stored.items, seen, ["item_number"], "item_id")
    for a in ITEM_ATTRIBUTES:
        if a not in items.columns:
            items = items.withColumn(a, F.lit(None).cast(seen.schema[a].dataType))
    out.items = kept(dim_fill_missing(items, seen, ["item_number"], ITEM_ATTRIBUTES), "items")
    return out


def with_ids(rows: DataFrame, registry: Registry) -> DataFrame:
    """Rows with the registry's org_id, location_id, item_id and, where they name a unit, uom_id. The tables are joined
    as Spark sees fit by their size; unknown keys give NULL."""
    out = rows.join(registry.organizations, "org_code", "left")
    out = out.join(registry.locations, ["org_id", "location_code"], "left")
    out = out.join(registry.items.select("item_number", "item_id"), "item_number", "left")
    return out.join(registry.uoms, "uom_code", "left") if "uom_code" in rows.columns else out
