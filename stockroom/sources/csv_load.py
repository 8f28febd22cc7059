"""CSV report loading (preamble-aware) and the rows of facts and dimensions that reports hold.

Input files are read as lines (``read_lines``): ``source_file``, ``line_no`` (increasing within a file) and the text.
A header is found per file as the first line holding all required column names; the lines after it are joined into
records (a quoted cell may hold line breaks) and parsed with ``from_csv``. Ids of organizations, locations, items and
so on are handed out by ``sources.registry``; the functions here give natural keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockroom.functions.normalize import parse_date_multi, parse_datetime_multi, parse_number
from stockroom.session import materialize

UNKNOWN_ORG = "UNKNOWN"

# fixed values: required header names of the report files
CLOSING_BALANCE_COLUMNS = [
    "Inventory Organization Code", "Subinventory Name", "Item Name", "Unit Cost", "Costed Onhand Quantity",
    "Costed Onhand Amount", "End Date", "Start Date",
]
OPENING_RECEIPTS_ISSUES_COLUMNS = [
    "Valuation Unit", "Category", "Item", "Description", "UOM", "Unit Cost", "Opening Quantity", "Receipts",
    "Issues", "Closing Quantity", "Inventory Value",
]
MIN_MAX_COLUMNS = [
    "ORGANIZATION_CODE", "DESTINATION", "ITEM_NUMBER", "MINMAX_QUANTITY_UOM", "MIN_MINMAX_QUANTITY",
    "MAX_MINMAX_QUANTITY", "INVENTORY_PLANNING_CODE", "SOURCE_SUBINVENTORY", "CREATION_DATE", "LAST_UPDATE_DATE",
]
CONSUMPTION_COLUMNS = [
    "ORGANIZATION_CODE", "Location", "ITEM_NUMBER", "CATEGORY", "ITEM_CLASS", "PRIMARY_UOM_CODE", "UNIT_COST",
    "QUANTITY", "COST", "ABCCLASS",
]
EXPIRY_COLUMNS = [
    "Source", "Txn Date", "Item", "Location", "Quantity", "UOM", "Unit Cost", "Value", "Reason", "Category",
    "Lot Number", "Lot Expiry Date",
]


#: Two quotes inside a quoted cell are one; a cell may hold line breaks.
CSV_OPTIONS = {"mode": "PERMISSIVE", "multiLine": "true", "escape": '"'}
#: Bits of a line number that count within one split of a file.
SPLIT_BITS = 33
#: Bits of a line number that count within a chunk: 4096 lines, what Spark's windows hold as plain rows.
CHUNK_BITS = 12


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of CSV files with their file and an increasing position within the file.

    Splits of one file are read in offset order, so ``monotonically_increasing_id``
    increases with the line position inside each file (it is not a dense count); its
    upper bits tell the splits apart.
    """
    t = spark.read.text(path)
    return t.select(
        F.col("_metadata.file_path").alias("source_file"),
        F.monotonically_increasing_id().alias("line_no"),
        F.regexp_replace("value", "^﻿", "").alias("value"),
    )


def _cells(value: Column) -> Column:
    return F.transform(F.split(value, ","), lambda c: F.trim(c))


def header_lines(lines: DataFrame, required: list[str]) -> DataFrame:
    """I8 (first half): per file, the first line whose comma-split cells contain every required name."""
    cells = _cells(F.col("value"))
    has_all = F.lit(True)
    for col in required:  # few lines are worth splitting
        has_all = has_all & F.contains(F.col("value"), F.lit(col))
    for col in required:
        has_all = has_all & F.array_contains(cells, F.lit(col))
    return (
        lines.filter(has_all)
        .groupBy("source_file")
        .agg(F.min_by("value", "line_no").alias("header"), F.min("line_no").alias("header_line"))
    )


def _opens(text: Column) -> Column:
    """Whether a quoted cell is open at the end of a text that begins outside of one. A quote opens a cell only at its
    start; two quotes inside a quoted cell are one that does not end it."""
    closed = F.regexp_replace(text, '(^|,)"[^"]*+(?:""[^"]*+)*+"', "$1x")
    return closed.rlike('(^|,)"').cast("int")


def records(body: DataFrame) -> DataFrame:
    """Join lines into records: a line break inside a quoted cell does not end one. Columns as ``body`` (source_file,
    line_no, value, others of the record's first line); line breaks are kept as line feeds.

    Each line maps "inside a quoted cell or not" at its start to the same at its end. Lines without a quote change
    nothing; most others end outside whatever came before (they *set* the state), and the rest turn it round. So the
    state before a line is the last one set, turned as often as lines since then do. Files are cut into chunks of
    consecutive lines. Running windows inside a chunk give its lines for both states that it may start in, and are
    written once; a row for each chunk then says which of the two holds. So no window holds more than a chunk. Only
    lines of records that span several are brought together, and only those. In a file none of whose lines opens a cell
    that it leaves open, each line is a record.
    """
    opened = F.max(F.when(F.contains("value", F.lit('"')), _opens(F.col("value"))).otherwise(0)) > 0
    files = materialize(body.groupBy("source_file").agg(opened.alias("_spans")), "record-files")
    kinds = {r[0] for r in files.select("_spans").distinct().collect()}
    if True not in kinds:
        return body
    if False in kinds:
        plain, spanning = (body.join(files.where(F.col("_spans") == k).select("source_file"), "source_file", "left_semi") for k in (False, True))
        return plain.unionByName(_spanning_records(spanning))
    return _spanning_records(body)


def _spanning_records(body: DataFrame) -> DataFrame:
    """``records`` by the states of lines."""
    rest = F.regexp_replace("value", '^[^"]*+(?:""[^"]*+)*+"[^,]*+', "")
    inside = F.when(F.col("value").rlike('^[^"]*+(?:""[^"]*+)*+"'), _opens(rest)).otherwise(F.lit(1))
    b = body.withColumn("_chunk", F.shiftright("line_no", CHUNK_BITS)).withColumn("_f0", _opens(F.col("value"))).withColumn("_f1", inside)
    turn = (F.col("_f0") > F.col("_f1")).cast("int")
    within = Window.partitionBy("source_file", "_chunk").orderBy("line_no")
    before, upto = within.rowsBetween(Window.unboundedPreceding, -1), within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.withColumn("_turns", F.sum(turn).over(upto))
    # the last set state, less the turns up to it, so that adding turns gives the state
    b = b.withColumn("_mark", F.when(F.col("_f0") == F.col("_f1"), F.col("_f0") - F.col("_turns")))
    b = b.withColumn("_before", F.last("_mark", ignorenulls=True).over(before))

    def is_open(start) -> Column:
        return F.pmod(F.coalesce("_before", start) + F.col("_turns") - turn, F.lit(2))

    for k in (0, 1):
        b = b.withColumn(f"_first{k}", F.last(F.when(is_open(F.lit(k)) == 0, F.col("line_no")), ignorenulls=True).over(upto))
    b = materialize(b, "record-lines")
    chunks = b.groupBy("source_file", "_chunk").agg(
        F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("line_no"))).alias("_mark"), F.max("_turns").alias("_all"),
        F.max("_first0").alias("_last0"), F.max("_first1").alias("_last1"),
    )
    earlier = Window.partitionBy("source_file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_base", F.coalesce(F.sum("_all").over(earlier), F.lit(0)))
    start = F.coalesce(F.last(F.col("_mark") - F.col("_base"), ignorenulls=True).over(earlier), F.lit(0)) + F.col("_base")
    chunks = chunks.withColumn("_start", F.pmod(start, F.lit(2)))
    last = F.when(F.col("_start") == 0, F.col("_last0")).otherwise(F.col("_last1"))
    chunks = chunks.withColumn("_carried", F.last(last, ignorenulls=True).over(earlier)).select("source_file", "_chunk", "_start", "_carried")
    b = b.join(materialize(chunks, "record-chunks"), ["source_file", "_chunk"]).withColumn("_open", is_open(F.col("_start")))
    b = b.withColumn("_first", F.coalesce(F.when(F.col("_start") == 0, F.col("_first0")).otherwise(F.col("_first1")), F.col("_carried")))
    # a record goes on if the next line starts inside; the last line of a chunk asks its own end state
    ends_open = F.when(F.col("_open") == 0, F.col("_f0")).otherwise(F.col("_f1"))
    whole = b.filter((F.col("_open") == 0) & (ends_open == 0)).select(*body.columns)
    parts = b.filter((F.col("_open") == 1) | (ends_open == 1))
    row = F.struct("line_no", "value", *[F.col(c).alias(f"_v{i}") for i, c in enumerate(body.columns)])
    joined = parts.groupBy("source_file", "_first").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    text = F.concat_ws("\n", F.col("_rows.value"))
    first = [text.alias("value") if c == "value" else F.col("_rows")[0][f"_v{i}"].alias(c) for i, c in enumerate(body.columns)]
    return whole.unionByName(joined.select(*first))


def csv_with_preamble(lines: DataFrame, required: list[str], optional: list[str] | None = None) -> DataFrame:
    """I8: records after each file's header line as string columns: the ``required`` ones and, where a file has them,
    the ``optional`` ones. Columns are found by name in each file's own header, however many headers there are; of a
    name that stands twice the last column counts. Raises if no file has a header."""
    names = [*required, *(optional or [])]
    cells = _cells(F.col("header"))

    def place(name: str) -> Column:
        back = F.array_position(F.reverse(cells), F.lit(name))
        return F.when(back > 0, F.size(cells) - back.cast("int"))

    # where each column stands is found once a file
    heads = header_lines(lines, required).withColumn("_width", F.size(cells)).withColumn("_at", F.array(*map(place, names)))
    heads = materialize(heads, "report-heads")
    width = heads.agg(F.max("_width")).first()[0]
    if width is None:
        raise ValueError(f"Header not found: {required}")
    body = lines.join(heads.select("source_file", "header_line", "_at"), "source_file").filter(F.col("line_no") > F.col("header_line"))
    body = records(body.drop("header_line")).filter(F.trim("value") != "")
    schema = ", ".join(f"_c{i} string" for i in range(width))
    rec = F.from_csv(F.col("value"), schema, CSV_OPTIONS)
    # a step of its own, so that what parses the columns is not compiled into one method too long for the JIT
    cells = F.transform(F.array(*[F.col(f"_rec._c{i}") for i in range(width)]), lambda c: F.nullif(F.trim(c), F.lit("")))
    read = body.withColumn("_rec", rec).withColumn("_cells", cells)
    return read.select("source_file", "line_no", *[F.get("_cells", F.get("_at", F.lit(i))).alias(c) for i, c in enumerate(names)])


def preamble_period(lines: DataFrame) -> DataFrame:
    """Per file, 'Period Start' / 'Period End' = last comma token of the first such line."""
    last_tok = parse_date_multi(F.element_at(F.split(F.col("value"), ","), -1))

    def first_with(text: str) -> Column:
        return F.min_by(F.when(F.col("value").contains(text), last_tok), F.when(F.col("value").contains(text), F.col("line_no")))

    return lines.groupBy("source_file").agg(
        first_with("Period Start").alias("period_start"), first_with("Period End").alias("period_end")
    )


def org_code(col: Column) -> Column:
    """Blank organization code -> 'UNKNOWN'."""
    return F.coalesce(F.nullif(F.trim(col), F.lit("")), F.lit(UNKNOWN_ORG))


def load_categories(lines: DataFrame) -> DataFrame:
    """Category rows (name, description)."""
    rows = csv_with_preamble(lines, ["Category Name"], ["Category Description"])
    return rows.select(
        F.col("Category Name").alias("category_name"), F.col("Category Description").alias("category_description"), "source_file", "line_no",
    ).filter(F.col("category_name").isNotNull())


def load_item_types(lines: DataFrame) -> DataFrame:
    """First column of every line after the first one of its file, non-blank."""
    first_line = lines.groupBy("source_file").agg(F.min("line_no").alias("_h"))
    body = lines.join(first_line, "source_file").filter(F.col("line_no") > F.col("_h")).drop("_h")
    first = F.from_csv(F.col("value"), "_c0 string", CSV_OPTIONS)["_c0"]
    rows = records(body).select(F.trim(first).alias("item_type_name"), "source_file", "line_no")
    return rows.filter(F.col("item_type_name") != "")


def _last_write_wins(df: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in seq])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


BALANCE_KEY = ["period_start", "period_end", "org_code", "location_code", "item_number"]


def load_closing_balance(lines: DataFrame) -> DataFrame:
    """I16: rows of period balances (quantities that the report does not have are NULL); ``latest_balances`` keeps the
    last of each key."""
    r = csv_with_preamble(lines, CLOSING_BALANCE_COLUMNS)
    b = r.select(
        parse_date_multi("Start Date").alias("period_start"),
        parse_date_multi("End Date").alias("period_end"),
        org_code(F.col("Inventory Organization Code")).alias("org_code"),
        F.col("Subinventory Name").alias("location_code"),
        F.col("Item Name").alias("item_number"),
        F.lit(None).cast("double").alias("opening_qty"),
        F.lit(None).cast("double").alias("receipts_qty"),
        F.lit(None).cast("double").alias("issues_qty"),
        parse_number("Costed Onhand Quantity").alias("closing_qty"),
        parse_number("Costed Onhand Amount").alias("inventory_value"),
        parse_number("Unit Cost").alias("unit_cost"),
        "source_file", "line_no",
    )
    return b


def has_balance_key() -> Column:
    """Rows without a period, item or location give no balance (their keys are registered all the same)."""
    known = [F.col(c).isNotNull() for c in ("period_start", "period_end", "item_number", "location_code")]
    return known[0] & known[1] & known[2] & known[3]


def latest_balances(rows: DataFrame) -> DataFrame:
    """The last row per (period, org, location, item) of the file order."""
    return _last_write_wins(rows.filter(has_balance_key()), BALANCE_KEY, ["source_file", "line_no"])


def load_opening_receipts_issues(lines: DataFrame, org: str) -> DataFrame:
    """Rows of balances with opening, receipts, issues and closing; the period comes from the file's preamble, the
    organization is fixed for the file."""
    r = csv_with_preamble(lines, OPENING_RECEIPTS_ISSUES_COLUMNS)
    per = preamble_period(lines)
    b = r.join(per, "source_file", "left").select(
        "period_start", "period_end",
        F.lit(org).alias("org_code"),
        F.col("Valuation Unit").alias("location_code"),
        F.col("Item").alias("item_number"),
        F.col("Category").alias("category_name"),
        F.col("Description").alias("item_description"),
        F.col("UOM").alias("uom_code"),
        parse_number("Opening Quantity").alias("opening_qty"),
        parse_number("Receipts").alias("receipts_qty"),
        parse_number("Issues").alias("issues_qty"),
        parse_number("Closing Quantity").alias("closing_qty"),
        parse_number("Inventory Value").alias("inventory_value"),
        parse_number("Unit Cost").alias("unit_cost"),
        "source_file", "line_no",
    )
    return b


def unpivot_movements(rows: DataFrame) -> DataFrame:
    """Every parsed row (also one whose balance a later row replaces) -> OPENING (at period start), RECEIPT and
    ISSUE (at period end) events for the quantities that are non-NULL and non-zero; marked as aggregates, without a
    total cost."""
    u = rows.filter(has_balance_key()).select(
        "org_code", "location_code", "item_number", "uom_code", "unit_cost", "period_start", "period_end", "source_file", "line_no",
        F.expr("stack(3, 'OPENING', opening_qty, 'RECEIPT', receipts_qty, 'ISSUE', issues_qty) AS (event_type, quantity)"),
    )
    u = u.filter(F.col("quantity").isNotNull() & (F.col("quantity") != 0))
    ts = F.when(F.col("event_type") == "OPENING", F.col("period_start")).otherwise(F.col("period_end"))
    return u.select(
        "org_code", "location_code", "item_number", "uom_code", "event_type", "quantity", "unit_cost",
        F.lit(None).cast("double").alias("total_cost"), ts.cast("timestamp_ntz").alias("event_ts"), F.lit(True).alias("is_aggregate"),
        "source_file", "line_no",
    )


def load_min_max(lines: DataFrame) -> DataFrame:
    """Rows of min/max levels; ``latest_min_max`` keeps the last of each (org, location, item)."""
    r = csv_with_preamble(lines, MIN_MAX_COLUMNS)
    b = r.select(
        org_code(F.col("ORGANIZATION_CODE")).alias("org_code"),
        F.col("DESTINATION").alias("location_code"),
        F.col("ITEM_NUMBER").alias("item_number"),
        F.col("MINMAX_QUANTITY_UOM").alias("uom_code"),
        parse_number("MIN_MINMAX_QUANTITY").alias("min_qty"),
        parse_number("MAX_MINMAX_QUANTITY").alias("max_qty"),
        F.col("INVENTORY_PLANNING_CODE").alias("planning_code"),
        F.col("SOURCE_SUBINVENTORY").alias("source_subinventory"),
        parse_datetime_multi("CREATION_DATE").alias("created_at"),
        parse_datetime_multi("LAST_UPDATE_DATE").alias("updated_at"),
        "source_file", "line_no",
    )
    return b


LEVEL_KEY = ["org_code", "location_code", "item_number"]


def has_item_and_location() -> Column:
    return F.col("location_code").isNotNull() & F.col("item_number").isNotNull()


def latest_min_max(rows: DataFrame) -> DataFrame:
    """The last row per (org, location, item) of the file order."""
    return _last_write_wins(rows.filter(has_item_and_location()), LEVEL_KEY, ["source_file", "line_no"])


def merge_min_max(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """I19 upsert into a stored table: incoming rows replace existing ones with the same ids, all columns of them."""
    key = ["org_id", "location_id", "item_id"]
    kept = existing.join(incoming.select(*key), key, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def load_consumption(lines: DataFrame) -> DataFrame:
    """Rows of consumption facts (appended)."""
    r = csv_with_preamble(lines, CONSUMPTION_COLUMNS)
    b = r.select(
        org_code(F.col("ORGANIZATION_CODE")).alias("org_code"),
        F.col("Location").alias("location_code"),
        F.col("ITEM_NUMBER").alias("item_number"),
        F.col("CATEGORY").alias("category_name"),
        F.col("ITEM_CLASS").alias("item_class"),
        F.col("PRIMARY_UOM_CODE").alias("uom_code"),
        parse_number("UNIT_COST").alias("unit_cost"),
        parse_number("QUANTITY").alias("quantity"),
        parse_number("COST").alias("total_cost"),
        F.col("ABCCLASS").alias("abc_class"),
        "source_file", "line_no",
    )
    return b


def load_expiry_waste(lines: DataFrame) -> DataFrame:
    """Expired / wasted / damaged quantities (appended)."""
    r = csv_with_preamble(lines, EXPIRY_COLUMNS)
    b = r.select(
        org_code(F.col("Source")).alias("org_code"),
        parse_datetime_multi("Txn Date").alias("event_ts"),
        F.col("Item").alias("item_number"),
        F.col("Location").alias("location_code"),
        parse_number("Quantity").alias("quantity"),
        F.col("UOM").alias("uom_code"),
        parse_number("Unit Cost").alias("unit_cost"),
        parse_number("Value").alias("total_cost"),
        F.col("Reason").alias("reason"),
        F.col("Category").alias("category_name"),
        F.col("Lot Number").alias("lot_number"),
        parse_date_multi("Lot Expiry Date").alias("lot_expiry"),
        "source_file", "line_no",
    )
    return b


def classify_waste(expiry: DataFrame) -> DataFrame:
    """WASTE when the reason mentions waste (any case), else EXPIRE; as movement events."""
    et = F.when(F.lower(F.coalesce("reason", F.lit(""))).contains("waste"), F.lit("WASTE")).otherwise(F.lit("EXPIRE"))
    return expiry.filter(has_item_and_location()).select(
        "org_code", "location_code", "item_number", "uom_code", et.alias("event_type"), "quantity", "unit_cost", "total_cost",
        "event_ts", F.lit(False).alias("is_aggregate"), "source_file", "line_no",
    )


def export_event_feed(feed: DataFrame, path: str) -> None:
    """The event feed as CSV (Type, Item ID, Location, Quantity as absolute value, Timestamp)."""
    out = feed.select(
        F.col("type").alias("Type"),
        F.col("item_id").alias("Item ID"),
        F.col("location").alias("Location"),
        F.abs("quantity").alias("Quantity"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
    )
    out.write.mode("overwrite").option("header", True).csv(path)
