"""Column-level normalizers (pure Catalyst expressions, no Python on the row path).

These reproduce the value semantics of the source application's SQLite expressions in
Spark's ANSI mode: SQLite's text->integer cast takes the numeric prefix, its ROUND is
half away from zero, JS ``Math.round`` is half toward +infinity, Python ``round`` is
banker's rounding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def prefix_int(col: Column | str) -> Column:
    """SQLite ``CAST(text AS INTEGER)``: leading integer prefix, 0 if none, NULL stays NULL."""
    c = _c(col)
    digits = F.regexp_extract(c.cast("string"), r"^\s*([+-]?\d+)", 1)
    return F.when(c.isNull(), F.lit(None).cast("bigint")).otherwise(
        F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))
    )


def norm_location(col: Column | str) -> Column:
    """``CAST(REPLACE(UPPER(loc), 'LOC', '') AS INTEGER)``: 'LOC07' -> 7, 'WH-A' -> 0."""
    return prefix_int(F.replace(F.upper(_c(col)), F.lit("LOC"), F.lit("")))


def location_label(col: Column | str) -> Column:
    """``printf('LOC%02d', n)``."""
    return F.format_string("LOC%02d", _c(col))


def location_code(col: Column | str) -> Column:
    """``UPPER(TRIM(loc))``: the code form used by per-code reports."""
    return F.upper(F.trim(_c(col)))


def norm_event_type(col: Column | str) -> Column:
    """``UPPER(TRIM(COALESCE(event_type, '')))``."""
    return F.upper(F.trim(F.coalesce(_c(col), F.lit(""))))


def is_blank(col: Column | str) -> Column:
    """``TRIM(COALESCE(x, '')) = ''``."""
    return F.trim(F.coalesce(_c(col).cast("string"), F.lit(""))) == ""


def js_round(col: Column | str) -> Column:
    """JavaScript ``Math.round`` (half toward +infinity) as a bigint."""
    return F.floor(_c(col) + F.lit(0.5)).cast("bigint")


def parse_number(col: Column | str) -> Column:
    """Strip, drop thousands commas, blank/'null' -> NULL, unparsable -> NULL."""
    s = F.replace(F.trim(_c(col).cast("string")), F.lit(","), F.lit(""))
    s = F.when(F.lower(s).isin("", "null", "none", "nan"), F.lit(None)).otherwise(s)
    return s.try_cast("double")


def parse_date_multi(col: Column | str) -> Column:
    """Try day-first, then month-first, then ISO date, then ISO datetime with Z; else NULL.

    '03/04/2024' is 3 April (day-first wins); '12/31/2024' falls through to month-first.
    """
    s = F.trim(_c(col).cast("string"))
    # fixed formats tried in order (day/month/year, month/day/year, ISO date, ISO datetime)
    # an ISO datetime (with 'T' or ' ', optional zone) keeps the calendar day written in it,
    # whatever the session time zone
    iso_dt = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))
    # a text without a format's separator is not tried: each failed try is an exception inside of Spark
    slashed, dashed = F.contains(s, F.lit("/")), F.contains(s, F.lit("-"))
    return F.coalesce(
        F.when(slashed, F.try_to_date(s, "d/M/yyyy")),
        F.when(slashed, F.try_to_date(s, "M/d/yyyy")),
        F.when(dashed, F.try_to_date(s, "yyyy-MM-dd")),
        iso_dt,
    )


def parse_datetime_multi(col: Column | str) -> Column:
    """The formats of ``parse_date_multi`` as date-times: dates at midnight, ISO date-times with the wall clock that is
    written in them, whatever their zone or the session's."""
    s = F.trim(_c(col).cast("string"))
    bare = F.regexp_replace(s, r"(Z|[+-]\d{2}:?\d{2})$", "")
    timed = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), bare.try_cast("timestamp_ntz"))
    return F.coalesce(timed, parse_date_multi(col).cast("timestamp_ntz"))


def expiry_date(col: Column | str) -> Column:
    """``date(substr(TRIM(x), 1, 10))``: NULL for blank or unparsable text."""
    return F.try_to_date(F.substring(F.trim(_c(col).cast("string")), 1, 10), "yyyy-MM-dd")


def literal_rows(spark, rows: list[tuple], names: list[str]):
    """A small literal table built on the JVM (``inline`` of an array of structs).

    ``createDataFrame`` on Python lists goes through a Python RDD and starts Python
    workers when the plan runs; this keeps constant tables (dataset list, category
    list, report preambles) inside the JVM plan.
    """
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
