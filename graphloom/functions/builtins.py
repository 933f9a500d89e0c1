"""Scalar functions of the query language, all over built-in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE, DATETIME = "yyyy-MM-dd", "yyyy-MMM-dd HH:mm:ss"


def label(binding: Column) -> Column:
    return binding.getField("label")


def has_label(binding: Column, name) -> Column:
    return binding.getField("label") == name


def has_property(value: Column) -> Column:
    return value.isNotNull()


def is_null(value: Column) -> Column:
    return value.isNull()


def pr_date(value: Column) -> Column:
    return F.date_format(value, DATE)


def pr_year(value: Column) -> Column:
    return F.year(value)


def pr_month(value: Column) -> Column:
    return F.month(value)


def to_int(value: Column) -> Column:
    return value.try_cast("int")


def int_to_datestring(seconds: Column) -> Column:
    """Seconds since 1970 as a date; UTC whatever the session's zone."""
    return F.date_format(F.dateadd(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), DATE)


def int_to_dtimestring(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), DATETIME)


def datestring_to_int(text: Column) -> Column:
    return F.unix_timestamp(F.to_timestamp(text, DATE))


def dtimestring_to_int(text: Column) -> Column:
    return F.unix_timestamp(F.to_timestamp(text, DATETIME))


def choose(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)


def first_of(*values: Column) -> Column:
    """The first value that is neither null nor an empty string."""
    return F.coalesce(*(F.when(v.cast("string") != "", v) for v in values))


BUILTINS = {
    "label": label, "get_label": label, "has_label": has_label, "has_property": has_property, "is_null": is_null, "pr_date": pr_date, "pr_year": pr_year, "year": pr_year, "pr_month": pr_month,
    "month": pr_month, "to_int": to_int, "int_to_datestring": int_to_datestring, "int_to_dtimestring": int_to_dtimestring, "datestring_to_int": datestring_to_int, "dtimestring_to_int": dtimestring_to_int,
    "choose": choose, "first_of": first_of,
}
