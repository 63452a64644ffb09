"""Safe casts of wire values: whatever can't be read is null or the default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vesselspark import config
from vesselspark.functions.geo import col


def safe_float(value, default: float | None = None) -> Column:
    return F.coalesce(col(value).cast("string").try_cast("double"), F.lit(default).cast("double"))


def nonzero_float(value) -> Column:
    """Zero stands for a missing value."""
    return F.nullif(safe_float(value), F.lit(0.0))


def safe_int(value, default: int | None = None) -> Column:
    """Whole and decimal text alike, cut towards zero."""
    return F.coalesce(col(value).cast("string").try_cast("double").cast("int"), F.lit(default).cast("int"))


def to_bool(value, default: bool = False) -> Column:
    text = F.lower(F.trim(col(value).cast("string")))
    return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(text.isin("true", "1", "yes"))


def iso_ts(value) -> Column:
    """An ISO time, with or without a zone; Z is UTC."""
    return F.try_to_timestamp(F.regexp_replace(col(value), "Z$", "+00:00"))


def text_or_null(value) -> Column:
    return F.nullif(F.trim(col(value)), F.lit(""))


def split_list(value) -> Column:
    """A comma list as its trimmed, non-empty items."""
    items = F.transform(F.split(F.coalesce(col(value), F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(items, lambda x: x != "")


def lookup(table: dict, key: Column, default: str) -> Column:
    """A small table of constants as an expression."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def vessel_class(value) -> Column:
    return lookup(config.VESSEL_CLASS, col(value), "vessel")
