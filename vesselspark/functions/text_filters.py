"""Rules that read filters and times from a question's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vesselspark.functions.geo import col

# The words looked for, the first hit counting, and times in order of the tests.
VESSEL_WORDS = ["tanker", "cargo", "container", "passenger", "fishing", "bulk"]
PORT_WORDS = ["mumbai", "chennai", "kochi", "singapore", "dubai", "colombo", "kandla"]
TIMES = [
    (("last hour", "past hour"), "1 hour"), (("last 2 hour",), "2 hours"), (("today",), "today"), (("yesterday",), "yesterday"),
    (("24 hour", "last day"), "24 hours"), (("this week", "last week"), "7 days"),
]


def _first(text: Column, words: list[str], shown) -> Column:
    return F.coalesce(*[F.when(text.contains(w), F.lit(shown(w))) for w in words])


def _any(text: Column, words) -> Column:
    test = text.contains(words[0])
    for word in words[1:]:
        test = test | text.contains(word)
    return test


def extract_filters(text) -> Column:
    """A struct of vessel_type, speed_gt, speed_lt, speed, port and is_dark_ship; null where the text says nothing."""
    low = F.lower(col(text))
    knots = F.nullif(F.regexp_extract(low, r"(\d+)\s*knots?", 1), F.lit("")).try_cast("int")
    over, under = _any(low, ("faster", "greater", ">")), _any(low, ("slower", "less", "<"))
    return F.struct(
        _first(low, VESSEL_WORDS, str.upper).alias("vessel_type"), F.when(over, knots).alias("speed_gt"), F.when(~over & under, knots).alias("speed_lt"),
        F.when(~over & ~under, knots).alias("speed"), _first(low, PORT_WORDS, str.capitalize).alias("port"), F.when(_any(low, ("dark ship", "dark_ship")), F.lit(True)).alias("is_dark_ship"))


def extract_time_range(text) -> Column:
    low = F.lower(col(text))
    return F.coalesce(*[F.when(_any(low, words), F.lit(value)) for words, value in TIMES])
