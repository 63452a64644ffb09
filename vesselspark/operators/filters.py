"""Selections on positions and tracks. All are predicates that reach the scan; times are arguments, never the clock."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselspark import config
from vesselspark.functions.geo import haversine

KNOWN_PORTS = {name.lower(): (lat, lon) for name, _, lat, lon in config.PORTS}


def speed_anomalies(df: DataFrame, knots: float = 35.0) -> DataFrame:
    reason = F.format_string("Speed %.1f knots exceeds threshold %.1f", F.col("speed_knots"), F.lit(float(knots)))
    return df.where(F.col("speed_knots") > knots).withColumn("reason", reason)


def in_bounding_box(df: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> DataFrame:
    return df.where(F.col("latitude").between(lat_min, lat_max) & F.col("longitude").between(lon_min, lon_max))


def ship_trajectory(df: DataFrame, ship: str, key: str = "mmsi") -> DataFrame:
    return df.where(F.col(key) == ship).orderBy("ts", "event_id")


def active_tracks(df: DataFrame, confirmed: bool = False) -> DataFrame:
    return df.where(F.col("track_status") == "confirmed" if confirmed else F.col("track_status") != "dropped")


def active_dark_ships(df: DataFrame) -> DataFrame:
    return active_tracks(df).where("is_dark_ship")


def tracks_where(df: DataFrame, vessel_type: str | None = None, faster: float | None = None, slower: float | None = None) -> DataFrame:
    tests = [F.col("vessel_type") == vessel_type] if vessel_type else []
    tests += [F.col("speed_knots") > faster] if faster is not None else []
    tests += [F.col("speed_knots") < slower] if slower is not None else []
    for test in tests:
        df = df.where(test)
    return df


def heading_sector(df: DataFrame, name: str) -> DataFrame:
    """north (wraps), east, south or west: a quarter of the circle, its ends included."""
    course = F.col("course")
    low = {"east": 45, "south": 135, "west": 225}
    return df.where((course >= 315) | (course <= 45) if name == "north" else course.between(low[name], low[name] + 90))


def time_filter(df: DataFrame, spec: str | None, now: datetime, column: str = "updated_at") -> DataFrame:
    """``N hours``, ``N days``, ``today`` or ``yesterday`` before ``now``; anything else filters nothing."""
    when, midnight = F.col(column), now.replace(hour=0, minute=0, second=0, microsecond=0)
    counted = re.match(r"(\d+)?.*(hour|day)", spec or "")
    if spec == "today":
        return df.where(when >= F.lit(midnight))
    if spec == "yesterday":
        return df.where((when >= F.lit(midnight - timedelta(days=1))) & (when < F.lit(midnight)))
    if counted:
        return df.where(when >= F.lit(now - timedelta(**{counted[2] + "s": int(counted[1] or 1)})))
    return df


def dark_events_today(events: DataFrame, now: datetime, column: str = "event_timestamp") -> DataFrame:
    return time_filter(events, "today", now, column).orderBy(F.desc(column), "track_id")


def _type_matches(wanted: str) -> Column:
    """Either name contains the other; a vessel without a type passes."""
    own, wanted = F.replace(F.upper(F.coalesce("vessel_type", F.lit(""))), F.lit("_"), F.lit(" ")), wanted.upper().replace("_", " ")
    return (own == "") | own.contains(wanted) | F.lit(wanted).contains(own)


def near_known_port(name: str, km: float = 100.0) -> Column:
    """An unknown port, or a position that can't be measured, passes."""
    if name.lower() not in KNOWN_PORTS:
        return F.lit(True)
    return F.coalesce(haversine("latitude", "longitude", *KNOWN_PORTS[name.lower()]) <= km, F.lit(True))


def match_filters(df: DataFrame, filters: dict) -> DataFrame:
    """Rows that meet a filter dictionary: vessel_type, speed_gt, speed_lt, is_dark_ship, port; other keys are ignored."""
    speed = F.coalesce("speed_knots", F.lit(0.0))
    for key, value in filters.items():
        if key == "vessel_type":
            df = df.where(_type_matches(value))
        elif key == "speed_gt":
            df = df.where(speed > value)
        elif key == "speed_lt":
            df = df.where(speed < value)
        elif key == "is_dark_ship":
            df = df.where(F.coalesce("is_dark_ship", F.lit(False)) == bool(value))
        elif key == "port":
            df = df.where(near_known_port(value))
    return df


def cargo_overspeed(df: DataFrame, n: int = 100) -> DataFrame:
    """The newest rows of cargo types, 70 to 79, above 25 knots."""
    return df.where((F.col("speed_knots") > 25) & F.col("ship_type_code").between(70, 79)).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def track_by_id(df: DataFrame, track_id: str) -> DataFrame:
    return df.where(F.col("track_id") == track_id)


def recently_updated(df: DataFrame, now: datetime, seconds: float = 5.0) -> DataFrame:
    return active_tracks(df).where(F.col("updated_at") >= F.lit(now - timedelta(seconds=seconds)))


def vessel_history(df: DataFrame, mmsi: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """A vessel's positions from ``start`` up to ``end``, each optional and included."""
    df = df.where(F.col("mmsi") == mmsi)
    df = df.where(F.col("ts") >= F.lit(start)) if start else df
    return (df.where(F.col("ts") <= F.lit(end)) if end else df).orderBy("ts", "event_id")
