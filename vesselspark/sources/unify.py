"""Sensor records in the one shape of a detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselspark.functions.casts import nonzero_float, safe_int, to_bool

FIELDS = {
    "detection_id": "string", "sensor": "string", "sensor_id": "string", "ts": "timestamp", "latitude": "double", "longitude": "double", "mmsi": "string",
    "ship_name": "string", "vessel_type": "string", "speed_knots": "double", "course": "double", "confidence": "double", "vessel_length_m": "double",
    "object_class": "string", "is_dark_ship": "boolean", "quality": "int", "local_track_id": "string"}


def to_positions(decoded: DataFrame, received: Column | None = None) -> DataFrame:
    """Decoded AIS messages with a place, as AIS records. ``received`` is the time for messages, which carry none."""
    placed = decoded.where("latitude is not null and longitude is not null")
    time = received if received is not None else F.lit(None).cast("timestamp")
    return placed.select(time.alias("ts"), "mmsi", "latitude", "longitude", F.col("speed_over_ground").alias("speed_knots"), F.col("course_over_ground").alias("course"), F.col("true_heading").alias("heading"))


def to_contacts(updates: DataFrame, station_id: str = "RADAR") -> DataFrame:
    """Decoded track updates as radar records."""
    return updates.select("ts", "track_id", F.lit(station_id).alias("station_id"), "latitude", "longitude", "speed_knots", "course", "quality", "rcs_dbsm", "range_nm", "bearing")


def _shape(df: DataFrame, sensor: str, columns: dict[str, Column]) -> DataFrame:
    columns = {"sensor": F.lit(sensor)} | {c: F.col(c) for c in ("ts", "latitude", "longitude")} | columns
    return df.select(*(columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in FIELDS.items()))


def _default(df: DataFrame, name: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default)) if name in df.columns else F.lit(default)


def _have(df: DataFrame, names: dict[str, str], read=F.col) -> dict[str, Column]:
    return {to: read(name) for to, name in names.items() if name in df.columns}


def unify_ais(df: DataFrame) -> DataFrame:
    return _shape(df, "ais", {"sensor_id": F.lit("AIS"), **_have(df, {"mmsi": "mmsi", "ship_name": "ship_name", "vessel_type": "ship_type"}), **_have(df, {"speed_knots": "speed_knots", "course": "course"}, nonzero_float)})


def unify_radar(df: DataFrame) -> DataFrame:
    return _shape(df, "radar", {"sensor_id": _default(df, "station_id", "RADAR"), **_have(df, {"local_track_id": "track_id"}), **_have(df, {"speed_knots": "speed_knots", "course": "course"}, nonzero_float), "quality": safe_int("quality", 0)})


def unify_satellite(df: DataFrame) -> DataFrame:
    return _shape(df, "satellite", {"sensor_id": _default(df, "satellite", "SAT"), **_have(df, {"detection_id": "detection_id"}), **_have(df, {"vessel_length_m": "vessel_length_m", "confidence": "confidence"}, nonzero_float), "is_dark_ship": to_bool("is_dark_ship")})


def unify_drone(df: DataFrame) -> DataFrame:
    return _shape(df, "drone", {"sensor_id": _default(df, "drone_id", "DRONE"), **_have(df, {"detection_id": "detection_id", "object_class": "object_class", "local_track_id": "tracking_id"}), **_have(df, {"vessel_length_m": "estimated_length_m", "confidence": "confidence"}, nonzero_float)})


def unify(ais: DataFrame | None = None, radar: DataFrame | None = None, satellite: DataFrame | None = None, drone: DataFrame | None = None) -> DataFrame:
    """The union of the feeds given. Zero speeds, courses, lengths and confidences stand for missing ones."""
    parts = [f(df) for f, df in ((unify_ais, ais), (unify_radar, radar), (unify_satellite, satellite), (unify_drone, drone)) if df is not None]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
